import zipfile

from lexmill.sources import glyphs, tables


def test_json_lines_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "x")
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "id string, v int")
    tables.append_json_lines(df, path)
    tables.append_json_lines(df.unionByName(spark.createDataFrame([("c", 3)], "id string, v int")), path)
    assert sorted(r.id for r in spark.read.json(path).collect()) == ["a", "b", "c"]


def test_csv(spark, tmp_path):
    row = {c: "x" for c in tables.CSV_COLUMNS} | {"summary_id": "2", "input_text": 'a "q"\nb, c'}
    tables.write_csv(spark.createDataFrame([row, row | {"summary_id": "1"}]), str(tmp_path / "c"), limit=1)
    got = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "c"), header=True).collect()
    assert [(r.summary_id, r.input_text) for r in got] == [("1", 'a "q"\nb, c')]


def test_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>Three</w:t></w:p>")
    (tmp_path / "b.txt").write_bytes("x\r\ny".encode())
    (tmp_path / "c.doc").write_bytes(b"\x00\x01" + "a readable run".encode("utf-16le") + b"\x00\xff\x02")
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in tables.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == "One & two\nThree" and got["b.txt"] == "x\ny" and "a readable run" in got["c.doc"] and got["d.docx"] is None


def test_glyphs(spark):
    rows = [(1, 1, s, float(x), float(y), float(w), 10.0) for s, x, y, w in (("Hel", 0, 100, 15), ("lo", 15, 100.5, 10), ("world", 30, 100, 20), (".", 55, 100, 2), ("next-", 0, 88, 20), ("line", 0, 76, 20), ("New", 0, 40, 10))]
    lines = glyphs.lines(spark.createDataFrame(rows + [(1, 1, None, 0.0, 0.0, 0.0, 0.0)], "doc_id long, page int, str string, x double, y double, width double, height double"))
    assert [r.line for r in lines.orderBy("line_no").collect()] == ["Hello world.", "next-", "line", "New"]
    assert glyphs.page_texts(lines).first().text == "─── PAGE 1 ───\nHello world. nextline\n\nNew"


def test_written_tables_are_removed_on_request(spark):
    from lexmill import session

    df = session.written(spark.range(3).toDF("id"), "kept")
    assert df.count() == 3 and session.clean(spark) >= 1 and session.clean(spark) == 0
