import pytest

from lexmill.llm import p01_scan_noise as p1

SCHEMA = "id long, mime_type string, extracted_text string"
BODY = "The court found that the lessee had paid the monthly rental in full. The board approved the transport contract after the hearing. "


@pytest.fixture(scope="module")
def rows():
    plain = [(i, "text/plain", f"Background\n\n{BODY * 3}\n\nOrder\n\n{BODY}") for i in range(1, 31)]
    scanned = []
    for i in range(101, 131):
        head = f"HH {i}/19"
        the, found = ("thc", "f0und") if i == 101 else ("the", "found")
        text = f"Background\n\nThe court found that the lessee had paid the mon-\nthly rental in full. The board approved the trans-\n\n{head}\n- 1 -\n\nport contract after {the} hearing. The court {found} that the lessee had paid.\n\n{head}\n- 2 -\n"
        scanned.append((i, "application/pdf", text))
    return plain + scanned


def test_kinds_and_repair(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in p1.found(df).filter("document_id = 101").collect()}
    assert got == {(101, 3, "hyphen_break"), (101, 4, "hyphen_break"), (101, 6, "running_header"), (101, 7, "page_number"), (101, 9, "misread_characters"), (101, 11, "running_header"), (101, 12, "page_number")}
    text = {r.document_id: r.repaired_text for r in p1.repaired(df).collect()}
    assert text[101] == "Background\n\nThe court found that the lessee had paid the monthly rental in full. The board approved the transport contract after the hearing. The court found that the lessee had paid."
    assert text[1] == rows[0][2]  # a file that wasn't scanned stays


def test_compound_keeps_its_hyphen(spark, rows):
    many = [(200 + i, "text/plain", "She ordered a part-payment of rent. He made a part-payment of fees.") for i in range(20)]
    scan = [(300, "application/pdf", "She ordered a part-\npayment of rent.")]
    df = spark.createDataFrame(rows + many + scan, SCHEMA)
    assert p1.found(df).filter("document_id = 300").count() == 0
    assert p1.repaired(df).filter("document_id = 300").first().repaired_text == "She ordered a part-payment of rent."


def test_page_numbers():
    for line in ("3", "- 4 -", "[2]", "Page 3 of 17", "Paqe 31", "pg. 9", "P a g e | 1", "─── PAGE 1 ───", "— 12 —", "2/9", "iv"):
        assert p1.is_page_number(line), line
    for line in ("309,993.", "2006.", "Order", "within 32 days", ""):
        assert not p1.is_page_number(line), line


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert p1.found(empty).count() == 0 and p1.repaired(empty).count() == 0
    df = spark.createDataFrame([(1, "application/pdf", None), (2, None, ""), (3, "application/pdf", "x" * 200_000), (None, "application/pdf", "a"), (4, "application/pdf", "-\n-"), (4, "application/pdf", "-\n-")], SCHEMA)
    assert p1.found(df.withColumn("document_id", df.id)).count() >= 0
    assert {r.document_id: r.repaired_text for r in p1.repaired(df).filter("document_id < 3").collect()} == {1: None, 2: ""}
