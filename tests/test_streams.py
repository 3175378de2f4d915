import datetime as dt


from lexmill.streaming import streams


def run(df, name, mode, sink=None):
    w = df.writeStream.trigger(availableNow=True).outputMode(mode)
    q = (w.foreachBatch(sink) if sink else w.format("memory").queryName(name)).start()
    q.awaitTermination()


def stream(spark, tmp_path, rows, schema, parts=1):
    path = str(tmp_path / "in")
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_count_every_event(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i % 3, i), "view", 1.0) for i in range(20)]
    run(streams.windowed(stream(spark, tmp_path, rows, "ts timestamp_ntz, event_type string, value double")), "w", "complete")
    assert spark.sql("select sum(n) from w").first()[0] == 20 and spark.sql("select count(*) from w").first()[0] == 3


def test_sessions(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 0, m)) for m in (0, 10, 59)]
    run(streams.sessions(stream(spark, tmp_path, rows, "user_id long, ts timestamp_ntz")), "se", "complete")
    assert sorted(r.n for r in spark.sql("select n from se").collect()) == [1, 2]


def test_latest_progress(spark, tmp_path):
    rows = [(1, "done", 140, dt.datetime(2024, 1, 3)), (1, "processing", 5, dt.datetime(2024, 1, 1)), (2, "pending", -4, dt.datetime(2024, 1, 1)), (2, "processing", 50, dt.datetime(2024, 1, 2))]
    out = str(tmp_path / "out")
    run(stream(spark, tmp_path, rows, "document_id long, status string, progress int, updated_at timestamp_ntz", 2), "", "append", streams.latest_progress(out))
    got = {r.document_id: (r.status, r.progress) for r in spark.read.parquet(f"{out}/batch=1").collect()}
    assert got == {1: ("done", 100), 2: ("processing", 50)}


def test_throttle_clears_on_success(spark, tmp_path):
    rows = [(1, i, True) for i in range(5)] + [(2, 0, True), (2, 1, True), (2, 2, True), (2, 3, True), (2, 4, False), (2, 5, True)] + [(3, i * 3000, True) for i in range(5)]
    base = 1_700_000_000
    rows = [(u, base + at, failed) for u, at, failed in rows]
    run(streams.throttled(stream(spark, tmp_path, rows, "user_id long, at long, failed boolean")), "th", "append")
    assert [tuple(r) for r in spark.sql("select * from th").collect()] == [(1, base + 4)]


def test_learning_is_cut_after_every_example(spark, tmp_path):
    term = "array<struct<term:string,weight:double>>"
    rows = [("m", "a", [("x", 3.0), ("y", 2.0), ("z", 1.0)]), ("m", "b", [("z", 1.5)]), ("m", "b", [("z", 1.5)])]
    run(streams.learn(stream(spark, tmp_path, rows, f"model string, id string, terms {term}"), cap=2), "le", "update")
    got = {r.term: r.weight for r in spark.sql("select * from le where examples_seen = 2").collect()}
    assert got == {"x": 3.0, "y": 2.0}  # z was cut before its second weight came
