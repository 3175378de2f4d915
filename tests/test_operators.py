import datetime as dt
import random

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import clauses, evidence, keywords, learned, payload, relational, report, rouge, search


def docs(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "id long, text string")
    return df.withColumn("sentences", T.sentences(F.col("text"))).withColumn("tokens", T.tokens(F.col("text")))


LEASE = "The lease agreement binds the tenant and the landlord. The tenant shall pay the monthly rental notice on time. The landlord must repair the roof before the winter comes. The lease agreement ends after one year of notice."


def test_keywords(spark):
    got = keywords.tfidf(docs(spark, LEASE, ""), "id", "sentences", "tokens").collect()
    assert {r.id for r in got} == {1} and len(got) <= 20 and "lease agreement" in {r.term for r in got}
    assert [r.score for r in sorted(got, key=lambda r: r["rank"])] == sorted((r.score for r in got), reverse=True)


def test_extract_is_in_order_and_without_repeats(spark):
    twice = LEASE + " The lease agreement binds the tenant and the landlord now."
    d = docs(spark, twice)
    s = keywords.extract(keywords.sentence_scores(d, "id", "sentences", keywords.tfidf(d, "id", "sentences", "tokens")), "id", 3).first().summary
    parts = [x for x in d.first().sentences if x in s]
    assert len(parts) == 3 and s == " ".join(parts) and s.count("binds the tenant") == 1


def test_results_do_not_depend_on_partitions(spark):
    d = docs(spark, *(LEASE.replace("roof", f"roof {i}") for i in range(12)))
    run = lambda n: sorted(map(tuple, keywords.tfidf(d.repartition(n), "id", "sentences", "tokens").collect()))
    assert run(1) == run(7)


def test_headed_clauses(spark):
    text = "Preamble\n1. Termination\nEither party may end it.\nOn notice.\nPage 2 of 3\nCONFIDENTIALITY OF TERMS\nNothing is told.\n2. Empty"
    got = [(r.heading, r.content, r.clause_type) for r in clauses.headed(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "id", "text").orderBy("seq").collect()]
    assert got == [("1. Termination", "Either party may end it. On notice.", "TERMINATION"), ("CONFIDENTIALITY OF TERMS", "Nothing is told.", "CONFIDENTIALITY")]


def test_merged_clauses_are_capped(spark):
    text = "\n".join(f"Section {i} of rent\nThe tenant shall pay rent number {i} in full on the first day." for i in range(1, 15))
    d = docs(spark, text).withColumn("doc_type", F.lit("Lease Agreement"))
    got = clauses.merged(d, "id", "text", "sentences", "doc_type").collect()
    assert len(got) == 8 and len({(r.heading, r.content) for r in got}) == 8


def test_evidence(spark):
    d = spark.createDataFrame([(1, "--- PAGE 1 ---\nThe fee was agreed by the parties long ago.\n--- PAGE 2 ---\nThe appeal was dismissed with costs by the court. Pay within 30 days of this order.")], "id long, text string")
    s = evidence.sentences(d, "id", "text")
    assert [(r.page, r.sentence) for r in evidence.deadlines(s, "id").collect()] == [(2, "Pay within 30 days of this order.")]
    n = spark.createDataFrame([(1, 1, "the appeal was dismissed"), (1, 2, "unrelated zebra")], "id long, item long, needle string")
    assert [(r.item, r.page) for r in evidence.best_match(n, s, "id", ("dismissed",)).collect()] == [(1, 2)]
    assert {r.item: r.page for r in evidence.best_match(n, s, "id", keep_unmatched=True).collect()} == {1: 2, 2: None}


def test_passages(spark):
    text = "\n\n".join(["The accused was charged and convicted on the evidence of one witness at the time of the incident.", "The appeal was dismissed with costs and the agreement stands as it was made by the court below it.", "x" * 90])
    d = spark.createDataFrame([(1, text)], "id long, text string").withColumn("terms", F.array(F.lit("appeal")))
    p = evidence.passages(d, "id", "text", "terms")
    assert {r.passage_id: r.kind for r in p.collect()} == {"P1-1": "facts", "P1-2": "outcome"}
    assert [r.passage_id for r in evidence.balanced(p, "id").orderBy("rank").collect()] == ["P1-1", "P1-2"]


def test_rouge(spark):
    rng = random.Random(1)
    words = lambda n: [rng.choice("abcdef") for _ in range(n)]

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(40):
        a, b = words(rng.randint(0, 30)), words(rng.randint(0, 20))
        assert rouge.lcs_length(a, b) == plain(a, b)
    df = spark.createDataFrame([(1, "a b c a", "a a a"), (2, "x", ""), (3, "the same text", "the same text")], "id long, r string, c string")
    assert {r.id: round(r.rouge_1, 2) for r in rouge.precision(df, "id", "r", "c", 1).collect()} == {1: 66.67, 2: 0.0, 3: 100.0}
    assert {r.id: r.rouge_l for r in rouge.subsequence(df, "id", "r", "c").collect()}[3] == 100.0


def test_search(spark):
    df = spark.createDataFrame([(1, "unfair dismissal of an employee by the employer"), (2, "boundary of land between neighbours"), (3, None)], "id long, t string")
    got = search.rank(df, "unfair dismissal", "id", "t", ["t"]).collect()
    assert got[0].id == 1 and [r.search_score for r in got] == sorted((r.search_score for r in got), reverse=True)
    assert search.rank(df, "  ", "id", "t", ["t"]) is df
    hay = F.lit("the unfair dismissal case")
    assert abs(spark.range(1).select(search.affinity("a unfair dismissal", hay).alias("v")).first().v - 2 / 3) < 1e-9
    v = spark.range(1).select(search.vector(F.array(F.lit("labour dispute"))).alias("v")).first().v
    assert v == {17: 1.0} == search.query_vector("") | {17: 1.0}


def test_dense_top_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    got = {(r.query_id, r["rank"]): r.neighbour_id for r in search.dense_top(spark.createDataFrame(rows + [(999, None)], "vec_id long, embedding array<double>")).collect()}
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 200, 50):
        sim = np.round(m @ m[q], 6)
        sim[q] = -2
        assert [got[q, k] for k in range(1, 6)] == list(np.lexsort((np.arange(200), -sim))[:5])


def test_relational(spark):
    s = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,), (None,), ("",)], "x string")
    assert [tuple(r) for r in relational.top_counts(s, "x", 2).collect()] == [("a", 2), ("b", 1)]
    d = spark.createDataFrame([("done",), ("odd",), (None,)], "status string")
    assert tuple(relational.status_totals(d).first()) == (1, 0, 0, 0)
    t0 = dt.datetime(2024, 1, 1)
    u = spark.createDataFrame([(1, 1, 10, t0), (1, 1, 11, t0), (1, 2, 12, None)], "document_id long, user_id long, id long, created_at timestamp_ntz")
    assert {r.id for r in relational.upsert(u, ["document_id", "user_id"], ["created_at", "id"]).collect()} == {11, 12}
    ev = spark.createDataFrame([(1, "processing", 140, t0), (1, "done", -5, t0 + dt.timedelta(1))], "document_id long, status string, progress int, updated_at timestamp_ntz")
    got = {r.document_id: (r.status, r.progress) for r in relational.progress(spark.createDataFrame([(1,), (2,)], "id long"), ev).collect()}
    assert got == {1: ("done", 0), 2: ("pending", 0)}
    assert relational.onto(u, ["id", "zzz"]).columns == ["id"]
    e = spark.range(1).select(relational.entities_involved(F.array(F.lit("Ann  Lee"), F.lit("")), F.lit(None).cast("array<string>"), F.array(F.lit("ANN LEE"), F.lit("Bo"))).alias("e")).first().e
    assert e == ["Ann Lee", "Bo"]
    n = spark.createDataFrame([(1, ["Breach of contract"]), (2, ["Land"]), (3, None)], "id long, i array<string>")
    assert [r.id for r in relational.with_issue(n, "i", "CONTRACT").collect()] == [1]


def test_throttle(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=i), "error") for i in range(5)] + [(1, t0 + dt.timedelta(hours=3), "error")]
    got = relational.throttle(spark.createDataFrame(rows, "u long, t timestamp_ntz, k string"), "u", "t", F.col("k") == "error").orderBy("t").collect()
    assert [r.locked for r in got] == [False] * 4 + [True, False]


def test_learned(spark):
    df = spark.createDataFrame([(1, 2, "rental notice period applies", "the rental notice"), (1, 2, "rental notice period applies", "the rental notice"), (3, 4, " ", "x"), (None, None, "roof repair works today", None)], "document_id long, summary_id long, input_text string, target_summary string")
    ex = learned.distinct_examples(df)
    assert ex.count() == 1
    m = learned.model(ex)
    assert {(r.term, r.weight, r.examples_seen) for r in m.collect()} == {("rental notice period", 1.4, 1), ("applies", 1.0, 1), ("rental notice", 1.4, 1)}
    b = learned.boosts(spark.createDataFrame([(1, "A Rental notice here"), (2, None)], "id long, t string"), "id", "t", m)
    assert [tuple(r) for r in b.collect()] == [(1, "rental notice", 1.4)]


def test_payload(spark):
    raw = '```json\n{"document_type": " Lease ", "court": "N/A", "parties": ["A", " A ", "", "B"], "outcome": "won"}\n```'
    df = spark.createDataFrame([(1, raw), (2, "noise " + raw[8:-4] + " tail"), (3, "not json"), (4, None)], "id long, raw string")
    got = {r.id: r.p for r in df.select("id", payload.normalised(payload.parsed(F.col("raw"))).alias("p")).collect()}
    assert got[1].document_type == "Lease" and got[1].court is None and got[1].parties == ["A", "B"] and got[2].outcome == "won" and got[3] is None and got[4] is None
    p = spark.range(1).select(payload.best_parties(F.array(F.lit("Court of Appeal"), F.lit("Ann")), F.array(F.lit("Bo"), F.lit("Cy"))).alias("p")).first().p
    assert p == ["Bo", "Cy"]


def test_report(spark):
    df = spark.createDataFrame([(1, "The applicant shall act bona fide, inter alia."), (2, None)], "id long, t string")
    assert [r.p for r in df.select(report.plain_language(F.col("t")).alias("p")).collect()] == ["The person bringing the case must act genuine, among other things.", None]
    lines = report.wrap_lines("word " * 60 + "x" * 300, 46.0)
    assert "".join(lines).replace(" ", "") == "word" * 60 + "x" * 300 and len(lines) > 5
    assert spark.range(1).select(report.longest(F.lit("a"), F.lit("b c"), F.lit("d e")).alias("v")).first().v == "b c"
    assert spark.range(1).select(report.highlighted(F.lit("Res judicata applies"), ["judicata", "res judicata"]).alias("v")).first().v == "<mark>Res judicata</mark> applies"
