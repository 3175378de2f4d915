"""Registered queries over small tables of our own."""

import pytest

from lexmill.functions import lexicons as L
from lexmill.plans import reports

LEASE = "LEASE AGREEMENT\n\nThis lease agreement is made between the landlord and the tenant of the premises. The tenant lives in the house and the landlord keeps the roof in good repair for the whole of the lease."
BILL = "ENVIRONMENT AMENDMENT BILL\n\nA Bill to amend the Environment Act. Be it enacted by the Parliament and the President. The memorandum of the Bill tells its objects. The application is dismissed with costs by the old law."
NOTE = "A plain note about the weather in the north, which tells nothing else of interest to anyone who reads it."


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    rows = [(1, "lease.pdf", LEASE), (2, "environment_bill.pdf", BILL), (3, "note.pdf", NOTE + " A wandering heron is seen.")]
    spark.createDataFrame(rows, "id long, original_name string, extracted_text string").write.parquet(str(d / "legal_documents.parquet"))
    records = [(1, 1, "Other", "Nothing.", "Nothing."), (2, 3, "Other", "Nothing.", "Nothing."), (3, 99, None, None, "An agreement.")]
    spark.createDataFrame(records, "id long, document_id long, document_type string, professional_summary string, citizen_summary string").write.parquet(str(d / "summaries.parquet"))
    examples = [(i, 1, i, "The wandering heron wintered.", "The wandering heron.") for i in range(1, 4)]
    spark.createDataFrame(examples, "dataset_id long, document_id long, summary_id long, input_text string, target_summary string").write.parquet(str(d / "legal_summary_dataset.parquet"))
    return str(d)


def run(spark, d, name):
    return reports.QUERIES[name](spark, d).collect()


def test_risk_panel_knows_the_type(spark, small):
    assert {r.id: r.urgency for r in run(spark, small, "risk_panel")} == {1: "medium", 2: "low", 3: "low"}


def test_outcome_of_a_bill_is_its_type_s(spark, small):
    assert {r.id: (r.doc_type, r.outcome) for r in run(spark, small, "typed_outcomes")}[2] == ("Bill", L.OUTCOME_BILL)


def test_passages_are_found_by_their_own_document_s_terms(spark, tmp_path):
    text = "MINING NOTES\n\nThe zirconium furnace stood beside the zirconium kiln, and each zirconium furnace was lit by hand at dawn.\n\nAnother paragraph tells of the village and of its many children who went down to the river."
    spark.createDataFrame([(1, "notes.pdf", text), (2, "n.pdf", None)], "id long, original_name string, extracted_text string").write.parquet(str(tmp_path / "legal_documents.parquet"))
    spark.createDataFrame([], "dataset_id long, document_id long, summary_id long, input_text string, target_summary string, summary_type string, created_at timestamp").write.parquet(str(tmp_path / "legal_summary_dataset.parquet"))
    got = run(spark, str(tmp_path), "passage_scores")
    first = [r for r in got if r.passage_id == "P1-1"]
    assert first and first[0].score >= 1.4 and {r.id for r in got} == {1}


def test_keywords_take_learned_and_opening_boosts(spark, small):
    got = {(r.id, r.term): r.score for r in run(spark, small, "boosted_keywords")}
    plain = {(r.id, r.term): r.score for r in run(spark, small, "tfidf_topk")}
    assert got[2, "environment amendment bill"] >= 39 and not any(s >= 39 for (i, _), s in plain.items() if i == 2)
    assert max(s for (i, _), s in got.items() if i == 1) < 18
    # each of the examples teaches the run once, at 1.4
    assert got[3, "wandering heron"] == pytest.approx(1.4)


def test_issues_take_keywords_and_type(spark):
    from pyspark.sql import functions as F

    from lexmill.functions import classify as C

    x = spark.createDataFrame([("zzz", ["mineral rights"], ["zero"]), ("zzz", ["a", "water-rail nest", "contract law", "repealed thing", "heron pond", "reed warbler", "great bittern"], ["zero"])], "t string, k array<string>, c array<string>")
    got = x.select(C.issues(F.col("t"), F.col("c"), F.col("k")).alias("a"), C.legislative_issues(F.col("t"), F.col("k")).alias("b")).collect()
    assert got[0].a == ["Constitutional rights"] and got[1].a == []
    assert got[1].b == ["Amendment or repeal effect", "Water-Rail Nest", "Repealed Thing", "Heron Pond"]


def test_learned_categories(spark):
    from lexmill.operators import learned

    ex = spark.createDataFrame([("1", "heron, heron, heron", ["Mining Law"]), ("2", "bittern", ["Family Law"])], "id string, text string, labels array<string>")
    docs = spark.createDataFrame([(1, "A Heron."), (2, "A bittern.")], "id long, text string")
    assert [(r.id, r.category, r.score) for r in learned.categories(docs, "id", "text", learned.category_model(ex)).collect()] == [(1, "Mining Law", 2.0)]  # the third runs on into the name


def test_analysis_has_keyword_issues(spark, small):
    got = {r.id: r.issues.split("|") for r in run(spark, small, "document_analysis")}
    assert len(got[2]) >= 4 and {r.id for r in run(spark, small, "typed_issues")} == {i for i, x in got.items() if x != [""]}


def test_search_reads_the_whole_record(spark, small):
    got = {r.id: (r.affinity, r.search_score) for r in run(spark, small, "semantic_search")}
    # the words stand in no field of the first record's own, but in its document's issues and profile
    assert got[1][0] > 0 and got[1][1] > got.get(2, (0, 0))[1] and 3 in got


def test_token_similarity(spark):
    from pyspark.sql import functions as F

    from lexmill.operators import rouge

    x = spark.createDataFrame([("The heron, the reed", "A heron in the mud"), ("", "heron"), (None, None)], "a string, b string")
    assert [r.s for r in x.select(rouge.similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [0.5, 0.0, 0.0]
