"""What a document means for its reader, over rows of our own."""

import re

from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.operators import clauses, evidence, insight, prose

def none():
    return F.array().cast("array<string>")


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_plain_rewrite(spark):
    said = '"3. According to the clerk, the applicant shall pay pursuant to section 12 of the Roads Act;'
    assert one(spark, prose.plain_rewrite(F.lit('According to the clerk, the applicant shall pay pursuant to section 12 of the Roads Act;')))[0] == "The party bringing the case must pay under the relevant legal rule."
    assert one(spark, prose.summary_sentence(F.lit(said.removeprefix('"'))))[0] == "According to the clerk, the applicant shall pay pursuant to section 12 of the Roads Act."
    assert one(spark, prose.plain_rewrite(F.lit(None).cast("string")), prose.plain_rewrite(F.lit(" ")))[:] == ("", "")


def test_prose(spark):
    text = "Facts: the roof was broken by rain .The roof was broken by rain. Costs. PAGE 3 the landlord must mend the roof of the house.."
    assert one(spark, prose.polish(F.lit(text), 300))[0] == "The roof was broken by rain. The landlord must mend the roof of the house."
    assert one(spark, prose.polish(F.lit(text), 10), prose.polish(F.lit("Only this"), 10), prose.polish(F.lit(None).cast("string"), 10))[:] == ("The roof was broken by rain.", "Only this.", "")
    assert one(spark, prose.polish_list(F.array(F.lit("pay is due"), F.lit("Pay is due."), F.lit("n/a"))))[0] == ["Pay is due."]
    found = F.array(*(F.lit(x) for x in ("1. The roof leaked.", "The roof leaked!", "Rain fell on the town", "", "The clerk slept", "Nobody came")))
    assert one(spark, prose.condense(found), prose.condense(found, 3, 30))[:] == ("The roof leaked. Rain fell on the town. The clerk slept.", "The roof leaked. Rain fell on…")


def test_missing_and_actions(spark):
    null = F.lit(None).cast("string")
    got = one(spark, insight.missing_information(F.lit("Court Judgment"), null, null, F.lit(""), none(), F.lit(L.OUTCOME_UNKNOWN), none()).alias("a"), insight.missing_information(null, null, F.lit("1 May"), null, none(), null, F.array(F.lit("x"))).alias("b"))
    assert got.a == list(L.MISSING.values()) and got.b == []
    pages = F.array(F.lit(2), F.lit(2), F.lit(3))
    got = one(spark, insight.actions(F.lit("Lease Agreement"), null, pages).alias("a"), insight.actions(null, null, F.lit(None).cast("array<int>")).alias("b"))
    assert got.a == [L.ACTIONS["deadline"] % 2, L.ACTIONS["deadline"] % 3, L.ACTIONS["contract"]] and got.b == [L.ACTIONS["none"]]


def test_cards(spark):
    text = F.lit("The appeal was dismissed.\nHe was sentenced to five years. She was awarded USD 1,200.50 in damages of USD 50.")
    cards = lambda kind: [(c.title, c["items"]) for c in one(spark, insight.result_cards(text, F.lit(kind), F.lit(""), none(), none(), F.array(F.lit("Pay.")), F.array(F.lit("Section 1"))))[0]]
    assert cards("Court Judgment") == [("Case Result", ["Appeal dismissed", "Sentence imposed"]), ("Compensation Awarded", ["damages of USD 50.", "awarded USD 1,200.50."]), ("Sentence Imposed", ["sentenced to five years."])]
    assert cards("Act") == [("Operative Provisions", ["Pay."]), ("Legal References", ["Section 1"])]
    assert one(spark, insight.case_results(F.lit(""), F.lit("Nothing was said ;")))[0] == ["Nothing was said."]


def test_references_and_sources(spark):
    got = one(spark, insight.references_panel(F.array(F.lit("Section 5")), F.lit("Under Section 9 and Chapter 2:03 it stands"), F.array(F.lit("contract law"), F.lit("heron"))).alias("r"), insight.source_map(F.array(*(F.lit(f"P1-{i}") for i in range(1, 5))), F.lit(False), F.lit(True)).alias("m"))
    assert got.r == ["Section 5", "Section 9.", "Chapter 2:03.", "contract law"]
    m = {x.section: x.passage_ids for x in got.m}
    assert m["professional_summary"] == ["P1-1", "P1-2", "P1-3"] and m["cited_instruments"] == [] and m["constitutional_rights_affected"] == ["P1-1", "P1-2"]


def test_checks_of_summaries(spark):
    bad = F.lit("The court found that the applicant spoke of a heron.")
    got = one(spark, insight.summary_issues(bad), insight.jargon_count(F.lit("Pursuant to it, the Applicant and the applicant sought relief.")), insight.doctrine_only(F.lit("It clarifies and outlines the burden of proof."), F.array(F.lit("HC 12/20"))), insight.doctrine_only(F.lit("It clarifies and outlines the burden of proof in HC 12/20."), F.array(F.lit("HC 12/20"))))
    assert got[0] == ["uses court-case framing", "uses dispute-party language", L.SUMMARY_NO_EFFECT] and got[1:] == (3, True, False)
    got = one(spark, insight.useful_outcome(F.lit("The appeal is dismissed.")), insight.useful_outcome(F.lit("With costs.")), insight.meaningful(F.lit("The court held that it was late.")), insight.meaningful(F.lit("n/a")), insight.heading_kind(F.lit("Duties of the officer")), insight.heading_kind(F.lit(None).cast("string")))
    assert got[:] == (True, False, True, False, "DUTY_OR_POWER", "GENERAL_CLAUSE")


def test_entity_evidence_matches_brute_force(spark):
    lines = ["Herons stood by the river in the rain.", "The clerk Ruva Moyo read the order aloud.", "Later Moyo and Ruva left the court together."]
    sents = spark.createDataFrame([(1, i, 1 + i, s) for i, s in enumerate(lines)], "id long, no long, page int, sentence string")
    values = [(1, "persons", "ruva moyo"), (1, "persons", "Ruva Moyo"), (1, "persons", "Moyo Ruva left early"), (1, "places", "Nowhere"), (1, "places", " "), (2, "persons", "Ruva")]
    got = {(r.id, r.kind, r.value.lower()): r.page for r in insight.entity_evidence(spark.createDataFrame(values, "id long, kind string, value string"), sents, "id").collect()}
    words = lambda s: set(re.findall(r"[a-z]{4,}", s.lower()))
    want = {}
    for d, k, v in values:
        if v.strip():
            own = [(i, s) for i, s in enumerate(lines) if d == 1]
            held = [i for i, s in own if v.lower() in s.lower()]
            share = [(len(words(v) & words(s)), -i) for i, s in own]
            want[d, k, v.lower()] = held[0] + 1 if held else 1 - max(share)[1] if share and max(share)[0] else None
    assert got == want
    assert evidence.best_match(spark.createDataFrame([], "id long, item string, needle string"), sents, "id").count() == 0


def test_entity_quotes_reads_the_documents_once_for_each_side(spark, sf_dir):
    from lexmill.plans import insights

    got = insights.entity_quotes(spark, sf_dir)
    assert "legal_documents" not in got._jdf.queryExecution().optimizedPlan().toString() and not any("legal_documents" in f for f in got.inputFiles())
    assert got.count() == got.select("id", "kind", "value").distinct().count() > 1000


def test_entity_evidence_of_a_repeated_key(spark):
    sents = spark.createDataFrame([(1, 0, 1, "The clerk Ruva Moyo read it.")] * 2, "id long, no long, page int, sentence string")
    values = spark.createDataFrame([(1, "persons", "Ruva Moyo"), (1, "persons", "clerk Moy"), (1, "persons", "lerk")], "id long, kind string, value string")
    got = {r.value: r.quote for r in insight.entity_evidence(values, sents, "id").collect()}
    assert got == {"Ruva Moyo": "The clerk Ruva Moyo read it.", "clerk Moy": "The clerk Ruva Moyo read it.", "lerk": None}


def test_windows_by_type(spark):
    text = "Case No. HC 12/20 was heard. The minister may appoint an officer. Any person shall be liable to a penalty. Insert a new part."
    df = spark.createDataFrame([(1, text, "Act"), (2, text, "Bill"), (3, text, "Legal Document")], "id long, t string, k string")
    got = {}
    for r in clauses.by_pattern(df, "id", "t", "k").collect():
        got.setdefault(r.id, set()).add(r.clause_type)
    assert got == {1: {"CASE_NUMBER", "PENALTY", "OFFICER_POWER"}, 2: {"CASE_NUMBER", "AMENDMENT"}, 3: {"CASE_NUMBER"}}


def test_documents_are_prepared_once(spark, sf_dir):
    """The plan of each query reads the documents' texts no more often than it has to; the prepared ones are a table."""
    from lexmill.plans.insights import R

    scans = lambda q: sum("Relation" in line and "extracted_text" in line for line in R.QUERIES[q](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert (scans("passage_scores"), scans("semantic_search"), scans("source_map")) == (1, 0, 2)


ODD = ["The contract of the notice party was a sub-contract. The mining lease agreement and the mining lease agreement stood by the court order. The don't-care clause''s lease ended.", "Ärzte prüfen den Vertrag-s und die contract lease court order. Der Vertrag ist die lease agreement registration court project.", "अधिनियम की धारा contract court order के अनुसार लिखित आवेदन। The labour\xa0court judgment notice stood", "İstanbul lease agreement ΟΔΟΣ court registration contract law. État contract́ lease notice party", ""]


def test_rights_bind_what_they_read(spark):
    from lexmill.functions import classify as C
    from lexmill.functions import extract as X

    x = spark.createDataFrame([("Under Section 56(1) of the Constitution and Chapter 2:03 it stands.", ["Constitutional rights"])], "t string, i array<string>")
    df = x.select(C.rights(X.references(F.col("t")), F.col("i")).alias("r"))
    # each of the references' patterns once, and not once for every right
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 3
    assert df.first().r


def test_search_sorts_what_is_made(spark, sf_dir):
    from lexmill.plans.insights import R

    assert "crc32" not in R.QUERIES["semantic_search"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_plain_ranking_equals_the_columns(spark):
    from lexmill.functions import text as T
    from lexmill.operators import keywords, learned

    x = spark.createDataFrame(list(enumerate(ODD)), "id int, text string").withColumn("sentences", T.sentences(F.col("text"))).withColumn("tokens", T.tokens(F.col("text"))).cache()
    model = spark.createDataFrame([("lease agreement", 3.0, 2), ("mining", 1.0, 8), ("rtrag", 9.0, 2)], "term string, weight double, examples_seen long")
    taught = [("lease agreement", 1.5), ("mining", 0.25), ("rtrag", 4.0)]
    want = keywords.tfidf(x, "id", "sentences", "tokens", boosts=(learned.boosts(x, "id", "text", model), keywords.opening_boosts(x.filter("id < 3"), "id", "text")))
    want = {(r.id, r["rank"]): (r.term, r.score) for r in want.collect()}
    of = keywords.ranked(taught)
    got = {(r.id, i + 1): z for r in x.collect() for i, z in enumerate(of(r.text, r.text.lower(), r.sentences, r.id < 3))}
    assert got == want and len(want) > 20


def test_plain_models_equal_the_columns(spark):
    from lexmill.functions import classify as C
    from lexmill.operators import learned

    ex = spark.createDataFrame([(str(i), t, f"tail {i} goes\xa0on") for i, t in enumerate([*ODD[:4], "mining lease", "one lease  \n", "lease now to"])], "id string, text string, target string").cache()
    boosts, areas = learned.models(ex.withColumn("cleaned", F.col("text")))
    labelled = ex.withColumn("labels", C.categories(F.col("text"))).cache()
    assert sorted(areas) == sorted((r.category, r.term, r.weight) for r in learned.category_model(labelled).collect()) and len(areas) > 10
    assert boosts == [(r.term, max(0.25, min(4.0, r.weight / r.examples_seen))) for r in learned.model(ex).orderBy("term").collect()]
    docs = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    of = learned.best_categories(areas)
    want = {}
    for r in learned.categories(docs, "id", "text", learned.category_model(labelled)).orderBy("id", "rank").collect():
        want.setdefault(r.id, []).append(r.category)
    assert {i: of(t.lower()) for i, t in enumerate(ODD) if of(t.lower())} == want


def test_gates_and_first_characters_lose_no_match(spark):
    from lexmill.functions import rx

    assert rx.needed(r"\b(lease|rental) agree(?:ment)?\b") == (("lease", "rental"), (" agree",)) and rx.needed(r"x?\d+") == ()
    assert rx.rx(r"\b(?:lease|s\.)x").endswith(r"(?=[\x{6c}\x{73}])\b(?:lease|s\.)x") and rx.rx(r"\b[^a]x") == r"(?d)\b[^a]x"
    x = spark.createDataFrame([("mİnıſtry of Kings",)], "t string")
    assert x.select(rx.gate(rx.fold(F.col("t")), "ministry").alias("g"), rx.gate(rx.fold(F.col("t")), "king").alias("h"), rx.gate(F.col("t"), "heron").alias("n")).first() == (True, True, False)
