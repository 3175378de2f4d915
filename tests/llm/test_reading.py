from lexmill.llm import p07_reading as p7

BASIC = "You can pay the fee now. Ask for a slip. The owner has to fix it. Bring the key and come back. "
HARD = "Notwithstanding antecedent stipulations, jurisprudential inconsistency irretrievably undermined discretionary determinations contemplated by the enabling legislation and presupposed comprehensive reconsideration. "
MID = "The council approved the written notice after several weeks of delay and the tenant accepted the rental contract that the board had corrected. "


def frames(spark):
    rows = [(i, t * (1 + i % 3)) for k, t in enumerate((BASIC, MID, HARD)) for i in range(1 + k * 20, 21 + k * 20)]
    legal = spark.createDataFrame(rows, "id long, extracted_text string")
    summaries = spark.createDataFrame([(1, HARD), (2, None), (3, "short"), (4, "Le tribunal a jugé que le locataire doit payer dans un délai de dix jours.")], "id long, citizen_summary string")
    bands = ("basic", "general", "specialist")
    labels = [("legal_documents", i, "rater_a", bands[(i - 1) // 20]) for i, _ in rows if i % 2] + [("legal_documents", 1, "rater_b", "specialist"), ("legal_documents", 999, "rater_a", "basic"), ("legal_documents", 3, "rater_a", None)]
    return legal, summaries, spark.createDataFrame(labels, "source_table string, row_id long, annotator string, band string")


def test_held_out(spark):
    got = {tuple(r) for r in p7.found(*frames(spark)).collect()}
    assert got == {("legal_documents", i) for i in range(41, 61)} | {("summaries", 1)}


def test_cover_rank_matches_brute_force(spark):
    legal, summaries, _ = frames(spark)
    t = p7.texts(legal, summaries)
    rank = {r.word: r["rank"] for r in p7.ranks(t, {}).collect()}
    row = p7.measures(t).filter("source_table = 'legal_documents' and row_id = 41").first()
    words = p7._WORD.findall((HARD * (1 + 41 % 3)).lower())
    least = next(r for r in range(1, len(rank) + 2) if sum(rank.get(w, len(rank) + 1) <= r for w in words) >= p7.COVER * len(words))
    assert row.coverage_rank == least


def test_accuracy_on_labels(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    labels = read("reading_labels")
    fit, held = labels.filter("row_id % 2 = 0"), labels.filter("row_id % 2 = 1")
    got = p7.levels(read("legal_documents"), read("summaries"), fit).join(held.withColumnRenamed("band", "said"), ["source_table", "row_id"])
    n = got.count()
    assert n > 15 and got.filter("band = said").count() / n > 0.8


def test_no_labels_or_rows(spark):
    legal, summaries, labels = frames(spark)
    assert p7.found(legal, summaries, labels.limit(0)).count() == 0
    assert p7.levels(legal.limit(0), summaries.limit(0), labels).count() == 0


def test_the_language_model_is_learned_from_every_text(spark):
    from lexmill.llm import language

    few = [f"De kantonrechter heeft het verzoek van de huurder niet aan de verhuurder gegeven en dat is nummer {i}." for i in range(4)]
    texts = [f"The tenant has paid the rent to the owner of the house and that was receipt {i}." for i in range(8000)] + few
    got, want = language.learn(spark.createDataFrame([(t,) for t in texts], "text string")), language.train(texts)
    assert set(got) == set(want) == {"en", "nl"} and got == want
