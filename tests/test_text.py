import pytest
from pyspark.sql import functions as F

from lexmill.functions import classify as C
from lexmill.functions import extract as X
from lexmill.functions import lexicons as L
from lexmill.functions import text as T


def one(spark, make, *values):
    cols = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{c} string" for c in cols))
    return df.select(make(*(F.col(c) for c in cols)).alias("v")).first().v


def kind(spark, text, name=""):
    df = spark.createDataFrame([(text, name)], "t string, f string")
    z = C.type_scores(F.col("t"), F.col("f"))
    return df.select(z.alias("z")).select(C.document_type(F.col("z.scores"), F.col("z.titles")).alias("d")).first().d



def test_clean(spark):
    assert one(spark, T.clean, "A con-\ntract,signed\r\n\r\n\r\n\r\nby “us” – [Chapter 12:34]\t now ") == 'A contract, signed\n\nby "us" - Chapter 12:34 now'
    assert one(spark, T.clean, "a\n-- PAGE 3 --\nb") == "a\n\nb" and one(spark, T.clean, None) is None


def test_sentences(spark):
    got = one(spark, lambda c: T.sentences(c), 'Mr. Moyo signed the lease for the house. He said "yes to all of it now." Then\n\nshort. The second paragraph holds one sentence')
    assert got == ["Mr. Moyo signed the lease for the house.", 'He said "yes to all of it now.', "The second paragraph holds one sentence"]


def test_tokens(spark):
    assert one(spark, T.tokens, "The co-owner’s naïve -- plan: 3 a 'x' of-") == ["the", "co-owner’s", "naïve", "plan", "x", "of"]
    assert one(spark, T.evidence_tokens, "Lease lease term shall be") == ["lease", "term", "shall"]
    assert one(spark, lambda c: T.word_limit(c, 2), " a  b c ") == "a b..."


def test_pages(spark):
    dashed = "lost\n--- PAGE 1 ---\nfirst\n— PAGE 2 —\n—— PAGE 2 ——\nsecond\n--- PAGE 99999999999 ---\n"
    assert [tuple(p) for p in one(spark, T.pages, dashed)] == [(1, "first\n— PAGE 2 —"), (2, "second")]
    boxed = "─── PAGE 1 ───\nx"
    assert [tuple(p) for p in one(spark, T.pages, boxed)] == [(1, boxed)]
    assert [tuple(p) for p in one(spark, lambda c: T.pages(c, True), boxed)] == [(1, "x")]
    assert one(spark, T.pages, "") == []


def test_title_case(spark):
    assert one(spark, T.title_case, "DELTA MINING (PRIVATE) LIMITED AND CITY OF X") == "Delta Mining (Private) Limited and City of X"
    assert one(spark, T.title_case, "McKay Ltd") == "McKay Ltd"


@pytest.mark.parametrize(
    ("text", "name", "want"),
    [
        ("IN THE HIGH COURT\nHH 12/20\nThe applicant and the respondent. It is ordered that the appeal dismissed.", "", "Court Judgment"),
        ("This lease agreement binds the tenant and the landlord of the premises for the rent.", "", "Lease Agreement"),
        ("The employment contract binds the employee and the employer. Salary and leave entitlement follow.", "", "Employment Contract"),
        ("This Bill seeks to amend. Amendment of section 4. Insertion of new section 5.", "Finance_Bill.pdf", "Bill"),
        ("Statutory Instrument 12 of 2020. It is hereby notified.", "", "Statutory Instrument"),
        ("I appoint my attorney. Special power of attorney.", "", "Power of Attorney"),
        ("A short note on the weather.", "", "Legal Document"),
    ],
)
def test_document_type(spark, text, name, want):
    assert kind(spark, text, name) == want


def test_tone_language_reading(spark):
    tone = lambda t: one(spark, lambda c: C.sentiment(T.tokens(c)), t)
    assert tone("granted upheld awarded") == "positive" and tone("granted upheld awarded breach") == "neutral" and tone("void breach penalty") == "negative"
    lang = lambda t: one(spark, lambda c: C.language(T.tokens(c)), t)
    assert lang("munhu vanhu") == "sn" and lang("munhu") == "en" and lang("abantu kodwa munhu") == "nd"
    assert one(spark, lambda c: C.readability(T.tokens(c), F.lit(1)), "") == 0.0
    assert 0 <= one(spark, lambda c: C.readability(T.tokens(c), F.lit(2)), "The cat sat on the mat. It was warm.") <= 100


def test_values(spark):
    assert one(spark, X.amounts, "pay USD 2,500.75 or US$ 1, 200 and $500") == ["USD 2,500", "US$ 1,200"]
    assert one(spark, X.dates, "on 3rd March 2020, May 4, 2021 and 1/2/23; again 1/2/23") == ["3rd March 2020", "May 4, 2021", "1/2/23"]
    assert one(spark, X.case_number, "see HH 123/20 and HC 9/1") == "HH 123/20" and one(spark, X.case_number, "none") is None
    assert one(spark, X.court, "Notes\nIN THE LABOUR COURT\nthe High Court") == "Labour Court of Zimbabwe"
    assert one(spark, X.court, "SC 12/20\nheld") == "Supreme Court of Zimbabwe" and one(spark, X.court, "nothing") is None
    assert one(spark, X.references, "Section 4 and Chapter 10:12 of the Property Transfer Act") == ["Section 4", "Chapter 10:12", "Property Transfer Act"]
    assert one(spark, X.judge, "before MOYO J and others") == "Moyo" and one(spark, X.parties, "JOHN DOE v ACME LIMITED.") == ["John Doe", "Acme Limited"]


def test_duties_and_outcome(spark):
    s = lambda *x: F.array(*(F.lit(v) for v in x))
    assert one(spark, lambda c: X.obligations(s("the tenant must pay the rent on the first day")), "") == ["The tenant must pay the rent on the first day"]
    assert one(spark, lambda c: X.obligations(F.array().cast("array<string>")), "") == list(L.NO_OBLIGATION)
    assert one(spark, lambda c: X.outcome(c, s("Long ago the lease was signed by both."), F.lit("Lease Agreement")), "nothing here") == L.OUTCOME_UNKNOWN
    assert one(spark, lambda c: X.outcome(c, s("In the end the application is dismissed with costs."), F.lit("Court Judgment")), "x") == "the application is dismissed with costs."
    assert one(spark, lambda c: X.outcome(c, s("x"), F.lit("Bill")), "x") == L.OUTCOME_BILL


def test_clause_and_passage_kinds(spark):
    assert one(spark, C.clause_type, "Notice of termination") == "TERMINATION" and one(spark, lambda c: C.clause_type(c, F.lit("Court Judgment")), "plain") == "COURT_ORDER"
    assert one(spark, C.passage_kind, "The accused was found") == "facts" and one(spark, C.passage_kind, "weather") == "other"
    assert one(spark, C.badge, "Employment Contract") == "contract" and one(spark, C.badge, None) == "other"
    assert one(spark, lambda c: C.urgency(F.lit(0), F.lit(2), F.lit(""), c), "") == "medium"
