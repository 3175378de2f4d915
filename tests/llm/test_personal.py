import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import p03_personal as p3

KEY = b"test key"
SURNAMES, GIVEN = frozenset({"rcva", "duko"}), frozenset({"vanl", "ator"})


def kinds(text):
    return [(k, re.sub(r"\s+", " ", text[a:b])) for a, b, k in p3.spans(text, SURNAMES, GIVEN)]


def test_forms():
    assert kinds("Mr Ruvani K. Tingoreva, ID 95187326B44, of Flat 2, 101 Granite Ave., Borida") == [("person_name", "Ruvani K. Tingoreva"), ("id_number", "95187326B44"), ("street_address", "Flat 2, 101 Granite Ave.")]
    assert kinds("call Shangoreva, Ruvani at +263-70-571-6599 or r.shangoreva [at] dune.invalid.") == [("person_name", "Shangoreva, Ruvani"), ("phone", "+263-70-571-6599"), ("email", "r.shangoreva [at] dune.invalid")]
    assert kinds("RUVANI\nKUNDUKO, ruvani kunduko, M. R.\nKunduko") == [("person_name", "RUVANI KUNDUKO"), ("person_name", "ruvani kunduko"), ("person_name", "M. R. Kunduko")]
    assert kinds("Adv. Shangoreva for Kunduko & Sons, invoice 071-19-82, item 36-2018-10, Acacia Road") == []


def test_split_words():
    assert kinds("paid by Ruvani Shango-\nreva today") == [("person_name", "Ruvani Shango- reva")]


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 900), st.binary(min_size=1, max_size=8))
def test_feistel_is_a_permutation(size, key):
    assert sorted(p3.feistel(i, size, key, "t") for i in range(size)) == list(range(size))


@settings(max_examples=60, deadline=None)
@given(st.from_regex(r"[0-9]{2}[- ]?[0-9]{6}[- ]?[A-Z][- ]?[0-9]{2}", fullmatch=True))
def test_format_is_kept(number):
    made = p3.pseudonym(number, "id_number", KEY)
    assert re.sub("[A-Z]", "A", re.sub(r"\d", "9", made)) == re.sub("[A-Z]", "A", re.sub(r"\d", "9", number))


def test_equal_values_stay_linked():
    digits = lambda s: re.sub(r"\D", "", s)[-9:]
    assert len({digits(p3.pseudonym(x, "phone", KEY)) for x in ("+263 70 629 1343", "+263-70-629-1343", "00263 706291343", "0706291343", "070 629 1343")}) == 1


def test_country_codes():
    digits = lambda s: re.sub(r"\D", "", s)[-10:]
    uk = ("+44 7700 900123", "07700 900123", "+44 (0)7700 900123", "0044 7700 900123")
    assert len({digits(p3.pseudonym(x, "phone", KEY)) for x in uk}) == 1 and p3.pseudonym(uk[0], "phone", KEY).startswith("+44 ")
    us = p3.pseudonym("+1 202 555 0143", "phone", KEY)
    assert us.startswith("+1 ") and re.sub(r"\D", "", us)[1:4] != "202" and digits(us) == digits(p3.pseudonym("+1-202-555-0143", "phone", KEY))
    for x in ("+44 7700 900123", "07700 900123", "+1 202 555 0143", "+49 30 901820"):
        assert kinds(f"Call {x} now, or see line 12.") == [("phone", x)]
    assert kinds("Codes +83 111 222 333 and 0000000000 and ID 00 000000 A 00 stay.") == []


def test_names_with_accents():
    assert kinds("signed by Rúvani Kündrcva and J. Órduko") == [("person_name", "Rúvani Kündrcva"), ("person_name", "J. Órduko")]


def test_dates_move_in_their_form():
    out = p3.redact("On 5 January 2021, on 3 Mar. 2004, on 2020-02-29 and on 30/02/2020.", SURNAMES, GIVEN, KEY, dates=True)
    assert re.fullmatch(r"On \d{1,2} [A-Z][a-z]+ \d{4}, on \d{1,2} [A-Z][a-z]{2}\. \d{4}, on \d{4}-\d\d-\d\d and on 30/02/2020\.", out) and "5 January 2021" not in out


def test_found_and_redacted(spark):
    surnames, given_names = ("Tingoreva", "Shangoreva", "Kunduko", "Manduko"), ("Ruvani", "Tavani", "Rutor", "Bator")
    people = [f"{a} {b}" for a in given_names for b in surnames]
    text = " ".join(f"The agent is M. {p.split()[1]} and the clerk is {p} now." for p in people)
    legal = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Pay 15/03/2020 by phone 0706291343."), (None, text)], "id long, extracted_text string")
    summaries = spark.createDataFrame([(1, '["Ruvani Kunduko", "Dune Trust"]'), (2, None)], "id long, parties string")
    got = {tuple(r) for r in p3.found(legal, summaries).collect()}
    assert ("legal_documents", 1, "person_name", "Bator Manduko") in got and ("summaries", 1, "person_name", "Ruvani Kunduko") in got and ("legal_documents", 4, "phone", "0706291343") in got
    out = {(r.source_table, r.row_id): r.redacted_text for r in p3.redacted(legal, summaries, KEY).collect()}
    assert out["legal_documents", 2] is None and out["legal_documents", 3] == ""
    assert "Bator" not in out["legal_documents", 1] and "[PERSON_NAME" in out["summaries", 1] and '"Dune Trust"' in out["summaries", 1]
    assert "15/03/2020" in out["legal_documents", 4] and "[PHONE 0" in out["legal_documents", 4]
    dated = {r.row_id: r.redacted_text for r in p3.redacted(legal, summaries, KEY, dates=True).filter("source_table = 'legal_documents'").collect()}
    assert "15/03/2020" not in dated[4] and re.search(r"\d\d/\d\d/\d{4}", dated[4])


def test_empty(spark):
    a, b = spark.createDataFrame([], "id long, extracted_text string"), spark.createDataFrame([], "id long, parties string")
    assert p3.found(a, b).count() == 0 and p3.redacted(a, b, KEY).count() == 0
