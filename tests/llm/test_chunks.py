from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import p04_chunks as p4

TOPICS = ("river water fish boats stream bridge current shore", "market price money trade bank shares profit loan", "court judge appeal order evidence witness verdict crime")


def topical(topic: str, n: int) -> str:
    words = topic.split()
    return " ".join(f"{words[i % 8].title()} {words[(i + 3) % 8]} {words[(i * 5 + 1) % 8]} {words[(i + 6) % 8]}." for i in range(n)) + " "


def check(text, limit, overlap):
    cuts = p4.cut_points(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (s, e, _), (s2, e2, _) in zip(cuts, cuts[1:], strict=False):
        assert s < e and e - s <= limit and s < s2 <= e and e - s2 <= overlap and e2 > e
    assert all(e - s <= limit for s, e, _ in cuts)
    return cuts


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .。\nπ", min_size=0, max_size=900), st.integers(20, 120))
def test_invariants(text, limit):
    check(text, limit, limit // 10)


def test_cuts_at_the_topic_change():
    text = topical(TOPICS[0], 60) + topical(TOPICS[1], 60)
    turn = len(topical(TOPICS[0], 60))
    cuts = check(text, int(turn * 1.3), 0)
    assert abs(cuts[0][1] - turn) < 40


def test_no_boundary_at_all():
    cuts = check("x" * 1000, 100, 10)
    assert {k for _, _, k in cuts[:-1]} == {"limit"}


def test_depths_match_a_plain_count():
    from collections import Counter

    text = topical(TOPICS[0], 12) + topical(TOPICS[2], 12)
    at = p4.gaps(text)
    ends = [0, *(p for p, _ in at), len(text)]
    units = [p4._terms(text[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    flat = [t for u in units for t in u]
    n, sims = 0, []
    for u in units[:-1]:
        n += len(u)
        sims.append(p4._cosine(Counter(flat[max(0, n - 20) : n]), Counter(flat[n : n + 20])))
    got = p4.depths(text, at, 20)
    low = min(range(len(sims)), key=sims.__getitem__)
    assert max(range(len(got)), key=got.__getitem__) == low


def test_operator(spark):
    rows = [("a", "x" * 6000), ("b", topical(TOPICS[0], 400)), ("b", topical(TOPICS[0], 400)), ("c", None), (None, "y" * 7000)]
    df = spark.createDataFrame(rows, "k string, t string").selectExpr("k", "t", "'clash' as piece", "1 as row_key")
    got = p4.pieces(df, "k", "t").collect()
    assert {r.row_key for r in got} == {"b", None} and all(len(r.piece) <= 6000 for r in got)
    assert p4.found(spark.createDataFrame([], "id long, extracted_text string"), spark.createDataFrame([], "dataset_id string, input_text string")).count() == 0
