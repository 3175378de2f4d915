import os

import pytest

from lexmill.llm import p09_mixture as p9
from lexmill.llm.queries import TOKENIZER

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer")
DOCS, TARGETS = "doc_id long, source string, text string", "source string, target_share double, max_repeats int"


def docs(spark):
    rows = [(i, " Big " if i % 2 else "BIG", "word " * (20 + i % 30)) for i in range(600)] + [(1000 + i, "small", "other " * 30) for i in range(40)] + [(2000, "stray", "x y z"), (2001, None, "x"), (2002, "small", None), (2003, "small", ""), (None, "big", "x")]
    return spark.createDataFrame(rows, DOCS)


def test_shares(spark):
    targets = spark.createDataFrame([("big", 0.7, 1), ("Small", 0.3, 4), ("empty", 0.2, 3), ("off", 0.0, 1), (None, 0.5, 1)], TARGETS)
    got = {r.source: r for r in p9.shares(docs(spark), targets, TOKENIZER, blocks=400).collect()}
    assert set(got) == {"big", "small", "empty"} and got["empty"].n_tokens == 0
    assert abs(got["big"].actual_share - 0.7) < 0.03 and abs(got["small"].actual_share - 0.3) < 0.03
    assert got["big"].most_repeats == 1 and got["small"].most_repeats <= 4


def test_tokens_match_the_tokenizer(spark):
    import base64

    import tiktoken

    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("t", pat_str=p9.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello there, it's me.", "Größe <|endoftext|> 12", "日本語"]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], DOCS)
    assert [r.n_tokens for r in p9.token_counts(df, TOKENIZER).orderBy("doc_id").collect()] == [len(coder.encode_ordinary(t)) for t in texts]


def test_schedule_is_even(spark):
    plan = [("a", 0.5, 1, 1), ("b", 0.3, 1, 1), ("c", 0.2, 1, 1)]
    rows = p9.schedule(spark, plan, 1000, 16).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(1000))
    seen = dict.fromkeys("abc", 0)
    for n, r in enumerate(rows, 1):
        assert r["rank"] == seen[r.source]
        seen[r.source] += 1
        assert all(abs(seen[s] - n * share) < 4 for s, share, _, _ in plan)


def test_no_document_too_often(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], TARGETS)
    got = p9.mixture(docs(spark), targets, TOKENIZER, blocks=200, slice_rows=50)
    assert got.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2 and got.groupBy("doc_id", "repeat_no").count().filter("count > 1").count() == 0


def test_empty(spark):
    none, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert p9.mixture(none, targets, TOKENIZER).count() == 0 and p9.shares(none, targets, TOKENIZER).first().n_tokens == 0 and p9.mixture(docs(spark), targets.limit(0), TOKENIZER).count() == 0
