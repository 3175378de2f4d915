import random

import pytest

from lexmill.llm import p05_group_splits as p5

SCHEMA = "dataset_id string, document_id long, summary_id long"


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r, d, s in rows:
        for k in ([("d", d)] if d and d > 0 else []) + ([("s", s)] if s and s > 0 else []):
            parent[find(("r", r))] = find(k)
        find(("r", r))
    groups = {}
    for r, _, _ in rows:
        groups.setdefault(find(("r", r)), set()).add(r)
    return {(r, min(g)) for g in groups.values() if len(g) > 1 for r in g}


@pytest.mark.parametrize("seed", [1, 2])
def test_found_matches_union_find(spark, seed):
    rng = random.Random(seed)
    some = lambda: rng.choice([None, 0, -1, *(rng.randint(1, 60) for _ in range(5))])
    rows = [(f"r{i:03d}", some(), some()) for i in range(70)] + [(f"c{i:03d}", 1000 + i, 1001 + i) for i in range(25)] + [(f"d{i:03d}", 1001 + i, 1000 + i) for i in range(25)]
    rows += rows[:9] + [("r000", 55, 56)]
    got = {tuple(r) for r in p5.found(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_forest_spans(spark):
    edges = [(2 * i, 2 * i + 1, f"w{i:02d}") for i in range(1, 9)] + [(2 * i + 1, 2 * i + 2, f"x{i:02d}") for i in range(1, 8)] + [(2, 17, "zz")]
    labels, forest = p5.spanning_forest(spark.createDataFrame(edges, "a long, b long, weight string"))
    assert labels.select("root").distinct().count() == 1 and forest.distinct().count() == labels.count() - 1
    assert "zz" not in {r.weight for r in forest.collect()}  # the heaviest edge of the only cycle


def test_splits(spark):
    rng = random.Random(5)
    rows = [(f"r{i:05d}", rng.randint(1, 1500), rng.randint(1, 4000)) for i in range(1800)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = p5.splits(df).collect()
    assert len(got) == 1800 and len({(r.group_id, r.split) for r in got}) == len({r.group_id for r in got})
    single = spark.createDataFrame([(f"s{i:05d}", i + 1, None) for i in range(2000)], SCHEMA)
    n = {r["split"]: r["count"] for r in p5.splits(single).groupBy("split").count().collect()}
    assert abs(n["train"] - 1600) < 60 and abs(n["validation"] - 200) < 40 and abs(n["test"] - 200) < 40


def test_edges(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert p5.found(df).count() == 0 and p5.splits(df).count() == 0
    alone = spark.createDataFrame([("a", None, None), ("b", 0, -1), (None, 5, 5), ("c", 5, 5)], SCHEMA)
    assert p5.found(alone).count() == 0 and {r.dataset_id for r in p5.splits(alone).collect()} == {"a", "b", "c"}


def test_forest_spans_the_groups_and_has_no_circle(spark):
    rng = random.Random(5)
    rows = [(f"r{i:03d}", rng.choice([None, 0, *range(1, 60)]), rng.choice([None, -1, *range(1, 60)])) for i in range(120)]
    got = p5.forest(spark.createDataFrame(rows, SCHEMA)).collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in got:
        a, b = [("d", x) for x in r.document_ids] + [("s", x) for x in r.summary_ids]
        assert find(a) != find(b)
        parent[find(a)] = find(b)
    full = {}
    keys = {k for _, d, s in rows for k in ([("d", d)] if d and d > 0 else []) + ([("s", s)] if s and s > 0 else [])}
    for _, d, s in rows:
        if d and d > 0 and s and s > 0:
            full.setdefault(("d", d), set()).add(("s", s))
    assert all(find(a) == find(b) for a, bs in full.items() for b in bs) and len(got) == len(keys) - len({find(k) for k in keys})
