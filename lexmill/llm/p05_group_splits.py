"""Splits that keep related records together.

Two records are tied by a shared positive ``document_id`` or a shared positive ``summary_id``. A record holds at
most one of each, so a record is an *edge* between two key nodes (or a leaf of one): the graph to contract has the
distinct keys as nodes and the distinct (document, summary) pairs as edges, each weighted by the smallest record id
that spans it. That pre-aggregation already folds duplicate rows and hot keys, whatever share of the rows they hold.

Components come from Boruvka contraction: every component picks its lightest outgoing edge (weights are unique, so
the picks form no cycle but mutual pairs), the picks are added to the persisted spanning forest, and the chosen
parents are shortened by pointer jumping until each names a root. Each round at least halves the components that
still have an outgoing edge, so the rounds are logarithmic. Every round's state is written to the shared folder.

Nulls, zero and negative ids tie nothing. One ``dataset_id`` in several rows is one record with all their keys. A null ``dataset_id`` names no record and is left out. Exact duplicate
rows are one record. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import cut, written

SHARES = {"train": 80, "validation": 10, "test": 10}
_FOREST = "lo long, hi long, weight string"


def records(df: DataFrame) -> DataFrame:
    """Distinct records as (dataset_id, d, s): the tying keys as node numbers, documents even and summaries odd."""
    key = lambda c, odd: F.when(F.col(c) > 0, F.col(c) * 2 + odd)
    return df.filter("dataset_id is not null").select("dataset_id", key("document_id", 0).alias("d"), key("summary_id", 1).alias("s")).distinct()


def _flatten(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest given as (node, parent), by pointer jumping; roots point at themselves.

    Each jump doubles the length of the path that is skipped; a parent named by many nodes is one row on its side
    of the join, and the other side is split by the adaptive skew join."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        parents = cut(parents.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
        if parents.filter("moved").isEmpty():
            return parents.select("node", F.col("parent").alias("root"))
        parents = parents.drop("moved")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, forest) of edges (a, b, weight): labels (node, root) covers every node of an edge; forest (lo, hi,
    weight) has the picked edges of all rounds."""
    spark = edges.sparkSession
    live = cut(edges.select("a", "b", F.col("a").alias("lo"), F.col("b").alias("hi"), "weight"))
    forest = spark.createDataFrame([], _FOREST)
    chain: list[DataFrame] = []
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("other"), "lo", "hi", "weight").unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("other"), "lo", "hi", "weight"))
        pick = ends.groupBy("node").agg(F.min(F.struct("weight", "lo", "hi", "other")).alias("m")).select("node", "m.other", "m.lo", "m.hi", "m.weight")
        pick = cut(pick)
        forest = forest.unionByName(pick.select("lo", "hi", "weight").distinct())
        back = pick.select(F.col("node").alias("other"), F.col("other").alias("returns"))
        # of two components that picked the same edge, the smaller number becomes the root
        parent = F.when((F.col("returns") == F.col("node")) & (F.col("node") < F.col("other")), F.col("node")).otherwise(F.col("other"))
        roots = _flatten(cut(pick.join(back, "other").select("node", parent.alias("parent"))))
        chain.append(roots)
        ra = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = live.join(ra, "a").join(rb, "b").filter("ra <> rb").groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min(F.struct("weight", "lo", "hi")).alias("m")).select("a", "b", "m.lo", "m.hi", "m.weight")
        live = cut(live)
    if not chain:
        return spark.createDataFrame([], "node long, root long"), forest
    labels = chain[-1]
    for earlier in reversed(chain[:-1]):
        later = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = earlier.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return labels, forest


def grouped(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with group_id and the group's size, the persisted spanning forest)."""
    rec = cut(records(df))
    edges = rec.filter("d is not null and s is not null").groupBy(F.col("d").alias("a"), F.col("s").alias("b")).agg(F.min("dataset_id").alias("weight"))
    # a record filed under several ids ties their keys: each to its smallest
    key = F.explode(F.array_compact(F.array("d", "s"))).alias("key")
    many = rec.groupBy("dataset_id").agg(F.count("*").alias("n"), F.min(F.least("d", "s")).alias("hub")).filter("n > 1 and hub is not null").drop("n")
    edges = edges.unionByName(many.join(rec, "dataset_id").select("dataset_id", "hub", key).filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b"), F.col("dataset_id").alias("weight")))
    labels, forest = spanning_forest(edges)
    lab = labels.select(F.col("node").alias("key"), "root")
    # a key that no edge joins to another is its own root; a record without keys is its own group
    rooted = rec.withColumn("key", F.coalesce("d", "s")).join(lab, "key", "left").select("dataset_id", F.coalesce(F.col("root"), F.col("key")).alias("root"))
    tied = rooted.filter("root is not null").groupBy("root").agg(F.min("dataset_id").alias("group_id"), F.countDistinct("dataset_id").alias("group_size"))
    out = rooted.join(tied, "root", "left").groupBy("dataset_id").agg(F.min(F.coalesce("group_id", "dataset_id")).alias("group_id"), F.max(F.coalesce("group_size", F.lit(1))).alias("group_size"))
    return out, forest


def splits(df: DataFrame, shares: dict[str, int] | None = None, seed: str = "lexmill") -> DataFrame:
    """(dataset_id, group_id, group_size, split).

    Roots are stratified by size band (the power of two of the group's size) and, in a seeded order within each
    band, dealt systematically: the running count of records before a group, offset over the bands, modulo the
    period of the shares names its split. A band's running count is two-level: inside one of many hash slices, and
    over the slices' totals, so no band is ordered in one task."""
    shares = shares or SHARES
    period = sum(shares.values())
    by, _ = grouped(df)
    by = cut(by)
    groups = by.select("group_id", "group_size").distinct().withColumn("band", F.floor(F.log2("group_size")).cast("int"))
    n_slices = max(1, groups.sparkSession.sparkContext.defaultParallelism) * 4
    h = F.xxhash64(F.lit(seed), "group_id")
    groups = groups.withColumn("h", h).withColumn("slice", F.pmod(F.col("h"), F.lit(n_slices)).cast("int"))
    totals = groups.groupBy("band", "slice").agg(F.sum("group_size").alias("n"))
    # bounded: at most 63 bands times n_slices rows
    before = totals.withColumn("before", F.sum("n").over(Window.orderBy(F.desc("band"), "slice").rowsBetween(Window.unboundedPreceding, -1))).select("band", "slice", F.coalesce("before", F.lit(0)).alias("before"))
    w = Window.partitionBy("band", "slice").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    # a stride coprime to the period interleaves the splits instead of dealing long runs of one
    stride = next(x for x in range(int(period * 0.618), period * 2) if _gcd(x, period) == 1) if period > 2 else 1
    at = F.pmod((F.col("before") + F.coalesce(F.sum("group_size").over(w), F.lit(0))) * F.lit(stride), F.lit(period))
    dealt = groups.join(F.broadcast(before), ["band", "slice"]).withColumn("at", at)
    name, upto = F.lit(list(shares)[-1]), 0
    case = None
    for split, share in list(shares.items())[:-1]:
        upto += share
        case = F.when(F.col("at") < upto, split) if case is None else case.when(F.col("at") < upto, split)
    dealt = dealt.select("group_id", (case.otherwise(name) if case is not None else name).alias("split"))
    return by.join(dealt, "group_id").select("dataset_id", "group_id", F.col("group_size").cast("long").alias("group_size"), "split")


def _gcd(a: int, b: int) -> int:
    return a if not b else _gcd(b, a % b)


def forest(df: DataFrame) -> DataFrame:
    """(dataset_id, document_ids, summary_ids): the persisted spanning forest, an edge a row: the record that ties its two keys.
    It has one edge fewer than keys in each tree, and its trees are the groups."""
    _, picked = grouped(df)
    ends = F.array("lo", "hi")
    of = lambda odd: F.array_sort(F.transform(F.filter(ends, lambda x: x % 2 == odd), lambda x: (x - odd) / 2)).cast("array<long>")
    return written(picked.distinct().select(F.col("weight").alias("dataset_id"), of(0).alias("document_ids"), of(1).alias("summary_ids")), "forest")


def found(df: DataFrame) -> DataFrame:
    """(dataset_id, group_id) of the records that share their split with at least one other."""
    by, _ = grouped(df)
    return by.filter("group_size > 1").select("dataset_id", "group_id")
