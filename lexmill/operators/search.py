"""Hybrid search: hashed sparse profiles by cosine, and the share of query words that the fields contain."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions.rx import let
from lexmill.functions.text import profile_tokens

BUCKETS = 48


def synonyms(text: Column) -> Column:
    low = F.lower(text)
    return F.flatten(F.array(*(F.when(low.contains(k), F.array(F.lit(k), *(F.lit(x) for x in v))).otherwise(F.array().cast("array<string>")) for k, v in L.SYNONYMS.items())))


def terms(text: Column, *more: Column) -> Column:
    """All profile terms of a text, with the given lists and the synonyms that the text calls for."""
    extra = [F.filter(F.transform(x, lambda t: F.lower(F.trim(t))), lambda t: (F.length(t) >= 3) & ~t.isin(L.PROFILE_STOP)) for x in more]
    return F.concat(profile_tokens(text), *extra, synonyms(text))


def vector(term_list: Column) -> Column:
    """Map of bucket to count."""
    buckets = F.transform(term_list, lambda t: (F.crc32(t.cast("binary")) % BUCKETS).cast("int"))
    count = lambda b: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(b)), lambda k: F.struct(k, F.size(F.filter(b, lambda x: x == k)).cast("double"))))
    return let(buckets, count)


def cosine(a: Column, b: Column) -> Column:
    """0 where either map is empty; rounded to four places."""
    dot = F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at(b, e["key"]), F.lit(0.0)))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    return F.coalesce(F.round(F.try_divide(dot, norm(a) * norm(b)), 4), F.lit(0.0))


def query_vector(query: str) -> dict[int, float]:
    """The profile of a query, made once."""
    import re

    low = query.lower()
    found = [t for t in re.findall(r"[^\W\d_][^\W\d_'-]*(?:['-][^\W\d_'-]*)*", low) if len(t) >= 3 and t not in L.PROFILE_STOP]
    for k, v in L.SYNONYMS.items():
        if k in low:
            found += [k, *v]
    out: dict[int, float] = {}
    for t in found:
        b = zlib.crc32(t.encode()) % BUCKETS
        out[b] = out.get(b, 0.0) + 1
    return out


def affinity(query: str, haystack: Column) -> Column:
    """Query words of three characters or more that the haystack contains, by all query words."""
    words = query.lower().split()
    hits = [F.when(haystack.contains(w), 1).otherwise(0) for w in words if len(w) >= 3]
    if not words or not hits:
        return F.lit(0.0)
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total / F.lit(float(len(words)))


def scored(df: DataFrame, query: str, text: str, haystack: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``affinity`` and ``search_score``; rows under 0.08 without a word in common are left out. The lists in the
    columns ``more`` go into the profile, whose first 20 terms then join the haystack."""
    q = query_vector(query)
    qmap = F.create_map(*(F.lit(x) for kv in q.items() for x in kv)) if q else F.expr("cast(map() as map<int,double>)")
    none = F.array().cast("array<string>")
    more_of = lambda t: [F.slice(F.array_distinct(t), 1, 20)] if more else []

    def of(t: Column) -> Column:
        near = lambda hay: affinity(query, hay)
        pair = F.struct(let(vector(t), lambda v: cosine(qmap, v)).alias("cos"), let(F.lower(F.concat_ws(" ", *haystack, *more_of(t))), near).alias("affinity"))
        return let(pair, lambda z: F.struct(z["affinity"].alias("affinity"), F.round(z["cos"] * 0.7 + z["affinity"] * 0.3, 4).alias("search_score")))

    made = let(terms(F.coalesce(text, F.lit("")), *(F.coalesce(c, none) for c in more)), of)
    # as one row each: a filter on what a projection makes would make it again
    x = df.select("*", F.explode(F.array(made)).alias("_z")).select(*df.columns, "_z.affinity", "_z.search_score")
    return x.filter("search_score >= 0.08 or affinity > 0")


def rank(df: DataFrame, query: str, key: str, text: str, haystack: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """``scored``, best first. An empty query gives ``df`` as it is."""
    return scored(df, query, text, haystack, more).orderBy(F.desc("search_score"), key) if query.strip() else df


def snippet(text: Column, query: str, width: int = 260, lead: int = 110) -> Column:
    """The window around the first hit, null without one."""
    at = F.locate(query.lower(), F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - lead), F.lit(width)))


SLICE_ROWS, BLOCK_ROWS = 50_000, 10_000  # vectors that meet in one task: of all rows, and of the queries


def dense_top(vectors: DataFrame, key: str = "vec_id", col: str = "embedding", k: int = 5, step: int = 50, slice_rows: int = SLICE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, neighbour_id, similarity): of every vector whose key is divisible by ``step``, its ``k`` nearest of
    all vectors. The stated query set goes over the rows in blocks: queries are gathered into blocks of vectors, and each block meets
    each slice of rows once, in a matrix product that keeps only ``k`` rows a query, so what is shuffled is bounded by
    queries times slices. There are as many slices and blocks as the rows ask for."""
    import numpy as np
    import pandas as pd

    base = vectors.select(F.col(key).alias("id"), F.col(col).alias("v")).filter("v is not null")
    n = base.count()
    slices, blocks = max(16, -(-n // slice_rows)), max(1, -(-n // step // block_rows))
    part = lambda of: F.pmod(F.xxhash64("id"), F.lit(of))
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    rows = base.withColumn("s", part(slices)).withColumn("b", every(blocks))
    queries = base.filter(f"id % {step} = 0").withColumn("b", part(blocks)).withColumn("s", every(slices))

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            a, b = np.stack(left["v"].to_numpy()).astype(float), np.stack(right["v"].to_numpy()).astype(float)
            a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
            b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
            ids = right["id"].to_numpy()
            for at in range(0, len(a), 256):
                sim = a[at : at + 256] @ b.T
                for q, row in zip(left["id"].to_numpy()[at : at + 256], sim, strict=True):
                    row = np.where(ids == q, -2, row)
                    best = np.lexsort((ids, -np.round(row, 6)))[:k]
                    out += [(q, ids[j], round(float(row[j]), 6)) for j in best if row[j] > -2]
        return pd.DataFrame(out, columns=["query_id", "neighbour_id", "similarity"])

    from pyspark.sql import Window

    got = queries.groupBy("s", "b").cogroup(rows.groupBy("s", "b")).applyInPandas(near, "query_id long, neighbour_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "similarity")
