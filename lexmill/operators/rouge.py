"""Overlap of a summary with its source: precision of words, pairs of words, and the longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexmill.functions.rx import all_of, let
from lexmill.functions.text import rouge_tokens

REFERENCE_MAX, CANDIDATE_MAX = 1500, 350  # fixed values: what the subsequence measure reads


def _grams(t: Column, n: int) -> Column:
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def precision(df: DataFrame, key: str, reference: str, candidate: str, n: int) -> DataFrame:
    """(key, precision in per cent): clipped n-gram overlap by the candidate's n-grams; 0 without any. Both sides are counted
    per document before they meet."""
    grams = lambda c, name: df.select(key, F.explode(let(rouge_tokens(F.col(c)), lambda t: _grams(t, n))).alias("g")).groupBy(key, "g").agg(F.count("*").alias(name))
    a, b = grams(candidate, "c"), grams(reference, "r")
    hit = a.join(b, [key, "g"], "left").groupBy(key).agg((F.sum(F.least("c", F.coalesce("r", F.lit(0)))) / F.sum("c") * 100).alias("p"))
    return df.select(key).distinct().join(hit, key, "left").select(key, F.coalesce("p", F.lit(0.0)).alias(f"rouge_{n}"))


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit vectors: one whole-number step per element of ``a``."""
    at: dict = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << i)
    row, full = 0, (1 << len(b)) - 1
    for x in a:
        y = row | at.get(x, 0)
        row = y & ~(y - ((row << 1) | 1)) & full
    return row.bit_count()


@F.pandas_udf(DoubleType())
def _lcs(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(r), list(c)) / len(c) * 100 if len(c) and len(r) else 0.0 for r, c in zip(reference, candidate, strict=True)])


def subsequence(df: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    """(key, rouge_l)."""
    return df.select(key, _lcs(F.slice(rouge_tokens(F.col(reference)), 1, REFERENCE_MAX), F.slice(rouge_tokens(F.col(candidate)), 1, CANDIDATE_MAX)).alias("rouge_l"))


def pairs(summaries: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, created_at, source, generated) of the summaries long enough to be measured."""
    generated = F.trim(F.coalesce(F.nullif("professional_summary", F.lit("")), F.nullif("executive_summary", F.lit("")), "citizen_summary", F.lit("")))
    d = documents.select(F.col("id").alias("document_id"), F.col("extracted_text").alias("source"))
    return summaries.select("id", "document_id", "created_at", generated.alias("generated")).join(d, "document_id").filter("length(source) >= 40 and length(generated) >= 20")


def similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of the distinct words of three characters or more; 0 where either side has none."""
    words = lambda c: F.array_distinct(all_of(F.lower(F.coalesce(c, F.lit(""))), r"\p{L}[\p{L}\p{Mn}'-]{2,}", "u"))
    share = lambda z: F.when((F.size(z["a"]) > 0) & (F.size(z["b"]) > 0), F.size(F.array_intersect(z["a"], z["b"])) / F.size(F.array_union(z["a"], z["b"]))).otherwise(0.0)
    return let(F.struct(words(left).alias("a"), words(right).alias("b")), share)
