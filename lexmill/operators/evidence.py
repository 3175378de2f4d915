"""Passages and evidence: which parts of a document support a finding, with their page."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions.classify import passage_kind
from lexmill.functions.rx import has, let, squeeze
from lexmill.functions.text import evidence_sentences, evidence_tokens, pages

PASSAGES, DEADLINES, RISKS = 6, 4, 5


def sentences(df: DataFrame, key: str, text: str, box_markers: bool = False) -> DataFrame:
    """(key, no, page, sentence) of every page, in order."""
    p = df.select(key, F.posexplode(pages(F.col(text), box_markers)).alias("pno", "p"))
    s = p.select(key, "pno", F.col("p.page").alias("page"), F.posexplode(evidence_sentences(F.col("p.text"))).alias("sno", "sentence"))
    return s.select(key, (F.col("pno") * 1_000_000 + F.col("sno")).cast("long").alias("no"), "page", "sentence")


def matching(sents: DataFrame, key: str, pattern: str, n: int) -> DataFrame:
    """The first ``n`` sentences of each document that hold the pattern."""
    w = Window.partitionBy(key).orderBy("no")
    return sents.filter(has(F.col("sentence"), pattern, "iu")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(key, "rank", "page", "sentence")


def deadlines(sents: DataFrame, key: str) -> DataFrame:
    return matching(sents, key, L.DEADLINE, DEADLINES)


def risky(sents: DataFrame, key: str) -> DataFrame:
    return matching(sents, key, L.RISKY, RISKS)


def best_match(needles: DataFrame, sents: DataFrame, key: str, preferred: tuple[str, ...] = (), keep_unmatched: bool = False) -> DataFrame:
    """(key, item, needle, quote, page, score): of each needle the sentence of its document that shares the largest part of
    its words, preferred terms adding 0.2 each; of equals the first. An equi-join on document and word, not all pairs."""
    n = needles.select(key, "item", "needle", evidence_tokens(F.col("needle")).alias("nt")).withColumn("size", F.size("nt"))
    s = sents.withColumn("st", evidence_tokens(F.col("sentence")))
    hits = n.select(key, "item", "size", F.explode("nt").alias("t")).join(s.select(key, "no", F.explode("st").alias("t")), [key, "t"]).groupBy(key, "item", "no").agg((F.count("*") / F.first("size")).alias("share"))
    bonus = reduce(add, (F.when(F.lower("sentence").contains(p), 0.2).otherwise(0.0) for p in preferred), F.lit(0.0))
    scored = hits.join(sents, [key, "no"]).withColumn("score", F.round(F.col("share") + bonus, 6))
    best = scored.groupBy(key, "item").agg(F.max_by(F.struct("sentence", "page", "score"), F.struct("score", -F.col("no"))).alias("b"))
    return needles.select(key, "item", "needle").join(best, [key, "item"], "left" if keep_unmatched else "inner").select(key, "item", "needle", F.col("b.sentence").alias("quote"), F.col("b.page").alias("page"), F.col("b.score").alias("score"))


def passage_score(x: Column, terms: Column) -> Column:
    """``terms`` are those of four characters or more."""

    def score(low: Column) -> Column:
        by_terms = F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.when(low.contains(t), F.when(t.contains(" "), 1.3).otherwise(0.7)).otherwise(0.0))
        cue = lambda words, v: reduce(add, (F.when(low.contains(w), v).otherwise(0.0) for w in words))
        doctrine = F.when(has(low, L.DOCTRINE, "iu") & ~has(low, L.DOCTRINE_PARTY, "iu"), 1.0).otherwise(0.0)
        return by_terms + cue(L.PASSAGE_OUTCOME, 0.55) + cue(L.PASSAGE_PARTY, 0.9) - doctrine

    return let(F.lower(x), score)


def passages(df: DataFrame, key: str, text: str, terms: str) -> DataFrame:
    """(key, passage_id, page, score, kind, passage): paragraphs of 80 characters or more with a positive score."""
    df = df.select(key, text, F.filter(terms, lambda t: F.length(t) >= 4).alias(terms))
    p = df.select(key, terms, F.posexplode(pages(F.col(text))).alias("pno", "p")).select(key, terms, "pno", F.col("p.page").alias("page"), F.posexplode(F.split("p.text", r"\n{2,}")).alias("no", "raw"))
    p = p.select(key, "pno", "page", "no", F.col("raw"), terms)
    scored = lambda x: F.when(F.length(x) >= 80, F.struct(x.alias("passage"), F.round(passage_score(x, F.col(terms)), 3).alias("score"), passage_kind(x).alias("kind")))
    # made once for a paragraph, as one row each: a filter on what a projection makes would make it again
    p = p.select(key, "pno", "page", "no", F.explode(F.transform(F.array(squeeze(F.col("raw"))), scored)).alias("z")).select(key, "pno", "page", "no", "z.passage", "z.score", "z.kind").filter("score > 0")
    w = Window.partitionBy(key).orderBy("pno", "no")
    return p.withColumn("seq", F.row_number().over(w)).select(key, "seq", F.format_string("P%d-%d", "page", F.row_number().over(w)).alias("passage_id"), "page", "score", "kind", "passage")


def balanced(found: DataFrame, key: str, n: int = PASSAGES) -> DataFrame:
    """The best passage of facts, of outcome and of reasoning, then the best of the rest, ``n`` in all."""
    by_kind = Window.partitionBy(key, "kind").orderBy(F.desc("score"), "seq")
    lead = {"facts": 0, "outcome": 1, "reasoning": 2}
    place = F.lit(3)
    for kind, at in lead.items():
        place = F.when((F.col("kind") == kind) & (F.col("kr") == 1), at).otherwise(place)
    w = Window.partitionBy(key).orderBy("place", F.desc("score"), "seq")
    return found.withColumn("kr", F.row_number().over(by_kind)).withColumn("place", place).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(key, "rank", "passage_id", "page", "score", "kind")
