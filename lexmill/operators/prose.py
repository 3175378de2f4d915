"""Prose of summaries: sentences made uniform, repeats and fragments left out, lengths held.

Null texts count as empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions.rx import has, let, squeeze, sub
from lexmill.functions.text import word_set

from .insight import meaningful


def _mended(x: Column, steps) -> Column:
    for pattern, to, flags in steps:
        x = sub(x, pattern, to, flags + "u")
    return x


def _sentence(x: Column) -> Column:
    """With a stop at the end and a capital at the start; an empty text stays empty."""
    x = F.when(has(x, r"[.!?]$"), x).otherwise(F.concat(x, F.lit(".")))
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 10_000_000))


def summary_sentence(x: Column) -> Column:
    """A sentence without numbering, page marks and outer quotes."""
    return let(_mended(squeeze(F.coalesce(x, F.lit(""))), L.SUMMARY_SENTENCE), lambda s: F.when(s == "", "").otherwise(_sentence(s)))


def plain_rewrite(x: Column) -> Column:
    """A sentence in plain words: the replacements one after another, white space squeezed."""
    x = let(summary_sentence(x), lambda s: squeeze(_mended(s, L.PLAIN_REWRITE)))
    return summary_sentence(x)


def prose_text(x: Column) -> Column:
    return F.trim(_mended(F.coalesce(x, F.lit("")), L.PROSE))


def prose_sentence(x: Column) -> Column:
    x = F.regexp_replace(sub(prose_text(x), L.PROSE_LABEL, "", "iu"), L.PROSE_OUTER.replace("$", r"\z"), "")
    return let(x, lambda s: F.when(s == "", "").otherwise(_sentence(sub(s, r"\.{2,}$", ".", "u"))))


def polish(x: Column, words: int, least: int = 6) -> Column:
    """The sentences of ``least`` words or more that say something, each once, up to ``words`` words in all; where there is
    none, the text as one sentence."""
    n_words = lambda s: F.size(F.filter(F.split(s, r"(?U)\s+"), lambda w: w != ""))

    def kept(text: Column) -> Column:
        parts = F.transform(F.filter(F.split(text, r"(?<=[.!?])(?U)\s+"), lambda s: s != ""), prose_sentence)
        told = F.transform(F.filter(parts, lambda s: meaningful(s, least)), lambda s: F.struct(s.alias("s"), F.lower(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " ")).alias("k"), n_words(s).alias("n")))
        start = F.struct(F.array().cast("array<string>").alias("s"), F.array().cast("array<string>").alias("k"), F.lit(0).alias("n"), F.lit(False).alias("full"))

        def step(a, x):
            more = F.struct(F.concat(a["s"], F.array(x["s"])).alias("s"), F.concat(a["k"], F.array(x["k"])).alias("k"), (a["n"] + x["n"]).alias("n"), F.lit(False).alias("full"))
            full = F.struct(a["s"].alias("s"), a["k"].alias("k"), a["n"].alias("n"), F.lit(True).alias("full"))
            return F.when(a["full"] | F.array_contains(a["k"], x["k"]), a).when(a["n"] + x["n"] > words, full).otherwise(more)

        joined = F.aggregate(told, start, step, lambda a: F.array_join(a["s"], " "))
        return let(joined, lambda j: F.when(text == "", "").when(j != "", j).otherwise(prose_sentence(text)))

    return let(prose_text(x), kept)


def polish_list(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), prose_sentence), lambda s: meaningful(s, 3)))


def condense(sentences: Column, n: int = 3, length: int = 620) -> Column:
    """The first ``n`` sentences that don't share 0.8 of the smaller word set with one before, cut to ``length`` characters."""
    clean = F.transform(F.filter(F.transform(sentences, summary_sentence), lambda s: s != ""), lambda s: F.struct(s.alias("s"), word_set(s).alias("w")))
    near = lambda a, c: F.exists(a, lambda k: (F.size(k["w"]) > 0) & (F.size(c["w"]) > 0) & (F.size(F.array_intersect(c["w"], k["w"])) / F.greatest(F.lit(1), F.least(F.size(c["w"]), F.size(k["w"]))) >= 0.8))
    picked = F.aggregate(clean, F.array().cast("array<struct<s:string,w:array<string>>>"), lambda a, c: F.when((F.size(a) >= n) | near(a, c), a).otherwise(F.concat(a, F.array(c))))
    short = lambda p: F.concat(F.regexp_replace(F.substring(p, 1, length - 1), r"[ ,;:\-]+\z", ""), F.lit("…"))
    return let(squeeze(F.array_join(F.transform(picked, lambda x: x["s"]), " ")), lambda p: F.when(F.length(p) > length, short(p)).otherwise(p))
