"""Keyword ranking and extractive summaries within documents.

Terms are rows, so counting and ranking are grouped aggregations with map-side combining; only the greedy choice of
sentences, which depends on its own earlier choices, folds over the sentences of one document.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions import plain
from lexmill.functions.rx import has
from lexmill.functions.text import tokens, weak, word_set


def _phrases(toks: Column, n: int) -> Column:
    """Phrases of ``n`` neighbouring tokens without a weak one, ending in a head word."""
    size = F.size(toks)
    grams = F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.slice(toks, i, n))).otherwise(F.array().cast("array<array<string>>"))
    edge = lambda t: t.isin(L.PHRASE_EDGE)
    ok = lambda g: ~F.exists(g, weak) & ~edge(g[0]) & ~edge(g[n - 1]) & has(g[n - 1], L.PHRASE_END, "u")
    good = F.transform(F.filter(grams, ok), lambda g: F.array_join(g, " "))
    return F.array_distinct(F.filter(good, lambda p: has(p, L.LEGAL_PHRASE, "u")) if n == 3 else good)


def tfidf(df: DataFrame, key: str, sentences: str, all_tokens: str, n: int = 20, boosts: tuple[DataFrame, ...] = ()) -> DataFrame:
    """(key, rank, term, score): the ``n`` best terms of each document, its sentences being the "documents" of the document
    frequency. A term in no kept sentence has frequency 1; ties go to the term that comes first by name. Each of ``boosts``,
    (key, term, boost), is added to the scores, and its terms count where the document's own ranking has none."""
    s = df.select(key, F.posexplode(sentences).alias("i", "s")).select(key, "i", tokens(F.col("s")).alias("t"))
    n_s = df.select(key, F.greatest(F.size(sentences), F.lit(1)).alias("n_s"))
    uni = df.select(key, F.explode(all_tokens).alias("term")).filter(~weak(F.col("term"))).groupBy(key, "term").agg(F.count("*").cast("double").alias("tf"))
    grams = s.select(key, F.explode(F.concat(F.transform(_phrases(F.col("t"), 2), lambda p: F.struct(p.alias("term"), F.lit(1.0).alias("w"))), F.transform(_phrases(F.col("t"), 3), lambda p: F.struct(p.alias("term"), F.lit(1.3).alias("w"))))).alias("g"))
    gram_tf = grams.groupBy(key, F.col("g.term").alias("term")).agg(F.sum("g.w").alias("tf"), F.count("*").alias("df"))
    uni_df = s.select(key, F.explode(F.array_distinct(F.filter("t", lambda t: ~weak(t)))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("df"))
    terms = uni.join(uni_df, [key, "term"], "left").unionByName(gram_tf).join(n_s, key)
    idf = F.log((1 + F.col("n_s")) / (1 + F.coalesce("df", F.lit(1)))) + 1
    score = F.col("tf") * idf * F.when(F.col("term").contains(" "), 1.35).otherwise(1.0) * F.when(has(F.col("term"), L.LEGAL_PHRASE, "u"), 1.2).otherwise(1.0)
    w = Window.partitionBy(key).orderBy(F.desc("score"), "term")
    scored = terms.select(key, "term", F.round(score, 4).alias("score"))
    if boosts:
        for b in boosts:
            scored = scored.unionByName(b.select(key, "term", F.col("boost").alias("score")))
        scored = scored.groupBy(key, "term").agg(F.round(F.sum("score"), 4).alias("score"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(key, "rank", "term", "score")


def ranked(taught: list[tuple[str, float]], n: int = 20) -> Callable:
    """A function of a document (text, its lower case, its sentences, whether it is legislation): its ``n`` best (term, score), as
    ``tfidf`` gives them with the boosts of the learned terms ``taught`` and, in legislation, of the opening."""
    find = plain.finder([t for t, _ in taught])
    boost = [plain.half_up(b) for _, b in taught]
    kinds, weak, edge, end, legal = plain.Kinds(), plain.WEAK, plain.EDGE, plain.END, plain.LEGAL

    def of(text: str, low: str, sents: list[str], legislation: bool) -> list[tuple[str, float]]:
        within: list[str] = []
        twos: list[str] = []
        threes: list[str] = []
        for s in sents:
            ts = plain.tokens(s.lower())
            within.extend(set(ts))
            ks = [kinds[t] for t in ts]
            two, three = set(), set()
            for j, k in enumerate(ks):
                if k & end and j and not (k | ks[j - 1]) & weak and not k & edge:
                    if not ks[j - 1] & edge:
                        two.add(f"{ts[j - 1]} {ts[j]}")
                    if j > 1 and not ks[j - 2] & (weak | edge) and (k | ks[j - 1] | ks[j - 2]) & legal:
                        three.add(f"{ts[j - 2]} {ts[j - 1]} {ts[j]}")
            twos.extend(two)
            threes.extend(three)
        df, n_s = Counter(within), max(len(sents), 1)
        idf = lambda d: math.log((1 + n_s) / (1 + d)) + 1
        raw = {t: c * idf(df[t] or 1) * (1.2 if kinds[t] & legal else 1.0) for t, c in Counter(plain.tokens(low)).items() if not kinds[t] & weak}
        for grams, w in ((twos, 1.0), (threes, 1.3)):
            for t, c in Counter(grams).items():
                raw[t] = c * w * idf(c) * 1.35 * (1.2 if any(kinds[x] & legal for x in t.split(" ")) else 1.0)
        more: dict[str, float] = {}
        for t, b in [*((taught[i][0], boost[i]) for i in find(low)), *(_opened(text, 20).items() if legislation else ())]:
            more[t] = more.get(t, 0.0) + b
        whole = raw | {t: raw.get(t, 0.0) + b for t, b in more.items()}
        # only what rounding can still bring among the best is rounded
        least = heapq.nlargest(n, whole.values())[-1] - 0.001 if whole else 0.0
        exact = lambda t: plain.half_up(plain.half_up(raw.get(t, 0.0)) + more.get(t, 0.0))
        best = sorted((-exact(t), t) for t, v in whole.items() if v >= least)[:n]
        return [(t, -v) for v, t in best]

    return of


def _opened(text: str, n: int) -> dict[str, float]:
    """``opening_boosts`` of one text."""
    kinds = plain.Kinds()
    t = [x for x in plain.tokens(text[:1200].lower()) if x in ("act", "bill") or not kinds[x] & plain.WEAK][:n]
    out: dict[str, float] = {}
    rows = [(x, 5.0 - min(i, 12) * 0.18) for i, x in enumerate(t)]
    rows += [(" ".join(t[i : i + size]), 18.0 + max(0, 20 - i) + extra) for size, extra in ((2, 1.0), (3, 1.3)) for i in range(len(t) - size + 1)]
    for x, b in rows:
        out[x] = max(b, out.get(x, b))
    return out


def sentence_scores(df: DataFrame, key: str, sentences: str, keywords: DataFrame) -> DataFrame:
    """(key, i, sentence, score): by the keywords a sentence holds, its place, cues and length in bytes."""
    kw = keywords.groupBy(key).agg(F.collect_list(F.struct("term", "score")).alias("kw"))
    x = df.select(key, sentences).join(kw, key, "left").select(key, "kw", F.posexplode(sentences).alias("i", "sentence"))
    low = F.lower("sentence")
    base = F.aggregate(F.coalesce("kw", F.array().cast("array<struct<term:string,score:double>>")), F.lit(0.0), lambda a, k: a + F.when(low.contains(k["term"]), k["score"]).otherwise(0.0))
    size = F.octet_length("sentence")
    cue = lambda p, v: F.when(has(F.col("sentence"), p, "iu"), v).otherwise(0.0)
    length = F.when((size > 80) & (size < 350), 1.0).when((size < 40) | (size > 500), -1.5).otherwise(0.0)
    score = base + F.when(F.col("i") < 4, 2.0).otherwise(0.0) + cue(L.SUMMARY_CUE, 3.0) + cue(L.OUTCOME_CUE, 3.5) + cue(L.PRINCIPLE_CUE, 1.5) + length
    return x.select(key, "i", "sentence", F.round(score, 6).alias("score"))


def extract(scored: DataFrame, key: str, n: int) -> DataFrame:
    """(key, summary): the best ``n`` sentences in their order, none that shares 0.8 of the smaller word set with one chosen
    before it."""
    one = F.struct((-F.col("score")).alias("neg"), F.col("i"), F.col("sentence"), word_set(F.col("sentence")).alias("w"))
    lists = scored.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("c"))
    kind = "array<struct<i:int,sentence:string,w:array<string>>>"

    def step(chosen, c):
        near = F.exists(chosen, lambda k: (F.size(c["w"]) > 0) & (F.size(k["w"]) > 0) & (F.size(F.array_intersect(c["w"], k["w"])) / F.greatest(F.lit(1), F.least(F.size(c["w"]), F.size(k["w"]))) >= 0.8))
        return F.when((F.size(chosen) >= n) | near, chosen).otherwise(F.concat(chosen, F.array(F.struct(c["i"].alias("i"), c["sentence"].alias("sentence"), c["w"].alias("w")))))

    chosen = F.aggregate("c", F.array().cast(kind), step)
    ordered = F.array_sort(F.transform(chosen, lambda x: F.struct(x["i"].alias("i"), x["sentence"].alias("s"))))
    return lists.select(key, F.array_join(F.transform(ordered, lambda x: x["s"]), " ").alias("summary"))


def _opening(size: int, extra: float):
    return lambda i: F.struct(F.array_join(F.slice("t", i + 1, size), " ").alias("term"), (F.lit(18.0) + F.greatest(F.lit(0), 20 - i) + extra).cast("double").alias("boost"))


def opening_boosts(df: DataFrame, key: str, text: str, n: int = 20) -> DataFrame:
    """(key, term, boost): the strong tokens of the first 1200 characters and their phrases of two and three."""
    t = F.filter(tokens(F.regexp_replace(F.trim(F.substring(text, 1, 1200)), r"\s+", " ")), lambda x: x.isin("act", "bill") | ~weak(x))
    x = df.select(key, F.slice(t, 1, n).alias("t"))
    rows = [F.transform(F.col("t"), lambda a, i: F.struct(a.alias("term"), (F.lit(5.0) - F.least(i, F.lit(12)) * 0.18).alias("boost")))]
    for size, extra in ((2, 1.0), (3, 1.3)):
        seq = F.when(F.size("t") >= size, F.sequence(F.lit(0), F.size("t") - size)).otherwise(F.array().cast("array<int>"))
        rows.append(F.transform(seq, _opening(size, extra)))
    return x.select(key, F.explode(F.concat(*rows)).alias("r")).groupBy(key, F.col("r.term").alias("term")).agg(F.max("r.boost").alias("boost"))
