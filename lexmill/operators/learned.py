"""The learned model of terms: what an example teaches, the batch model, and what it says of a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions import plain
from lexmill.functions.rx import all_of, squeeze, trim

PER_EXAMPLE, MODEL, PER_CATEGORY, CATEGORIES = 40, 600, 80, 4
SUMS = 200_000  # terms that a task adds up before it sends them on


def runs(text: Column) -> Column:
    """Non-overlapping runs of one to three words of four characters or more that are no stop words."""
    found = F.transform(all_of(F.lower(text), r"\p{L}[\p{L}\p{Mn}'-]{3,}(?:\s+\p{L}[\p{L}\p{Mn}'-]{3,}){0,2}", "u"), squeeze)
    return F.filter(found, lambda t: ~t.isin(L.LEARNED_STOP))


def distinct_examples(df: DataFrame) -> DataFrame:
    """(id, text, target): each example once, by the hash over document, summary, input and target."""
    x = df.select("document_id", "summary_id", trim(F.coalesce("input_text", F.lit(""))).alias("text"), trim(F.coalesce("target_summary", F.lit(""))).alias("target")).filter("text <> '' and target <> ''")
    return x.select(F.sha2(F.concat_ws("|", F.coalesce(F.col("document_id").cast("string"), F.lit("")), F.coalesce(F.col("summary_id").cast("string"), F.lit("")), "text", "target"), 256).alias("id"), "text", "target").dropDuplicates(["id"])


def terms(examples: DataFrame) -> DataFrame:
    """(id, term, weight): at most 40 terms of each example, those that came first winning ties."""
    t = examples.select("id", F.posexplode(runs(F.concat_ws("\n", "text", "target"))).alias("pos", "term"))
    g = t.groupBy("id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).withColumn("weight", F.col("n") * F.when(F.col("term").contains(" "), 1.4).otherwise(1.0))
    w = Window.partitionBy("id").orderBy(F.desc("weight"), "pos")
    return g.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= PER_EXAMPLE).select("id", "term", "weight")


def model(examples: DataFrame, n: int = MODEL) -> DataFrame:
    """(term, weight, examples_seen): the batch model, truncated once at the end; ties by term. ``TakeOrdered`` keeps the
    truncation out of a global sort."""
    seen = examples.agg(F.count("*").alias("examples_seen"))
    top = terms(examples).groupBy("term").agg(F.round(F.sum("weight"), 4).alias("weight")).orderBy(F.desc("weight"), "term").limit(n)
    return top.withColumn("k", F.lit(1)).join(F.broadcast(seen.withColumn("k", F.lit(1))), "k").drop("k")


def held(terms_: list[str]):
    """A column function: the places of the terms that a text contains. Python looks for a plain string several times faster than
    a function of arrays does."""
    find = plain.finder(terms_)

    @F.pandas_udf("array<int>")
    def at(low: pd.Series) -> pd.Series:
        return low.map(find)

    return at


def _boost(learned: DataFrame) -> DataFrame:
    return learned.select("term", F.greatest(F.lit(0.25), F.least(F.lit(4.0), F.col("weight") / F.greatest(F.lit(1), F.col("examples_seen")))).alias("boost"))


def boosts(texts: DataFrame, key: str, text: str, learned: DataFrame) -> DataFrame:
    """(key, term, boost): learned terms that a text contains, weight by example held within 0.25 and 4. The model has at most
    600 rows, so it travels with the function that looks for its terms."""
    m = _boost(learned).orderBy("term").collect()
    at = held([r.term for r in m])(F.lower(F.coalesce(text, F.lit(""))))
    e = F.array(*(F.struct(F.lit(r.term).alias("term"), F.lit(r.boost).alias("boost")) for r in m)) if m else F.lit(None).cast("array<struct<term:string,boost:double>>")
    return texts.select(key, F.explode(at).alias("at")).join(F.broadcast(texts.sparkSession.range(1).select(F.posexplode(e).alias("at", "e"))), "at").select(key, "e.term", F.round("e.boost", 4).alias("boost"))


def category_model(examples: DataFrame, n: int = PER_CATEGORY) -> DataFrame:
    """(category, term, weight): of each area of law in ``labels``, the ``n`` heaviest terms of its examples' texts with its name;
    truncated once at the end, ties by term."""
    x = examples.select("id", "text", F.explode("labels").alias("target")).select(F.concat_ws("|", "id", "target").alias("id"), "text", "target")
    t = terms(x).withColumn("category", F.substring_index("id", "|", -1)).groupBy("category", "term").agg(F.round(F.sum("weight"), 4).alias("weight"))
    w = Window.partitionBy("category").orderBy(F.desc("weight"), "term")
    return t.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")


def _totals(model_: list[tuple[str, str, float]]) -> Callable[[str], dict[str, float]]:
    """What the terms of each category that a text contains weigh together."""
    find = plain.finder([t for _, t, _ in model_])

    def of(low: str) -> dict[str, float]:
        out: dict[str, float] = {}
        for i in find(low):
            c, _, w = model_[i]
            out[c] = out.get(c, 0.0) + w
        return out

    return of


def categories(texts: DataFrame, key: str, text: str, model_: DataFrame, n: int = CATEGORIES) -> DataFrame:
    """(key, category, score, rank): at most ``n`` areas of law whose terms in the text weigh 2 or more together; ties by name. The
    model has at most 80 rows a category, so it travels with the function that looks for its terms."""
    m = model_.select("category", "term", "weight").orderBy("category", "term").collect()
    totals_of = _totals([tuple(r) for r in m])

    @F.pandas_udf("array<struct<category:string,score:double>>")
    def totals(low: pd.Series) -> pd.Series:
        return low.map(lambda x: [{"category": c, "score": w} for c, w in totals_of(x).items()])

    scored = texts.select(key, F.explode(totals(F.lower(F.coalesce(text, F.lit(""))))).alias("e")).select(key, "e.category", F.round("e.score", 4).alias("score")).filter("score >= 2.0")
    w = Window.partitionBy(key).orderBy(F.desc("score"), "category")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def models(examples: DataFrame, text: str = "cleaned") -> tuple[list[tuple[str, float]], list[tuple[str, str, float]]]:
    """``model`` as (term, boost) and ``category_model`` as (category, term, weight), both from one pass over the examples (id, text,
    target and their ``text`` for the patterns). The driver gets at most 600 rows and 80 a category."""
    keep = PER_EXAMPLE

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, str], float] = {}
        rows = lambda: pd.DataFrame([(c, t, w) for (c, t), w in sums.items()], columns=["category", "term", "weight"])
        for b in batches:
            for x, target, clean in zip(b["text"], b["target"], b[text], strict=True):
                runs_of = plain.runs_before(x)
                for c, tail in [("", target), *((c, c) for c in plain.categories(clean))]:
                    for t, w in plain.heaviest(runs_of(tail), keep):
                        sums[c, t] = sums.get((c, t), 0.0) + w
            if len(sums) > SUMS:
                yield rows()
                sums.clear()
        yield rows()

    n = examples.count()
    t = examples.select("text", "target", text).mapInPandas(work, "category string, term string, weight double").groupBy("category", "term").agg(F.round(F.sum("weight"), 4).alias("weight"))
    w = Window.partitionBy("category").orderBy(F.desc("weight"), "term")
    most = F.when(F.col("category") == "", MODEL).otherwise(PER_CATEGORY)
    got = t.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= MODEL).filter(F.col("r") <= most).orderBy("category", "term").collect()
    return [(r.term, max(0.25, min(4.0, r.weight / max(1, n)))) for r in got if not r.category], [(r.category, r.term, r.weight) for r in got if r.category]


def best_categories(model_: list[tuple[str, str, float]], n: int = CATEGORIES) -> Callable[[str], list[str]]:
    """A function of a lower-case text: its ``categories`` by a collected model, in order."""
    totals_of = _totals(model_)

    def of(low: str) -> list[str]:
        scored = ((plain.half_up(w), c) for c, w in totals_of(low).items())
        return [c for _, c in sorted((-w, c) for w, c in scored if w >= 2.0)[:n]]

    return of
