"""A mixture of sources to target weights, by a low-discrepancy schedule.

Sizes are tokens of a public tokenizer, counted in Arrow batches. The mixture's size is the largest at which every source
that has text can give its share without repeating a document more often than it may; a source without text leaves its
slots out, and the shares that come out are reported beside the targets.

The mixture is a row of slots of one block of tokens each. Slot i takes the point frac((i + 1/2) * golden ratio) and, by the
cumulative weights, the source in whose interval the point falls: after any number of slots every source is within a few
blocks of its share. A source's documents are shuffled anew for each pass by a keyed hash and laid end to end; the r-th slot
of a source takes the documents that begin in the source's r-th block.

Positions within a source come from running sums in two levels, inside many hash ranges and over the ranges' totals, and
so do the slots' ranks: a source that holds a third of all rows is never ordered in one task, for ranges and runs have some
``SLICE_ROWS`` rows, and so as many as the rows ask for. There are ``BLOCKS`` slots, more where a block would exceed
``BLOCK_TOKENS``. Only the table of targets (a row for each source named) and the tokenizer's vocabulary are held on the driver.

Source names are compared without case and outer blanks. Null and empty texts, sources without a target, and targets that
are null or not positive stay out; a target named twice counts with the sum of its shares and its largest cap. Copies of a
text are documents of their own. Empty tables give an empty mixture.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import written

# Fixed value: how the tokenizer parts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GOLDEN, BLOCKS, BLOCK_TOKENS, SLICE_ROWS = 0.6180339887498949, 4096, 10_000_000, 100_000
BROADCAST_ROWS = 200_000


def name(c: str) -> Column:
    return F.lower(F.regexp_replace(F.col(c), r"^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+$", ""))


def token_counts(df: DataFrame, tokenizer: str) -> DataFrame:
    """``df(doc_id, source, text)`` as (doc_id, source, n_tokens); special tokens' strings are ordinary text. ``tokenizer`` is
    the path of a vocabulary on the driver; the vocabulary travels to the tasks."""
    with open(tokenizer, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": [len(coder.encode_ordinary(t)) for t in b["text"]]})

    return df.mapInPandas(work, "doc_id long, source string, n_tokens long")


def _plan(docs: DataFrame, targets: DataFrame) -> tuple[list, int, int]:
    """[(source, share, cap, tokens)] of the targets, the mixture's size in tokens, and the rows of the largest source."""
    t = targets.select(name("source").alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).filter("source is not null and target_share > 0 and max_repeats > 0")
    t = t.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = t.join(have, "source", "left").orderBy("source").collect()
    plan = [(r.source, float(r.share), int(r.cap), int(r.tokens or 0)) for r in rows]
    reach = [c * n / s for _, s, c, n in plan if n]
    return plan, int(min(reach, default=0)), max((r.documents or 0 for r in rows), default=0)


def _running(df: DataFrame, keys: list[str], h: str, size: str, slices: int) -> DataFrame:
    """``df`` with ``before``: the sum of ``size`` over the rows of the same keys that come earlier by ``h``."""
    part = F.floor((F.col(h).cast("double") + 9.223372036854775808e18) / 1.8446744073709551616e19 * slices).cast("int")
    df = df.withColumn("_slice", F.least(F.greatest(part, F.lit(0)), F.lit(slices - 1)))
    # a source's slices: a table bounded by sources, passes and slices
    totals = df.groupBy(*keys, "_slice").agg(F.sum(size).alias("_n"))
    base = totals.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, "_slice").orderBy(h, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_in", F.coalesce(F.sum(size).over(inner), F.lit(0))).join(base, [*keys, "_slice"]).withColumn("before", F.col("_in") + F.col("_base")).drop("_in", "_base", "_slice")


def schedule(spark, plan: list, n_slots: int, slices: int) -> DataFrame:
    """(source, rank, slot): the slots of each source in order. Slots are ranked within runs of consecutive slots and over
    the runs' counts."""
    total = sum(s for _, s, _, _ in plan)
    slots = spark.range(n_slots).withColumn("u", F.expr(f"(id + 0.5D) * {GOLDEN!r}D - floor((id + 0.5D) * {GOLDEN!r}D)"))
    cells, upto, bounds = 4 * len(plan), 0.0, []
    for k, (s, share, _, _) in enumerate(plan):
        low, upto = upto, 2.0 if k == len(plan) - 1 else upto + share / total
        bounds.append((s, low, upto))
    # the sources whose stretch of the weights reaches into a cell; at most five for each source on average
    cell = lambda x: F.least(F.floor(F.col(x) * cells), F.lit(cells - 1))
    into = spark.createDataFrame(bounds, "source string, low double, upto double").select("*", F.explode(F.sequence(cell("low"), cell("upto"))).alias("cell"))
    slots = slots.withColumn("cell", cell("u")).join(F.broadcast(into) if len(plan) * 5 <= BROADCAST_ROWS else into, "cell").filter("u >= low and u < upto")
    slots = slots.select(F.col("id").alias("slot"), "source", F.floor(F.col("id") / max(1, -(-n_slots // slices))).alias("run"))
    counts = slots.groupBy("source", "run").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    r = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot"))
    return slots.withColumn("r", r).join(base, ["source", "run"]).select("source", (F.col("r") - 1 + F.col("base")).alias("rank"), "slot")


def mixture(docs: DataFrame, targets: DataFrame, tokenizer: str, blocks: int = BLOCKS, seed: int = 0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(slot, source, doc_id, repeat_no, n_tokens): the mixture's documents, slot by slot."""
    mixed, _, _ = _mixed(docs, targets, tokenizer, blocks, seed, slice_rows)
    return mixed


def _mixed(docs: DataFrame, targets: DataFrame, tokenizer: str, blocks: int, seed: int, slice_rows: int) -> tuple[DataFrame, list, DataFrame]:
    spark = docs.sparkSession
    known = targets.select(name("source").alias("source")).distinct()
    own = docs.select("doc_id", name("source").alias("source"), "text").filter("doc_id is not null and text is not null and text <> ''").join(F.broadcast(known), "source", "left_semi")
    sized = written(token_counts(own.select("doc_id", "source", "text"), tokenizer).filter("n_tokens > 0"), "tokens")
    plan, size, most = _plan(sized, targets)
    if not size:
        return spark.createDataFrame([], "slot long, source string, doc_id long, repeat_no int, n_tokens long"), plan, sized
    total = sum(s for _, s, _, _ in plan)
    block = max(1, min(size // blocks, BLOCK_TOKENS))
    n_slots = -(-size // block)
    passes = spark.createDataFrame([(s, min(c, int(size * share / total // n) + 1)) for s, share, c, n in plan if n], "source string, passes int")
    each = sized.join(F.broadcast(passes), "source").select("source", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), "passes")).alias("repeat_no"))
    each = each.withColumn("h", F.xxhash64(F.lit(seed), "repeat_no", "doc_id"))
    placed = _running(each, ["source", "repeat_no"], "h", "n_tokens", most // slice_rows + 1)
    whole = spark.createDataFrame([(s, n) for s, _, _, n in plan if n], "source string, tokens long")
    at = F.floor(((F.col("repeat_no") - 1) * F.col("tokens") + F.col("before")) / block)
    placed = placed.join(F.broadcast(whole), "source").select("source", "doc_id", "repeat_no", "n_tokens", at.alias("rank"))
    slots = schedule(spark, plan, n_slots, n_slots // slice_rows + 1)
    mixed = placed.join(F.broadcast(slots) if n_slots <= BROADCAST_ROWS else slots, ["source", "rank"]).select("slot", "source", "doc_id", "repeat_no", "n_tokens")
    return mixed, plan, sized


def shares(docs: DataFrame, targets: DataFrame, tokenizer: str, blocks: int = BLOCKS, seed: int = 0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_documents, most_repeats) of every target source."""
    mixed, plan, _ = _mixed(docs, targets, tokenizer, blocks, seed, slice_rows)
    spark = docs.sparkSession
    got = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).groupBy("source").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_documents"), F.max("k").alias("most_repeats"))
    goal = spark.createDataFrame([(s, share) for s, share, _, _ in plan], "source string, target_share double")
    out = goal.join(got, "source", "left").fillna(0, ["n_tokens", "n_documents", "most_repeats"])
    # a row for each target
    return out.withColumn("actual_share", F.coalesce(F.try_divide("n_tokens", F.sum("n_tokens").over(Window.partitionBy())), F.lit(0.0))).select("source", "target_share", "actual_share", "n_tokens", "n_documents", "most_repeats")
