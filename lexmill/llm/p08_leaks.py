"""Evaluation passages inside a training corpus, by a positional inverted index.

Both sides are folded to skeletons that misread, lost and wrongly decoded characters leave alike, and parted into
numbered terms. ``index`` holds, for every term of the training corpus, each document and the term's position in it. It is
written once to the shared folder and serves any number of test sets (``postings=``); a term that lost a character is looked
up under the term it came from.

Of each run of ``words`` consecutive test terms the rarest three (by their number of postings) are seeds. A posting of
a seed gives a document, an item and an offset; those that at least two seeds agree on are candidates, whose full
offset-adjusted lists are then intersected. A run of at least ``words`` matched positions is a leak; a candidate that
reaches as many matches without such a run is a proximity match. For proximity, offsets within ``drift`` of each other count
together, so a word put in or lost on the way doesn't break a match.

The tables of the test items travel to the tasks if they have at most ``BROADCAST_ROWS`` rows; larger ones are joined, with
the same result. The corpus is never broadcast. Copies of a file are documents of their own. Null or empty texts hold no
term; items of fewer words than a run match nothing; repeated item rows give one pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import cut, written

from .cues import fold, lines_once, spoken

WORDS, SEEDS, DRIFT, BROADCAST_ROWS = 12, 3, 4, 1_000_000


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast where its rows are few; a large one is joined as tables are. ``df`` has been cut."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _terms(x):
    return F.filter(F.split(x, " "), lambda t: t != "")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, ipos, term, lost) of the test items."""
    words = lambda x: _terms(fold(x))
    # the second form is that of a text whose sharp s is lost
    both = F.arrays_zip(words(F.col("text")).alias("term"), words(F.replace("text", F.lit("ß"), F.lit(""))).alias("lost"))
    t = items.filter("item_id is not null and text is not null").select("item_id", F.posexplode(both).alias("ipos", "w")).select("item_id", "ipos", "w.term", F.coalesce("w.lost", "w.term").alias("lost")).distinct()
    return cut(t)


def variants(terms: DataFrame) -> DataFrame:
    """(seen, term): the forms under which a term is looked for: itself, and without one of its characters if it has
    five or more; a form that is a term itself stands for that term only."""
    own = terms.select("term").distinct()
    lost = own.filter("length(term) >= 5").select("term", F.explode(F.sequence(F.lit(1), F.length("term"))).alias("k")).select(F.expr("concat(substring(term, 1, k - 1), substring(term, k + 1))").alias("seen"), "term")
    lost = lost.unionByName(terms.filter("lost <> term").select(F.col("lost").alias("seen"), "term"))
    lost = lost.join(own.select(F.col("term").alias("seen")), "seen", "left_anti")
    return own.select(F.col("term").alias("seen"), "term").unionByName(lost).distinct()


def index(corpus: DataFrame) -> DataFrame:
    """The written postings (seen, doc_id, pos) of every term of the corpus."""
    body = corpus.filter("doc_id is not null and text is not null").select("doc_id", fold(lines_once(spoken(F.col("text")))).alias("body"))
    return written(body.select("doc_id", F.posexplode(_terms(F.col("body"))).alias("pos", "seen")), "index")


def looked_up(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The written postings (term, doc_id, pos) of the test items' terms."""
    return written(postings.join(_small(cut(variants(terms))), "seen").select("term", "doc_id", "pos"), "postings")


def matches(corpus: DataFrame | None, items: DataFrame, words: int = WORDS, drift: int = DRIFT, postings: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, kind, run_words, matched_words, item_words): ``phrase`` or ``proximity`` matches; without a drift the
    latter stand at one offset. ``postings`` is an index made before, in place of the corpus."""
    terms = item_terms(items)
    post = looked_up(index(corpus) if postings is None else postings, terms)
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    ranked = cut(terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))))
    n = cut(ranked.groupBy("item_id").agg((F.max("ipos") + 1).alias("item_words")))
    # every run of consecutive test terms, and the rarest of its terms
    runs = ranked.join(n, "item_id").select("item_id", "ipos", "term", "df", F.explode(F.expr(f"sequence(greatest(0, ipos - {words - 1}), least(ipos, item_words - {words}))")).alias("run")).filter(F.col("run") >= 0)
    w = Window.partitionBy("item_id", "run").orderBy("df", "ipos")
    seeds = cut(runs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SEEDS).select("item_id", "ipos", "term").distinct())
    hits = post.join(_small(seeds), "term").select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("offset"), "ipos")
    found = hits.groupBy("doc_id", "item_id", "offset").agg(F.count_distinct("ipos").alias("n")).filter("n >= 2").select("doc_id", "item_id", "offset")
    lists = post.join(found, "doc_id").withColumn("ipos", F.col("pos") - F.col("offset")).filter("ipos >= 0")
    own = ranked.select("item_id", "ipos", "term")
    own = _small(cut(own))
    both = lists.join(own, ["item_id", "ipos", "term"]).select("doc_id", "item_id", "offset", "ipos").distinct()
    g = Window.partitionBy("doc_id", "item_id", "offset").orderBy("ipos")
    runs = both.withColumn("island", F.col("ipos") - F.row_number().over(g)).groupBy("doc_id", "item_id", "offset", "island").agg(F.count("*").alias("run"))
    best = runs.groupBy("doc_id", "item_id", "offset").agg(F.max("run").alias("run"), F.sum("run").alias("matched"))
    best = best.groupBy("doc_id", "item_id").agg(F.max("run").alias("run_words"), F.max("matched").alias("matched_words"))
    if drift:
        # two sets of bins, set off by half a bin, hold any two offsets within the drift together
        bins = F.explode(F.array(F.floor(F.col("offset") / (2 * drift)) * 2, F.floor((F.col("offset") + drift) / (2 * drift)) * 2 + 1)).alias("bin")
        near = hits.select("doc_id", "item_id", "ipos", bins).groupBy("doc_id", "item_id", "bin").agg(F.count_distinct("ipos").alias("n")).filter("n >= 2").select("doc_id", "item_id").distinct()
        said = post.join(near, "doc_id").join(own, ["item_id", "term"]).select("doc_id", "item_id", "ipos", (F.col("pos") - F.col("ipos")).alias("offset"))
        near = said.select("doc_id", "item_id", "ipos", bins).distinct().groupBy("doc_id", "item_id", "bin").agg(F.count("*").alias("k")).groupBy("doc_id", "item_id").agg(F.max("k").alias("near"))
        best = best.join(near, ["doc_id", "item_id"], "full").select("doc_id", "item_id", F.coalesce("run_words", F.lit(0)).alias("run_words"), F.greatest("matched_words", "near").alias("matched_words"))
    kind = F.when(F.col("run_words") >= words, "phrase").when(F.col("matched_words") >= words, "proximity")
    return best.withColumn("kind", kind).filter("kind is not null").join(_small(n), "item_id").select("doc_id", "item_id", "kind", "run_words", "matched_words", "item_words")


def found(corpus: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the documents that speak at least twelve consecutive words of an item."""
    return matches(corpus, items, drift=0).filter("kind = 'phrase'").select("doc_id", "item_id")
