"""Reading level of English texts.

How rare the words of a text are is told by the smallest frequency-ranked vocabulary that covers a fixed share of its
words: words are counted over the English texts of both tables and ranked, and a text's coverage rank is the rank that
``COVER`` of its words don't exceed. Only words that make up ``RANK_SHARE`` of all have a rank of their own (so there are
at most 1/RANK_SHARE ranks, whatever the corpus); all rarer words share the next one. With it go the words per sentence and
the letters per word.

Calibration is SQL: for each band of the labelled texts (majority of the raters, ties to the lower band) the median and
the median deviation of each measure (by sketches of bounded size, to a ten-thousandth of the ranks), which a share of wrong labels hardly moves; a text gets the band under which its
measures are likeliest.

A text has a level if it is English and longer than 20 characters with at least one word; others have none. Without
labels no band is given. Repeated rows count as often as they occur; ids are kept apart by their table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut

from .language import detect, learn

COVER, RANK_SHARE = 0.9, 2e-6
BANDS = ("basic", "general", "specialist")
_BREAK = re.compile(r"[-¬­]\s?\n\s?(?=[a-z])")
_WORD = re.compile(r"[A-Za-z]+(?:['’][A-Za-z]+)?")
_STOP = re.compile(r"[.!?](?<=[A-Za-z0-9%)\"”’'].)(?<!\b[A-Za-z].)(?<!\b(?:Mr|Dr|St|No|no|vs|Co).)(?<!\b(?:Mrs|Adv|Ltd|Pvt|nos|e\.g|i\.e|Ave|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec).)[\"'”’)]*(?:\s+|$)")
_BLANK = re.compile(r"\n[ \t]*\n")
_THREE = re.compile(r"(?:[A-Za-z](?:[A-Za-z'’])*[^A-Za-z]+){2}[A-Za-z]")


def texts(legal: DataFrame, summaries: DataFrame) -> DataFrame:
    """(source_table, row_id, text) of the texts that may have a level; a row without an id is left out."""
    legal, summaries = legal.filter("id is not null"), summaries.filter("id is not null")
    a = legal.select(F.lit("legal_documents").alias("source_table"), F.col("id").alias("row_id"), F.col("extracted_text").alias("text"))
    b = summaries.select(F.lit("summaries").alias("source_table"), F.col("id").alias("row_id"), F.col("citizen_summary").alias("text"))
    return a.unionByName(b).filter("length(text) > 20")


def _pieces(text: str) -> Counter:
    """What stands between blanks, words broken across lines joined; words are looked for in different pieces only."""
    return Counter(_BREAK.sub("", text).lower().split())


def _sentences(text: str) -> int:
    """The number of sentences of three words or more, at least one."""
    ends = sorted([m.span() for m in _STOP.finditer(text)] + [m.span() for m in _BLANK.finditer(text)])
    n, at = 0, 0
    for a, b in [*ends, (len(text), len(text))]:
        n += bool(_THREE.search(text, at, a))
        at = max(at, b)
    return n or 1


def ranks(t: DataFrame, model: dict) -> DataFrame:
    """(word, rank) of the words frequent enough for a rank of their own."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pieces: Counter = Counter()
            for text in b["text"]:
                if detect(text, model) == "en":
                    pieces.update(_pieces(text))
            c: Counter = Counter()
            for piece, n in pieces.items():
                for w in _WORD.findall(piece):
                    c[w] += n
            if c:
                yield pd.DataFrame({"word": list(c.keys()), "n": list(c.values())})

    counts = cut(t.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    own = counts.filter(F.col("n") >= max(2, RANK_SHARE * total))
    # at most 1/RANK_SHARE rows
    return own.selectExpr("word", "row_number() over (order by n desc, word) as rank")


def measures(t: DataFrame) -> DataFrame:
    """(source_table, row_id, coverage_rank, words_per_sentence, letters_per_word) of the English texts."""
    model = learn(t)
    own = ranks(t, model).toPandas()
    rank = t.sparkSession.sparkContext.broadcast(dict(zip(own["word"], own["rank"], strict=True)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, rest = rank.value, len(rank.value) + 1
        seen: dict[str, list[tuple[int, int]]] = {}
        for b in batches:
            rows = []
            for table_, row, text in zip(b["source_table"], b["row_id"], b["text"], strict=True):
                if detect(text, model) != "en":
                    continue
                by, words, letters = Counter(), 0, 0
                for piece, n in _pieces(text).items():
                    got = seen.get(piece)
                    if got is None:
                        if len(seen) > 200_000:
                            seen.clear()
                        got = seen[piece] = [(of.get(w, rest), len(w)) for w in _WORD.findall(piece)]
                    for r, k in got:
                        by[r] += n
                        words += n
                        letters += n * k
                if not words:
                    continue
                left = math.ceil(words * COVER)
                for r in sorted(by):
                    left -= by[r]
                    if left <= 0:
                        break
                rows.append((table_, row, r, words / _sentences(text), letters / words))
            yield pd.DataFrame(rows, columns=["source_table", "row_id", "coverage_rank", "words_per_sentence", "letters_per_word"])

    return t.mapInPandas(work, "source_table string, row_id long, coverage_rank long, words_per_sentence double, letters_per_word double")


def levels(legal: DataFrame, summaries: DataFrame, labels: DataFrame) -> DataFrame:
    """The measures of each English text with its band."""
    m = cut(measures(texts(legal, summaries)))
    return m.sparkSession.sql(
        """
        with x as (select *, ln(coverage_rank) as a, ln(words_per_sentence) as b, letters_per_word as c from {measured}),
        votes as (select source_table, row_id, band, count(*) as n from {labels} where band is not null group by all),
        voted as (select source_table, row_id, max_by(band, struct(n, case band when 'basic' then 3 when 'general' then 2 else 1 end)) as band from votes group by all),
        known as (select v.band, x.a, x.b, x.c from voted v join x using (source_table, row_id)),
        middle as (select band, count(*) as n, approx_percentile(a, 0.5, 10000) as a, approx_percentile(b, 0.5, 10000) as b, approx_percentile(c, 0.5, 10000) as c from known group by band),
        scale as (select k.band, greatest(approx_percentile(abs(k.a - m.a), 0.5, 10000), 0.05) as sa, greatest(approx_percentile(abs(k.b - m.b), 0.5, 10000), 0.05) as sb,
            greatest(approx_percentile(abs(k.c - m.c), 0.5, 10000), 0.05) as sc from known k join middle m using (band) group by k.band),
        bands as (select m.band, m.n, m.a as ma, m.b as mb, m.c as mc, sa, sb, sc from middle m join scale s using (band))
        select x.source_table, x.row_id, x.coverage_rank, x.words_per_sentence, x.letters_per_word,
            max_by(band, ln(s.n) - ln(sa * sb * sc) - 0.2275 * (pow((x.a - ma) / sa, 2) + pow((x.b - mb) / sb, 2) + pow((x.c - mc) / sc, 2))) as band
            from (select x.*, explode(array('basic', 'general', 'specialist')) as band from x) x left join bands s using (band)
            group by x.source_table, x.row_id, x.coverage_rank, x.words_per_sentence, x.letters_per_word""",
        measured=m,
        labels=labels.select("source_table", "row_id", "band"),
    )


def found(legal: DataFrame, summaries: DataFrame, labels: DataFrame) -> DataFrame:
    """(source_table, row_id) of the texts of band specialist."""
    return levels(legal, summaries, labels).filter("band = 'specialist'").select("source_table", "row_id").distinct()
