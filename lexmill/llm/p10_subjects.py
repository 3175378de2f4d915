"""Subject areas of subtitle files, by label propagation over a document-similarity graph.

Two files are similar in so far as their cues share telling terms. That graph is kept in factored form, as the edges between
documents and terms (weight: the share of the document's cues that hold the term): the mean similarity of a file to all files
of a subject is then two joins, exact, and a term shared by very many files is one node and never a clique of pairs. Files
that speak the same words in the same cues (re-timed copies; verified by a hash of all their words) are linked directly:
a label of one is a label of all.

Edges are verified: a term is a link only while its labelled neighbourhood leans to one subject (``LEAN``). A term that
stands in ``LEAST`` trusted files and leans nowhere is closed after the first round: its edges, most of all edges, carry
nothing and aren't moved again.

Hand-labelled files and their copies are trusted seeds, clamped in every round and in the result; a file labelled as none of
the subjects seeds a class of its own. Each round sends the documents' subjects to the terms and the terms' back to the
documents, by joins, until under ``SETTLED`` of the telling terms change (or ``MAX_ROUNDS`` are done, a documented stop). A
document keeps every subject that enough of its cues lean to, so one can hold several. At the end each cue speaks of the
subject its telling terms agree on, and a document has the subjects that ``THRESHOLD`` of its cues speak of.

Terms travel with the tasks where there are at most ``MAX_TERMS``; more of them are joined, in the last step to the cues'
words, with the same result. Null and empty texts and files without a cue have no subject but a label's; copies of a
file are files of their own; labels of unknown files and repeated labels are ignored; a file labelled both with a subject and
as none of them has the subject. Without labels nothing has a subject.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut, written

THRESHOLD, LEAN, LEAST, MAX_TERMS = 0.16, 0.6, 3, 500_000
SETTLED, MAX_ROUNDS = 0.002, 8
NONE = "none of them"
_TIME = re.compile(r"^[^\n]*-->[^\n]*$", re.M)
_MARKUP = re.compile(r"<[^<>\n]{0,60}>|\{[^{}\n]{0,60}\}|\[[^\[\]\n]{0,60}\]|\([^()\n]{0,60}\)|♪[^♪\n]*♪?")
_WORD = re.compile(r"[^\W\d_]{3,}")
_MOJIBAKE = re.compile(r"[ÃÂâ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œžŸ¡-¿]{1,2}")


def _decode(m: re.Match) -> str:
    for code in ("cp1252", "latin1"):
        try:
            return m.group().encode(code).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return m.group()


def cues(text: str) -> list[list[str]]:
    """The words of each cue, lower case; adverts and credits are cues like others."""
    if "Ã" in text or "â" in text:
        text = _MOJIBAKE.sub(_decode, text)
    parts = _TIME.split(_MARKUP.sub("", text).lower())
    return [w for p in parts[1:] if (w := _WORD.findall(p))]


def nodes(docs: DataFrame) -> DataFrame:
    """The written files (doc_id, copy, n_cues, edges): in how many of its cues a file holds each term; ``copy`` is the same
    for files that speak the same words."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            copies, sizes, terms, counts = [], [], [], []
            for text in b["text"]:
                c = cues(text)
                n: Counter = Counter()
                for words in c:
                    n.update(set(words))
                copies.append(hashlib.blake2b("\n".join(map(" ".join, c)).encode("utf-8", "replace"), digest_size=16).digest())
                sizes.append(len(c))
                terms.append(list(n.keys()))
                counts.append(list(n.values()))
            yield pd.DataFrame({"doc_id": b["doc_id"], "copy": copies, "n_cues": sizes, "terms": terms, "counts": counts})

    each = docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(work, "doc_id long, copy binary, n_cues int, terms array<string>, counts array<int>")
    return written(each.filter("n_cues > 0").select("doc_id", "copy", "n_cues", F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("n")).alias("edges")), "files")


def seeded(files: DataFrame, labels: DataFrame) -> DataFrame:
    """The files with ``seeds``: (subject, part) of the labels that they or copies of them have, else null."""
    own = labels.join(files.select("doc_id", "copy"), "doc_id").select("copy", "subject").distinct()
    size = own.groupBy("copy").agg(F.collect_set("subject").alias("all")).select("copy", F.when(F.size("all") > 1, F.array_remove("all", NONE)).otherwise(F.col("all")).alias("all"))
    seeds = size.select("copy", F.transform("all", lambda x: F.struct(x.alias("subject"), (1.0 / F.size("all")).alias("part"))).alias("seeds"))
    return written(files.join(seeds, "copy", "left").select("doc_id", "n_cues", "edges", "seeds"), "seeded")


def _sums(held: DataFrame) -> DataFrame:
    """(term, subject, w, part, docs) of ``held(term, n, subject, part)``."""
    return held.groupBy("term", "subject").agg(F.sum("n").alias("w"), F.sum(F.col("n") * F.col("part")).alias("part"), F.sum("part").alias("docs"))


def leaning(sums: DataFrame, files: DataFrame) -> DataFrame:
    """(term, subject, lean) of ``sums`` over the documents' ``files(subject, c, part)``: of the cues with the term, the part in
    files of the subject, where one subject has ``LEAN`` of them and half of what its base rate leaves open. A file of two
    subjects counts for either, once in all."""
    total = files.agg(F.sum("part")).first()[0] or 1.0
    # a row for each subject
    base = files.groupBy("subject").agg((F.sum("c") / total).alias("base"))
    per = sums.groupBy("term", "subject").agg(F.sum("w").alias("w"), F.sum("part").alias("part"), F.sum("docs").alias("docs"))
    per = per.groupBy("term").agg(F.sum("part").alias("all"), F.sum("docs").alias("docs"), F.max(F.struct("w", "subject")).alias("top"))
    # one file's worth of doubt keeps rare terms from leaning by chance
    lean = F.col("top.w") / (F.col("all") + 0.5)
    return per.filter(f"docs >= {LEAST}").select("term", F.col("top.subject").alias("subject"), lean.alias("lean")).join(F.broadcast(base), "subject").select("term", "subject", "lean", ((F.col("lean") >= LEAN) & (F.col("subject") != NONE) & (F.col("lean") >= F.col("base") + 0.5 * (1 - F.col("base")))).alias("telling"))


def _small(terms: DataFrame, n: int, max_terms: int) -> DataFrame:
    """``terms``, of ``n`` rows, to be broadcast where they are few."""
    return F.broadcast(terms) if n <= max_terms else terms


def propagate(files: DataFrame, max_rounds: int = MAX_ROUNDS, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, subject, lean) of the telling terms, from ``seeded`` files."""
    tied = files.filter("seeds is not null")
    trusted = cut(_sums(tied.select("seeds", F.explode("edges").alias("e")).select("e.term", "e.n", F.explode("seeds").alias("s")).select("term", "n", "s.subject", "s.part")))
    seeds = tied.select(F.explode("seeds").alias("s")).select("s.*").groupBy("subject").agg(F.count("*").alias("c"), F.sum("part").alias("part"))
    first = cut(leaning(trusted, seeds))
    lean = first.filter("telling").drop("telling")
    free = files.filter("seeds is null")
    if max_rounds < 2 or free.isEmpty():
        return lean
    everyone = free.select("doc_id")
    closed = first.filter("not telling").select("term")
    open_ = cut(free.select("doc_id", "n_cues", F.explode("edges").alias("e")).select("doc_id", "n_cues", "e.term", "e.n").join(_small(closed, closed.count(), max_terms), "term", "left_anti"))
    n = lean.count()
    for _ in range(max_rounds - 1):
        # to the documents: by subject the share of cues that hold a telling term
        held = open_.join(_small(lean, n, max_terms), "term").groupBy("doc_id", "subject").agg((F.sum(F.col("n") * F.col("lean")) / F.first("n_cues")).alias("share"))
        soft = held.filter(f"share >= {THRESHOLD}").groupBy("doc_id").agg(F.collect_list("subject").alias("all"))
        # a document without a subject is of the class of none
        soft = cut(everyone.join(soft, "doc_id", "left").select("doc_id", F.coalesce("all", F.array(F.lit(NONE))).alias("all")))
        each = soft.select("doc_id", F.explode("all").alias("subject"), (1.0 / F.size("all")).alias("part"))
        # and back to the terms, with the seeds clamped
        known = seeds.unionByName(each.groupBy("subject").agg(F.count("*").alias("c"), F.sum("part").alias("part")))
        now = cut(leaning(trusted.unionByName(_sums(open_.join(each, "doc_id"))), known)).filter("telling").drop("telling")
        same = now.join(lean.select("term", "subject"), ["term", "subject"], "left_semi").count()
        before, n, lean = n, now.count(), now
        if max(before, n) - same <= SETTLED * n:
            break
    return lean


def _told(docs: DataFrame, lean: DataFrame) -> DataFrame:
    """(doc_id, subject, share), where the telling terms travel with the tasks."""
    told = docs.sparkSession.sparkContext.broadcast({r.term: (r.subject, r.lean) for r in lean.collect()})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = told.value
        for b in batches:
            rows = []
            for d, text in zip(b["doc_id"], b["text"], strict=True):
                c = cues(text)
                n: Counter = Counter()
                for words in c:
                    s: Counter = Counter()
                    for w in words:
                        if w in of:
                            s[of[w][0]] += of[w][1]
                    if s:
                        n[max(s, key=lambda k: (round(s[k], 9), k))] += 1
                rows += [(d, k, v / len(c)) for k, v in n.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "share"])

    return docs.mapInPandas(work, "doc_id long, subject string, share double")


def _joined(docs: DataFrame, lean: DataFrame) -> DataFrame:
    """The same for any number of telling terms: they are joined to the cues' words."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, text in zip(b["doc_id"], b["text"], strict=True):
                c = cues(text)
                rows += [(d, len(c), i, w, k) for i, words in enumerate(c) for w, k in Counter(words).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "n_cues", "cue", "term", "n"])

    said = docs.mapInPandas(work, "doc_id long, n_cues int, cue int, term string, n int").join(lean, "term")
    cue = said.groupBy("doc_id", "n_cues", "cue", "subject").agg(F.round(F.sum(F.col("n") * F.col("lean")), 9).alias("s"))
    cue = cue.groupBy("doc_id", "n_cues", "cue").agg(F.max(F.struct("s", "subject")).alias("m"))
    return cue.groupBy("doc_id", F.col("m.subject").alias("subject")).agg((F.count("*") / F.first("n_cues")).alias("share"))


def _labels(subject_labels: DataFrame) -> DataFrame:
    return subject_labels.filter("doc_id is not null").select("doc_id", F.coalesce("subject", F.lit(NONE)).alias("subject")).distinct()


def _shares(docs: DataFrame, files: DataFrame, max_terms: int) -> DataFrame:
    lean = propagate(files, max_terms=max_terms)
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    return (_told if lean.count() <= max_terms else _joined)(texts, lean)


def shares(docs: DataFrame, subject_labels: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """(doc_id, subject, share): by document the share of its cues that speak of each subject, as its words have it; zeros are
    left out."""
    return _shares(docs, seeded(nodes(docs), _labels(subject_labels)), max_terms)


def found(docs: DataFrame, subject_labels: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """(doc_id, subject) of the subjects that about a fifth or more of a file's cues speak of; of a trusted file those of its
    labels."""
    labels = _labels(subject_labels)
    files = seeded(nodes(docs), labels)
    trusted = files.filter("seeds is not null").select("doc_id", F.explode("seeds.subject").alias("subject"))
    said = _shares(docs, files, max_terms).filter(f"share >= {THRESHOLD}").select("doc_id", "subject")
    # a labelled file without a cue is no node
    mute = labels.join(docs.select("doc_id"), "doc_id", "left_semi").join(files.select("doc_id"), "doc_id", "left_anti")
    return said.join(trusted.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(trusted).unionByName(mute).filter(F.col("subject") != NONE).distinct()
