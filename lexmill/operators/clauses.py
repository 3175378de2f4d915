"""Clauses of documents: headed ones by a running count over lines, ones by pattern, and sentences of provision, merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions.classify import clause_type
from lexmill.functions.rx import all_of, has, let, squeeze, sub

CAP = 8
# Openings of clauses by pattern, and how far they reach.
WINDOWS = (
    ("LEASE_TERM", "Lease Term", r"\b(?:lease term|duration)\b.{0,220}(?:\.|$)"),
    ("PAYMENT_TERMS", "Payment Terms", r"\b(?:payment terms|rent|fees|consideration)\b.{0,220}(?:\.|$)"),
    ("TERMINATION", "Termination", r"\btermination\b.{0,240}(?:\.|$)"),
    ("CONFIDENTIALITY", "Confidentiality", r"\bconfidential(?:ity)?\b.{0,240}(?:\.|$)"),
    ("LIABILITY", "Liability", r"\bliability\b.{0,240}(?:\.|$)"),
    ("COURT_ORDER", "Court Order", r"\b(?:it is ordered that|ordered that|the court orders)\b.{0,320}(?:\.|$)"),
)


def noise(line: Column) -> Column:
    return has(F.trim(line), L.CLAUSE_NOISE, "iu")


def is_heading(line: Column) -> Column:
    numbered = has(line, r"^(?:section|clause|article|part)\s+\d+[A-Za-z0-9().:-]*\b.*$", "iu") | has(line, r"^\d+(?:\.\d+)*[A-Za-z]?[.)-]?\s+[A-Z][A-Za-z0-9 ,&'()\/:-]{2,100}$", "u")
    capitals = has(line, r"^[A-Z][A-Z0-9 ,&'()\/:-]{4,100}$", "u") & has(line, L.HEADING_WORDS, "iu")
    return (F.length(line) <= 120) & (numbered | capitals)


def headed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, clause_type, heading, content): lines after each heading up to the next. The lines of one document are
    ordered in its own window; a group without a line is no clause."""
    lines = df.select(key, F.posexplode(F.split(text, r"\n+")).alias("no", "raw")).select(key, "no", squeeze(F.col("raw")).alias("line")).filter(F.col("line") != "").filter(~noise(F.col("line")))
    lines = lines.withColumn("h", is_heading(F.col("line")))
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = lines.withColumn("seq", F.sum(F.col("h").cast("int")).over(w)).filter("seq > 0")
    out = grouped.groupBy(key, "seq").agg(F.max(F.when(F.col("h"), F.col("line"))).alias("heading"), F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("no", "line")))).alias("c"))
    out = out.filter(F.size("c") > 0).select(key, "seq", "heading", F.array_join(F.transform("c", lambda x: x["line"]), " ").alias("content"))
    return out.select(key, "seq", clause_type(F.concat_ws(" ", "heading", "content")).alias("clause_type"), "heading", "content")


def by_pattern(df: DataFrame, key: str, text: str, doc_type: str | None = None) -> DataFrame:
    """Clauses by their openings, those of every document first, then those of its type."""
    def shaped(kind: str, heading: str):
        return lambda m: F.struct(F.lit(kind).alias("clause_type"), F.lit(heading).alias("heading"), squeeze(m).alias("content"))

    t, h, p = L.CASE_WINDOW
    parts = [F.transform(all_of(F.col(text), p, "u"), shaped(t, h))] + [F.transform(all_of(F.col(text), p, "iu"), shaped(t, h)) for t, h, p in WINDOWS]
    for kind, windows in L.TYPE_WINDOWS.items() if doc_type else ():
        own = F.col(doc_type).isin(kind, "Statutory Instrument") if kind == "Act" else F.col(doc_type) == kind
        parts += [F.when(own, F.transform(all_of(F.col(text), p, "iu"), shaped(t, h))).otherwise(F.array().cast("array<struct<clause_type:string,heading:string,content:string>>")) for t, h, p in windows]
    return df.select(key, F.posexplode(F.concat(*parts)).alias("seq", "c")).select(key, "seq", "c.clause_type", "c.heading", "c.content").filter("content <> ''")


def provisions(df: DataFrame, key: str, sentences: str, doc_type: str) -> DataFrame:
    """Sentences of 35 to 420 characters of a known kind, or with an operative word."""
    x = df.select(key, doc_type, F.posexplode(sentences).alias("seq", "content")).filter("length(content) between 35 and 420").filter(~noise(F.col("content")))
    x = x.withColumn("kind", clause_type(F.col("content"), F.col(doc_type)))
    leg = F.col(doc_type).isin("Act", "Bill", "Statutory Instrument")
    operative = has(F.col("content"), L.OPERATIVE, "iu") | F.when(leg, has(F.col("content"), L.OPERATIVE_LEGISLATIVE, "iu")).otherwise(has(F.col("content"), L.OPERATIVE_CONTRACT, "iu"))
    x = x.filter((F.col("kind") != "GENERAL_CLAUSE") | operative)
    title = None
    for t, h in L.CLAUSE_HEADINGS.items():
        title = F.when(F.col("kind") == t, h) if title is None else title.when(F.col("kind") == t, h)
    title = title.otherwise(F.when(leg, "Operative Provision").otherwise("Key Clause"))
    return x.select(key, "seq", F.when(F.col("kind") == "GENERAL_CLAUSE", "OPERATIVE_PROVISION").otherwise(F.col("kind")).alias("clause_type"), title.alias("heading"), "content")


def trimmed(content: Column) -> Column:
    """The first two good sentences, at most 70 words."""
    x = squeeze(sub(content, r"\bPage\s+\d+\s+(?:of|\/)\s+\d+\b", " ", "iu"))
    good = F.slice(F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: (F.length(s) >= 20) & ~noise(s)), 1, 2)
    x = F.when(F.size(good) > 0, F.array_join(good, " ")).otherwise(x)
    return let(F.split(x, " "), lambda w: F.when(F.size(w) <= 70, F.array_join(w, " ")).otherwise(F.concat(F.array_join(F.slice(w, 1, 70), " "), F.lit("..."))))


def merged(df: DataFrame, key: str, text: str, sentences: str, doc_type: str) -> DataFrame:
    """(key, rank, clause_type, heading, content): headed, patterned and provision clauses in that order, the first of each
    fingerprint (28 words of heading and content), at most eight a document."""
    every = headed(df, key, text).withColumn("source", F.lit(0)).unionByName(by_pattern(df, key, text, doc_type).withColumn("source", F.lit(1))).unionByName(provisions(df, key, sentences, doc_type).withColumn("source", F.lit(2)))
    every = every.withColumn("content", trimmed(F.col("content"))).filter("heading <> '' and length(content) >= 20")
    words = F.filter(F.split(F.lower(F.regexp_replace(F.concat_ws(" ", "heading", "content"), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    every = every.withColumn("fp", F.array_join(F.slice(words, 1, 28), " "))
    first = Window.partitionBy(key, "fp").orderBy("source", "seq")
    kept = every.withColumn("n", F.row_number().over(first)).filter("n = 1")
    order = Window.partitionBy(key).orderBy("source", "seq", "fp")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= CAP).select(key, "rank", "clause_type", "heading", "content")
