"""The analysis of documents as one plan: the columns that later steps share are made once, each in its own projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import classify as C
from lexmill.functions import extract as X
from lexmill.functions import text as T
from lexmill.functions.rx import let


def documents(legal: DataFrame, *more: str) -> DataFrame:
    """(id, filename, text): the cleaned text of every document that has one, with the columns ``more``."""
    return legal.filter("extracted_text is not null").select("id", F.coalesce("original_name", F.lit("")).alias("filename"), *more, T.clean(F.col("extracted_text")).alias("text"))


def with_sentences(docs: DataFrame) -> DataFrame:
    return docs.withColumn("sentences", T.sentences(F.col("text")))


def with_tokens(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tokens", T.tokens(F.col("text")))


def typed(docs: DataFrame) -> DataFrame:
    """Documents with ``doc_type``."""
    return docs.withColumn("doc_type", let(C.type_scores(F.col("text"), F.col("filename")), lambda z: C.document_type(z["scores"], z["titles"])))


def analysed(x: DataFrame, keywords: Column | None = None, taught: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row of results per document, of typed documents with sentences, tokens and perhaps ``categories``; columns that aren't selected are pruned
    with what they need. ``keywords`` speak for issues, and ``taught`` are areas of law after those of the patterns;
    ``keep`` are columns that stay."""
    found = F.col("categories") if "categories" in x.columns else C.categories(F.col("text"))
    none = F.array().cast("array<string>")
    x = x.withColumn("categories", found if taught is None else F.array_union(found, taught)).withColumn("keywords", none if keywords is None else keywords)
    leg = C.legislative(F.col("doc_type"))
    return x.select(
        "id",
        *keep,
        "doc_type",
        F.when(~leg, X.case_number(F.col("text"))).alias("case_number"),
        F.when(leg, X.legislative_date(F.col("text"))).otherwise(X.document_date(F.col("text"))).alias("document_date"),
        F.when(~leg, X.court(F.col("text"))).alias("court"),
        F.when(~leg, X.judge(F.col("text"))).alias("judge"),
        F.when(~leg, X.parties(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("parties"),
        X.dates(F.col("text")).alias("dates"),
        X.amounts(F.col("text")).alias("amounts"),
        X.references(F.col("text")).alias("legal_references"),
        X.persons(F.col("text")).alias("persons"),
        X.organisations(F.col("text")).alias("organisations"),
        X.locations(F.col("text")).alias("locations"),
        X.obligations(F.col("sentences")).alias("obligations"),
        X.principles(F.col("sentences")).alias("principles"),
        X.outcome(F.col("text"), F.col("sentences"), F.col("doc_type")).alias("outcome"),
        C.sentiment(F.col("tokens")).alias("sentiment"),
        C.language(F.col("tokens")).alias("language"),
        C.readability(F.col("tokens"), F.size("sentences")).alias("readability"),
        "categories",
        F.when(leg, C.legislative_issues(F.col("text"), F.col("keywords"))).otherwise(C.issues(F.col("text"), F.col("categories"), F.col("keywords"))).alias("issues"),
        F.size("tokens").alias("word_count"),
        "keywords",
    )
