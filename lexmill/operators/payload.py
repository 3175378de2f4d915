"""Normalising and merging of analysis payloads that come as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions.rx import has

SCHEMA = (
    "document_type string, case_number string, parties array<string>, date_of_document string, court string, judge string, executive_summary string, professional_summary string, citizen_summary string, "
    "key_findings string, key_obligations array<string>, legal_principles string, outcome string, practical_implications string, key_issues array<string>, cited_instruments array<string>, legal_references array<string>"
)
LISTS = ("parties", "key_obligations", "key_issues", "cited_instruments", "legal_references")
REQUIRED = ("document_type", "executive_summary", "professional_summary", "citizen_summary")
AUTHORITY = r"\b(?:supreme court of appeal|court of appeal|law reports?|\d{4}\s+z\w+|sa\s+\d+|pty\s+ltd\s+and\s+[a-z]+\s+\d{4})\b"


def text_or_null(x: Column) -> Column:
    x = F.trim(x)
    return F.when((x == "") | F.lower(x).isin(*L.NULL_LIKE), F.lit(None)).otherwise(x)


def items(x: Column) -> Column:
    """Trimmed, distinct, without empty ones; never null."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(x, lambda v: F.trim(v)), lambda v: v != "")), F.array().cast("array<string>"))


def parsed(raw: Column) -> Column:
    """The payload of a fenced, bare or embedded JSON object; null where there is none."""
    x = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?m)^```(?:json)?\s*", ""), r"(?m)```$", ""))
    bare = F.from_json(x, SCHEMA)
    inner = F.from_json(F.regexp_extract(x, r"\{[\s\S]+\}", 0), SCHEMA)
    return F.when(bare["document_type"].isNotNull(), bare).when(has(x, r"\{[\s\S]+\}"), inner)


def normalised(p: Column) -> Column:
    cols = []
    for name in (c.strip().split()[0] for c in SCHEMA.split(", ")):
        v = items(p[name]) if name in LISTS else F.trim(F.coalesce(p[name], F.lit(""))) if name in REQUIRED else text_or_null(p[name])
        cols.append(v.alias(name))
    return F.when(p.isNotNull(), F.struct(*cols))


def best_text(preferred: Column, fallback: Column) -> Column:
    return F.coalesce(text_or_null(preferred), text_or_null(fallback))


def best_parties(remote: Column, local: Column) -> Column:
    """Two or more remote parties that are no cited authority, else local ones, else what there is; at most eight."""
    a, b = items(remote), items(local)
    clean = lambda x: F.filter(x, lambda v: ~has(v, AUTHORITY, "iu"))
    ca, cb = clean(a), clean(b)
    return F.slice(F.when(F.size(ca) >= 2, ca).when(F.size(cb) >= 2, cb).when(F.size(ca) > 0, ca).when(F.size(cb) > 0, cb).when(F.size(a) > 0, a).otherwise(b), 1, 8)


def mode(x: Column) -> Column:
    return F.when(x.isin("legal_professional", "general_user"), x).otherwise("general_user")


