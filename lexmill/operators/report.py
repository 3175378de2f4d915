"""Report shaping: blocks, plain language, list splitting and line wrapping."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lexmill.functions import lexicons as L
from lexmill.functions.rx import squeeze, sub
from lexmill.functions.text import blank_words


@F.pandas_udf(StringType())
def plain_latin(text: pd.Series) -> pd.Series:
    """Latin terms by their meaning, term by term in the fixed order, as a later term may stand in an earlier's meaning."""
    rules = [(re.compile(rf"\b{re.escape(k)}\b", re.I), v) for k, v in L.LATIN.items()]
    # most texts have none, and one look tells
    any_of = re.compile("|".join(re.escape(k) for k in L.LATIN), re.I)

    def one(x):
        if not x or not any_of.search(x):
            return x
        for p, v in rules:
            x = p.sub(v, x)
        return x

    return text.map(one, na_action="ignore")


def plain_language(text: Column) -> Column:
    for word, simple in L.PLAIN.items():
        text = sub(text, rf"\b{word}\b", simple, "iu")
    return squeeze(plain_latin(text))


def plain_words(text: Column) -> Column:
    """The first part of ``plain_language``, without the Latin terms."""
    for word, simple in L.PLAIN.items():
        text = sub(text, rf"\b{word}\b", simple, "iu")
    return squeeze(text)


def longest(*texts: Column) -> Column:
    """The candidate with the most words; of equals the first."""
    c = F.array(*(F.struct(F.size(blank_words(F.coalesce(t, F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.coalesce(t, F.lit("")).alias("t")) for i, t in enumerate(texts)))
    return F.array_max(c)["t"]


def saved_or(saved: Column, fallback: Column, least: int) -> Column:
    n = lambda x: F.size(blank_words(F.coalesce(x, F.lit(""))))
    return F.when((n(saved) < least) & (n(fallback) > n(saved)), fallback).otherwise(saved)


def list_items(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"\n+|;\s+"), lambda v: F.trim(v)), lambda v: v != "")


def blocks(row: dict[str, Column]) -> Column:
    """Array of (label, text) of the fields that have text."""
    return F.filter(F.array(*(F.struct(F.lit(k).alias("label"), squeeze(F.coalesce(v, F.lit(""))).alias("text")) for k, v in row.items())), lambda b: b["text"] != "")


_WIDTHS = {**dict.fromkeys("iljtfI.,:;'!| ", 0.28), **dict.fromkeys("mwMW@", 0.85), **dict.fromkeys("ABCDEFGHJKLNOPQRSTUVXYZ", 0.68)}


def wrap_lines(text: str, width: float) -> list[str]:
    """Lines no wider than ``width`` em by the width of each class of letters; a word wider than a line is cut."""
    size = lambda s: sum(_WIDTHS.get(c, 0.52) for c in s)
    lines, line = [], ""
    for word in text.split():
        while size(word) > width and len(word) > 1:
            if line:
                lines.append(line)
                line = ""
            cut = 1
            while cut < len(word) and size(word[: cut + 1]) <= width:
                cut += 1
            lines.append(word[:cut])
            word = word[cut:]
        if line and size(f"{line} {word}") > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return [*lines, line] if line else lines


@F.pandas_udf(ArrayType(StringType()))
def wrapped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: wrap_lines(t, 46.0) if t else [])


def highlighted(text: Column, terms: list[str]) -> Column:
    """Known terms between marks, the longest first, whole words in any case."""
    alternatives = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return sub(text, rf"\b({alternatives})\b", "<mark>$1</mark>", "iu") if terms else text
