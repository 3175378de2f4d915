"""What subtitle files say, in SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIME = r"[^\n]*\d:\d\d[.,]\d+ *--> *[^\n]*"


def spoken(text: Column, labels: bool = True) -> Column:
    """The spoken lines of a subtitle text, parted by line feeds: without the file's header, cue numbers, times,
    markup, sound descriptions, music and (unless ``labels`` is false) the names of speakers. Cues are parted by an
    empty line."""
    r = F.regexp_replace
    x = r(text, r"\r\n?", "\n")
    x = r(x, r"\A﻿?(?:WEBVTT[^\n]*)?", "")
    # a number alone on a line is a cue's number only where a time follows
    x = r(x, rf"(?m)^(?:[ \t]*\d+[ \t]*\n)?{_TIME}$", "")
    x = r(x, r"<[^<>\n]{0,60}>|\{[^{}\n]{0,60}\}|\[[^\[\]\n]{0,60}\]|\([^()\n]{0,60}\)|♪[^♪\n]*♪?|\xAD", "")
    if labels:
        x = r(x, r"(?m)^[ \t>\-–]*[\p{L}\p{M}']{2,20}:[ \t]", "")
    return x


def lines_once(x: Column) -> Column:
    """Spoken text on one line, with the line that a rolling cue repeats from the cue before said once."""
    x = F.regexp_replace(x, r"\s*\n\s*", "\n")
    # a repeated line, and a repeated pair of lines
    x = F.regexp_replace(x, r"(?m)^([^\n]+\n[^\n]+)\n(?=\1(?:\n|\z))", "")
    x = F.regexp_replace(x, r"(?m)^([^\n]+)\n(?=\1(?:\n|\z))", "")
    return F.regexp_replace(x, r"\n", " ")


# Letters that readers of scanned or filmed text confuse, each pair or group folded to one sign.
FOLDS = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"))
FOLD_FROM, FOLD_TO = "01i!|59qceftbh", "ollll" + "sgg" + "ccttbb"


def fold(x: Column) -> Column:
    """A skeleton of ``x`` that confused characters, lost accents and wrong encodings leave alike: lower case, only
    ASCII letters and digits, confusable letters folded; words are parted by single blanks."""
    r = F.regexp_replace
    # a sharp s is two letters in capitals; so are its wrongly decoded bytes
    x = F.lower(r(x, r"ß|Ã[Ÿ\x9f]", "ss"))
    # outside ASCII there are accents, wrongly decoded bytes and lost characters; a dash or an ellipsis parts words
    x = r(x, r"[–—…]|â€[“”¦]|â\x80[\x93\x94¦]", " ")
    x = r(x, r"[^\x00-\x7F]+|['`]", "")
    x = r(x, r"(?<=[a-z])[!|](?=[a-z])", "l")
    x = r(x, r"[^a-z0-9]+", " ")
    # signs that stand for letters first: with them a pair may be complete
    x = F.translate(F.trim(x), "01", "ol")
    for a, b in FOLDS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.translate(x, FOLD_FROM, FOLD_TO)
