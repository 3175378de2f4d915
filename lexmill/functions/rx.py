"""Regular expressions as columns.

Patterns are written for the flags they need: ``u`` reads letters and blanks by Unicode, ``i`` folds case; a line end is
always a line feed alone. Patterns are literals, so each is compiled once for a plan.
"""

from __future__ import annotations

import re._parser as parser
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 2  # characters of a string that a gate looks for


def rx(pattern: str, flags: str = "") -> str:
    inline = ("i" if "i" in flags else "") + ("U" if "u" in flags else "") + "d"
    return f"(?{inline}){_ahead(pattern)}{pattern}"


@lru_cache
def _ahead(pattern: str) -> str:
    """Before a pattern that begins at a word's end: the characters that can come next, for they are told sooner than words are."""
    try:
        first = pattern.startswith(r"\b") and _first(list(parser.parse(pattern[2:])))
    except parser.error:  # what only Java knows
        return ""
    return f"(?=[{''.join(sorted(first))}])" if first else ""


def _first(parts: list) -> set[str] | None:
    """What a match can begin with, as parts of a character class; none where that isn't sure."""
    if not parts:
        return None
    op, of = parts[0]
    if op is parser.LITERAL:
        return {rf"\x{{{of:x}}}"}
    if op is parser.IN and all(o in (parser.LITERAL, parser.RANGE) for o, _ in of):
        return {rf"\x{{{v:x}}}" if o is parser.LITERAL else rf"\x{{{v[0]:x}}}-\x{{{v[1]:x}}}" for o, v in of}
    if op is parser.SUBPATTERN:
        return _first([*of[3], *parts[1:]])
    if op is parser.BRANCH:
        each = [_first([*x, *parts[1:]]) for x in of[1]]
        return set().union(*each) if all(each) else None
    if op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
        inner, after = _first(list(of[2])), _first(parts[1:]) if of[0] == 0 else set()
        return None if inner is None or after is None else inner | after
    return None


def sub(c: Column, pattern: str, to: str, flags: str = "") -> Column:
    return F.regexp_replace(c, rx(pattern, flags), to)


def has(c: Column, pattern: str, flags: str = "") -> Column:
    return c.rlike(rx(pattern, flags))


def count(c: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(c, F.lit(rx(pattern, flags)))


def all_of(c: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(rx(pattern, flags)), F.lit(group))


def first_of(c: Column, pattern: str, flags: str = "", group: int = 1) -> Column:
    return F.regexp_extract(c, rx(pattern, flags), group)


def squeeze(c: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(sub(c, r"\s+", " ", "u"))


@lru_cache
def needed(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of strings, of each of which every match of ``pattern`` holds one; none where nothing is sure."""
    try:
        return tuple(_needed(parser.parse(pattern)))
    except parser.error:  # what only Java knows
        return ()


def _needed(parts) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = []
    run = ""
    for op, of in [*parts, (None, None)]:
        if op is parser.LITERAL:
            run += chr(of)
            continue
        if len(run) >= LEAST:
            out.append((run,))
        run = ""
        if op is parser.SUBPATTERN:
            out += _needed(of[3])
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and of[0] >= 1:
            out += _needed(of[2])
        elif op is parser.BRANCH:
            # of each choice its longest sure string; a choice without one opens the gate
            each = [max(_needed(x), key=lambda z: min(map(len, z)), default=()) for x in of[1]]
            if all(each):
                out.append(tuple(dict.fromkeys(t for x in each for t in x)))
    return out


def fold(x: Column) -> Column:
    """In lower case, with the letters that patterns without case take for an i, k or s."""
    return F.lower(F.translate(x, "İıſ", "iis"))


def gate(x: Column, pattern: str) -> Column:
    """False only where ``pattern`` can't match, for a plain string is found many times faster. ``x`` is the text, or its ``fold``
    and the pattern in lower case where that is without case."""
    every = [reduce(lambda a, b: a | b, (x.contains(t) for t in ts)) for ts in needed(pattern)]
    return reduce(lambda a, b: a & b, every, F.lit(True))


def missing(c: Column) -> Column:
    """Null where a text is null or empty."""
    return F.nullif(c, F.lit(""))


def ladder(*choices: Column) -> Column:
    """The first of the choices that is neither null nor empty."""
    return F.coalesce(*(missing(c) for c in choices))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: inside a function of an array, an outer expression is otherwise computed
    anew for every element."""
    return F.transform(F.array(value), f)[0]


def distinct_ci(items: Column) -> Column:
    """Array items without empty ones and without later ones that differ from an earlier one by case only."""
    seen = lambda kept, x: F.exists(kept, lambda y: F.lower(y) == F.lower(x))
    return F.aggregate(F.filter(items, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"), lambda kept, x: F.when(seen(kept, x), kept).otherwise(F.concat(kept, F.array(x))))


_TRIMMED = r"^[ \t\n\r\x{00}\x{0B}]+|[ \t\n\r\x{00}\x{0B}]+$"


def trim(c: Column) -> Column:
    """Without blanks, tabs, line ends and nulls at either end; wide and no-break blanks stay."""
    return F.regexp_replace(c, _TRIMMED.replace("$", r"\z"), "")


def capped(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)
