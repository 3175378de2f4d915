"""Building blocks of the ANSI SQL that states the same results for another engine.

Its regular expressions have ASCII blanks and no looking around, so blanks are spelled out and lookarounds are replaced by
markers; the rest of each pattern is the same fixed value.
"""

from __future__ import annotations

from lexmill.functions import lexicons as L
from lexmill.functions.text import PLAIN, PUNCTUATION, TYPOGRAPHIC

_BLANKS = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def re2(pattern: str) -> str:
    """A pattern with Unicode blanks, as a quoted SQL string."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_BLANKS if inside else f"[{_BLANKS}]")
            i += 2
            continue
        if two[0] == "\\":
            out.append(two)
            i += 2
            continue
        inside = True if two[0] == "[" else False if two[0] == "]" else inside
        out.append(two[0])
        i += 1
    return q("".join(out))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def gsub(x: str, pattern: str, to: str, flags: str = "") -> str:
    return f"regexp_replace({x}, {re2(pattern)}, {q(to)}, 'g{flags}')"


def has(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {re2(pattern)}" + (f", '{flags}')" if flags else ")")


def every(x: str, pattern: str, group: int = 0, flags: str = "") -> str:
    return f"regexp_extract_all({x}, {re2(pattern)}, {group}" + (f", '{flags}')" if flags else ")")


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(r'^[ \t\n\r\x{00}\x{0B}]+|[ \t\n\r\x{00}\x{0B}]+$')}, '', 'g')"


def wordy(x: str) -> str:
    """Letters outside ASCII as an ASCII letter, for a boundary that knows no others."""
    return f"regexp_replace({x}, '[\\x{{C0}}-\\x{{1FFF}}\\x{{3040}}-\\x{{D7FF}}]', 'x', 'g')"


def squeeze(x: str) -> str:
    return f"trim({gsub(x, r'\s+', ' ')})"


def clean(x: str) -> str:
    x = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = f"replace({x}, chr(173), '')"
    for bad, good in PUNCTUATION:
        x = f"replace({x}, {q(bad)}, {q(good)})"
    x = f"translate({x}, {q(TYPOGRAPHIC)}, {q(PLAIN)})"
    x = gsub(x, r"(\p{L})-\s*\n(\p{L})", r"\1\2")
    x = gsub(x, r"\[(?:Chapter\s*)?([0-9]{1,2}:[0-9]{2})\]", r" Chapter \1 ", "i")
    x = gsub(x, r",([^\s])", r", \1")
    x = gsub(x, r"[ \x{A0}]{2,}", " ")
    x = gsub(x, r"\n{3,}", "\n\n")
    return f"regexp_replace({x}, {q(r'^[ \t\n\r\x{0B}]+|[ \t\n\r\x{0B}]+$')}, '', 'g')"


def sentences(x: str) -> str:
    x = gsub(x, rf"\b({'|'.join(L.ABBREVIATIONS)})\.", "\\1\x1e", "i")
    x = gsub(x, r"""([.!?])["')\]]*\s+""", "\\1\x1f")
    x = gsub(x, r"\n{2,}", "\x1f")
    return f"list_filter(list_transform(string_split({x}, chr(31)), lambda s: {squeeze('replace(s, chr(30), ' + q('.') + ')')}), lambda s: length(s) > 25)"


def evidence_sentences(x: str) -> str:
    x = gsub(gsub(x, r"\s+", " "), r"([.!?])\s+", "\\1\x1f")
    return f"list_filter(list_transform(string_split({x}, chr(31)), lambda s: trim(s)), lambda s: length(s) >= 20)"


def tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower({x}), {q(chr(92) + 'p{L}[' + chr(92) + 'p{L}' + chr(92) + 'p{Mn}' + chr(39) + '’-]+')}), lambda w: trim(w, {q(chr(45) + chr(39) + '’')})), lambda w: w <> '')"


DOCS = f"""d AS (SELECT id, coalesce(original_name, '') AS filename, {clean('extracted_text')} AS t FROM legal_documents WHERE extracted_text IS NOT NULL)"""
SENTS = f"""s AS (SELECT id, {sentences('t')} AS ss FROM d)"""
TOKENS = f"""k AS (SELECT id, {tokens('t')} AS ts FROM d)"""
