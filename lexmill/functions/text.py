"""Normalising, cutting and counting of text, as column expressions over whole documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .rx import all_of, let, rx, squeeze, sub

_MARK = "\x1e"  # stands for a protected stop
# Wrongly decoded and typographic punctuation, and what stands for it.
PUNCTUATION = (("Ã¢â‚¬â€œ", "-"), ("Ã¢â‚¬Ëœ", "'"), ("Ã¢â‚¬â„¢", "'"), ("Ã¢â‚¬Å“", '"'), ("Ã¢â‚¬Â¦", "..."), ("Ã¢â‚¬Â", '"'), ("Ã¢â‚¬â€", "-"))
TYPOGRAPHIC, PLAIN = "\t“”‘’–—•", " \"\"''-- "


def clean(text: Column) -> Column:
    """Line ends, soft hyphens, punctuation, words broken across lines, bracketed chapters, comma spacing, hyphen page
    markers, blank runs and blank lines, in that order. Null stays null."""
    x = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    x = F.replace(x, F.lit("\xad"), F.lit(""))
    for bad, good in PUNCTUATION:
        x = F.replace(x, F.lit(bad), F.lit(good))
    x = F.translate(x, TYPOGRAPHIC, PLAIN)
    x = sub(x, r"(?<=\p{L})-\s*\n(?=\p{L})", "", "u")
    x = sub(x, r"\[(?:Chapter\s*)?([0-9]{1,2}:[0-9]{2})\]", " Chapter $1 ", "iu")
    x = sub(x, r",([^\s])", ", $1", "u")
    x = sub(x, r"(?:^|\n)\s*[-]{2,}\s*PAGE\s+\d+\s*[-]{2,}\s*(?=\n|$)", "\n\n", "iu")
    x = sub(x, r"[ \x{00A0}]{2,}", " ", "u")
    x = sub(x, r"\n{3,}", "\n\n")
    return sub(x, r"\A[ \t\n\r\x{00}\x{0B}]+|[ \t\n\r\x{00}\x{0B}]+\z", "")


def sentences(cleaned: Column) -> Column:
    """Sentences of more than 25 characters; the stops of known abbreviations end none."""
    x = sub(cleaned, rf"\b({'|'.join(L.ABBREVIATIONS)})\.", "$1" + _MARK, "iu")
    parts = F.split(x, rx(r"""(?<=[.!?])["')\]]*\s+|\n{2,}""", "u"), -1)
    parts = F.transform(parts, lambda s: squeeze(F.translate(s, _MARK, ".")))
    return F.filter(parts, lambda s: F.length(s) > 25)


def evidence_sentences(page_text: Column) -> Column:
    """Sentences of at least 20 characters of a page; blanks are squeezed first, so lines and paragraphs run on."""
    parts = F.split(sub(page_text, r"\s+", " ", "u"), rx(r"(?<=[.!?])\s+", "u"), -1)
    return F.filter(F.transform(parts, lambda v: F.trim(v)), lambda s: F.length(s) >= 20)


def prose_sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), rx(r"(?<=[.!?])\s+", "u"), -1), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Lower-case words of two letters or more, with inner hyphens and apostrophes."""
    found = all_of(F.lower(text), r"\p{L}[\p{L}\p{Mn}'’-]+", "u")
    return F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"^[-'’]+|[-'’]+$", "")), lambda t: t != "")


def evidence_tokens(text: Column) -> Column:
    """Distinct words of four characters or more."""
    return F.array_distinct(F.filter(all_of(F.lower(text), r"\p{L}[\p{L}\p{Mn}'-]+", "u"), lambda t: F.length(t) >= 4))


def profile_tokens(text: Column) -> Column:
    """Words of three characters or more that are no stop words of the search profile."""
    return F.filter(all_of(F.lower(text), r"\p{L}[\p{L}\p{Mn}'-]{2,}", "u"), lambda t: ~t.isin(L.PROFILE_STOP))


def rouge_tokens(text: Column) -> Column:
    return all_of(F.lower(text), r"[\p{L}\p{N}]+", "u")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), rx(r"\W+", "u")), lambda t: t != ""))


def unicode_words(text: Column) -> Column:
    """How many words, counted by letters and digits with inner hyphens and apostrophes."""
    return F.regexp_count(text, F.lit(rx(r"[\p{L}\p{N}][\p{L}\p{N}'-]*", "u")))


def blank_words(text: Column) -> Column:
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def word_limit(text: Column, n: int, tail: str = "...") -> Column:
    """The first ``n`` words, with ``tail`` where more follow."""
    return let(blank_words(text), lambda w: F.when(F.size(w) <= n, F.array_join(w, " ")).otherwise(F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(tail))))


def excerpt(text: Column, n: int) -> Column:
    x = squeeze(text)
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, n - 1), r"[ \t\n\r,.;:\-]+$", ""), F.lit("...")))


def weak(token: Column) -> Column:
    """Whether a token is no keyword: a stop word, shorter than four characters, or a number."""
    return token.isin(L.STOP_WORDS) | (F.length(token) < 4) | token.rlike(r"^\d+$")


def title_case(x: Column) -> Column:
    """An upper-case name in title case, each run of letters for itself; other names stay."""

    def titled(x: Column) -> Column:
        parts = all_of(F.lower(x), r"[\p{L}\p{M}']+|[^\p{L}\p{M}']+", "u")
        out = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")
        return F.when(x == F.upper(x), sub(sub(out, r"\bOf\b", "of"), r"\bAnd\b", "and")).otherwise(x)

    return let(x, titled)


def pages(text: Column, box_markers: bool = False) -> Column:
    """Array of (page, text): the parts after each page marker; what stands before the first is dropped. Without a marker
    the text is page 1. Box-drawing markers count only if asked for."""
    dashes = "[—─━-]" if box_markers else "[—-]"
    marker = rf"(?:^|\n)\s*{dashes}{{2,}}\s*PAGE\s+(\d+)\s*{dashes}{{2,}}\s*\n?"
    x = F.trim(text)
    numbers = F.transform(F.regexp_extract_all(x, F.lit(rx(marker, "iu")), F.lit(1)), lambda n: n.try_cast("int"))
    parts = F.split(x, rx(marker, "iu"), -1)
    paired = F.zip_with(numbers, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda n, t: F.struct(n.alias("page"), sub(t, r"\A\s+|\s+\z", "").alias("text")))
    paired = F.filter(paired, lambda p: p["text"] != "")
    return F.when(F.coalesce(x, F.lit("")) == "", F.array().cast("array<struct<page:int,text:string>>")).when(F.size(numbers) == 0, F.array(F.struct(F.lit(1).alias("page"), x.alias("text")))).otherwise(paired)


def html_text(x: Column) -> Column:
    """Readable text of markup: block ends become line ends, tags go, common entities are decoded."""
    x = sub(x, r"<(script|style)\b[^>]*>[\s\S]*?</\1>", " ", "i")
    x = sub(x, r"</(p|div|tr|li|h[1-6])>|<br\s*/?>", "\n", "i")
    x = sub(x, r"<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(sub(sub(x, r"[ \t]+", " "), r"\n\s*\n\s*", "\n\n"))
