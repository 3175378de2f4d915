"""Personal information in free text: found, and replaced by typed placeholders that keep equal values linked.

Numbers, mail and street addresses are found by their forms and validated (digit counts, separators, neighbours that
mark an invoice, a case or a reference). Persons' names need a model of what a name looks like, and it is trained on the
texts themselves: the words after initials give the endings of surnames, the capitalised words right before such a
surname the endings of given names. Only endings with at least a share of ``SHARE`` of those words count, so either set
has at most 1/SHARE entries whatever the size of the corpus, and may travel with the tasks. Endings are compared as
skeletons, which misread characters leave alike.

A number is validated before it counts: a phone number has 9 to 15 digits, its country code is one that is assigned and
what follows has 6 to 12 digits, not all alike; an identity number's district and running number are not nought; a date is
one of the calendar. Check letters are not asked for: misread numbers would be left standing for want of one.

A placeholder names the type and, for numbers, holds a pseudonym of the same format: the digits (and letters) of the
validated number are permuted under a key by a balanced Feistel network, separators and the public prefix (the country code,
or the nought that stands for it) staying in place. The same number written in two ways, or in two documents, gets the same
digits. Names, mail and street addresses get a keyed tag of 64 bits for the same purpose. With ``dates=True`` validated
calendar dates are permuted within 1900-2099 in the form they are written in; the statement of this project's data keeps
dates, so that is a query of its own.

``replacements`` is the operator; ``found`` and ``redacted`` are views of what it replaced. Looking back from a surname or a
mail's sign is bounded by what may stand there: ``NAME_PART`` characters for one name with its blanks, ``LOCAL_PART`` for the
local part of an address (64 by its standard, and breaks).

Null and blank texts hold nothing and stay as they are; repeated rows give repeated results, and ``found`` distinct
ones; texts of any length are read whole.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut

from .cues import FOLD_FROM, FOLD_TO, FOLDS, fold

SHARE, TAIL = 0.002, 4
NAME_PART, LOCAL_PART = 60, 80
# The assigned country codes of two digits; 1 and 7 have one digit, all others three.
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
# The first two digits of assigned codes of three digits.
THREE_DIGITS = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
_TABLE, _SIGNS = str.maketrans(FOLD_FROM, FOLD_TO), str.maketrans("01!|", "olll")

_HY = r"(?:[-¬­]\s?\n\s?)?"  # a break inside a word
# addresses of mail are read outwards from their sign, or from the spelled-out dot
_AT = re.compile(r"@|[\[({]at[\])}]|＠", re.I)
_AT_DOT = re.compile(_AT.pattern + r"|(?<=\w)\s+at\s+(?=[\w-]+\s+dot\s)", re.I)
_LOCAL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]|[-¬­]\s?\n)*\s?\Z")
_DOMAIN = re.compile(r"\s?[A-Za-z0-9-]+(?:(?:[-¬­]\s?\n)?[A-Za-z0-9-]*(?:\.|\s?[\[({]dot[\])}]\s?|\s+dot\s+)[A-Za-z0-9-]+)+", re.I)
_S = r"[ \t ]?\n?"
_PHONE = re.compile(
    r"(?<![\w+/.-])(?:(?:\+|00)\d{1,3}[\s.-]?\(?\d{2,3}\)?[\s.-]?\d{3}[\s.-]?\d{3,4}(?:[\s.-]?\d{2,4})?|\(0\d{2,4}\)\s?\d{3}[\s.-]?\d{4}|0\d{2,4}[.-]\d{3}[.-]\d{3,4}|\+\d{1,3}(?:[ .-]?\(?\d{1,6}\)?){2,5}|0\d{4}\s\d{6}|0\d{2}\s\d{3}\s\d{4}|0\d{3}\s\d{3}\s\d{3,4}|0[1-9]\d{8})(?![\w/-])(?!\.\d)"
)
_ID = re.compile(r"(?<![\w/-])(?:\d{2}[\s-]?\d{6,7}\s?[A-Z]\s?\d{2}|[A-Z]{2}\d{6,7})(?![\w/-])")
_KIND = r"St\.|Ave\.|(?:Street|Road|Avenue|Lane|Drive|Way|Close|Crescent|Boulevard|Terrace|Place|Square|Rd|St|Ave)(?![A-Za-z])"
_WORD = rf"[A-Z][a-z'01!9]+{_HY}[a-z'01!9]*"
_STREET = re.compile(rf"(?<![\w/-])(?:(?:Flat|Unit|Suite|Apt\.?|Apartment|Room)\s+\d+[A-Z]?,\s+)?(?:Stand\s+(?:No\.\s*)?)?\d{{1,5}}[A-Z]?\s+(?:{_WORD}\s+){{1,3}}?(?:{_KIND})")
_TITLE = {"mr", "mrs", "ms", "miss", "dr", "adv", "prof", "rev", "hon", "sir", "messrs", "mme", "sr", "sra", "the", "late", "and", "of", "to"}
# letters of names: Latin with its accents, Greek, Cyrillic
_UP, _LO = "A-ZÀ-ÖØ-ÞΑ-ΩА-Я", "a-zß-öø-ÿα-ωа-я"
_L = f"A-Za-zÀ-ÖØ-öø-žΆ-ώЀ-ӿ"
_NAME_WORD = rf"[{_L}][{_L}0159!|]*(?:[-¬­]\s?\n\s?[{_LO}0159!|]+|-[{_L}][{_L}0159!|]+)*"
_BACK = re.compile(rf"(?<![{_L}0-9]){_NAME_WORD}\Z")
_BROKEN = re.compile(rf"[-¬­](?<=[{_L}]{{2}}.)\s?\n\s?[{_LO}0159!|]{{1,3}}(?![{_L}0-9])")
_RUN = re.compile(rf"[{_L}0159!|]{{3,}}")
_INITIALS = re.compile(rf"(?<![{_L}])((?:[{_UP}]\.\s*){{1,3}})$")
_MIDDLE = re.compile(rf"(?<![{_L}0-9@.])({_NAME_WORD})\s+(?:(?:[{_UP}]\.\s*){{1,2}})?$")
_AFTER = re.compile(rf"\A,\s+({_NAME_WORD})(?:\s+(?:[{_UP}]\.)(?=\s))*(?![{_L}@])")
_ALNUM, _GOES_ON = re.compile(rf"[{_L}0-9]"), re.compile(rf"-[{_UP}]")


def skeleton(word: str) -> str:
    w = re.sub(r"[-¬­]\s?\n\s?", "", word).lower().translate(_SIGNS)
    for a, b in FOLDS:
        w = w.replace(a, b)
    w = w.translate(_TABLE)
    # accents are lost with their letters, as in texts that were wrongly decoded; another script keeps its own
    return w if w.isascii() else "".join(c for c in w if c < "\x80" or c >= "\u0370")


def endings(texts: DataFrame, share: float = SHARE) -> tuple[list[str], list[str]]:
    """(surname endings, given-name endings) of the whole corpus ``texts(text)``, at most 1/share each."""
    tail = lambda c: F.expr(f"right({c}, {TAIL})")
    body = texts.filter("text is not null")
    after = body.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}.])(?:\p{Lu}\.\s){1,2}(\p{Lu}\p{Ll}{4,})(?![\p{L}-])"), F.lit(1))).alias("w"))
    counts = after.select(fold(F.col("w")).alias("s")).select(tail("s").alias("tail")).groupBy("tail").agg(F.count("*").alias("n"))
    rows = _common(counts, share)
    if not rows:
        return [], []
    ends = "|".join(re.escape(r) for r in rows)
    # the endings as written may differ from their skeletons, so the pair is taken first and folded after
    pairs = body.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}.])(\p{Lu}\p{Ll}{3,} \p{Lu}\p{Ll}{4,})(?![\p{L}-])"), F.lit(1))).alias("p"))
    pairs = pairs.groupBy("p").agg(F.count("*").alias("n")).select(fold(F.substring_index("p", " ", 1)).alias("g"), fold(F.substring_index("p", " ", -1)).alias("s"), "n")
    given = pairs.filter(F.col("s").rlike(f"(?:{ends})$")).select(tail("g").alias("tail"), "n").groupBy("tail").agg(F.sum("n").alias("n"))
    return rows, _common(given, share)


def _common(counts: DataFrame, share: float) -> list[str]:
    counts = cut(counts.filter(f"length(tail) = {TAIL}"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted(r.tail for r in counts.filter(F.col("n") >= max(2, share * total)).select("tail").collect())


_SEEN: dict[str, str] = {}


def _tail(word: str) -> str:
    """The end of a word's skeleton; remembered, for words recur."""
    end = word[-2 * TAIL :]
    if end not in _SEEN:
        if len(_SEEN) > 200_000:
            _SEEN.clear()
        _SEEN[end] = skeleton(end)[-TAIL:]
    return _SEEN[end]


def names(text: str, surnames: frozenset[str], given: frozenset[str]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    ends = {m.end() for m in _BROKEN.finditer(text)}
    for w in set(_RUN.findall(text)):
        if _tail(w) in surnames:
            at = text.find(w)
            while at >= 0:
                ends.add(at + len(w))
                at = text.find(w, at + 1)
    for e in sorted(ends):
        if _ALNUM.match(text, e):
            continue
        at = max(0, e - NAME_PART)
        m = _BACK.search(text[at:e])
        if not m or len(w := m.group()) < 5:
            continue
        s = at + m.start()
        # of a double name that goes on after the hyphen, the end counts
        if _GOES_ON.match(text, e) or any(skeleton(p)[-TAIL:] not in surnames for p in re.split(r"-(?!\s?\n)", w) if p):
            continue
        if (out and s < out[-1][1]) or (text[s - 1 : s] in ("@", ".", "_") and text[s - 2 : s - 1].isalnum()) or re.match(r"[@_]|\s?(?:[\[({]at[\])}])|\.[a-z]", text[e : e + 6]):
            continue
        back = text[max(0, s - NAME_PART) : s]
        before = _MIDDLE.search(back)
        if before and len(before.group(1)) > 3 and before.group(1).lower() not in _TITLE and _given(before.group(1), given, w):
            out.append((s - len(back) + before.start(1), e))
            continue
        initials = _INITIALS.search(back)
        if initials and not w.islower():
            out.append((s - len(back) + initials.start(1), e))
            continue
        then = _AFTER.match(text[e : e + NAME_PART])
        if then and len(then.group(1)) > 3 and _given(then.group(1), given, w):
            out.append((s, e + then.end()))
    return out


def mails(text: str) -> list[tuple[int, int]]:
    out = []
    for m in (_AT_DOT if " dot" in text or "\ndot" in text else _AT).finditer(text):
        local = _LOCAL.search(text[max(0, m.start() - LOCAL_PART) : m.start()])
        domain = _DOMAIN.match(text, m.end()) if local else None
        if domain:
            out.append((m.start() - len(local.group()), domain.end()))
    return out


def _given(word: str, given: frozenset[str], surname: str) -> bool:
    if word.islower() != surname.islower():
        return False
    return skeleton(word)[-TAIL:] in given


def national(text: str) -> int:
    """How many of a phone number's digits are its public prefix: the country code with its sign, or a leading nought; a
    nought in brackets that stands between them belongs to it. Negative if no such code is assigned."""
    digits = [c for c in text if c.isdigit()]
    lead = 2 if text.lstrip().startswith("00") else 0
    if not lead and not text.lstrip().startswith("+"):
        return 1 if digits[:1] == ["0"] else 0
    code = "".join(digits[lead : lead + 2])
    n = 1 if code[:1] in ("1", "7") else 2 if code in TWO_DIGITS else 3 if code in THREE_DIGITS else -99
    return lead + n + bool(re.search(r"\(0\)", text))


def valid(text: str, kind: str) -> bool:
    """Whether a number keeps the rules of its kind; other kinds have none."""
    digits = [c for c in text if c.isdigit()]
    if kind == "phone":
        k = national(text)
        return k >= 0 and 9 <= len(digits) <= 15 and 6 <= len(digits) - k <= 12 and len(set(digits[k:])) > 1
    return kind != "id_number" or any(c != "0" for c in digits[2 if text[:1].isdigit() else 0 :])


def spans(text: str, surnames: frozenset[str], given: frozenset[str]) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, type) in order; a longer form wins over one inside it."""
    out: list[tuple[int, int, str]] = []
    out += [(a, b, "email") for a, b in mails(text)]
    taken = [(a, b) for a, b, _ in out]
    for kind, pattern in (("id_number", _ID), ("phone", _PHONE), ("street_address", _STREET)):
        i, new = 0, []
        for m in pattern.finditer(text):
            if not valid(m.group(), kind):
                continue
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if i == len(taken) or taken[i][0] >= m.end():
                new.append((*m.span(), kind))
        out += new
        taken = sorted(taken + [(a, b) for a, b, _ in new])
    addresses = [(a, b) for a, b, k in out if k == "email"]
    i = 0
    for a, b in names(text, surnames, given):
        while i < len(addresses) and addresses[i][1] <= a:
            i += 1
        if i == len(addresses) or addresses[i][0] >= b:
            out.append((a, b, "person_name"))
    out.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str]] = []
    for x in out:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    return kept


def _round(key: bytes, tweak: str, i: int, right: int, mod: int) -> int:
    return int.from_bytes(hmac.digest(key, f"{tweak}|{i}|{right}".encode(), "sha256")[:16], "big") % mod


def feistel(value: int, size: int, key: bytes, tweak: str, rounds: int = 8) -> int:
    """A keyed permutation of range(size): a Feistel network over a*b >= size, walked until it falls inside."""
    a = math.isqrt(size - 1) + 1
    b = a
    while True:
        left, right = divmod(value, b)
        m, n = a, b
        for i in range(rounds):
            left, right, m, n = right, (left + _round(key, tweak, i, right, m)) % m, n, m
        value = left * n + right
        if value < size:
            return value


def pseudonym(text: str, kind: str, key: bytes) -> str:
    """``text`` with its private digits and letters permuted within the format. A phone number's public prefix stays."""
    chars = list(text)
    at = [i for i, c in enumerate(chars) if c.isdigit() or (kind == "id_number" and c.isalpha())]
    if kind == "phone":
        # written with a country code or with a leading nought, a number is the same number
        at = at[max(0, national(text)) :]
    flat = "".join(chars[i] for i in at)
    value, size = 0, 1
    bases = [10 if c.isdigit() else 26 for c in flat]
    for c, base in zip(flat, bases, strict=True):
        value, size = value * base + (int(c) if base == 10 else ord(c.upper()) - 65), size * base
    if size < 2:
        return text
    value = feistel(value, size, key, f"{kind}|{''.join('d' if b == 10 else 'a' for b in bases)}")
    for i, base in zip(reversed(at), reversed(bases), strict=True):
        value, d = divmod(value, base)
        chars[i] = str(d) if base == 10 else chr(65 + d)
    return "".join(chars)


def date_pseudonym(d: dt.date, key: bytes) -> dt.date:
    first, last = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
    return dt.date.fromordinal(first + feistel(d.toordinal() - first, last - first + 1, key, "date")) if first <= d.toordinal() <= last else d


# Month names as dates write them.
MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS)
_DATE = re.compile(rf"(?<![\d/-])(?:(\d{{1,2}})([/-])(\d{{1,2}})\2((?:19|20)\d\d)|((?:19|20)\d\d)-(\d\d)-(\d\d)|(\d{{1,2}})(\s+)({_MONTH})(\.?\s+)((?:19|20)\d\d))(?![\d/-])")


def placeholder(text: str, kind: str, key: bytes) -> str:
    tag = kind.upper()
    if kind in ("phone", "id_number"):
        return f"[{tag} {pseudonym(re.sub(r'\s+', ' ', text), kind, key)}]"
    plain = re.sub(r"[\W_]+", "", re.sub(r"[-¬­]\s?\n\s?", "", text)).lower()
    return f"[{tag} {hashlib.blake2b(plain.encode(), key=key[:64], digest_size=8).hexdigest()}]"


def redact(text: str | None, surnames: frozenset[str], given: frozenset[str], key: bytes, dates: bool = False) -> str | None:
    if not text:
        return text
    out, at = [], 0
    found_ = spans(text, surnames, given)
    for a, b, kind in found_:
        out += [text[at:a], placeholder(text[a:b], kind, key)]
        at = b
    out.append(text[at:])
    done = "".join(out)

    def move(m: re.Match) -> str:
        try:
            if m[4]:
                d = dt.date(int(m[4]), int(m[3]), int(m[1]))
            elif m[5]:
                d = dt.date(int(m[5]), int(m[6]), int(m[7]))
            else:
                d = dt.date(int(m[12]), next(i for i, x in enumerate(MONTHS, 1) if x.startswith(m[10][:3])), int(m[8]))
        except ValueError:
            return m.group()
        x = date_pseudonym(d, key)
        if m[4]:
            return f"{x.day:02d}{m[2]}{x.month:02d}{m[2]}{x.year:04d}"
        if m[5]:
            return x.isoformat()
        # a shortened month stays so
        month = MONTHS[x.month - 1]
        return f"{x.day}{m[9]}{month if m[10] in MONTHS else month[:3]}{m[11]}{x.year:04d}"

    return _DATE.sub(move, done) if dates else done


def texts(legal: DataFrame, summaries: DataFrame) -> DataFrame:
    """(source_table, row_id, text) of the two tables' text columns; a row without an id is left out."""
    legal, summaries = legal.filter("id is not null"), summaries.filter("id is not null")
    a = legal.select(F.lit("legal_documents").alias("source_table"), F.col("id").alias("row_id"), F.col("extracted_text").alias("text"))
    return a.unionByName(summaries.select(F.lit("summaries").alias("source_table"), F.col("id").alias("row_id"), F.col("parties").alias("text")))


def replacements(legal: DataFrame, summaries: DataFrame, key: bytes) -> DataFrame:
    """(source_table, row_id, start_pos, end_pos, pii_type, pii_text, placeholder) of every value that is replaced; positions
    from 1, runs of white space in ``pii_text`` written as one blank."""
    all_texts = texts(legal, summaries)
    surnames, given = map(frozenset, endings(all_texts))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for table_, row, text in zip(b["source_table"], b["row_id"], b["text"], strict=True):
                for s, e, kind in spans(text, surnames, given):
                    rows.append((table_, row, s + 1, e, kind, re.sub(r"\s+", " ", text[s:e]), placeholder(text[s:e], kind, key)))
            yield pd.DataFrame(rows, columns=["source_table", "row_id", "start_pos", "end_pos", "pii_type", "pii_text", "placeholder"])

    return all_texts.filter("text is not null").mapInPandas(work, "source_table string, row_id long, start_pos long, end_pos long, pii_type string, pii_text string, placeholder string")


def found(legal: DataFrame, summaries: DataFrame, key: bytes = b"lexmill") -> DataFrame:
    """(source_table, row_id, pii_type, pii_text), distinct: what is replaced."""
    return replacements(legal, summaries, key).select("source_table", "row_id", "pii_type", "pii_text").distinct()


def redacted(legal: DataFrame, summaries: DataFrame, key: bytes, dates: bool = False) -> DataFrame:
    """(source_table, row_id, redacted_text) of every row; null stays null."""
    all_texts = texts(legal, summaries)
    surnames, given = map(frozenset, endings(all_texts))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"source_table": b["source_table"], "row_id": b["row_id"], "redacted_text": [redact(t, surnames, given, key, dates) for t in b["text"]]})

    return all_texts.mapInPandas(work, "source_table string, row_id long, redacted_text string")
