"""What is looked for in a text as plain Python, for functions that see whole documents: it gives what the column expressions of
the same names give, several times faster than functions of arrays do."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from itertools import count, groupby

from . import lexicons as L

LAST = 0x33480  # behind it are no letters, and no marks but those at 0xE0100


def _class(*kinds: str) -> str:
    """The characters of the general categories that begin with any of ``kinds``, as ranges of a character class."""
    found = (i for i in (*range(LAST), *range(0xE0000, 0xE0200)) if unicodedata.category(chr(i)).startswith(kinds))
    at = count()
    runs = [list(g) for _, g in groupby(found, lambda i: i - next(at))]
    return "".join(rf"\U{r[0]:08x}-\U{r[-1]:08x}" for r in runs)


_L, _MN = _class("L"), _class("Mn")
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_TOKEN = re.compile(rf"[{_L}][{_L}{_MN}'’-]+")
_WORD = rf"[{_L}][{_L}{_MN}'-]{{3,}}"
_RUN = re.compile(rf"{_WORD}(?:{_BLANK}+{_WORD}){{0,2}}")
_ASCII_RUN = re.compile(r"[a-z][a-z'-]{3,}(?:[\t-\r ]+[a-z][a-z'-]{3,}){0,2}")
_ASCII_WORDS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz'-" else 32 for c in range(256))
_BLANKS, _MARKS = re.compile(_BLANK + "+"), re.compile(f"[{_MN}]")
_END, _LEGAL = re.compile(L.PHRASE_END), re.compile(L.LEGAL_PHRASE)
_STOP, _LEARNED_STOP, _EDGE = frozenset(L.STOP_WORDS), frozenset(L.LEARNED_STOP), frozenset(L.PHRASE_EDGE)
_CATEGORIES = {k: p.split("|") if re.fullmatch(r"[a-z |]+", p) else re.compile(p, re.I | re.A) for k, p in L.CATEGORIES.items()}
HEAD = 4  # characters of a term that are looked for first


def half_up(x: float) -> float:
    """Rounded to four places as SQL rounds: half up, by the decimal digits of the number."""
    y = abs(x) * 1e4
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) if abs(y % 1 - 0.5) < 1e-4 else round(x, 4)


def tokens(low: str) -> list[str]:
    if low.isascii():  # most texts are, and a table of bytes is faster than a class of all letters
        words = (w.lstrip("-'") for w in low.encode().translate(_ASCII_WORDS).decode().split())
        return [w.rstrip("-'") for w in words if len(w) > 1]
    return [t for t in (x.strip("-'’") for x in _TOKEN.findall(low)) if t]


WEAK, EDGE, END, LEGAL = 1, 2, 4, 8
KEPT = 1 << 18  # words that a worker remembers


class Kinds(dict):
    """Whether a token is weak, no edge of a phrase, a head word that ends one, and a word of the law, as bits."""

    def __missing__(self, token: str) -> int:
        if len(self) > KEPT:
            self.clear()
        x = _MARKS.sub("x", token)
        weak = token in _STOP or len(token) < 4 or re.fullmatch("[0-9]+", token) is not None
        self[token] = k = WEAK * weak + EDGE * (token in _EDGE) + END * (_END.search(x) is not None) + LEGAL * (_LEGAL.search(x) is not None)
        return k


class _Near(dict):
    """Of a piece of text without blanks, the places of the terms whose first word it contains."""

    def __init__(self, terms: list[str]):
        self.heads: dict[str, list[tuple[int, str]]] = {}
        self.always = [i for i, t in enumerate(terms) if len(t[:HEAD].split()) != 1 or len(t) < HEAD or t[:HEAD].split()[0] != t[:HEAD]]
        for i in set(range(len(terms))).difference(self.always):
            self.heads.setdefault(terms[i][:HEAD], []).append((i, terms[i].split()[0]))

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > KEPT:
            self.clear()
        here = self.heads.keys() & {piece[i : i + HEAD] for i in range(len(piece) - HEAD + 1)}
        self[piece] = out = tuple(i for h in here for i, w in self.heads[h] if w in piece)
        return out


def finder(terms: list[str]) -> Callable[[str], list[int]]:
    """A function of a text: the places of the terms that it contains. A term is looked for where a piece of the text contains its
    first word."""
    near = _Near(terms)

    def find(x: str) -> list[int]:
        maybe = set(near.always)
        for piece in set(x.split()):
            if at := near[piece]:
                maybe.update(at)
        return sorted(i for i in maybe if terms[i] in x)

    return find


def categories(text: str) -> list[str]:
    """The areas of law whose pattern stands in a text; letters other than ASCII's have no case here."""
    low = text.encode("utf-8", "replace").lower().decode()
    return [k for k, p in _CATEGORIES.items() if (any(w in low for w in p) if isinstance(p, list) else p.search(low))]


def runs_before(text: str) -> Callable[[str], list[str]]:
    """A function of what follows a text in a line of its own: the runs of words of both. Only the text's last run can go on."""
    low = text.lower()
    run = lambda x: (_ASCII_RUN if x.isascii() else _RUN).finditer(x)
    found = list(run(low))
    open_ = bool(found) and not _BLANKS.sub("", low[found[-1].end() :])
    said = lambda ms: [t for t in (" ".join(m.group().split()) for m in ms) if t not in _LEARNED_STOP]
    base, rest = said(found[:-1] if open_ else found), low[found[-1].start() :] if open_ else ""
    return lambda tail: base + said(run(f"{rest}\n{tail.lower()}"))


def heaviest(found: list[str], n: int) -> list[tuple[str, float]]:
    """The ``n`` heaviest terms with their weights, those that came first winning ties."""
    weighed = [(t, c * (1.4 if " " in t else 1.0)) for t, c in Counter(found).items()]
    return sorted(weighed, key=lambda r: -r[1])[:n]
