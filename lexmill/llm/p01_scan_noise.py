"""Repair of text from scanned pages.

Three passes in Arrow batches, each over whole texts. A text is parted at blanks, and only distinct pieces are looked at
closer: what words a piece holds, and whether one of them is suspect, is remembered.

1. Counts over the whole corpus: words, hyphenated compounds, and the shapes of short lines that stand at the edge of a
   paragraph (letters to their case, digits to ``#``), apart for scanned files and others. A shape that scanned files
   have and the others don't, and whose lines recur within files, is page furniture.
2. Skip-gram vectors of the frequent words. Skip-gram with one negative sample factorises the matrix of pointwise mutual
   information of words and the words around them (its shift is the logarithm of the number of samples, here nought); the
   pairs are counted over all texts and the positive part of the matrix is factorised directly. Its size is bounded: a word
   must make up ``WORD_SHARE`` of all words, a context word ``CONTEXT_SHARE``, so there are at most 1/share of either,
   whatever the corpus holds. The matrix stays on the executors; the driver gets its Gram matrix (at most 1/CONTEXT_SHARE
   squared numbers, 32 MB) and the finished vectors.
3. Each scanned document: headers and footers (furniture shapes, or lines that recur in the document and whose shape
   other files don't have), page numbers, breaks within words, and misread words. A word that is not frequent, or far
   rarer than a frequent word of the same glyph skeleton, is linked to that neighbour; the neighbour is taken if the
   words around the place expect it (for a rare word: by their context vectors; for a commoner misreading such as that
   of an article: if both words' vectors point the same way). Of several neighbours the one the place expects most is
   taken. A word with a digit or sign within its letters is misread also where no neighbour is known.

Then furniture is dropped, broken words are joined, misread ones replaced, and lines reflowed; a paragraph that a page
break cut in mid sentence goes on. Null and blank texts have no noise; a repeated row gives repeated results; a text of
any length is one document. Texts of files that weren't scanned are counted in pass 1 and returned as they are.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import cut

from .cues import FOLD_FROM, FOLD_TO, FOLDS

WORD_SHARE, CONTEXT_SHARE, SHAPE_SHARE = 2e-5, 5e-4, 2e-3
BLOCK = 50  # rows of the Gram matrix that travel together
RATIO, ALIKE, DIM, WINDOW = 12, 0.6, 48, 2
# the least context score of a correction, by the word's length: few words lie one glyph from a long one
EXPECTED = {2: 0.5, 3: 0.1, 4: 0.03}
_TABLE, _SIGNS = str.maketrans(FOLD_FROM, FOLD_TO), str.maketrans("01!|", "olll")
_TOKEN = re.compile(r"[^\W_]+(?:[!|][^\W_]+)*")
_COMPOUND = re.compile(r"[^\W\d_]{2,}-[^\W\d_]{2,}")
_PLAIN = re.compile(r"\w+")
_N = r"[0-9OolIS]{0,3}[0-9][0-9OolIS]{0,3}"
_PAGE = re.compile(
    rf"\s*(?:\d{{1,4}}|{_N}|[-–—─]+\s*{_N}\s*[-–—─]+|\[\s*{_N}\s*\]|\(\s*{_N}\s*\)|{_N}\s*/\s*{_N}"
    rf"|(?:[Pp]a[gq][e\x63]|PA[GQ]E|[Pp][gq]\.?|[Pp]\.|[Pp][áa]g(?:ina)?\.?)\s*{_N}(?:\s*(?:of|0f|ot|/|de|sur)\s*{_N})?"
    rf"|[Pp]\s?[a]\s?[gq]\s?[ec]\s*[|l!]\s*{_N}|[─—–-]{{2,}}\s*PA[GQ]E\s*{_N}\s*[─—–-]{{2,}}|[ivxl]{{1,6}})\s*"
)
_END_MARK = re.compile(r"([^\W\d_]+)(-|¬|\xad|‐)[ \t\xa0]?$")
_START = re.compile(r"[^\W\d_]+")
_GLITCH = re.compile(r"(?:[^\W\d_]{2,}[0159!|][^\W\d_]+|[^\W\d_]+[0159!|][^\W\d_]{2,})(?:[0159!|]*[^\W\d_]+)*[0159]?|[^\W\d_]{3,}[015][^\W\d_]*")


def skeleton(word: str) -> str:
    w = word.lower().translate(_SIGNS)
    for a, b in FOLDS:
        w = w.replace(a, b)
    return w.translate(_TABLE)


def is_page_number(line: str) -> bool:
    s = line.strip()
    return len(s) < 60 and bool(_PAGE.fullmatch(s))


_LETTERS = re.compile(r"[^\W\d_](?:[\w'’]|(?<=\w)[!|](?=\w))*")


def shape(line: str) -> str | None:
    """The shape of a line that may be furniture; null for one with more than two common words."""
    s = re.sub(r"(\s{2,}|\t)\S{1,8}$", "", line.strip()) if re.search(r"(\s{2,}|\t)\S{1,8}$", line.strip()) else line.strip()
    low = 0

    def of(m: re.Match) -> str:
        nonlocal low
        w = m.group()
        if len(w) > 1 and sum(c.isupper() for c in w) * 2 > len(w):
            return "A"
        if w[0].isupper() or len(w) == 1:
            return "Aa" if len(w) > 1 else w
        low += 1
        return skeleton(w)

    out = re.sub(r"\d[\d.,]*", "#", _LETTERS.sub(of, s))
    return out if low <= 2 else None


_ENDS = frozenset(".,;:?!-¬\xad。！？।።")
_LOW = re.compile(r"(?<!\S)[a-z]")


def short_shape(line: str) -> str | None:
    """The shape of a short line that is no part of running text, else null."""
    s = line.strip()
    if not 2 < len(s) <= 90 or s[-1] in _ENDS or s[0].islower() or len(_LOW.findall(s)) > 3:
        return None
    if not s.isascii() and sum(w[0].islower() for w in s.split()) > 3:
        return None
    return shape(line)


def edge_lines(lines: list[str], free: list[bool]) -> dict[int, str]:
    """Shapes of the short lines at an edge: next to a blank line, a page number, or the text's start or end."""
    out, last = {}, len(lines) - 1
    for i, line in enumerate(lines):
        if not free[i] and (i == 0 or i == last or free[i - 1] or free[i + 1]) and (f := short_shape(line)):
            out[i] = f
    return out


_KEYS: dict[str, str] = {}


def head_key(line: str) -> str:
    """What copies of one header have in common: the letters' skeleton, without a page number at the end; remembered."""
    if line not in _KEYS:
        if len(_KEYS) > 100_000:
            _KEYS.clear()
        _KEYS[line] = skeleton(re.sub(r"[\W\d_]+", "", re.sub(r"(\s{2,}|\t)\S{1,8}$", "", line.strip())))
    return _KEYS[line]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        pieces, words, compounds, scan, plain, again, n = Counter(), Counter(), Counter(), Counter(), Counter(), Counter(), [0, 0]
        for text, scanned in zip(b["text"], b["scanned"], strict=True):
            pieces.update(text.lower().split())
            n[bool(scanned)] += 1
            lines = text.split("\n")
            edges = edge_lines(lines, [not x or x.isspace() or is_page_number(x) for x in lines])
            (scan if scanned else plain).update(set(edges.values()))
            if scanned:
                often = Counter(head_key(lines[i]) for i in edges)
                again.update({f for i, f in edges.items() if often[head_key(lines[i])] > 1})
        for w, k in pieces.items():  # blanks part words too, so a piece's words are words of the text
            for x in _PLAIN.findall(w):
                words[x] += k
            if "-" in w and "@" not in w:
                for x in _COMPOUND.findall(w):
                    compounds[x] += k
        rows = [("again", k, v, 0) for k, v in again.items()] + [("word", k, v, 0) for k, v in words.items()] + [("compound", k, v, 0) for k, v in compounds.items()]
        rows += [("shape", k, v, plain.get(k, 0)) for k, v in scan.items()] + [("shape", k, 0, v) for k, v in plain.items() if k not in scan] + [("documents", "", n[1], n[0]), ("words", "", words.total(), 0)]
        yield pd.DataFrame(rows, columns=["kind", "key", "a", "b"])


class Remembered(dict):
    """What ``f`` gave for each of up to half a million keys."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key):
        if len(self) > 500_000:
            self.clear()
        self[key] = v = self.f(key)
        return v


class Model:
    """What pass 3 needs: frequent words, their vectors, skeletons, compounds and furniture shapes."""

    def __init__(self, words: dict[str, int], compounds: frozenset[str], furniture: frozenset[str], ordinary: frozenset[str]):
        self.words, self.compounds, self.furniture, self.ordinary = words, compounds, furniture, ordinary
        self.ids = {w: i for i, w in enumerate(sorted(words, key=lambda w: (-words[w], w)))}
        self.by_skeleton: dict[str, list[str]] = {}
        for w in self.ids:
            self.by_skeleton.setdefault(skeleton(w), []).append(w)
        # words that need no second look: frequent, of letters, and alone with their skeleton
        self.good = frozenset(w for x in self.by_skeleton.values() if len(x) == 1 for w in x if w.isalpha())
        self.vectors = self.contexts = None
        self.remember()

    def remember(self) -> None:
        self.verdicts, self.suspects = Remembered(self.verdict), Remembered(self.suspect)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("verdicts", "suspects")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.remember()

    def suspect(self, piece: str) -> tuple[str, ...]:
        """The words of a piece between blanks that are not plainly right."""
        return tuple(w for w in _TOKEN.findall(piece) if w not in self.good and self.verdicts[w] != (None, False))

    def verdict(self, word: str) -> tuple[str | None, bool]:
        """(the neighbour, whether the word is misread by its looks)."""
        f = None if len(word) < 2 or word.isdigit() else self.neighbour(word)
        return f, f is None and len(word) > 2 and bool(_GLITCH.fullmatch(word))

    def neighbour(self, word: str) -> str | None:
        """The most frequent word with the same skeleton, if it is another one and far more frequent."""
        own = self.words.get(word, 0)
        for f in self.by_skeleton.get(skeleton(word), ()):
            return f if f != word and f.isalpha() and self.words[f] >= RATIO * max(own, 1) else None
        return None

    def best(self, word: str, around: list[str]) -> str | None:
        """Of the far more frequent words with the same skeleton the one that the words around expect most."""
        own = RATIO * max(self.words.get(word, 0), 1)
        these = [f for f in self.by_skeleton.get(skeleton(word), ()) if f != word and f.isalpha() and self.words[f] >= own]
        return these[0] if len(these) == 1 else max(these, key=lambda f: (self.expected(f, around), self.words[f]), default=None)

    def expected(self, word: str, around: list[str]) -> float:
        """How much the words around expect ``word``: mean of its vector against their context vectors."""
        at = [self.ids[w] for w in around if self.ids.get(w, len(self.contexts)) < len(self.contexts)]
        if not at:
            return 1.0 if len(word) > 3 else 0.0
        return float(np.mean(self.contexts[at] @ self.vectors[self.ids[word]]))

    def alike(self, a: str, b: str) -> float:
        u, v = self.vectors[self.ids[a]], self.vectors[self.ids[b]]
        n = np.linalg.norm(u) * np.linalg.norm(v)
        return float(u @ v / n) if n else 0.0


def learn(texts: DataFrame) -> Model:
    """The model of ``texts(text, scanned)``: passes 1 and 2."""
    spark = texts.sparkSession
    body = texts.filter("text is not null").select("text", "scanned")
    sums = body.mapInPandas(_counts, "kind string, key string, a long, b long").groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = cut(sums)
    total = {r.kind: (r.a, r.b) for r in sums.filter("kind in ('documents', 'words')").collect()}
    n_words, (n_scan, n_plain) = max(1, total.get("words", (0, 0))[0]), total.get("documents", (0, 0))
    # every list below is bounded by one over its share
    words = {r.key: r.a for r in sums.filter(F.col("kind") == "word").filter(F.col("a") >= max(3, WORD_SHARE * n_words)).collect()}
    compounds = frozenset(r.key for r in sums.filter(F.col("kind") == "compound").filter(F.col("a") >= max(3, WORD_SHARE * n_words / 4)).collect())
    again = {r.key: r.a for r in sums.filter(F.col("kind") == "again").filter(F.col("a") >= max(1, 0.1 * SHAPE_SHARE * n_scan)).collect()}
    shapes = sums.filter(F.col("kind") == "shape").filter((F.col("a") >= max(2, SHAPE_SHARE * n_scan)) | (F.col("b") >= max(1, SHAPE_SHARE * n_plain))).collect()
    rate = lambda n, of: n / max(1, of)
    furniture = frozenset(r.key for r in shapes if r.a >= max(2, SHAPE_SHARE * n_scan) and again.get(r.key, 0) >= 0.1 * r.a and rate(r.b, n_plain) < 0.06 * rate(r.a, n_scan) and n_plain)
    ordinary = frozenset(r.key for r in shapes if rate(r.b, n_plain) >= 0.2 * rate(r.a, n_scan) and r.b)
    model = Model(words, compounds, furniture, ordinary)
    n_context = sum(1 for w in words.values() if w >= CONTEXT_SHARE * n_words)
    ids, k = model.ids, max(1, len(model.ids))
    if not n_context:
        model.vectors, model.contexts = np.zeros((k, 1), np.float32), np.zeros((0, 1), np.float32)
        return model

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Remembered(lambda piece: tuple(ids.get(w, -1) for w in _PLAIN.findall(piece)))
        for b in batches:
            # texts one after another, parted by more unknown words than the window is wide
            flat: list[int] = []
            for text in b["text"]:
                flat.extend(chain.from_iterable(map(of.__getitem__, text.lower().split())))
                flat += [-1] * WINDOW
            seq = np.asarray(flat, dtype=np.int64)
            codes = []
            for d in range(1, WINDOW + 1):
                x, y = seq[:-d], seq[d:]
                ok = (x >= 0) & (y >= 0) & ((x < n_context) | (y < n_context))
                codes.append(x[ok] * k + y[ok])
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            # either word stands around the other
            x, y = code // k, code % k
            a, b_ = y < n_context, x < n_context
            yield pd.DataFrame({"w": np.concatenate([x[a], y[b_]]), "c": np.concatenate([y[a], x[b_]]), "n": np.concatenate([n[a], n[b_]])})

    # at most 1/WORD_SHARE x 1/CONTEXT_SHARE rows
    counts = cut(body.select("text").mapInPandas(pairs, "w long, c long, n long").groupBy("w", "c").agg(F.sum("n").alias("n")))
    rows, cols = counts.groupBy("w").agg(F.sum("n").alias("r")), counts.groupBy("c").agg(F.sum("n").alias("q"))
    all_ = max(1.0, float(counts.agg(F.sum("n")).first()[0] or 0))
    pmi = counts.join(F.broadcast(rows), "w").join(F.broadcast(cols), "c").select("w", "c", F.log(F.col("n") * all_ / F.col("r") / F.col("q")).alias("v")).filter("v > 0")
    # one row for each frequent word, of at most 1/CONTEXT_SHARE numbers
    matrix = cut(pmi.groupBy("w").agg(F.collect_list("c").alias("c"), F.collect_list("v").alias("v")))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((n_context, n_context))
        for b in batches:
            for c, v in zip(b["c"], b["v"], strict=True):
                g[np.ix_(c, c)] += np.outer(v, v)
        at = list(range(0, n_context, BLOCK))
        yield pd.DataFrame({"block": [i // BLOCK for i in at], "part": [g[i : i + BLOCK].tobytes() for i in at]})

    def added(g: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in g["part"])
        return pd.DataFrame({"block": g["block"].iloc[:1], "part": [total.tobytes()]})

    parts = matrix.mapInPandas(gram, "block int, part binary").groupBy("block").applyInPandas(added, "block int, part binary").collect()
    g = np.concatenate([np.frombuffer(r.part).reshape(-1, n_context) for r in sorted(parts)]) if parts else np.zeros((n_context, n_context))
    # the factors of the matrix, by its context side's eigenvectors
    _, vector = np.linalg.eigh(g)
    top = np.ascontiguousarray(vector[:, ::-1][:, : min(DIM, n_context)]).astype(np.float32)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"w": b["w"], "x": [np.asarray(v, np.float32) @ top[c] for c, v in zip(b["c"], b["v"], strict=True)]})

    model.vectors, model.contexts = np.zeros((k, top.shape[1]), np.float32), top
    for r in matrix.mapInPandas(project, "w long, x array<float>").toLocalIterator():
        model.vectors[r.w] = r.x
    return model


def _joins(left: str, mark: str, right: str, model: Model) -> bool:
    """Whether a mark at a line's end broke a word, as against a compound's own hyphen."""
    if mark in "¬\xad":
        return True
    a, b = left.lower(), right.lower()
    if right[:1].isupper() and not (left.isupper() and len(left) > 1 and right.isupper()):
        return False
    if f"{a}-{b}" in model.compounds and model.words.get(a + b, 0) == 0:
        return False
    if a + b in model.words or len(a) < 3 or len(b) < 3:
        return True
    return not (a in model.words and b in model.words and model.words[a] > 50 and model.words[b] > 50 and skeleton(a + b) not in model.by_skeleton)


_BANG = re.compile(r"[!|](?<=[^\W\d_].)(?=\s+[a-zà-ÿ])")


class Page:
    """One document's lines with what is wrong with each."""

    def __init__(self, text: str, model: Model):
        self.lines = text.split("\n")
        self.noise: list[tuple[int, str]] = []
        self.furniture: set[int] = set()
        self.joined: dict[int, int] = {}
        self.fixes: dict[int, list[tuple[int, int, str]]] = {}
        self._furniture(model)
        body = [i for i, x in enumerate(self.lines) if i not in self.furniture and x and not x.isspace()]
        self._breaks(body, model)
        self._words(text, body, model)

    def _furniture(self, model: Model) -> None:
        free = [not x or x.isspace() for x in self.lines]
        for i, x in enumerate(self.lines):
            if not free[i] and is_page_number(x):
                self.noise.append((i, "page_number"))
                self.furniture.add(i)
                free[i] = True
        edges = edge_lines(self.lines, free)
        known = {head_key(self.lines[i]) for i, f in edges.items() if f in model.furniture}
        # a header may stand within a paragraph, with nothing around it
        for i, x in enumerate(self.lines):
            if not free[i] and i not in edges and (f := short_shape(x)) and (f in model.furniture or head_key(x) in known):
                edges[i] = f
        key = {i: head_key(self.lines[i]) for i in edges}
        often = Counter(key.values())
        for i, f in edges.items():
            if f in model.furniture or (often[key[i]] > 1 and key[i] and f not in model.ordinary):
                self.noise.append((i, "running_header"))
                self.furniture.add(i)

    def _breaks(self, body: list[int], model: Model) -> None:
        for i, nxt in zip(body, [*body[1:], None][: len(body)], strict=True):
            if self.lines[i].rstrip()[-1:] not in "-¬\xad‐":
                continue
            m = _END_MARK.search(self.lines[i])
            if not m:
                continue
            right = _START.match(self.lines[nxt].lstrip()) if nxt is not None else None
            if (right and _joins(m[1], m[2], right.group(), model)) or (not right and m[2] in "¬\xad"):
                self.noise.append((i, "hyphen_break"))
                if right:
                    self.joined[i] = nxt

    def _words(self, text: str, body: list[int], model: Model) -> None:
        """Only words that are not plainly right are looked for in their places."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer would shift the places
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        suspects = set(chain.from_iterable(map(model.suspects.__getitem__, set(low.split()))))
        starts, at = [], 0
        for x in self.lines:
            starts.append(at)
            at += len(x) + 1
        into = {j: i for i, j in self.joined.items()}
        bad: set[int] = set()
        for w in suspects:
            f, glitch = model.verdicts[w]
            s = low.find(w)
            while s >= 0:
                e = s + len(w)
                if not (low[s - 1 : s].isalnum() or low[e : e + 1].isalnum()):
                    i = bisect.bisect_right(starts, s) - 1
                    if i not in self.furniture and self._misread(i, s - starts[i], e - starts[i], w, f, glitch, into, model):
                        bad.add(i)
                s = low.find(w, e)
        for i, j in self.joined.items():
            for line, part in ((i, -1), (j, 0)):
                if self._half(line, into, part, model):
                    bad.add(line)
        for m in _BANG.finditer(low):  # a sign that stands for a letter may end the word
            s = m.start()
            while s and low[s - 1].isalnum():
                s -= 1
            w = low[s : m.start()]
            f = model.verdicts[w + "!"][0] if w and w not in model.words else None
            i = bisect.bisect_right(starts, m.start()) - 1
            if f and i not in self.furniture:
                self.fixes.setdefault(i, []).append((m.start() - len(w) - starts[i], m.end() - starts[i], f))
                bad.add(i)
        self.noise += [(i, "misread_characters") for i in bad]

    def _misread(self, i: int, s: int, e: int, w: str, f: str | None, glitch: bool, into: dict[int, int], model: Model) -> bool:
        line = self.lines[i]
        if (s and line[s - 1] in "@_") or line[e : e + 1] in ("@", "_"):
            return False
        if (line[e : e + 1] == "." and line[e + 1 : e + 2].isalnum()) or (s and line[s - 1] == "." and line[s - 2 : s - 1].isalnum()):
            return False
        found = list(_TOKEN.finditer(line))
        k = next((n for n, m in enumerate(found) if m.start() == s), None)
        if k is None:
            return False
        if (i in self.joined and k == len(found) - 1) or (i in into and k == 0):
            return bool(re.search(r"[^\W\d_][0159!|][^\W\d_]", w))
        if f is None:
            return glitch
        words = [m.group().lower() for m in found]
        around = words[max(0, k - WINDOW) : k]
        if not k and i:
            before = next((self.lines[j] for j in range(i - 1, max(-1, i - 8), -1) if j not in self.furniture and self.lines[j].strip()), "")
            around = [x.lower() for x in _TOKEN.findall(before)[-WINDOW:]]
        around += words[k + 1 : k + 1 + WINDOW]
        if w in model.ids:
            # a misreading stands where the right word stands
            good = model.alike(w, f) >= ALIKE and w not in around
        else:
            good = any(c.isdigit() or c in "!|" for c in w) or model.expected(f, around) >= EXPECTED.get(len(w), 0.0)
        if good:
            self.fixes.setdefault(i, []).append((s, e, _case(line[s:e], model.best(w, around) or f)))
        return good

    def _half(self, i: int, into: dict[int, int], part: int, model: Model) -> bool:
        """Whether the half of a broken word in this line (its last word, or its first) holds the misread character."""
        a, b = (i, self.joined[i]) if part else (into[i], i)
        left, right = _TOKEN.findall(self.lines[a].lower())[-1:], _TOKEN.search(self.lines[b].lower())
        left, right = left[0] if left else "", right.group() if right else ""
        whole = left + right
        if not left or not right or whole in model.words:
            return False
        f = model.verdicts[whole][0]
        if not f:
            return False
        own = left if part else right
        if len(f) == len(whole):
            return own != (f[: len(left)] if part else f[len(left) :])
        return not (f.startswith(own) if part else f.endswith(own))

    def repaired(self) -> str:
        paragraphs: list[str] = []
        current, gap, broke = "", True, False
        for i, line in enumerate(self.lines):
            if i in self.furniture:
                continue
            if not line.strip():
                gap = True
                continue
            for s, e, f in sorted(self.fixes.get(i, ()), reverse=True):
                line = line[:s] + f + line[e:]
            line = line.strip()
            # after a page's furniture, an unfinished sentence goes on
            cut = any(j in self.furniture for j in range(max(0, i - 6), i)) and current and not re.search(r"[.!?:;。！？।።][\"'”’»)\]]*$", current)
            if current and gap and not broke and not (cut and not line[:1].isupper()):
                paragraphs.append(current)
                current = line
            elif broke:
                current += line
            else:
                current = f"{current} {line}" if current else line
            broke = i in self.joined
            if broke:
                current = re.sub(r"(-|¬|\xad|‐)\s?$", "", current)
            elif re.search(r"[^\W\d_]-$", current):
                broke = True  # a compound's own hyphen stays, without a blank after it
            gap = False
        if current:
            paragraphs.append(current)
        return "\n\n".join(paragraphs)


def _case(seen: str, word: str) -> str:
    return word.upper() if seen.isupper() and len(seen) > 2 else word[:1].upper() + word[1:] if seen[:1].isupper() else word


def texts(legal: DataFrame) -> DataFrame:
    """(document_id, text, scanned): a file that isn't plain text was scanned. A row without an id is left out."""
    return legal.filter("id is not null").select(F.col("id").alias("document_id"), F.col("extracted_text").alias("text"), (F.coalesce(F.col("mime_type"), F.lit("")) != "text/plain").alias("scanned"))


def found(legal: DataFrame) -> DataFrame:
    """(document_id, line_no, noise_kind): the noisy lines of scanned documents."""
    t = texts(legal)
    model = t.sparkSession.sparkContext.broadcast(learn(t))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, text in zip(b["document_id"], b["text"], strict=True):
                rows += [(d, i + 1, kind) for i, kind in sorted(set(Page(text, model.value).noise))]
            yield pd.DataFrame(rows, columns=["document_id", "line_no", "noise_kind"])

    return t.filter("scanned and text is not null").select("document_id", "text").mapInPandas(work, "document_id long, line_no long, noise_kind string")


def repaired(legal: DataFrame) -> DataFrame:
    """(document_id, repaired_text) of every document; null stays null."""
    t = texts(legal)
    model = t.sparkSession.sparkContext.broadcast(learn(t))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [Page(x, model.value).repaired() if x is not None and s else x for x, s in zip(b["text"], b["scanned"], strict=True)]
            yield pd.DataFrame({"document_id": b["document_id"], "repaired_text": done})

    return t.mapInPandas(work, "document_id long, repaired_text string")
