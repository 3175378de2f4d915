"""The language of a text by its script, its function words and its letter trigrams.

Other scripts than Latin are told by their letters. Among the languages in Latin letters the function words decide where one
language has clearly more of them; otherwise letter trigrams do. The trigrams are trained on all texts at hand: texts whose
function words are clear teach the trigrams of their language, which then tell texts of too few function words, and languages that join many words into one. Without
training the function words alone decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LEAST_TEXTS, LEAST_GRAMS, FLOOR = 3, 12, -1.0
ELIDED = frozenset("l d qu n s c j m".split())  # French before an apostrophe
# Frequent function words of the languages written in Latin letters.
WORDS = {
    "en": "the of and to is was were in that it for not by on with you can this be at are or if from has had have an as which but must may i my your no who their they his her will would so what when there we he she been do",
    "fr": "le la les des du et est une qui dans pas pour au aux sur par avec je ne ce été dont son sa ses il elle nous vous sous sans c'est selon plus deux être ont leur cette un que mais ou se en",
    "pt": "o os as do da dos das e é um uma que não em no na para por com foi pelo pela pelas se ao ou mais seja mas posso este esta à às nos sua seu de são são ele ela isso quem muito também já",
    "es": "el la los las y en que del se por con no una su es al lo como más pero sus le ya fue este esta sí porque entre cuando muy sin sobre también me hasta hay donde quien desde todo nos ni contra son unos ella han un de ha debe",
    "de": "der die das und ist nicht ein eine einer eines einem den dem des mit von zu im auf für wird wurde werden auch sich als an nach wie oder aber hat haben war bei aus sie er es ich wir ihr kein keine durch über unter zur zum daß dass noch nur vor",
    "it": "il lo gli di che è un una per con non del della dei delle nel nella sono ha al alla come da si anche più ma questo questa o se ed i le suo sua dal dalla essere stato hanno tra fra",
    "nl": "de het een en van is niet op te dat die in voor met zijn aan door ook bij als uit om maar werd wordt naar ze hij er geen over hun nog wel deze dit heeft hebben onder tegen",
    "sn": "uye kana kuti asi iye ini isu imi ivo nokuti sei chii ndiani pa ku mu wa ya za cha ndi haana haina musi mukati pamberi pasi munhu vanhu wese vese zvose iyi ichi iri uyo avo ane vane unogona anofanira zvino zvakare kusvika rako ake yake wake ne na se pane pasina pasati yese kwete hongu nyaya mwedzi mazuva",
    "nd": "ukuthi kodwa futhi ngoba yena mina thina bona ku kumele nxa uma lapho bonke phambi ngubani yini le leli lesi lo lokhu umuntu abantu ka kwa e uthe ithe sithi yi kumbe njengoba ngemva phansi wonke zonke insuku lakho lakhe yakhe wami kungakapheli mhla ngaphandle khona njalo kakhulu",
}
# Letter ranges of the other scripts and the language each stands for.
SCRIPTS = {"ar": "؀-ۿݐ-ݿ", "am": "ሀ-፿", "hi": "ऀ-ॿ", "th": "฀-๿", "zh": "㐀-鿿", "ja": "぀-ヿ", "ru": "Ѐ-ӿ", "ko": "가-힯", "el": "Ͱ-Ͽ", "he": "֐-׿"}


_SETS = {code: frozenset(w.split()) for code, w in WORDS.items()}
_OF = {w: tuple(code for code, own in _SETS.items() if w in own) for w in set().union(*_SETS.values())}
_WORD = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)*")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+")
_RUNS = {code: re.compile(f"[{r}]+") for code, r in SCRIPTS.items()}
_OTHER = re.compile("[" + "".join(SCRIPTS.values()) + "]+")


def _size(pattern: re.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def _script(text: str) -> str | None:
    """The language of a text of which another script than Latin has a quarter of the letters or more."""
    other = _size(_OTHER, text)
    if not other or other * 3 < _size(_LATIN, text):
        return None
    counts = {code: _size(run, text) for code, run in _RUNS.items()}
    # Japanese mixes kana with the letters it shares with Chinese
    return "ja" if counts["ja"] * 8 >= other else max(counts, key=counts.get)


_CODES: dict[str, tuple[str, ...]] = {}


def _codes(piece: str) -> tuple[str, ...]:
    """The languages that the words of a piece between blanks speak for."""
    out: list[str] = []
    for w in _WORD.findall(piece):
        out += _OF.get(w, ())
        if ("'" in w or "’" in w) and re.split("['’]", w)[0] in ELIDED:
            out.append("fr")
    return tuple(out)


def _hits(text: str) -> Counter:
    """How many function words of each language a text has. Few different pieces stand between blanks, so theirs are
    remembered."""
    hits: Counter = Counter()
    for piece, n in Counter(text.lower().split()).items():
        got = _CODES.get(piece)
        if got is None:
            if len(_CODES) > 200_000:
                _CODES.clear()
            got = _CODES[piece] = _codes(piece)
        for code in got:
            hits[code] += n
    return hits


def _clear(hits: Counter) -> str | None:
    """The language with at least three hits and half as many again as any other."""
    top = hits.most_common(2)
    return top[0][0] if top and top[0][1] >= 3 and (len(top) < 2 or top[0][1] >= 1.5 * top[1][1]) else None


def _trigrams(words: Counter) -> Counter:
    """Of the words, each as often as it is given."""
    out: Counter = Counter()
    for w, n in words.items():
        if len(w) > 2 and w[0].isalpha():
            w = f" {w} "
            for i in range(len(w) - 2):
                out[w[i : i + 3]] += n
    return out


def _counts(texts: Iterable[str]) -> Iterator[tuple[Counter, dict[str, Counter]]]:
    """Of the texts with clear function words, by language: how many there are, and in how many of them each word stands. Given
    out whenever there are many different words."""
    n_texts: Counter = Counter()
    by: dict[str, Counter] = {}
    for text in texts:
        if not text or not (text.isascii() or _script(text) is None):
            continue
        if code := _clear(_hits(text)):
            n_texts[code] += 1
            of = by.setdefault(code, Counter())
            of.update(set(_WORD.findall(text.lower())))
            if len(of) > 200_000:
                yield n_texts, by
                n_texts, by = Counter(), {}
    yield n_texts, by


def _model(n_texts: dict[str, int], by: dict[str, dict[str, int]]) -> dict[str, dict[str, float]]:
    """By language the logarithms of its trigrams' shares, over how common they are in all languages together."""
    by = {code: c for code, c in sorted(by.items()) if n_texts[code] >= LEAST_TEXTS}
    sizes = {code: sum(c.values()) for code, c in by.items()}
    seen = set().union(*by.values()) if by else set()
    out: dict[str, dict[str, float]] = {code: {} for code in by}
    for g in seen:
        share = {code: (c.get(g, 0) + 0.5) / (sizes[code] + 0.5 * len(seen)) for code, c in by.items()}
        mean = sum(share.values()) / len(by)
        for code in by:
            out[code][g] = max(FLOOR, math.log(share[code] / mean))
    return out


def train(texts: list[str]) -> dict[str, dict[str, float]]:
    """The trigrams of ``texts``."""
    n_texts: Counter = Counter()
    by: dict[str, Counter] = {}
    for n, words in _counts(texts):
        n_texts.update(n)
        for code, c in words.items():
            by.setdefault(code, Counter()).update(_trigrams(c))
    return _model(n_texts, by)


def detect(text: str | None, model: dict[str, dict[str, float]] | None = None) -> str | None:
    """Language code, or null where a text has too little to tell."""
    if not text:
        return None
    if not text.isascii() and (code := _script(text)):
        return code
    hits = _hits(text)
    if code := _clear(hits):
        return code
    best = max(hits, key=lambda c: (hits[c], -list(_SETS).index(c)), default=None)
    grams = _trigrams(Counter(_WORD.findall(text.lower())))
    if not model or (not hits and grams.total() < LEAST_GRAMS):
        return best
    score = {code: sum(n * of.get(g, 0.0) for g, n in grams.items()) for code, of in model.items()}
    # a function word weighs as much as a few trigrams
    for code in {*score, *hits}:
        score[code] = score.get(code, 0.0) + 3.0 * hits[code]
    top = max(score, key=score.get, default=None)
    return top if top and score[top] > 0 else best


def learn(texts: DataFrame) -> dict[str, dict[str, float]]:
    """The trigrams of all ``texts(text)``, counted where they are; the driver gets their sums."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n_texts, by in _counts(text for b in batches for text in b["text"]):
            rows = [(code, "", n) for code, n in n_texts.items()] + [(code, g, n) for code, c in by.items() for g, n in _trigrams(c).items()]
            if rows:
                yield pd.DataFrame(rows, columns=["code", "gram", "n"])

    sums = texts.select("text").mapInPandas(count, "code string, gram string, n long").groupBy("code", "gram").agg(F.sum("n").alias("n"))
    n_texts: dict[str, int] = {}
    by: dict[str, dict[str, int]] = {}
    for code, gram, n in sums.toLocalIterator():
        if gram:
            by.setdefault(code, {})[gram] = n
        else:
            n_texts[code] = n
    return _model(n_texts, by)


def detector(model: dict[str, dict[str, float]]) -> Callable[[Column | str], Column]:
    """A column function: the language of each text; whole texts are read, in Arrow batches."""

    @F.pandas_udf(StringType())
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield text.map(lambda t: detect(t, model), na_action="ignore")

    return language
