"""Cutting oversized items at natural boundaries, by lexical cohesion.

Items over the limit are read alone (the length filter runs before Python sees a row). Their sentence and paragraph
ends are the gaps; at each gap the words of the block before and the block after are compared by cosine. A gap whose
similarity is low against the peaks on either side is a valley, that is a change of topic. Within each size window
(from half the limit up to the limit) the deepest valley is the cut; a paragraph end counts a little deeper than a
sentence end. Where a window holds no gap the last white space is the cut, and where there is none the limit itself.
The next piece begins up to ``overlap`` characters earlier, at a sentence start where one lies there, else a word's.

The work per item is linear in its length, whatever that is. Sizes count code points. Null and short texts give no
piece; equal items under several keys are cut alike. ``found`` names an item once; ``pieces`` cuts repeated rows once if asked
to (``distinct``, which moves the oversized texts once), else each of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, BLOCK = 6000, 300, 120
_GAP = re.compile(r"\n[ \t\r]*\n\s*|[.!?؟][\"'”’»)\]]*\s+|[。！？।።፧][\"'”’»」』)\]]*\s*")
_WORD = re.compile(r"[^\W\d_]+")
# scripts written without blanks give character pairs instead of words
_DENSE = re.compile(r"[฀-๿぀-ヿ㐀-鿿]")


def _terms(text: str) -> list[str]:
    out: list[str] = []
    for w in _WORD.findall(text.lower()):
        if _DENSE.search(w):
            out += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
        elif len(w) > 3:
            out.append(w)
    return out


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    dot = sum(n * b[t] for t, n in a.items() if t in b)
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def gaps(text: str) -> list[tuple[int, bool]]:
    """(position after the gap's white space, whether a paragraph ends there), in order, inner ones only."""
    return [(m.end(), m.group().count("\n") > 1) for m in _GAP.finditer(text) if 0 < m.end() < len(text)]


def depths(text: str, at: list[tuple[int, bool]], block: int = BLOCK) -> list[float]:
    """The valley depth of each gap: how far its similarity lies below the nearest peak on either side."""
    ends = [0, *(p for p, _ in at), len(text)]
    units = [_terms(text[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    flat = [t for u in units for t in u]
    starts, n = [], 0
    for u in units[:-1]:
        n += len(u)
        starts.append(n)
    sims = []
    left, right, lo, mid, hi = Counter(), Counter(), 0, 0, 0
    for s in starts:  # both blocks slide, so a word enters and leaves each once
        while mid < s:
            if mid < hi:
                right[flat[mid]] -= 1
                if not right[flat[mid]]:
                    del right[flat[mid]]
            left[flat[mid]] += 1
            mid += 1
        while lo < s - block:
            left[flat[lo]] -= 1
            if not left[flat[lo]]:
                del left[flat[lo]]
            lo += 1
        hi = max(hi, mid)
        while hi < min(len(flat), s + block):
            right[flat[hi]] += 1
            hi += 1
        sims.append(_cosine(left, right))
    n = len(sims)
    peak_l, peak_r = [0.0] * n, [0.0] * n
    for i in range(n):  # the peak reached while climbing away from the gap
        peak_l[i] = peak_l[i - 1] if i and sims[i - 1] >= sims[i] and peak_l[i - 1] >= sims[i - 1] else sims[i - 1] if i and sims[i - 1] > sims[i] else sims[i]
    for i in range(n - 1, -1, -1):
        peak_r[i] = peak_r[i + 1] if i + 1 < n and sims[i + 1] >= sims[i] and peak_r[i + 1] >= sims[i + 1] else sims[i + 1] if i + 1 < n and sims[i + 1] > sims[i] else sims[i]
    return [max(0.0, peak_l[i] - sims[i]) + max(0.0, peak_r[i] - sims[i]) for i in range(n)]


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> list[tuple[int, int, str]]:
    """(start, end, kind of the end) of the pieces of ``text``, offsets from 0."""
    if len(text) <= limit:
        return [(0, len(text), "end")]
    at = gaps(text)
    deep = depths(text, at, block)
    out, start, k = [], 0, 0
    while len(text) - start > limit:
        low, high = start + limit // 2, start + limit
        while k < len(at) and at[k][0] <= low:
            k += 1
        best, j = None, k
        while j < len(at) and at[j][0] <= high:
            score = (deep[j] + (0.15 if at[j][1] else 0.0), at[j][0])
            if best is None or score > best[0]:
                best = (score, at[j])
            j += 1
        if best:
            end, kind = best[1][0], "paragraph" if best[1][1] else "sentence"
        else:
            space = max((m.end() for m in re.finditer(r"\s", text[low:high])), default=0)
            end, kind = (low + space, "word") if space else (high, "limit")
        out.append((start, end, kind))
        nxt = end
        if overlap:
            back = [p for p, _ in at[max(0, k - 1) : j] if end - overlap <= p < end]
            i = k
            while i > 0 and at[i - 1][0] >= end - overlap:
                i -= 1
                back.append(at[i][0])
            back = [p for p in back if end - overlap <= p < end and p > start]
            if back:
                nxt = min(back)
            else:
                word = re.search(r"\s+(?=\S)", text[max(start + 1, end - overlap) : end])
                nxt = max(start + 1, end - overlap) + word.end() if word else max(start + 1, end - overlap)
                if nxt > end:
                    nxt = end
        start = nxt
        while k > 0 and at[k - 1][0] > start:
            k -= 1
    out.append((start, len(text), "end"))
    return out


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, distinct: bool = True) -> DataFrame:
    """(row_key, piece_no, start_pos, end_pos, boundary, piece) of the items of more than ``limit`` characters."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    big = df.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("body")).filter(F.length("body") > limit)
    if distinct:
        big = big.distinct()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row_key, body in zip(b["row_key"], b["body"], strict=True):
                for n, (s, e, kind) in enumerate(cut_points(body, limit, overlap), 1):
                    rows.append((row_key, n, s + 1, e, kind, body[s:e]))
            yield pd.DataFrame(rows, columns=["row_key", "piece_no", "start_pos", "end_pos", "boundary", "piece"])

    return big.mapInPandas(work, "row_key string, piece_no int, start_pos long, end_pos long, boundary string, piece string")


def found(legal: DataFrame, dataset: DataFrame) -> DataFrame:
    """(source_table, row_key) of the items that were cut into more than one piece."""
    a = pieces(legal, "id", "extracted_text", distinct=False).withColumn("source_table", F.lit("legal_documents"))
    b = pieces(dataset, "dataset_id", "input_text", distinct=False).withColumn("source_table", F.lit("legal_summary_dataset"))
    # a second piece names an oversized row; only names are moved to make them distinct
    return a.unionByName(b).filter("piece_no = 2").select("source_table", "row_key").distinct()
