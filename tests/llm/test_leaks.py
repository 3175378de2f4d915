import random

from lexmill.llm import p08_leaks as p8

ITEMS = [(i, " ".join(f"{w}{i}" if k % 3 == 0 else w for k, w in enumerate("harbour lantern bought the silver kettle from a weaver and kept nine candles for the winter school beside Vaëlin bridge".split()))) for i in range(1, 6)]


def srt(words, per=4, dirty=lambda w: w, roll=False):
    lines = [" ".join(dirty(w) for w in words[i : i + per]) for i in range(0, len(words), per)]
    out = []
    for n, line in enumerate(lines, 1):
        text = f"{lines[n - 2]}\n{line}" if roll and n > 1 else line
        out.append(f"{n}\n00:00:{n:02d},000 --> 00:00:{n + 1:02d},500\n{text}\n")
    return "\n".join(out)


def test_runs_against_brute_force(spark):
    rng = random.Random(2)
    docs, want = [], set()
    for d in range(60):
        item, text = rng.choice(ITEMS)
        w = text.split()
        n, at = rng.randint(6, 18), rng.randint(0, 3)
        n = min(n, len(w) - at)
        body = ["tonight", "we", "talk"] + w[at : at + n] + ["good", "night", "all"]
        docs.append((d, srt(body, per=rng.randint(2, 6), roll=d % 3 == 0)))
        if n >= 12:
            want.add((d, item))
    got = {tuple(r) for r in p8.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    # items share their common words, so a run may also be another item's where no numbered word differs
    assert want <= got and all((d, i) in want for d, i in got)


def test_dirty_characters(spark):
    text = ITEMS[0][1]
    w = text.split()
    swap = {"kettle": "kettlc", "weaver": "vveaver", "candles": "canclles", "Vaëlin": "VaÃ«lin", "winter": "winfer"}
    docs = [
        (1, srt([swap.get(x, x) for x in w])), (2, srt([x.upper() for x in w])), (3, "﻿WEBVTT\r\n\r\n" + srt(w).replace(",", ".").replace("\n", "\r\n")), (4, srt([x.replace("ë", "�") for x in w])),
        (5, srt(["<i>" + w[0], *w[1:-1], w[-1] + "</i>"]).replace("kettle", "[door slams] kettle")), (6, srt(list(reversed(w)))), (7, None), (8, ""),
    ]
    got = {tuple(r) for r in p8.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got == {(i, 1) for i in range(1, 6)}


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "too short to leak"), (2, None), (None, "a b"), (1, "too short to leak")], "item_id long, text string")
    assert p8.found(none, items).count() == 0
    assert p8.found(spark.createDataFrame([(1, srt("too short to leak".split()))], "doc_id long, text string"), items).count() == 0


def test_a_word_put_in_is_near_and_an_index_serves_again(spark, monkeypatch):
    w = ITEMS[0][1].split()
    docs = spark.createDataFrame([(1, srt(w[:8] + ["indeed"] + w[8:16])), (2, srt(w[:5])), (3, srt(w))], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    made = p8.index(docs)
    assert {(r.doc_id, r.kind) for r in p8.matches(None, items, postings=made).collect()} == {(1, "proximity"), (3, "phrase")}
    # the joins that take the place of broadcasts
    monkeypatch.setattr(p8, "BROADCAST_ROWS", 0)
    assert {(r.doc_id, r.kind) for r in p8.matches(None, items, postings=made).collect()} == {(1, "proximity"), (3, "phrase")}
