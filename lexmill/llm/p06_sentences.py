"""Sentence units across languages and scripts, wholly in SQL expressions.

Every stop that cannot end a sentence is masked by a character of its own that no text may hold (Unicode's noncharacters;
where a text holds them they come out as U+FFFD): decimals, initials, titles
and other abbreviations, addresses of the web and of mail, everything inside quotations and brackets, an ellipsis in
mid sentence. What is left of the terminators of each script ends a unit, closing quotes and brackets included, and
so does a blank line or the end of the text. Masks keep the length, so offsets in the masked text are offsets in the
text. Thai has no stop: there a blank between two Thai letters ends a unit.

The pieces of one document are numbered, and their offsets summed, within its own row, so nothing is shuffled. A quotation
may be of any length within its paragraph, and hold another with the same marks (a third inside that is read as the
second's text). Null texts and texts without anything but blanks have no unit. Repeated rows give repeated units; the same text
under two ids is cut alike. Positions count code points from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles and the like that never end a sentence; words that are cut short only before a number; and
# abbreviations that do end one before a capital.
NEVER = "Mr Mrs Ms Messrs Dr Dra Prof Adv Hon Rev Gen Col Capt Sgt Lt Sr Sra Exmo Exma Me Mme Mlle MM M v vs viz cf ibid NO"
BEFORE_NUMBER = "no nos No Nos p pp P Pp pág págs para paras Para s ss S sec Sec art arts Art Arts ch Ch cl reg vol Vol fig Fig núm approx tel Tel"
MAYBE = "Ltd Pvt Inc Co Corp Bros Jr etc al Ave Rd St Blvd Cres Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec"

DOT, BANG, ASK, FULL, FBANG, FASK, ELL, DANDA, ETH, AASK, EASK = (chr(0xFDD0 + i) for i in range(11))
STOPS = ".!?。！？…।።؟፧"
MASKS = DOT + BANG + ASK + FULL + FBANG + FASK + ELL + DANDA + ETH + AASK + EASK
OPEN, CLOSE, MARK, INNER_OPEN, INNER_CLOSE = (chr(0xFDE0 + i) for i in range(5))
OURS = MASKS + OPEN + CLOSE + MARK + INNER_OPEN + INNER_CLOSE
CLOSERS = f"[\\\"'”’»」』)\\]{CLOSE}]"


def _alternatives(words: str) -> str:
    return "|".join(sorted(words.split(), key=len, reverse=True))


def masked(text: Column) -> Column:
    """``text`` with every stop that ends no sentence, and each straight quote's side, masked one for one."""
    r = F.regexp_replace
    x = F.translate(text, OURS, "\ufffd" * len(OURS))
    # straight quotes are told apart by their neighbours
    x = r(x, r'(?<![^\s(\[:;,])"(?=\S)', OPEN)
    x = r(x, r'"', CLOSE)
    # decimals, times and dates; addresses of mail and web
    x = r(x, r"\.(?<=\d\.)(?=\d)", DOT)
    x = r(x, r"\.(?=[\w.+\-]{0,80}@)|\.(?<=@[\w.\-]{0,80}\.)(?=\w)|\.(?<=\bwww[\w./\-]{0,80}\.)(?=\w)", DOT)
    # abbreviations and initials
    unless_end = rf"(?!\s+\p{{Lu}}|\s*\n\s*\n|\s*\z|{CLOSE})"
    letter = r"(?<![\p{L}\p{M}])"
    x = r(x, rf"{letter}([eiapcEIAPC])\.(?=[gemfGEMF]\.)", "$1" + DOT)
    x = r(x, rf"{letter}([eicEIC]{DOT}[gefGEF])\.", "$1" + DOT)
    x = r(x, rf"{letter}([apAP]{DOT}[mM])\.{unless_end}", "$1" + DOT)
    x = r(x, rf"{letter}(c)\.(-à-d)\.", f"$1{DOT}$2{DOT}")
    x = r(x, rf"{letter}({_alternatives(NEVER)})\.(?=\s)", "$1" + DOT)
    x = r(x, rf"{letter}({_alternatives(BEFORE_NUMBER)})\.(?=\s*\d)", "$1" + DOT)
    x = r(x, rf"{letter}({_alternatives(MAYBE)})\.{unless_end}", "$1" + DOT)
    x = r(x, r"(?<![\p{L}\p{M}\d])(\p{Lu}|[؀-ۿ])\.(?=\s*\p{L})", "$1" + DOT)
    # a full stop after a letter of a script that has its own is part of an abbreviation
    x = r(x, r"(?<=[ऀ-ॿ฀-๿ሀ-፿぀-ヿ㐀-鿿])\.", DOT)
    # an ellipsis ends a sentence only before a capital or the paragraph's end
    x = r(x, r"\.(?=\.)", DOT)
    x = r(x, rf"\.(?<={DOT}\.)(?=\s*[\p{{Ll}}\p{{Lo}}])", DOT)
    x = r(x, r"…(?=…|\s*[\p{Ll}\p{Lo}])", ELL)
    return x


# Quotations and brackets: their stops belong to the sentence around them.
_PAIRS = (("“", "”", ".!?。！？"), ("«", "»", ".!?"), ("「", "」", "。！？"), ("『", "』", "。！？"), (OPEN, CLOSE, ".!?"), ("(", ")", ".!?"), ("（", "）", "。！？"))


def _closed(x: Column, o: str, c: str, change: tuple[str, str]) -> Column:
    """``x`` with characters changed in every stretch from an opening mark to the closing mark that is next to it, with no
    other mark and no blank line between them."""
    parts = F.split(x, rf"(?=\Q{o}\E)|(?<=\Q{c}\E)|(?<=\n)(?=\s*\n)", -1)
    return F.array_join(F.transform(parts, lambda s: F.when(s.startswith(o) & s.endswith(c), F.translate(s, *change)).otherwise(s)), "")


def masked_inside(df: DataFrame, col: str) -> DataFrame:
    """``col`` with the stops inside each kind of quotation and bracket masked. A kind is one projection, entered only
    by the rows that hold its closing mark."""
    for o, c, stops in _PAIRS:
        masks = "".join(MASKS[STOPS.index(x)] for x in stops)
        x = F.col(col)
        # of a quotation inside another the marks are hidden first, so that the outer one has no mark within
        nested = x.rlike(rf"\Q{o}\E[^\Q{c}\E]*\Q{o}\E[^\Q{o}{c}\E]*\Q{c}\E[^\Q{o}\E]*\Q{c}\E")
        inner = _closed(x, o, c, (stops + o + c, masks + INNER_OPEN + INNER_CLOSE))
        outer = F.translate(_closed(inner, o, c, (stops, masks)), INNER_OPEN + INNER_CLOSE, o + c)
        df = df.withColumn(col, F.when(F.col(col).contains(c), F.when(nested, outer).otherwise(_closed(x, o, c, (stops, masks)))).otherwise(F.col(col)))
    return df


def marked(x: Column) -> Column:
    """Masked text with a mark after every unit."""
    r = F.regexp_replace
    # a stop (with its closers) before a blank; the text's end needs no mark
    x = r(x, rf"([.!?؟…।።፧]+{CLOSERS}*)(?=\s)", "$1" + MARK)
    # stops of scripts without blanks
    x = r(x, rf"([。！？।።፧]+{CLOSERS}*)(?![。！？\s{MARK}])", "$1" + MARK)
    # a missing blank after a stop
    x = r(x, r"(?<=[\p{Ll}\d)])([.!?])(?=\p{Lu}[\p{Ll}\s'])", "$1" + MARK)
    # a quotation that is a sentence of its own
    x = r(x, rf"([{MASKS}]\s?[”»{CLOSE}])(?=\s+\p{{Lu}})", "$1" + MARK)
    # Thai
    x = r(x, r"(?<=[฀-๿])(?=[ \t\r\n]+[฀-๿])", MARK)
    # paragraphs
    return r(x, r"(?=\n[ \t\r\f]*\n)", MARK)


def units(df: DataFrame, key: str, text: str, with_text: bool = True) -> DataFrame:
    """(document_id, sentence_no, start_pos, end_pos[, sentence]) of every unit."""
    body = df.select(F.col(key).alias("document_id"), F.col(text).alias("body")).filter("body is not null")
    body = masked_inside(body.select("document_id", masked(F.col("body")).alias("body")), "body")
    pieces = body.select("document_id", F.split(marked(F.col("body")), MARK, -1).alias("pieces"))
    blank = r"[\s ​﻿]"
    size = lambda p: F.struct(F.length(p).alias("n"), F.length(F.regexp_replace(p, rf"{blank}+\z", "")).alias("kept"), F.length(F.regexp_extract(p, rf"\A{blank}*", 0)).alias("lead"))
    pieces = pieces.select("document_id", *(["pieces"] if with_text else []), F.transform("pieces", size).alias("sizes"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    before = F.aggregate("sizes", start, lambda acc, x: F.struct((acc.at + x.n).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)
    zipped = F.filter(F.arrays_zip("sizes", before.alias("before"), *(["pieces"] if with_text else [])), lambda u: u.sizes.kept > 0)
    out = pieces.select("document_id", F.posexplode(zipped).alias("i", "u"))
    cols = [F.col("document_id"), (F.col("u.before") + F.col("u.sizes.lead") + 1).cast("long").alias("start_pos"), (F.col("u.before") + F.col("u.sizes.kept")).cast("long").alias("end_pos")]
    if with_text:
        restored = F.translate(F.expr("substring(u.pieces, u.sizes.lead + 1, u.sizes.kept - u.sizes.lead)"), MASKS + OPEN + CLOSE, STOPS + '""')
        cols += [restored.alias("sentence"), (F.col("i") + 1).alias("sentence_no")]
    return out.select(*cols)


def found(legal: DataFrame) -> DataFrame:
    """(document_id, end_pos) of the units of plain-text documents of more than 20 characters."""
    plain = legal.filter("mime_type = 'text/plain' and length(extracted_text) > 20")
    return units(plain, "id", "extracted_text", with_text=False).select("document_id", "end_pos")
