"""Defective prompt and response pairs.

``truncated_answer``: the distinct responses are sorted by text. In that order a text that another one continues
stands right before one of its continuations, so one look at the next neighbour finds every shortened version. The same
order is made of the responses' last units among all units, digits levelled: a last unit that another text carries on, and
that nowhere stands whole, is cut, though it end in a stop (that of an abbreviation, or a number's point) and in scripts
that write no stop. Lengths at which far more responses end than around them are length limits; of a response that ends
there, a last unit that ends in a number's point or a short word's, or in Thai one that is no known unit, is cut as well.
A response that nothing carries on, but whose script has stops and that ends without one, is cut, and so is one that ends
in an abbreviation. An ellipsis after a letter or digit is no stop, in any script; neighbours are compared without it.

The order is a range partitioning by whole texts into ranges of some ``RANGE_ROWS`` texts; each range's last text is
compared with the next range's first, so the result doesn't depend on the ranges. Texts are made distinct before, so copies
of one response, whatever their share, are one row.

``copied_question``: the response, without case, punctuation and blanks, is the prompt or a long opening stretch of it
after a lead-in of at most ``LEAD_MAX`` such characters (a longer one is an answer of its own). ``refusal``: the response opens by declining in the first person. ``wrong_language``: both
languages are known and differ. ``empty_answer``: null, blanks, invisible characters, punctuation, empty markup or a
placeholder word.

A row without an id is left out. An empty answer and a copy have that type only; a null prompt gives no copy and no language defect. Repeated rows count
once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import cut

from .language import detector, learn

# Placeholder words, without punctuation and blanks.
PLACEHOLDERS = "na none null nil nan tbd tba todo nosummary nosummaryavailable summarynotavailable notavailable unavailable notapplicable pending empty blank unknown undefined placeholder noanswer notprovided".split()
# Openings of a refusal, matched in lower case at the start of the response.
REFUSALS = (
    r"(?:i[ ']?a?m (?:very |so )?sorry|sorry|apologies|my apologies|i apologi[sz]e|unfortunately|regrettably|i regret)\b[^.]{0,160}(?:can'?t|cannot|can not|unable|not able|won'?t|no summary|don'?t have|do not have|outside what|not allowed|not permitted|declin)",
    r"(?:i|we) (?:cannot|can'?t|can not|could not|couldn'?t|a?'?m unable|am unable|are unable|a?'?m not able|am not able|are not able|won'?t|will not|must decline|must refuse|have to decline|decline|refuse|do not feel|don'?t feel|do not have enough|don'?t have enough)",
    r"(?:unable|not able) to (?:comply|help|assist|summari[sz]e|process|complete|provide|answer|fulfil)",
    r"(?:my|our|the) (?:guidelines|policies|policy|instructions|rules) (?:prevent|do not allow|don'?t allow|do not permit|forbid|prohibit)",
    r"as an? (?:automated|ai|artificial|language|virtual|digital)\b[^.]{0,60}(?:cannot|can'?t|not able|unable|not allowed|not permitted|do not|don'?t)",
    r"(?:this|your|the) (?:request|question|prompt|content)[^.]{0,40}(?:was|is|has been|falls|cannot be|violates)[^.]{0,60}(?:declined|refused|blocked|denied|rejected by|outside what|processed|polic)",
    r"it (?:would not|wouldn'?t|is not|isn'?t) (?:be )?(?:appropriate|possible) for me",
    r"no summary can be (?:offered|given|provided|produced)",
    r"(?:désolée?|je suis désolée?|pardon|malheureusement|je regrette)\b[^.]{0,80}(?:ne peux|ne puis|impossible|pas en mesure)|je ne (?:peux|puis|suis) pas",
    r"(?:lamento|desculpe|desculpa|sinto muito|infelizmente)\b[^.]{0,80}não (?:posso|consigo|é possível)|não (?:posso|consigo) (?:resumir|ajudar|fazer)",
    r"(?:ndine urombo|ndinokumbira ruregerero)|handikwanise|handigone",
    r"(?:uxolo|ngiyaxolisa)\b|ngingeke ngi|angikwazi",
    r"(?:抱歉|对不起|很抱歉|非常抱歉)[^。]{0,40}(?:无法|不能|不可以)|我(?:无法|不能)",
    r"(?:申し訳|すみません|恐れ入りますが|ごめんなさい)|[^。]{0,30}(?:要約できません|要約することはできません|お手伝いできません)",
    r"(?:عذرا|عذرًا|آسف|نأسف|للأسف|المعذرة)[^.]{0,60}(?:لا|لن|غير قادر)|لا (?:أستطيع|يمكنني)",
    r"(?:क्षमा करें|माफ़? ?करें|खेद है|मुझे खेद)[^।]{0,80}(?:नहीं|असमर्थ)|मैं [^।]{0,60}नहीं (?:कर|दे) सकत",
    r"ይቅርታ[^።]{0,60}(?:አልችልም|አይቻልም)|[^።]{0,60}ማጠቃለል አልችልም",
    r"(?:ขออภัย|ขอโทษ|เสียใจ)[^\n]{0,60}(?:ไม่สามารถ|ไม่ได้)|(?:ฉัน|ผม|ดิฉัน)ไม่สามารถ",
)
LEAD_IN = r"(?:[>\-*#\s\"'“‘«]|(?:summary|answer|response|résumé|réponse|resumo|resposta)\s*[:–—-])*\s*"
_END = r"[.!?。！？।።፧؟…]"
_CLOSE = r"[\"'”’»」』)\]*_]"
# An ellipsis after a letter or digit, perhaps in brackets, stands for text that was left off. Four dots are a stop and an ellipsis.
_OPEN_DOTS = rf"(?<=[\p{{L}}\p{{M}}\p{{N}}%]{_CLOSE}{{0,3}}\s{{0,3}})[(\[]?(?:\.\s?\.\s?\.|[…⋯]+)[)\]]?$"
# What a full stop may follow without ending a sentence.
_ABBREVIATION = r"(?:^|[\s(\[])(?:no|nos|p|pp|para|s|ss|sec|art|arts|pág|mr|mrs|ms|dr|adv|messrs|sr|sra|m|mme|v|vs|e\.g|i\.e|gen|\p{Lu})\.$"
# the stop of a number, or of a word so short that it may be an abbreviation
_LOOSE = rf"(?:\p{{N}}|(?<![\p{{L}}\p{{M}}])\p{{L}}{{1,3}})\.{_CLOSE}*$"
LEAD_MAX, WORDS_MIN, DENSE_MIN = 90, 60, 120
RANGE_ROWS = 100_000


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{M}\p{N}]+", "")


def _units(x: Column) -> Column:
    """The units of a text, digits levelled: parted after a stop before a capital or a letter without case, by blanks in
    Thai, and by blank lines."""
    x = F.regexp_replace(F.trim(x), r"\p{N}+(?:[.,]\p{N}+)*", "0")
    x = F.regexp_replace(x, rf"(?<=[.!?؟]{_CLOSE}{{0,3}})\s+(?=[\"'“‘«(]*[\p{{Lu}}\p{{Lo}}])|(?<=[。！？।።፧])(?!{_CLOSE})\s*|(?<=[฀-๿])\s+(?=[฀-๿])|\s*\n\s*\n\s*", "\n\n")
    return F.split(x, "\n\n")


def next_neighbours(texts: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(t, after) for distinct ``t``: ``after`` is the next text in binary order, null for the last."""
    texts = cut(texts.select("t").filter("t is not null").distinct())
    n = max(texts.sparkSession.sparkContext.defaultParallelism if range_rows == RANGE_ROWS else 1, texts.count() // range_rows + 1)

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = 0, None
        for b in batches:
            if len(b):
                at, t = b["range"].iloc[0], ([] if last is None else [last]) + list(b["t"])
                last = t[-1]
                if len(t) > 1:
                    yield pd.DataFrame({"range": [at] * (len(t) - 1), "t": t[:-1], "after": t[1:]})
        if last is not None:
            yield pd.DataFrame({"range": [at], "t": [last], "after": [None]})

    # the ranges' numbers follow their order
    placed = cut(texts.repartitionByRange(n, "t").sortWithinPartitions("t").select(F.spark_partition_id().alias("range"), "t").mapInPandas(lead, "range int, t string, after string"))
    # one row for each range
    firsts = placed.groupBy("range").agg(F.min("t").alias("first"))
    following = firsts.select("range", F.lead("first").over(Window.orderBy("range")).alias("following"))
    return placed.join(F.broadcast(following), "range").select("t", F.coalesce("after", "following").alias("after"))


def length_limits(texts: DataFrame) -> DataFrame:
    """(n,) of the lengths at which at least 20 responses, and eight times the mean of the 20 lengths around, end."""
    h = texts.groupBy(F.length("t").alias("n")).agg(F.count("*").alias("rows"))
    w = Window.orderBy("n").rangeBetween(-10, 10)  # one row per length that occurs, so a small table
    h = h.withColumn("around", (F.sum("rows").over(w) - F.col("rows")) / 20)
    return h.filter("n > 40 and rows >= 20 and rows >= 8 * around").select("n")


def defects(df: DataFrame, key: str = "dataset_id", prompt: str = "input_text", response: str = "target_summary") -> DataFrame:
    """(dataset_id, defect_type) of every defective pair."""
    return explained(df, key, prompt, response).select("dataset_id", "defect_type").distinct()


def explained(df: DataFrame, key: str = "dataset_id", prompt: str = "input_text", response: str = "target_summary") -> DataFrame:
    """(dataset_id, defect_type, evidence): of a truncated answer what showed it (``neighbour``, ``ellipsis``, ``limit``,
    ``open end`` or ``abbreviation``, the first of these), else null."""
    pairs = df.select(F.col(key).alias("dataset_id"), F.col(prompt).alias("p"), F.col(response).alias("t")).filter("dataset_id is not null")
    core = F.regexp_replace(F.regexp_replace(F.coalesce("t", F.lit("")), r"<[^<>]*>", ""), r"[^\p{L}\p{N}]+", "")
    empty = (core == "") | F.lower(core).isin(PLACEHOLDERS)
    a, b = _plain(F.col("p")), _plain(F.col("t"))
    language = detector(learn(pairs.select(F.concat_ws("\n", "p", "t").alias("text"))))
    pairs = pairs.select("dataset_id", "t", empty.alias("empty"), a.alias("a"), b.alias("b"), language(F.col("p")).alias("lp"), language(F.col("t")).alias("lt"), "p")
    # where the prompt's opening stands in the response, and what of the response stands from there on
    at = F.when(F.length("a") > 0, F.expr("locate(substring(a, 1, 24), b)")).otherwise(0)
    pairs = pairs.withColumn("at", at).withColumn("rest", F.expr("case when at > 0 then substring(b, at) end"))
    latin = F.length(F.regexp_replace("rest", r"[^a-zà-ɏ0-9]+", "")) * 2 >= F.length("rest")
    n_words = F.size(F.split(F.trim(F.col("t")), r"[^\p{L}\p{M}\p{N}'’]+"))
    long = F.when(latin, n_words >= WORDS_MIN).otherwise(F.length("rest") >= DENSE_MIN)
    whole = F.col("rest") == F.col("a")
    copied = (F.col("at").between(1, LEAD_MAX)) & F.expr("startswith(a, rest)") & (whole | long)
    text = F.regexp_replace(F.trim(F.col("t")), r"[\s ​﻿]+$", "")
    refusal = F.lower(F.regexp_replace("t", "’", "'")).rlike(r"^\s*" + LEAD_IN + "(?:" + "|".join(f"(?:{r})" for r in REFUSALS) + ")")
    stopless = F.col("lt").isin("th")
    dotted = text.rlike(_OPEN_DOTS)
    open_end = ~text.rlike(_END + _CLOSE + "*$") | text.rlike(r"[,;:\-–—](?:\.\.\.|…)$") | dotted
    abbreviation, loose = text.rlike(_ABBREVIATION), text.rlike(_LOOSE)
    text = F.regexp_replace(text, r"\s*" + _OPEN_DOTS, "")  # neighbours are compared without the dots
    pairs = cut(pairs.select("dataset_id", "t", text.alias("text"), F.when(F.col("lp") == "th", F.col("p")).alias("p"), "empty", F.coalesce(copied, F.lit(False)).alias("copied"), refusal.alias("refusal"), "lp", "lt", F.coalesce(stopless, F.lit(False)).alias("stopless"), open_end.alias("open_end"), F.coalesce(dotted, F.lit(False)).alias("dotted"), abbreviation.alias("abbreviation"), loose.alias("loose")).distinct())

    answers = pairs.filter("not empty and not copied")
    after = next_neighbours(answers.select(F.col("text").alias("t")))
    # the continuation must go on within the sentence
    stopped = F.col("t").rlike(_END + _CLOSE + "*$")
    goes_on = F.col("t").rlike(r"\.$") & F.expr("substring(after, length(t) + 1, 1)").rlike(r"[\p{Ll}\d]")
    shortened = after.filter(F.expr("startswith(after, t)")).filter(~stopped | goes_on).select(F.col("t").alias("text"), F.lit(True).alias("shortened"))
    limits = length_limits(answers.select("t"))
    ends = cut(answers.select("dataset_id", "stopless", _units(F.col("text")).alias("u")).select("dataset_id", "stopless", F.regexp_replace(F.element_at("u", -1), _CLOSE + "+$", "").alias("t"), F.slice("u", 1, F.greatest(F.size("u") - 1, F.lit(0))).alias("inner")))
    # of a number's point, what stands before it may be carried on too
    last = ends.select("dataset_id", F.explode(F.array_compact(F.array("t", F.when(F.col("t").rlike(r"0\.$"), F.expr("substring(t, 1, length(t) - 1)"))))).alias("t"), "t").toDF("dataset_id", "t", "unit")
    whole = ends.select(F.explode("inner").alias("t")).unionByName(pairs.filter("lp = 'th'").select(F.explode(_units(F.col("p"))).alias("t")))
    whole = cut(whole.select(F.regexp_replace("t", _CLOSE + "+$", "").alias("t")).filter("length(t) > 1").distinct())
    carried = next_neighbours(whole.select("t").unionByName(last.select("t"))).filter(F.expr("startswith(after, t)")).filter((F.col("t") != "") & F.expr("substring(after, length(t) + 1, 1)").rlike(r"[\s\p{L}\p{M}\p{N}]")).select("t")
    known = whole.select(F.col("t").alias("unit"), F.lit(True).alias("known"))
    cut_ids = last.join(carried, "t", "left_semi").join(known, "unit", "left_anti").select("dataset_id").distinct().withColumn("cut_unit", F.lit(True))
    # in Thai a unit at a limit is whole only if it is known
    known_ids = ends.filter("stopless").select("dataset_id", F.col("t").alias("unit")).join(known, "unit", "left_semi").select("dataset_id").distinct().withColumn("known_unit", F.lit(True))

    judged = answers.join(shortened, "text", "left").join(F.broadcast(limits.withColumn("limit_hit", F.lit(True))), F.length("t") == F.col("n"), "left").join(cut_ids, "dataset_id", "left").join(known_ids, "dataset_id", "left")
    of = lambda c: F.coalesce(c, F.lit(False))
    neighbour = of("cut_unit") | (~F.col("stopless") & of("shortened"))
    limit = of("limit_hit") & F.when(F.col("stopless"), ~of("known_unit")).otherwise(F.col("loose"))
    shown = F.when(neighbour, "neighbour").when(F.col("dotted"), "ellipsis").when(limit, "limit").when(~F.col("stopless") & F.col("open_end"), "open end").when(~F.col("stopless") & F.col("abbreviation"), "abbreviation")
    shown = F.when(~F.col("refusal"), shown)
    wrong = F.coalesce(F.col("lp") != F.col("lt"), F.lit(False))
    kind = lambda name, evidence=None: F.struct(F.lit(name).alias("defect_type"), (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence"))
    kinds = F.array_compact(F.array(F.when(F.col("refusal"), kind("refusal")), F.when(shown.isNotNull(), kind("truncated_answer", shown)), F.when(wrong, kind("wrong_language"))))
    rest = judged.select("dataset_id", F.explode(kinds).alias("k")).select("dataset_id", "k.*")
    plain = pairs.filter("empty or copied").select("dataset_id", F.when(F.col("empty"), "empty_answer").otherwise("copied_question").alias("defect_type"), F.lit(None).cast("string").alias("evidence"))
    return plain.unionByName(rest).distinct()
