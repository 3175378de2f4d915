"""What an analysed document means for its reader: implications, gaps, next steps, results, evidence and checks of summaries.

All are expressions over one row, but for evidence, which joins words. A null text or list counts as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions.classify import legislative
from lexmill.functions.extract import stopped
from lexmill.functions.rx import all_of, capped, count, distinct_ci, has, let, squeeze
from lexmill.functions.text import evidence_tokens


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def implications(text: Column, doc_type: Column) -> Column:
    kind = F.lower(_text(doc_type))
    out = F.when((_text(doc_type) != "Court Judgment") & has(_text(text), L.ENVIRONMENT, "i"), L.IMPLICATION_ENVIRONMENT)
    for name, said in L.IMPLICATIONS.items():
        out = out.when(kind.contains(name.lower()), said)
    return out.otherwise(L.IMPLICATION_OTHER)


def missing_information(doc_type: Column, case_number: Column, date: Column, court: Column, parties: Column, outcome: Column, dates: Column) -> Column:
    """At most six messages, in their order; ``parties`` and ``dates`` are arrays."""
    judgment, none = _text(doc_type).contains("Judgment"), lambda x: _text(x) == ""
    empty = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    when = {"case": judgment & case_number.isNull(), "date": none(date), "court": judgment & none(court), "parties": judgment & empty(parties), "outcome": _text(outcome) == L.OUTCOME_UNKNOWN, "dates": empty(dates)}
    return F.array_compact(F.array(*(F.when(when[k], F.lit(v)) for k, v in L.MISSING.items())))


def actions(doc_type: Column, outcome: Column, deadline_pages: Column) -> Column:
    """Next steps, distinct; ``deadline_pages`` are the pages of the deadlines in order."""
    kind = _text(doc_type)
    due = F.transform(F.coalesce(deadline_pages, F.array().cast("array<int>")), lambda p: F.concat(F.lit(L.ACTIONS["deadline"].split("%s")[0]), p.cast("string"), F.lit(L.ACTIONS["deadline"].split("%s")[1])))
    others = F.array_compact(F.array(F.when((_text(outcome) != "") & F.lower(kind).contains("judgment"), L.ACTIONS["judgment"]), F.when(has(kind, L.CONTRACT_WORDS, "iu"), L.ACTIONS["contract"]), F.when(has(kind, L.LEGISLATION_WORDS, "iu"), L.ACTIONS["legislation"])))
    return let(F.array_distinct(F.concat(due, others)), lambda a: F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(L.ACTIONS["none"]))))


def matches(text: Column, patterns: tuple[str, ...], flags: str = "iu", n: int = 8) -> Column:
    """What the patterns' first groups hold, each with one full stop, distinct, at most ``n``."""
    return capped(F.array_distinct(F.transform(F.concat(*(all_of(_text(text), p, flags, 1) for p in patterns)), stopped)), n)


def references_panel(references: Column, principles: Column, keywords: Column) -> Column:
    """References of the text, those in the principles, and keywords that tell of a section, chapter or act (also within a
    word); at most eight."""
    named = F.filter(keywords, lambda k: has(k, r"section|chapter|act", "i"))
    return capped(F.array_distinct(F.filter(F.concat(references, matches(principles, L.PRINCIPLE_REFERENCES, "u"), named), lambda x: x != "")), 8)


def case_results(text: Column, outcome: Column) -> Column:
    """The results that the text, as it stands or with its white space squeezed, or the outcome tells of; else the outcome."""
    low, said = F.lower(F.concat_ws("\n", _text(text), squeeze(_text(text)))), F.lower(_text(outcome))
    found = F.array_compact(F.array(*(F.when(has(low, p, "u") | said.contains(label.lower()), F.lit(label)) for label, p in L.CASE_RESULTS.items())))
    return let(found, lambda f: F.when((F.size(f) == 0) & (_text(outcome) != ""), F.array(stopped(outcome))).otherwise(f))


def result_cards(text: Column, doc_type: Column, outcome: Column, rights: Column, orders: Column, obligations: Column, references: Column) -> Column:
    """(title, tone, items) of every card that has an item; legislation has two cards of its own."""
    card = lambda title, tone, items: F.struct(F.lit(title).alias("title"), F.lit(tone).alias("tone"), items.alias("items"))
    case = F.array(
        card("Case Result", "success", case_results(text, outcome)), card("Compensation Awarded", "warning", matches(text, L.AWARDS)), card("Sentence Imposed", "danger", matches(text, L.SENTENCES_IMPOSED)),
        card("Constitutional Rights Affected", "info", F.array_distinct(rights)), card("Court Orders", "neutral", orders),
    )
    law = F.array(card("Operative Provisions", "info", capped(obligations, 5)), card("Legal References", "neutral", capped(references, 5)))
    return F.filter(F.when(legislative(doc_type), law).otherwise(case), lambda c: F.size(c["items"]) > 0)


def source_map(passage_ids: Column, has_instruments: Column, has_rights: Column) -> Column:
    """(section, passage_ids): the first passages that each section rests on."""
    first = {"professional_summary": 3, "citizen_summary": 2, "result_cards": 2, "case_information": 2, "key_legal_issues": 3, "cited_instruments": 3, "important_legal_references": 3, "people_and_organisations": 2, "constitutional_rights_affected": 2}
    only = {"cited_instruments": has_instruments, "constitutional_rights_affected": has_rights}
    return F.array(*(F.struct(F.lit(k).alias("section"), F.when(only.get(k, F.lit(True)), capped(passage_ids, n)).otherwise(F.array().cast("array<string>")).alias("passage_ids")) for k, n in first.items()))


def summary_issues(summary: Column) -> Column:
    """What is wrong with a summary of legislation."""
    low = F.lower(_text(summary))
    return F.array_compact(F.array(*(F.when(has(low, p, "u"), F.lit(k)) for k, p in L.SUMMARY_ISSUES.items()), F.when(~has(low, L.SUMMARY_EFFECT, "u"), L.SUMMARY_NO_EFFECT)))


def doctrine_only(summary: Column, terms: Column) -> Column:
    """Whether a summary tells of doctrine three times and names nothing of the case."""
    low = F.lower(_text(summary))
    named = F.exists(F.concat(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.trim(F.lower(_text(t)))), F.array(*(F.lit(t) for t in L.CASE_TERMS))), lambda t: (F.length(t) >= 4) & low.contains(t))
    return (count(low, L.DOCTRINE_WORDS, "iu") >= 3) & ~named


def jargon_count(x: Column) -> Column:
    return F.size(F.array_distinct(F.transform(all_of(_text(x), L.JARGON, "iu", 1), lambda w: F.lower(w))))


def _words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))


def useful_outcome(x: Column) -> Column:
    x = F.trim(_text(x))
    return (_words(x) >= 4) & ~has(F.regexp_replace(x, r"\.+$", ""), r"^(?:with\s+costs|costs)$", "iu") & has(x, L.USEFUL_OUTCOME, "iu")


def meaningful(x: Column, least: int = 6) -> Column:
    x = F.trim(_text(x))
    return (x != "") & ~has(x, L.NO_SENTENCE, "iu") & (_words(x) >= least) & has(x, L.SENTENCE_VERB, "iu")


def heading_kind(heading: Column) -> Column:
    low, out = F.lower(_text(heading)), None
    for kind, p in L.HEADING_KINDS.items():
        out = F.when(has(low, p), kind) if out is None else out.when(has(low, p), kind)
    return out.otherwise("GENERAL_CLAUSE")


def entity_evidence(entities: DataFrame, sents: DataFrame, key: str) -> DataFrame:
    """(key, kind, value, quote, page): of each entity the first sentence that contains it, else the one that shares the most
    words with it, else nulls. ``entities`` is (key, kind, value). The values of a document meet its sentences as one list; a
    value counts where its first word is a word of the sentence, one within words only is looked for in the words' best match.
    ``sents`` is read several times, so it should be a table."""
    values = entities.filter("trim(value) <> ''").groupBy(key, "kind", F.lower(F.trim("value")).alias("low")).agg(F.min(F.trim("value")).alias("value"))
    values = values.withColumn("item", F.concat_ws("|", "kind", "low"))
    one = F.struct("item", "low", F.regexp_extract("low", r"[\p{L}\p{N}]+", 0).alias("w"), evidence_tokens(F.col("value")).alias("nt"))
    of = values.groupBy(key).agg(F.collect_list(one).alias("of"))
    # the words of a sentence are looked at only where it contains the value
    holds = lambda low, v: (v["w"] != "") & low.contains(v["low"]) & F.array_contains(all_of(low, r"[\p{L}\p{N}]+"), v["w"])
    share = lambda v, st: F.when(F.size(v["nt"]) > 0, F.round(F.size(F.array_intersect(v["nt"], st)) / F.size(v["nt"]), 6)).otherwise(0.0)
    score = lambda s, v: F.when(holds(s["low"], v), 2.0).otherwise(share(v, s["st"]))
    scores = lambda s: F.filter(F.transform("of", lambda v: F.struct(v["item"].alias("item"), score(s, v).alias("score"))), lambda z: z["score"] > 0)
    at = sents.join(of, key).select(key, "no", F.explode(let(F.struct(F.lower("sentence").alias("low"), evidence_tokens(F.col("sentence")).alias("st")), scores)).alias("z"))
    at = at.groupBy(key, "z.item").agg(F.min(F.struct((-F.col("z.score")).alias("neg"), "no"))["no"].alias("no"))
    # sentences are fetched by number; a key that two documents share has a number twice
    e = at.join(sents, [key, "no"]).groupBy(key, "item").agg(F.min(F.struct("sentence", "page")).alias("e"))
    return values.join(e, [key, "item"], "left").select(key, "kind", "value", F.col("e.sentence").alias("quote"), F.col("e.page").alias("page"))


def latest(df: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` rows of summaries: partial top-n lists, no full sort."""
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def unique_values(kind: str, values: Column) -> Column:
    return F.transform(distinct_ci(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

