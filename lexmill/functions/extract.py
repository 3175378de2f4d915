"""Extraction of dates, sums, courts, references, duties, outcomes, names and parties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .rx import all_of, capped, distinct_ci, first_of, fold, gate, has, ladder, let, missing, squeeze, sub
from .text import title_case

_OUTER = r"^[ \t\n\r\x{00}\x{0B},.;:\-]+|[ \t\n\r\x{00}\x{0B},.;:\-]+$"


def dates(text: Column) -> Column:
    """Dates as written, pattern by pattern, distinct."""
    return F.array_distinct(F.concat(*(all_of(text, p, "iu", 1) for p in L.DATES)))


def amounts(text: Column) -> Column:
    """Sums of money as currency and whole number, distinct; decimals are dropped."""
    cur, num = all_of(text, L.AMOUNT, "iu", 1), all_of(text, L.AMOUNT, "iu", 2)
    return F.array_distinct(F.zip_with(cur, num, lambda c, n: F.concat(c, F.lit(" "), sub(n, r"\s*,\s*", ","))))


def references(text: Column) -> Column:
    return capped(F.array_distinct(F.filter(F.transform(F.concat(*(all_of(text, p, "u", 1) for p in L.REFERENCES)), squeeze), lambda x: x != "")), 12)


def case_number(text: Column) -> Column:
    return ladder(*(squeeze(first_of(text, p, f + "u")) for p, f in L.CASE_NUMBERS))


def document_date(text: Column) -> Column:
    more = (r"\((\d{1,2}\s+[A-Z][a-z]+\s+\d{4})\)", L.DATES[2], r"\b(\d{4}-\d{2}-\d{2})\b")
    return ladder(*(squeeze(first_of(text, p, "iu")) for p in L.DATES[:2]), *(squeeze(first_of(text, p, "u")) for p in more))


def legislative_date(text: Column) -> Column:
    return ladder(*(squeeze(first_of(text, p, "iu")) for p in L.DATES[:2]), first_of(text, r"\b(\d{4})\b", "u"))


def court(text: Column) -> Column:
    """The court of the caption in the first 3500 characters: captions at a line's start, then anywhere, the earliest
    first; else by the citation in the first twelve lines."""

    def earliest(z: Column, prefix: str) -> Column:
        at = lambda i, name, p: F.when(gate(z["low"], p) & has(z["head"], prefix + p + r"\b", "iu"), F.struct(F.regexp_instr(z["head"], F.lit(f"(?iUd){prefix}{p}\\b")).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("name")))
        return F.array_min(F.array_compact(F.array(*(at(i, name, p) for i, (name, p) in enumerate(L.COURTS.items())))))["name"]

    def cited(lines: Column) -> Column:
        out = None
        for name, p in L.COURT_CITATIONS.items():
            out = F.when(has(lines, p, "iu"), name) if out is None else out.when(has(lines, p, "iu"), name)
        return out

    lines = lambda head: F.array_join(F.slice(F.filter(F.transform(F.split(head, "\n"), lambda v: F.trim(v)), lambda x: x != ""), 1, 12), "\n")
    found = lambda z: F.coalesce(earliest(z, r"(?:^|\n)\s*(?:in\s+the\s+)?"), earliest(z, r"\b"), let(lines(z["head"]), cited))
    return let(let(F.substring(sub(text, r"[ \x{00A0}]+", " "), 1, 3500), lambda head: F.struct(head.alias("head"), fold(head).alias("low"))), found)


def _name(x: Column) -> Column:
    x = squeeze(sub(x, r"\b(OPPOSED APPLICATION|UNOPPOSED APPLICATION)\b", "", "iu"))
    return x


def person(x: Column) -> Column:
    """A person's name without court words and the judge's letter, upper case made title case."""
    x = sub(_name(x), r"^(?:in\s+the\s+)?(?:supreme|high|constitutional|labour|magistrates?|administrative|commercial)\s+court(?:\s+of\s+zimbabwe)?\s+", "", "iu")
    x = sub(x, r"^(?:court\s+of\s+zimbabwe|of\s+zimbabwe)\s+", "", "iu")
    return title_case(F.regexp_replace(sub(x, r"\bJ(?:A|P)?\b", ""), _OUTER, ""))


def organisation(x: Column) -> Column:
    return F.regexp_replace(title_case(_name(x)), _OUTER, "")


def persons(text: Column) -> Column:
    found = F.concat(
        all_of(text, r"(?:Justice|Judge|Honourable|Mr|Mrs|Ms|Dr|Adv|Prof)\s+([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+){0,3})", "u", 1),
        all_of(text, r"\b([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+){0,3})\s+J(?:A|P)?\b", "u", 1),
        all_of(text, r"(?:^|\n)\s*([A-Z][A-Z\-]+(?:\s+[A-Z][A-Z\-]+){0,3})\s+J(?:A|P)?(?:\s|\n|$)", "u", 1),
        all_of(text, r"\b(?:before|coram)\s*[:\-]?\s*([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+){0,3})", "iu", 1),
    )
    return capped(distinct_ci(F.transform(found, person)), 10)


def organisations(text: Column) -> Column:
    named = (
        r"([A-Z][A-Za-z0-9,&'\-\s()]{3,120}(?:Limited|Ltd|Pvt(?:\s+Ltd)?|Holdings|Corporation|Inc|Group|Trust|Foundation|Authority|Services|Agency|Commission|Committee|Council|University|Bank|Ministry|Department))",
        L.PUBLIC_BODIES,
        r"(?:^|\n)([A-Z][A-Z\s,&'\-\(\)]{5,120}(?:LIMITED|LTD|PVT(?:\s+LTD)?|GROUP|TRUST|AUTHORITY|AGENCY|COMMISSION|SERVICES|COUNCIL|UNIVERSITY|BANK|MINISTRY|DEPARTMENT))(?:\n|$)",
    )
    none = F.array().cast("array<string>")
    found = let(text, lambda t: F.concat(*(F.when(gate(t, p), all_of(t, p, "u", 1)).otherwise(none) for p in named)))
    return capped(distinct_ci(F.transform(found, organisation)), 12)


_NO_JUDGE = r"\b(court|zimbabwe|held|harare|bulawayo|mutare|gweru|masvingo|case|number|applicant|respondent|plaintiff|defendant|judgment|judgement|justice|judge|honourable|rules?|order)\b"


def judge(text: Column) -> Column:
    choices = (
        (r"\b(?:before|coram)\s*:?\s*([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+){0,3})\s+J(?:A|P)?\b", "iu"),
        (r"\b([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+){0,2})\s+J(?:A|P)?\b", "u"),
        (r"(?:Justice|JUDGE|Judge|Honourable)\s+([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+){0,3})", "u"),
    )
    found = [F.trim(first_of(text, p, f)) for p, f in choices]
    return missing(person(F.coalesce(*(F.when((x != "") & ~has(x, _NO_JUDGE, "iu"), x) for x in found))))


def party(x: Column) -> Column:
    x = sub(squeeze(x), r"\b(OPPOSED APPLICATION|UNOPPOSED APPLICATION)\b", "", "iu")
    x = sub(x, r"\b(applicant|respondent|plaintiff|defendant|appellant)\b", "", "iu")
    return F.regexp_replace(title_case(x), _OUTER, "")


def parties(text: Column) -> Column:
    """The two parties by the first layout that fits: ``X v Y``, ``between A and B`` on a line, or on lines of their own."""
    forms = (
        (r"\b([A-Z][A-Za-z0-9,&'\-\s()]{3,100}?)\s+v(?:s\.?)?\s+([A-Z][A-Za-z0-9,&'\-\s()]{3,140}?)(?=(?:\s+\(|\s{2,}|[\.\n\r]))", "u"),
        (r"(?s)between\s+(.{6,100}?)\s+(?:and|v\.?s?\.?)\s+(.{6,120}?)(?:\s+(?:and|v\.?|in\s+the\s+matter)|[\.\n\r])", "iu"),
        (r"(?s)(?:^|\n)\s*between\s*\n+(.{3,100}?)\n+(?:and|v\.?s?\.?)\n+(.{3,140}?)(?:\n|$)", "iu"),
    )
    pick = None
    for p, f in forms:
        pair = F.array(party(first_of(text, p, f, 1)), party(first_of(text, p, f, 2)))
        pick = F.when(has(text, p, f), pair) if pick is None else pick.when(has(text, p, f), pair)
    return F.filter(pick.otherwise(F.array().cast("array<string>")), lambda x: x != "")


def _upper_first(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000))


def obligations(sents: Column) -> Column:
    """The first six sentences of duty, between 30 and 300 bytes; standing advice where there is none."""
    found = F.filter(sents, lambda s: has(s, L.OBLIGATION, "i") & (F.octet_length(s) > 30) & (F.octet_length(s) < 300))
    found = capped(F.transform(found, lambda s: _upper_first(F.trim(s))), 6)
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(*(F.lit(v) for v in L.NO_OBLIGATION))))


def principles(sents: Column) -> Column:
    return F.array_join(capped(F.filter(sents, lambda s: has(s, L.PRINCIPLE, "i") & (F.octet_length(s) < 400)), 3), " ")


def outcome(text: Column, sents: Column, doc_type: Column) -> Column:
    """The operative outcome: of a bill or an instrument by its type; else by pattern in the last twelve sentences, then in
    the whole text, then the last sentence with a cue."""
    tail = F.slice(sents, F.greatest(F.size(sents) - 11, F.lit(1)), 12)
    joined = F.array_join(tail, " ")
    tried = [missing(F.trim(first_of(x, p, "iu", 0))) for x in (joined, text) for p in L.OUTCOMES]
    cued = F.try_element_at(F.filter(tail, lambda s: (F.octet_length(s) > 40) & (has(s, L.OUTCOME_CUE, "iu") | has(s, L.OUTCOME_WORD, "iu"))), F.lit(-1))
    return F.when(doc_type == "Bill", F.lit(L.OUTCOME_BILL)).when(doc_type.isin("Act", "Statutory Instrument"), F.lit(L.OUTCOME_LEGISLATION)).otherwise(F.coalesce(*tried, cued, F.lit(L.OUTCOME_UNKNOWN)))


def locations(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(has(text, rf"\b{x}\b", "u"), F.lit(x)) for x in L.LOCATIONS)))


def court_orders(text: Column) -> Column:
    found = F.concat(*(all_of(text, p, "iu", 1) for p in (r"\b(It is ordered that[^.]{10,200})\b", r"\b(The application is [^.]{4,120})\b", r"\b(The appeal is [^.]{4,120})\b", r"\b(Accordingly,[^.]{10,200})\b")))
    return capped(F.array_distinct(F.transform(found, stopped)), 5)


def stopped(x: Column) -> Column:
    """Squeezed, with exactly one full stop at the end."""
    return F.concat(F.regexp_replace(squeeze(x), r"[ \t\n\r.;]+$", ""), F.lit("."))


def instruments(text: Column) -> Column:
    """Cited laws: named by several forms, one per spelling, those that a longer name contains left out; at most fifteen."""
    forms = (
        (r"\b(Constitution(?:\s+of\s+Zimbabwe)?(?:\s+Amendment\s+\(No\.?\s*\d+\)\s+Act,\s*\d{4})?)\b", "iu"),
        (r"\b([A-Z][A-Za-z&,\-()]+(?:\s+(?:and|of|the|for|in|on|to|[A-Z][A-Za-z&,\-()]+)){0,9}\s+(?:Act|Regulations|Rules|Code|By-laws|Statutory Instrument)(?:\s*(?:No\.?\s*)?\d+)?(?:\s*(?:of|,)\s*\d{4})?(?:\s*\[?Chapter\s+\d{1,2}:\d{2}\]?)?)\b", "u"),
        (r"\b((?:SI|S\.I\.|Statutory Instrument)\s*\d+\s*(?:of|\/)\s*\d{4})\b", "iu"),
        (r"\b(Chapter\s+\d{1,2}:\d{2})\b", "u"),
    )
    found = F.concat(*(capped(F.array_distinct(F.transform(all_of(text, p, f, 1), squeeze)), 8) for p, f in forms))
    names = F.transform(found, lambda x: F.regexp_replace(sub(sub(squeeze(x), r"^the\s+", "", "iu"), r"^(?:section|sections|article|articles)\s+[\dA-Za-z(),\s.-]+\s+of\s+the\s+", "", "iu"), r"[ \t\n\r.;:]+$", ""))
    names = F.filter(names, lambda x: (F.length(x) >= 4) & ~has(x, r"\b(applicant|respondent|plaintiff|defendant|court|judge)\b", "iu"))
    return capped(let(distinct_ci(names), lambda n: F.filter(n, lambda x: ~F.exists(n, lambda y: (F.length(y) > F.length(x)) & F.lower(y).contains(F.lower(x))))), 15)
