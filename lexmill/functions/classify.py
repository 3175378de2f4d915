"""Classifiers: document type, tone, language, readability, areas of law, clauses, passages, issues and rights."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .rx import capped, count, gate, has, let, squeeze


def weighted(x: Column, patterns) -> Column:
    return reduce(add, (F.when(gate(x, p), F.least(F.lit(4), count(x, p, "u")) * F.lit(w)).otherwise(0.0) for p, w in patterns), F.lit(0.0))


def title_line(x: Column) -> Column:
    """A line as a title: squeezed, without outer punctuation; empty if longer than 180 characters."""
    x = F.regexp_replace(squeeze(x), r"^[ \t\n\r,.;:\-]+|[ \t\n\r,.;:\-]+$", "")
    return F.when(F.length(x) <= 180, x).otherwise("")


def title_signal(cleaned: Column, filename: Column) -> Column:
    """The file's name and the telling lines among the first 18 of the first 3000 characters."""
    name = title_line(F.regexp_replace(F.regexp_replace(F.trim(filename), r"(?i)\.[a-z0-9]{2,6}$", ""), r"[_-]+", " "))
    lines = F.slice(F.filter(F.split(F.substring(cleaned, 1, 3000), "\n"), lambda x: x != ""), 1, 18)
    lines = F.filter(F.transform(lines, title_line), lambda x: (x != "") & ~has(x, L.TITLE_IGNORED, "iu") & (has(x, L.TITLE_WORDS, "iu") | (x == F.upper(x))))
    return F.array_join(F.array_distinct(F.filter(F.concat(F.array(F.coalesce(name, F.lit(""))), lines), lambda x: x != "")), "\n")


def type_scores(cleaned: Column, filename: Column) -> Column:
    """Struct of ``scores`` and ``titles``, an array each in the fixed order of types. Every shared part is bound once, so a
    predicate on the type that the optimizer moves to the scan doesn't multiply the patterns."""
    level = lambda a: F.transform(a, lambda x: F.round(x, 6))
    body = lambda h: level(F.array(*(weighted(h, p) for p in L.TYPE_PATTERNS.values())))
    title = lambda t: level(F.array(*(weighted(t, L.TITLE_PATTERNS.get(k, ())) for k in L.TYPE_PATTERNS)))
    both = lambda z: F.struct(F.zip_with(z["b"], z["t"], lambda x, y: F.round(x + y, 6)).alias("scores"), z["t"].alias("titles"))
    of_text = lambda c: let(F.lower(title_signal(c, filename)), lambda t: let(F.struct(let(F.concat(F.lower(c), F.lit("\n"), t), body).alias("b"), title(t).alias("t")), both))
    return let(cleaned, of_text)


def document_type(scores: Column, titles: Column) -> Column:
    """The type by the ordered decisions; the first of equal scores wins."""
    place = {t: i for i, t in enumerate(L.TYPE_PATTERNS)}
    s = lambda t: scores[place[t]]
    titled = lambda t: titles[place[t]]
    best_of = lambda names: F.greatest(*(s(t) for t in names))
    first = lambda names, top: F.coalesce(*(F.when(s(t) == top, F.lit(t)) for t in names))
    special, every = best_of(L.SPECIFIC_CONTRACTS), best_of(L.TYPE_PATTERNS)
    return (
        F.when((s("Bill") >= 4.0) & (s("Bill") >= F.greatest(s("Act"), s("Statutory Instrument")) - 0.4), "Bill")
        .when((s("Statutory Instrument") >= 4.0) & (s("Statutory Instrument") >= s("Act") - 0.4), "Statutory Instrument")
        .when((titled("Act") >= 5.0) & (titled("Bill") < 5.0) & (titled("Statutory Instrument") < 5.0), "Act")
        .when(s("Court Judgment") >= 4.0, "Court Judgment")
        .when((special >= 3.2) & (special >= s("Contract Agreement") - 1.0), first(L.SPECIFIC_CONTRACTS, special))
        .when(every >= 2.4, first(L.TYPE_PATTERNS, every))
        .otherwise("Legal Document")
    )


def legislative(doc_type: Column) -> Column:
    return doc_type.isin("Bill", "Act", "Statutory Instrument")


def hits(tokens: Column, words) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(list(words))))


def sentiment(tokens: Column) -> Column:
    p, n = hits(tokens, L.POSITIVE), hits(tokens, L.NEGATIVE)
    return F.when(p > n + 2, "positive").when(n > p + 2, "negative").otherwise("neutral")


def language(tokens: Column) -> Column:
    a, b = hits(tokens, L.SHONA), hits(tokens, L.NDEBELE)
    return F.when((a >= 2) & (a > b), "sn").when((b >= 2) & (b > a), "nd").otherwise("en")


def readability(tokens: Column, n_sentences: Column) -> Column:
    """Reading ease from 0 to 100; a text without tokens has 0."""
    n = F.size(tokens)
    syllables = F.aggregate(tokens, F.lit(0), lambda a, t: a + F.greatest(F.lit(1), F.regexp_count(t, F.lit("(?i)[aeiouy]+"))))
    score = F.lit(206.835) - F.lit(1.015) * (n / F.greatest(n_sentences, F.lit(1))) - F.lit(84.6) * (syllables / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1))


def matching(x: Column, labels: dict[str, str]) -> Column:
    """The labels whose pattern stands anywhere in ``x``, in the fixed order."""
    found = lambda z: F.array_compact(F.array(*(F.when(gate(z["low"], p) & has(z["x"], p, "i"), F.lit(k)) for k, p in labels.items())))
    return let(let(x, lambda x: F.struct(x.alias("x"), F.lower(x).alias("low"))), found)


def categories(text: Column) -> Column:
    return matching(text, L.CATEGORIES)


def clause_type(x: Column, doc_type: Column | None = None) -> Column:
    low = F.lower(x)
    out = None
    for label, p in L.CLAUSE_TYPES.items():
        out = F.when(has(low, p), label) if out is None else out.when(has(low, p), label)
    return out.when(doc_type == "Court Judgment", "COURT_ORDER").otherwise("GENERAL_CLAUSE") if doc_type is not None else out.otherwise("GENERAL_CLAUSE")


def passage_kind(x: Column) -> Column:
    out = None
    for label, p in L.PASSAGE_KINDS.items():
        out = F.when(has(x, p, "iu"), label) if out is None else out.when(has(x, p, "iu"), label)
    return out.otherwise("other")


def issues(text: Column, cats: Column, keywords: Column | None = None) -> Column:
    """At most six issues of a case: by the text, then those that an area of law or a keyword implies."""
    righted = F.lit(False) if keywords is None else F.exists(keywords, lambda k: F.lower(k).contains("right"))
    implied = F.array_compact(F.array(F.when(F.array_contains(cats, "Labour Law"), "Labour dispute"), F.when(F.array_contains(cats, "Contract Law"), "Breach of contract"), F.when(F.array_contains(cats, "Constitutional Law") | righted, "Constitutional rights")))
    return capped(F.array_distinct(F.concat(matching(text, L.ISSUES), implied)), 6)


def legislative_issues(text: Column, keywords: Column | None = None) -> Column:
    """At most six issues of legislation, by the text and the keywords; up to four are filled with keywords as titles."""
    if keywords is None:
        return capped(matching(text, L.LEGISLATIVE_ISSUES), 6)
    title = lambda k: F.array_join(F.transform(F.split(k, "-"), lambda x: F.initcap(x)), "-")
    fit = F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: (F.length(k) >= 6) & ~has(k, r"\b(breach|contract|dispute|applicant|respondent)\b", "iu"))
    fill = lambda m: F.concat(m, F.slice(F.transform(fit, title), 1, F.greatest(F.lit(0), 4 - F.size(m))))
    found = let(F.concat_ws(" ", text, F.array_join(keywords, " ")), lambda x: matching(F.lower(x), L.LEGISLATIVE_ISSUES))
    return capped(F.array_distinct(let(found, fill)), 6)


def rights(references: Column, found_issues: Column) -> Column:
    def of(z: Column) -> Column:
        named = lambda joined: F.array_compact(F.array(*(F.when(joined.contains(n), F.lit(k)) for k, n in L.RIGHTS.items())))
        open_ = lambda n: F.when((F.size(n) == 0) & F.array_contains(z["i"], "Constitutional rights"), F.array(F.lit(L.RIGHTS_OPEN))).otherwise(n)
        return let(let(F.lower(F.array_join(F.concat(z["r"], z["i"]), " ")), named), open_)

    return let(F.struct(references.alias("r"), found_issues.alias("i")), of)


def badge(kind: Column) -> Column:
    """The display group of a document type; contracts are told first."""
    t = F.lower(F.coalesce(kind, F.lit("")))
    any_of = lambda *w: reduce(lambda a, b: a | b, (t.contains(x) for x in w))
    return F.when(any_of("contract", "agreement", "lease"), "contract").when(any_of("judgment", "court", "ruling"), "judgment").when(any_of("act", "bill", "regulation", "statute", "statutory"), "act").otherwise("other")


def urgency(n_deadlines: Column, n_risky: Column, outcome: Column, doc_type: Column) -> Column:
    loud = has(F.lower(F.coalesce(outcome, F.lit(""))), r"\b(with costs|dismissed|granted|refused|set aside|appeal)\b")
    contract = has(F.lower(F.coalesce(doc_type, F.lit(""))), r"\b(contract|agreement|lease|employment|loan)\b")
    return F.when((n_deadlines > 0) | loud, "high").when((n_risky >= 2) | contract, "medium").otherwise("low")
