"""Registered queries of what a document means for its reader, with their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import classify as C
from lexmill.functions import extract as X
from lexmill.functions import lexicons as L
from lexmill.operators import evidence, insight, payload, prose, relational, report, rouge
from lexmill.session import cut, table, written

from . import ansi as A
from . import reports as R
from .analysis import typed, with_sentences
from .reports import query


def _summaries(spark, d, *cols):
    return table(spark, d, "summaries").select("id", *cols)


def _rows(df, col, no):
    """An array column as numbered rows."""
    return df.select("id", F.posexplode(col).alias("i", "v")).select("id", (F.col("i") + 1).cast("long").alias(no), F.col("v"))


def _fold(x: str, steps) -> str:
    for pattern, to, flags in steps:
        x = A.gsub(x, pattern, to.replace("$1", "\\1"), flags)
    return x


def _said(name: str, source: str, x: str) -> str:
    """A step of SQL: ``x`` of ``source`` without numbering and outer marks, with a stop and a capital."""
    return f"{name}a AS (SELECT id, {_fold(A.squeeze(x), L.SUMMARY_SENTENCE)} AS x FROM {source}), {name}b AS (SELECT id, CASE WHEN x = '' OR regexp_matches(x, '[.!?]$') THEN x ELSE x || '.' END AS x FROM {name}a), {name} AS (SELECT id, upper(substr(x, 1, 1)) || substr(x, 2) AS x FROM {name}b)"


@query(f"WITH {_said('u', 'summaries', 'executive_summary')}, v AS (SELECT id, {A.squeeze(_fold('x', L.PLAIN_REWRITE))} AS x FROM u WHERE x IS NOT NULL), {_said('w', 'v', 'x')} SELECT id, x AS plain FROM w")
def plain_rewrite(spark, d):
    return _summaries(spark, d, "executive_summary").filter("executive_summary is not null").select("id", prose.plain_rewrite(F.col("executive_summary")).alias("plain"))


@query()
def polished_summaries(spark, d):
    s = _summaries(spark, d, "professional_summary", "outcome")
    return s.select("id", prose.polish(F.col("professional_summary"), 300).alias("professional_summary"), prose.polish(F.col("outcome"), 120, 3).alias("outcome"))


@query()
def condensed_findings(spark, d):
    s = _summaries(spark, d, "professional_summary").filter("professional_summary is not null")
    return s.select("id", prose.condense(F.split("professional_summary", r"(?<=[.!?])(?U)\s+")).alias("findings"))


_IMPLIED = " ".join(f"WHEN contains(lower(coalesce(document_type, '')), {A.q(k.lower())}) THEN {A.q(v)}" for k, v in L.IMPLICATIONS.items())


@query(f"""SELECT id, CASE WHEN coalesce(document_type, '') <> 'Court Judgment' AND {A.has("coalesce(professional_summary, '')", L.ENVIRONMENT, 'i')} THEN {A.q(L.IMPLICATION_ENVIRONMENT)} {_IMPLIED} ELSE {A.q(L.IMPLICATION_OTHER)} END AS implication FROM summaries""")
def practical_implications(spark, d):
    return _summaries(spark, d, "document_type", "professional_summary").select("id", insight.implications(F.col("professional_summary"), F.col("document_type")).alias("implication"))


_JUDGED = "contains(coalesce(document_type, ''), 'Judgment')"
_LACKS = {"case": f"{_JUDGED} AND case_number IS NULL", "date": "coalesce(date_of_document, '') = ''", "court": f"{_JUDGED} AND coalesce(court, '') = ''", "parties": f"{_JUDGED} AND (parties IS NULL OR trim(parties) = '' OR trim(parties) = '[]')", "outcome": f"coalesce(outcome, '') = {A.q(L.OUTCOME_UNKNOWN)}", "dates": "n_dates = 0"}


@query(f"""WITH {A.DOCS}, x AS ({R._DATES}), n AS (SELECT id, count(*) AS k FROM x GROUP BY id), j AS (SELECT s.*, coalesce(k, 0) AS n_dates FROM summaries s LEFT JOIN n ON s.document_id = n.id),
m AS (SELECT id, list_filter([{', '.join(f"CASE WHEN {_LACKS[k]} THEN {A.q(v)} END" for k, v in L.MISSING.items())}], lambda v: v IS NOT NULL) AS a FROM j) SELECT id, CAST(generate_subscripts(a, 1) AS BIGINT) AS message_no, UNNEST(a) AS message FROM m""")
def missing_information(spark, d):
    docs = R._docs(spark, d).select(F.col("id").alias("document_id"), X.dates(F.col("text")).alias("dates"))
    s = _summaries(spark, d, "document_id", "document_type", "case_number", "date_of_document", "court", "parties", "outcome").join(docs, "document_id", "left")
    parties = F.when(F.coalesce(F.trim("parties"), F.lit("")).isin("", "[]"), F.array().cast("array<string>")).otherwise(relational.json_or_text(F.col("parties")))
    said = insight.missing_information(F.col("document_type"), F.col("case_number"), F.col("date_of_document"), F.col("court"), parties, F.col("outcome"), F.col("dates"))
    return _rows(s.select("id", said.alias("a")), "a", "message_no").withColumnRenamed("v", "message")


@query()
def recommended_actions(spark, d):
    due = evidence.deadlines(R._evidence(spark, d), "id").groupBy(F.col("id").alias("document_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page"))), lambda x: x["page"]).alias("pages"))
    s = _summaries(spark, d, "document_id", "document_type", "outcome").join(due, "document_id", "left")
    return _rows(s.select("id", insight.actions(F.col("document_type"), F.col("outcome"), F.col("pages")).alias("a")), "a", "action_no").withColumnRenamed("v", "action")


@query()
def result_cards(spark, d):
    x = cut(typed(with_sentences(R._docs(spark, d))).select("id", "text", "doc_type", "sentences"))
    x = x.select("id", "text", "doc_type", X.outcome(F.col("text"), F.col("sentences"), F.col("doc_type")).alias("outcome"), X.references(F.col("text")).alias("refs"), X.court_orders(F.col("text")).alias("orders"), X.obligations(F.col("sentences")).alias("duties"), C.issues(F.col("text"), C.categories(F.col("text"))).alias("issues"))
    cards = insight.result_cards(F.col("text"), F.col("doc_type"), F.col("outcome"), C.rights(F.col("refs"), F.col("issues")), F.col("orders"), F.col("duties"), F.col("refs"))
    return x.select("id", F.posexplode(cards).alias("i", "c")).select("id", (F.col("i") + 1).cast("long").alias("card_no"), "c.title", "c.tone", F.array_join("c.items", "|").alias("items"))


_RESULTS = ", ".join(f"CASE WHEN {A.has('low', p)} OR {A.has('sq', p)} OR contains(lower(coalesce(outcome, '')), {A.q(k.lower())}) THEN {A.q(k)} END" for k, p in L.CASE_RESULTS.items())


@query(f"""WITH x AS (SELECT id, outcome, lower(coalesce(professional_summary, '')) AS low, lower({A.squeeze("coalesce(professional_summary, '')")}) AS sq FROM summaries),
f AS (SELECT id, outcome, list_filter([{_RESULTS}], lambda v: v IS NOT NULL) AS a FROM x), g AS (SELECT id, CASE WHEN len(a) = 0 AND coalesce(outcome, '') <> '' THEN [regexp_replace({A.squeeze('outcome')}, '[ \\t\\n\\r.;]+$', '') || '.'] ELSE a END AS a FROM f)
SELECT id, CAST(generate_subscripts(a, 1) AS BIGINT) AS result_no, UNNEST(a) AS result FROM g""")
def case_results(spark, d):
    s = _summaries(spark, d, "professional_summary", "outcome").select("id", insight.case_results(F.col("professional_summary"), F.col("outcome")).alias("a"))
    return _rows(s, "a", "result_no").withColumnRenamed("v", "result")


@query()
def references_panel(spark, d):
    x = with_sentences(R._docs(spark, d)).select("id", X.references(F.col("text")).alias("refs"), X.principles(F.col("sentences")).alias("principles"))
    kw = R._keywords(spark, d).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"]).alias("kw"))
    x = x.join(kw, "id", "left")
    return _rows(x.select("id", insight.references_panel(F.col("refs"), F.col("principles"), F.coalesce("kw", F.array().cast("array<string>"))).alias("a")), "a", "reference_no").withColumnRenamed("v", "reference")


@query()
def source_map(spark, d):
    docs, text = R._prepared(spark, d, "extracted_text"), F.col("text")
    ids = evidence.balanced(R._passages(docs), "id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage_id"))), lambda r: r["passage_id"]).alias("ids"))
    x = docs.select("id", (F.size(X.instruments(text)) > 0).alias("cited"), (F.size(C.rights(X.references(text), C.issues(text, F.col("categories")))) > 0).alias("rights"))
    m = x.join(ids, "id").select("id", F.explode(insight.source_map(F.col("ids"), F.col("cited"), F.col("rights"))).alias("m"))
    return m.select("id", "m.section", F.array_join("m.passage_ids", "|").alias("passage_ids"))


_ISSUES = ", ".join([*(f"CASE WHEN {A.has('low', p)} THEN {A.q(k)} END" for k, p in L.SUMMARY_ISSUES.items()), f"CASE WHEN NOT {A.has('low', L.SUMMARY_EFFECT)} THEN {A.q(L.SUMMARY_NO_EFFECT)} END"])
_JARGON = f"len(list_distinct(list_transform({A.every('x', L.JARGON, 1, 'i')}, lambda w: lower(w))))"
_CASE = " OR ".join(f"contains(low, {A.q(t)})" for t in L.CASE_TERMS)


@query(f"""WITH x AS (SELECT id, coalesce(citizen_summary, '') AS x, lower(coalesce(citizen_summary, '')) AS low, case_number, judge FROM summaries)
SELECT id, array_to_string(list_filter([{_ISSUES}], lambda v: v IS NOT NULL), '|') AS issues, CAST({_JARGON} AS BIGINT) AS jargon,
len({A.every('low', L.DOCTRINE_WORDS, 1, 'i')}) >= 3 AND NOT ({_CASE}) AND NOT coalesce(length(trim(case_number)) >= 4 AND contains(low, lower(trim(case_number))), FALSE) AND NOT coalesce(length(trim(judge)) >= 4 AND contains(low, lower(trim(judge))), FALSE) AS doctrine_only FROM x""")
def summary_checks(spark, d):
    x = F.col("citizen_summary")
    return _summaries(spark, d, "citizen_summary", "case_number", "judge").select("id", F.array_join(insight.summary_issues(x), "|").alias("issues"), insight.jargon_count(x).cast("long").alias("jargon"), insight.doctrine_only(x, F.array("case_number", "judge")).alias("doctrine_only"))


def _n(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, {A.re2(chr(92) + 's+')}), lambda w: w <> ''))"


_O, _P = "trim(coalesce(outcome, ''))", "trim(coalesce(professional_summary, ''))"


@query(f"""SELECT id, {_n(_O)} >= 4 AND NOT {A.has(f"regexp_replace({_O}, '[.]+$', '')", r'^(?:with\s+costs|costs)$', 'i')} AND {A.has(_O, L.USEFUL_OUTCOME, 'i')} AS useful_outcome,
{_P} <> '' AND NOT {A.has(_P, L.NO_SENTENCE, 'i')} AND {_n(_P)} >= 6 AND {A.has(_P, L.SENTENCE_VERB, 'i')} AS meaningful FROM summaries""")
def sentence_checks(spark, d):
    return _summaries(spark, d, "outcome", "professional_summary").select("id", insight.useful_outcome(F.col("outcome")).alias("useful_outcome"), insight.meaningful(F.col("professional_summary")).alias("meaningful"))


_KIND = " ".join(f"WHEN {A.has('h', p)} THEN {A.q(k)}" for k, p in L.HEADING_KINDS.items())


@query(f"WITH x AS (SELECT id, lower(coalesce(original_name, '')) AS h FROM legal_documents) SELECT id, CASE {_KIND} ELSE 'GENERAL_CLAUSE' END AS kind FROM x")
def heading_kinds(spark, d):
    return table(spark, d, "legal_documents").select("id", insight.heading_kind(F.col("original_name")).alias("kind"))


@query()
def rouge_report(spark, d):
    """Means over the latest thirty summaries, of those long enough to be measured; nulls where none is."""
    s = insight.latest(table(spark, d, "summaries").select("id", "document_id", "created_at", "professional_summary", "executive_summary", "citizen_summary"), 30)
    p = cut(rouge.pairs(s, R._legal(spark, d, "id", "extracted_text")))
    x = rouge.precision(p, "id", "source", "generated", 1).join(rouge.precision(p, "id", "source", "generated", 2), "id").join(rouge.subsequence(p, "id", "source", "generated"), "id")
    return x.agg(F.count("*").alias("sample_size"), *(F.round(F.avg(c), 1).alias(c) for c in ("rouge_1", "rouge_2", "rouge_l")))


@query()
def entity_quotes(spark, d):
    x = R._docs(spark, d).select("id", F.explode(F.concat(insight.unique_values("persons", X.persons(F.col("text"))), insight.unique_values("organisations", X.organisations(F.col("text"))), insight.unique_values("dates", X.dates(F.col("text"))))).alias("e")).select("id", "e.kind", "e.value")
    return insight.entity_evidence(cut(x), written(R._evidence(spark, d), "evidence"), "id")


@query()
def obligation_quotes(spark, d):
    x = with_sentences(R._docs(spark, d)).select("id", F.posexplode(X.obligations(F.col("sentences"))).alias("item", "needle"))
    return evidence.best_match(x, R._evidence(spark, d), "id", L.OBLIGATION_TERMS, keep_unmatched=True)


@query()
def finding_quotes(spark, d):
    s = _summaries(spark, d, "document_id", "professional_summary").select(F.col("document_id").alias("id"), F.col("id").alias("summary_id"), F.posexplode(F.split(F.trim(F.coalesce("professional_summary", F.lit(""))), r"(?<=[.!?])(?U)\s+")).alias("n", "needle")).filter("needle <> ''")
    s = s.select("id", F.concat_ws("-", "summary_id", "n").alias("item"), "needle")
    return evidence.best_match(s, R._evidence(spark, d), "id")


@query("SELECT id, user_id, created_at FROM legal_documents WHERE user_id = 1 ORDER BY created_at DESC, id DESC LIMIT 500")
def newest_owned(spark, d):
    return relational.newest(relational.owned(table(spark, d, "legal_documents").select("id", "user_id", "created_at"), 1), 900)


@query("SELECT subject AS term, description AS meaning FROM subjects WHERE contains(lower(subject), 'law') OR contains(lower(description), 'law')")
def glossary_lookup(spark, d):
    return relational.glossary(table(spark, d, "subjects").select(F.col("subject").alias("term"), F.col("description").alias("meaning")), "Law")


_WC = lambda c: f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '[ \\t\\n\\r\\f\\x{{0B}}]+'), lambda w: w <> ''))"


@query(f"SELECT id, CASE WHEN {_WC('citizen_summary')} < 80 AND {_WC('professional_summary')} > {_WC('citizen_summary')} THEN professional_summary ELSE citizen_summary END AS shown FROM summaries")
def saved_or_fallback(spark, d):
    return _summaries(spark, d, "citizen_summary", "professional_summary").select("id", report.saved_or(F.col("citizen_summary"), F.col("professional_summary"), 80).alias("shown"))


@query("WITH x AS (SELECT id, list_filter(list_transform(regexp_split_to_array(citizen_summary, '\\n+|;[ \\t\\n\\r]+'), lambda v: trim(v, ' ')), lambda v: v <> '') AS a FROM summaries WHERE citizen_summary IS NOT NULL) SELECT id, CAST(generate_subscripts(a, 1) AS BIGINT) AS item_no, UNNEST(a) AS item FROM x")
def list_splitting(spark, d):
    return _rows(_summaries(spark, d, "citizen_summary").filter("citizen_summary is not null").select("id", report.list_items(F.col("citizen_summary")).alias("a")), "a", "item_no").withColumnRenamed("v", "item")


@query()
def merged_text(spark, d):
    return _summaries(spark, d, "executive_summary", "professional_summary").select("id", payload.best_text(F.col("executive_summary"), F.col("professional_summary")).alias("chosen"))
