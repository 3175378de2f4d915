"""Registered queries of the document operators and relational reports, each with its ANSI SQL where SQL can say it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import classify as C
from lexmill.functions import extract as X
from lexmill.functions import lexicons as L
from lexmill.functions import plain
from lexmill.functions import text as T
from lexmill.operators import clauses, evidence, keywords, learned, payload, relational, report, rouge, search
from lexmill.functions.rx import let
from lexmill.session import cut, spread, table, written

from . import ansi as A
from .analysis import analysed, documents, typed, with_sentences, with_tokens

QUERIES: dict = {}
SQL: dict = {}
AS_OF = "2025-06-30 12:00:00"
QUERY = "agreement for the monthly rental and unfair dismissal"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _legal(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "legal_documents").select(*(cols or ("id", "original_name", "extracted_text")))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return documents(spread(_legal(spark, d)))


# --- text ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {A.DOCS} SELECT id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest FROM d")
def clean_text(spark, d):
    return _docs(spark, d).select("id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"WITH {A.DOCS}, {A.SENTS} SELECT id, CAST(i AS BIGINT) AS sentence_no, ss[i] AS sentence FROM s, UNNEST(range(1, len(ss) + 1)) AS u(i)")
def sentence_split(spark, d):
    return with_sentences(_docs(spark, d)).select("id", F.posexplode("sentences").alias("i", "sentence")).select("id", (F.col("i") + 1).cast("long").alias("sentence_no"), "sentence")


@query(f"WITH {A.DOCS}, {A.TOKENS} SELECT token, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT id) AS BIGINT) AS documents FROM (SELECT id, UNNEST(ts) AS token FROM k) GROUP BY token")
def token_counts(spark, d):
    return with_tokens(_docs(spark, d)).select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("id").alias("documents"))


@query("SELECT id, CAST(len(regexp_extract_all(extracted_text, '[\\p{L}\\p{N}][\\p{L}\\p{N}''-]*')) AS BIGINT) AS words FROM legal_documents WHERE extracted_text IS NOT NULL")
def unicode_word_count(spark, d):
    return _legal(spark, d, "id", "extracted_text").filter("extracted_text is not null").select("id", T.unicode_words(F.col("extracted_text")).cast("long").alias("words"))


_WORDS = f"string_split({A.squeeze('executive_summary')}, ' ')"


@query(f"SELECT id, CASE WHEN executive_summary = '' OR {A.squeeze('executive_summary')} = '' THEN '' WHEN len({_WORDS}) <= 40 THEN array_to_string({_WORDS}, ' ') ELSE array_to_string(list_slice({_WORDS}, 1, 40), ' ') || '...' END AS limited FROM summaries WHERE executive_summary IS NOT NULL")
def word_limited(spark, d):
    return table(spark, d, "summaries").select("id", "executive_summary").filter("executive_summary is not null").select("id", T.word_limit(F.col("executive_summary"), 40).alias("limited"))


@query()
def page_split(spark, d):
    return _legal(spark, d, "id", "extracted_text").filter("extracted_text is not null").select("id", F.explode(T.pages(F.col("extracted_text"), box_markers=True)).alias("p")).select("id", "p.page", F.length("p.text").cast("long").alias("n_chars"))


# --- classification -----------------------------------------------------------------------------------------------------

_SCORES = ", ".join("round(" + " + ".join(f"least(4, len({A.every('h', p)})) * {w}" for p, w in ps) + f", 6) AS {A.q(t).replace(chr(39), chr(34))}" for t, ps in L.TYPE_PATTERNS.items())


@query(f"WITH {A.DOCS}, h AS (SELECT id, lower(t) AS h FROM d), w AS (SELECT id, {_SCORES} FROM h) SELECT id, label, CAST(score AS DOUBLE) AS score FROM (UNPIVOT w ON COLUMNS(* EXCLUDE (id)) INTO NAME label VALUE score) WHERE score > 0")
def body_type_scores(spark, d):
    x = _docs(spark, d).withColumn("h", F.lower("text"))
    pairs = F.array(*(F.struct(F.lit(t).alias("label"), F.round(C.weighted(F.col("h"), p), 6).alias("score")) for t, p in L.TYPE_PATTERNS.items()))
    return x.select("id", F.explode(pairs).alias("p")).select("id", "p.label", "p.score").filter("score > 0")


@query()
def document_types(spark, d):
    return typed(_docs(spark, d)).select("id", "doc_type")


@query()
def doc_type_top5(spark, d):
    return relational.top_counts(typed(_docs(spark, d)).select("doc_type"), "doc_type")


def _count_in(words) -> str:
    return "len(list_filter(ts, lambda w: w IN (" + ", ".join(A.q(w) for w in words) + ")))"


@query(f"WITH {A.DOCS}, {A.TOKENS}, c AS (SELECT id, {_count_in(L.POSITIVE)} AS p, {_count_in(L.NEGATIVE)} AS n FROM k) SELECT id, CASE WHEN p > n + 2 THEN 'positive' WHEN n > p + 2 THEN 'negative' ELSE 'neutral' END AS sentiment FROM c")
def sentiments(spark, d):
    return with_tokens(_docs(spark, d)).select("id", C.sentiment(F.col("tokens")).alias("sentiment"))


@query(f"WITH {A.DOCS}, {A.TOKENS}, c AS (SELECT id, {_count_in(L.SHONA)} AS a, {_count_in(L.NDEBELE)} AS b FROM k) SELECT id, CASE WHEN a >= 2 AND a > b THEN 'sn' WHEN b >= 2 AND b > a THEN 'nd' ELSE 'en' END AS language FROM c")
def languages(spark, d):
    return with_tokens(_docs(spark, d)).select("id", C.language(F.col("tokens")).alias("language"))


@query(f"""WITH {A.DOCS}, {A.SENTS}, {A.TOKENS}, c AS (SELECT k.id, len(ts) AS n, len(ss) AS m, coalesce(list_sum(list_transform(ts, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouyAEIOUY]+'))))), 0) AS y FROM k JOIN s ON k.id = s.id)
SELECT id, CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * (n::DOUBLE / greatest(m, 1)) - 84.6::DOUBLE * (y::DOUBLE / n))), 1) END AS readability FROM c""")
def readability(spark, d):
    return with_tokens(with_sentences(_docs(spark, d))).select("id", C.readability(F.col("tokens"), F.size("sentences")).alias("readability"))


_CATEGORIES = " UNION ALL ".join(f"SELECT id, {A.q(k)} AS category FROM d WHERE regexp_matches(t, {A.q(p)}, 'i')" for k, p in L.CATEGORIES.items())


@query(f"WITH {A.DOCS} {_CATEGORIES}")
def legal_categories(spark, d):
    return _docs(spark, d).select("id", F.explode(C.categories(F.col("text"))).alias("category"))


_CLAUSE = "CASE " + " ".join(f"WHEN regexp_matches(l, {A.q(p)}) THEN {A.q(t)}" for t, p in L.CLAUSE_TYPES.items()) + " ELSE 'GENERAL_CLAUSE' END"


@query(f"WITH {A.DOCS}, {A.SENTS}, x AS (SELECT id, lower(UNNEST(ss)) AS l FROM s) SELECT clause_type, CAST(count(*) AS BIGINT) AS sentences, CAST(count(DISTINCT id) AS BIGINT) AS documents FROM (SELECT id, {_CLAUSE} AS clause_type FROM x) GROUP BY clause_type")
def clause_types(spark, d):
    x = with_sentences(_docs(spark, d)).select("id", F.explode("sentences").alias("s")).select("id", C.clause_type(F.col("s")).alias("clause_type"))
    return x.groupBy("clause_type").agg(F.count("*").alias("sentences"), F.count_distinct("id").alias("documents"))


_ISSUES = " UNION ALL ".join(f"SELECT id, {i} AS o, {A.q(k)} AS issue FROM d WHERE regexp_matches(t, {A.q(p)}, 'i')" for i, (k, p) in enumerate(L.ISSUES.items()))


@query(f"""WITH {A.DOCS}, i AS ({_ISSUES}), c AS ({_CATEGORIES}), m AS (SELECT id, 10 AS o, 'Labour dispute' AS issue FROM c WHERE category = 'Labour Law' UNION ALL SELECT id, 11, 'Breach of contract' FROM c WHERE category = 'Contract Law' UNION ALL SELECT id, 12, 'Constitutional rights' FROM c WHERE category = 'Constitutional Law'),
u AS (SELECT id, issue, min(o) AS o FROM (SELECT * FROM i UNION ALL SELECT * FROM m) GROUP BY id, issue), r AS (SELECT id, issue, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM u) SELECT id, CAST(n AS BIGINT) AS issue_no, issue FROM r WHERE n <= 6""")
def legal_issues(spark, d):
    x = _docs(spark, d).withColumn("c", C.categories(F.col("text")))
    return x.select("id", F.posexplode(C.issues(F.col("text"), F.col("c"))).alias("i", "issue")).select("id", (F.col("i") + 1).cast("long").alias("issue_no"), "issue")


@query("""SELECT document_type, CASE WHEN regexp_matches(x, 'contract|agreement|lease') THEN 'contract' WHEN regexp_matches(x, 'judgment|court|ruling') THEN 'judgment' WHEN regexp_matches(x, 'act|bill|regulation|statute|statutory') THEN 'act' ELSE 'other' END AS badge, CAST(count(*) AS BIGINT) AS n
FROM (SELECT document_type, lower(coalesce(document_type, '')) AS x FROM summaries) GROUP BY document_type, x""")
def type_badges(spark, d):
    return table(spark, d, "summaries").groupBy("document_type").agg(F.count("*").alias("n")).select("document_type", C.badge(F.col("document_type")).alias("badge"), "n")


# --- extraction ---------------------------------------------------------------------------------------------------------

_DATES = " UNION ALL ".join(f"SELECT id, {i} AS p, UNNEST({A.every('t', p, 1, 'i' if i < 2 else '')}) AS v FROM d" for i, p in enumerate(L.DATES))


@query(f"WITH {A.DOCS}, x AS ({_DATES}) SELECT DISTINCT id, v AS date_text FROM x")
def entity_dates(spark, d):
    return _docs(spark, d).select("id", F.explode(X.dates(F.col("text"))).alias("date_text"))


_CUR, _NUM = A.every(A.wordy("t"), L.AMOUNT, 1, "i"), A.every(A.wordy("t"), L.AMOUNT, 2, "i")


@query(f"WITH {A.DOCS}, x AS (SELECT id, UNNEST({_CUR}) AS c, UNNEST({_NUM}) AS n FROM d) SELECT DISTINCT id, c || ' ' || {A.gsub('n', r'\s*,\s*', ',')} AS amount FROM x")
def entity_amounts(spark, d):
    return _docs(spark, d).select("id", F.explode(X.amounts(F.col("text"))).alias("amount"))


_CASE_NO = ", ".join(f"nullif({A.squeeze(f'regexp_extract(t, {A.re2(p)}, 1' + (f', {A.q(f)})' if f else ')'))}, '')" for p, f in L.CASE_NUMBERS)


@query(f"WITH {A.DOCS} SELECT id, coalesce({_CASE_NO}) AS case_number FROM d")
def case_numbers(spark, d):
    return _docs(spark, d).select("id", X.case_number(F.col("text")).alias("case_number"))


@query()
def courts_found(spark, d):
    return _docs(spark, d).select("id", X.court(F.col("text")).alias("court"))


_REFS = " UNION ALL ".join(f"SELECT id, {i} AS p, generate_subscripts(v, 1) AS o, UNNEST(v) AS v FROM (SELECT id, {A.every('t', p, 1)} AS v FROM d)" for i, p in enumerate(L.REFERENCES))


@query(f"""WITH {A.DOCS}, x AS ({_REFS}), y AS (SELECT id, p, o, {A.squeeze('v')} AS v FROM x), z AS (SELECT id, v, min(p * 100000 + o) AS o FROM y WHERE v <> '' GROUP BY id, v), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM z)
SELECT id, CAST(n AS BIGINT) AS reference_no, v AS reference FROM r WHERE n <= 12""")
def legal_references(spark, d):
    return _docs(spark, d).select("id", F.posexplode(X.references(F.col("text"))).alias("i", "reference")).select("id", (F.col("i") + 1).cast("long").alias("reference_no"), "reference")


@query(f"""WITH {A.DOCS}, {A.SENTS}, f AS (SELECT id, list_slice(list_transform(list_filter(ss, lambda x: {A.has('x', L.OBLIGATION, 'i')} AND strlen(x) > 30 AND strlen(x) < 300), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), 1, 6) AS o FROM s),
g AS (SELECT id, CASE WHEN len(o) > 0 THEN o ELSE [{', '.join(A.q(x) for x in L.NO_OBLIGATION)}] END AS o FROM f) SELECT id, CAST(generate_subscripts(o, 1) AS BIGINT) AS obligation_no, UNNEST(o) AS obligation FROM g""")
def obligations(spark, d):
    return with_sentences(_docs(spark, d)).select("id", F.posexplode(X.obligations(F.col("sentences"))).alias("i", "obligation")).select("id", (F.col("i") + 1).cast("long").alias("obligation_no"), "obligation")


@query(f"WITH {A.DOCS}, {A.SENTS} SELECT id, array_to_string(list_slice(list_filter(ss, lambda x: {A.has('x', L.PRINCIPLE, 'i')} AND strlen(x) < 400), 1, 3), ' ') AS principles FROM s")
def legal_principles(spark, d):
    return with_sentences(_docs(spark, d)).select("id", X.principles(F.col("sentences")).alias("principles"))


_OUT = [f"nullif(trim(regexp_extract({x}, {A.re2(p)}, 0, 'i')), '')" for x in ("j", "t") for p in L.OUTCOMES]


@query(f"""WITH {A.DOCS}, {A.SENTS}, y AS (SELECT d.id, t, list_slice(ss, greatest(len(ss) - 11, 1), len(ss)) AS tail FROM d JOIN s ON d.id = s.id), z AS (SELECT id, t, tail, array_to_string(tail, ' ') AS j FROM y)
SELECT id, coalesce({', '.join(_OUT)}, list_filter(tail, lambda x: strlen(x) > 40 AND ({A.has('x', L.OUTCOME_CUE, 'i')} OR {A.has('x', L.OUTCOME_WORD, 'i')}))[-1], {A.q(L.OUTCOME_UNKNOWN)}) AS outcome FROM z""")
def outcomes(spark, d):
    return with_sentences(_docs(spark, d)).select("id", X.outcome(F.col("text"), F.col("sentences"), F.lit("Legal Document")).alias("outcome"))


@query()
def typed_outcomes(spark, d):
    """The outcome by each document's type; ``outcomes`` has the rules of a court's document for every one, as its SQL."""
    return typed(with_sentences(_docs(spark, d))).select("id", "doc_type", X.outcome(F.col("text"), F.col("sentences"), F.col("doc_type")).alias("outcome"))


@query()
def names_found(spark, d):
    x = _docs(spark, d).select("id", X.persons(F.col("text")).alias("persons"), X.organisations(F.col("text")).alias("organisations"), X.judge(F.col("text")).alias("judge"))
    return x.select("id", F.array_join("persons", "|").alias("persons"), F.array_join("organisations", "|").alias("organisations"), "judge")


@query()
def party_pairs(spark, d):
    return _docs(spark, d).select("id", F.array_join(X.parties(F.col("text")), "|").alias("parties"))


@query()
def cited_instruments(spark, d):
    return _docs(spark, d).select("id", F.explode(X.instruments(F.col("text"))).alias("instrument"))


@query()
def court_orders(spark, d):
    return _docs(spark, d).select("id", F.explode(X.court_orders(F.col("text"))).alias("court_order"))


def _prepared(spark, d, *more):
    """The typed documents with their sentences, keywords, areas of law and learned areas as a table, for the steps of one query to share;
    ``more`` are columns of the documents that it keeps."""
    boosts, areas = learned.models(written(_examples(spark, d).withColumn("cleaned", T.clean(F.col("text"))), "examples"))
    rank, areas_of = keywords.ranked(boosts), learned.best_categories(areas)

    @F.pandas_udf("keywords array<struct<term:string,score:double>>, areas array<string>, categories array<string>")
    def told(text: pd.Series, sentences: pd.Series, legislation: pd.Series) -> pd.DataFrame:
        rows = [(x, x.lower(), s, law) for x, s, law in zip(text, sentences, legislation, strict=True)]
        return pd.DataFrame({"keywords": [[{"term": t, "score": v} for t, v in rank(*r)] for r in rows], "areas": [areas_of(r[1]) for r in rows], "categories": [plain.categories(x) for x in text]})

    x = typed(with_sentences(documents(spread(_legal(spark, d)), *more)))
    x = x.withColumn("told", told("text", "sentences", C.legislative(F.col("doc_type"))))
    return written(x.select("*", "told.keywords", "told.areas", "told.categories").drop("told"), "prepared")


def _taught(spark, d):
    """The learned areas of law of each document. The examples' own labels aren't in the tables; as those are what the patterns
    found in the text, the patterns give them again."""
    x = _examples(spark, d).withColumn("labels", let(T.clean(F.col("text")), C.categories))
    return learned.categories(_docs(spark, d), "id", "text", learned.category_model(x))


@query()
def learned_categories(spark, d):
    return _taught(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query()
def typed_issues(spark, d):
    x = _analysed(spark, d)[0]
    return x.select("id", F.posexplode("issues").alias("i", "issue")).select("id", (F.col("i") + 1).cast("long").alias("issue_no"), "issue")


@query()
def document_analysis(spark, d):
    x = _analysed(spark, d)[0].drop("keywords")
    return x.select(*(F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in x.dtypes))


# --- keywords, summaries, passages ----------------------------------------------------------------------------------------


def _tfidf(spark, d):
    # four branches read the prepared texts
    x = cut(with_tokens(with_sentences(_docs(spark, d))).select("id", "sentences", "tokens"))
    return keywords.tfidf(x, "id", "sentences", "tokens")


def _analysed(spark, d):
    """The analysis of each document with its keywords and learned areas of law, and the prepared documents."""
    x = _prepared(spark, d)
    return analysed(with_tokens(x), F.col("keywords.term"), F.col("areas")), x


def _keywords(spark, d):
    """The keywords of each document, by all steps of the score: the learned terms it holds and, in legislation, its opening
    phrases are added. ``tfidf_topk`` stops before these, as its SQL."""
    x = _prepared(spark, d).select("id", F.posexplode("keywords").alias("i", "k"))
    return x.select("id", (F.col("i") + 1).alias("rank"), "k.term", "k.score")


_STOP = ", ".join(A.q(w) for w in L.STOP_WORDS)
_WEAK = lambda t: f"({t} IN ({_STOP}) OR length({t}) < 4 OR regexp_matches({t}, '^[0-9]+$'))"
_EDGE = ", ".join(A.q(w) for w in L.PHRASE_EDGE)


def _gram_sql(n: int, w: float) -> str:
    parts = " || ' ' || ".join(f"ts[i + {j}]" for j in range(n))
    conds = " AND ".join(f"NOT {_WEAK(f'ts[i + {j}]')}" for j in range(n))
    legal = f" AND {A.has(A.wordy('term'), L.LEGAL_PHRASE)}" if n == 3 else ""
    return f"SELECT DISTINCT id, i0, term, {w} AS w FROM (SELECT id, i0, {parts} AS term, ts[i] AS a, ts[i + {n - 1}] AS z FROM st, UNNEST(range(1, len(ts) - {n - 2})) AS u(i) WHERE {conds}) WHERE a NOT IN ({_EDGE}) AND z NOT IN ({_EDGE}) AND {A.has(A.wordy('z'), L.PHRASE_END)}{legal}"


@query(f"""WITH {A.DOCS}, {A.SENTS}, {A.TOKENS}, se AS (SELECT id, generate_subscripts(ss, 1) AS i0, UNNEST(ss) AS sx FROM s), st AS (SELECT id, i0, {A.tokens('sx')} AS ts FROM se),
uni AS (SELECT id, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT id, UNNEST(ts) AS term FROM k) WHERE NOT {_WEAK('term')} GROUP BY id, term),
udf AS (SELECT id, term, count(DISTINCT i0) AS df FROM (SELECT id, i0, UNNEST(ts) AS term FROM st) GROUP BY id, term),
g AS ({_gram_sql(2, 1.0)} UNION ALL {_gram_sql(3, 1.3)}), gt AS (SELECT id, term, sum(w)::DOUBLE AS tf, count(*) AS df FROM g GROUP BY id, term),
a AS (SELECT uni.id, uni.term, tf, coalesce(df, 1) AS df FROM uni LEFT JOIN udf ON uni.id = udf.id AND uni.term = udf.term UNION ALL SELECT id, term, tf, df FROM gt),
sc AS (SELECT a.id, term, round(tf * (ln((1 + greatest(len(ss), 1))::DOUBLE / (1 + df)) + 1) * CASE WHEN contains(term, ' ') THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN {A.has(A.wordy('term'), L.LEGAL_PHRASE)} THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END, 4) AS score FROM a JOIN s ON a.id = s.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS rank FROM sc) SELECT id, CAST(rank AS BIGINT) AS rank, term, score FROM r WHERE rank <= 20""")
def tfidf_topk(spark, d):
    return _tfidf(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query()
def extractive_summary(spark, d):
    x = with_sentences(_docs(spark, d))
    return keywords.extract(keywords.sentence_scores(x, "id", "sentences", _keywords(spark, d)), "id", 3)


@query()
def boosted_keywords(spark, d):
    return _keywords(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query()
def opening_keywords(spark, d):
    return keywords.opening_boosts(_docs(spark, d), "id", "text").withColumn("boost", F.round("boost", 4))


def _passages(docs):
    """The passages of documents that were prepared with their raw text. They are looked up by the words of the document's type, its
    keywords, areas of law and parties in lower case, and its case number, court and judge as they stand. Repeated terms count
    again."""
    x = analysed(with_tokens(docs), F.col("keywords.term"), F.col("areas"), ("extracted_text",)).select("id", "extracted_text", "doc_type", "keywords", "categories", "parties", "case_number", "court", "judge")
    lower = lambda c: F.transform(c, lambda t: F.lower(t))
    parts = F.concat(F.split(F.lower("doc_type"), " "), lower(F.array_sort("keywords")), lower("categories"), lower("parties"), F.array("case_number", "court", "judge"))
    x = x.select("id", "extracted_text", F.transform(F.array_compact(parts), lambda t: F.trim(t)).alias("terms"))
    return evidence.passages(x, "id", "extracted_text", "terms")


@query()
def passage_scores(spark, d):
    return _passages(_prepared(spark, d, "extracted_text")).select("id", "passage_id", "page", "score", "kind")


@query()
def passage_balanced(spark, d):
    return evidence.balanced(_passages(_prepared(spark, d, "extracted_text")), "id")


# --- clauses, evidence, risk -----------------------------------------------------------------------------------------------


@query()
def headed_clauses(spark, d):
    return clauses.headed(_docs(spark, d), "id", "text")


@query()
def clause_dedupe(spark, d):
    x = cut(typed(with_sentences(_docs(spark, d))))
    return clauses.merged(x, "id", "text", "sentences", "doc_type")


_EV = f"""e AS (SELECT id, {A.evidence_sentences("trim(extracted_text, ' ')")} AS ss FROM legal_documents WHERE extracted_text IS NOT NULL AND trim(extracted_text) <> '' AND NOT regexp_matches(extracted_text, '[—-][—-]' || '[' || chr(32) || ']*PAGE', 'i')), es AS (SELECT id, generate_subscripts(ss, 1) AS no, UNNEST(ss) AS sentence FROM e)"""


def _evidence(spark, d):
    return evidence.sentences(spread(_legal(spark, d, "id", "extracted_text")).filter("extracted_text is not null"), "id", "extracted_text")


@query(f"WITH {_EV}, r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY no) AS rank, sentence FROM es WHERE {A.has('sentence', L.DEADLINE, 'i')}) SELECT id, CAST(rank AS BIGINT) AS rank, CAST(1 AS BIGINT) AS page, sentence FROM r WHERE rank <= 4")
def deadlines(spark, d):
    return evidence.deadlines(_evidence(spark, d), "id").select("id", F.col("rank").cast("long").alias("rank"), F.col("page").cast("long").alias("page"), "sentence")


@query(f"WITH {_EV}, r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY no) AS rank, sentence FROM es WHERE {A.has('sentence', L.RISKY, 'i')}) SELECT id, CAST(rank AS BIGINT) AS rank, CAST(1 AS BIGINT) AS page, sentence FROM r WHERE rank <= 5")
def risky_clauses(spark, d):
    return evidence.risky(_evidence(spark, d), "id").select("id", F.col("rank").cast("long").alias("rank"), F.col("page").cast("long").alias("page"), "sentence")


@query()
def risk_panel(spark, d):
    sents = _evidence(spark, d)
    n = lambda x, c: x.groupBy("id").agg(F.count("*").alias(c))
    a = typed(with_sentences(_docs(spark, d))).select("id", "doc_type", X.outcome(F.col("text"), F.col("sentences"), F.col("doc_type")).alias("outcome"))
    x = a.join(n(evidence.deadlines(sents, "id"), "n_deadlines"), "id", "left").join(n(evidence.risky(sents, "id"), "n_risky"), "id", "left").fillna(0, ["n_deadlines", "n_risky"])
    return x.select("id", "n_deadlines", "n_risky", C.urgency(F.col("n_deadlines"), F.col("n_risky"), F.when(F.col("outcome") == L.OUTCOME_UNKNOWN, "").otherwise(F.col("outcome")), F.col("doc_type")).alias("urgency"))


@query()
def evidence_best_sentence(spark, d):
    s = table(spark, d, "summaries").filter("outcome is not null and outcome <> ''").select(F.col("document_id").alias("id"), F.col("id").alias("item"), F.col("outcome").alias("needle"))
    return evidence.best_match(s, _evidence(spark, d), "id", ("ordered", "dismissed", "granted", "upheld", "set aside", "refused", "therefore", "accordingly"), keep_unmatched=True).select("id", "item", "quote", "page", "score")


# --- search and overlap ----------------------------------------------------------------------------------------------------


def _records(spark, d):
    return table(spark, d, "summaries").select("id", "document_type", "professional_summary", "citizen_summary")


_HAY = "lower(concat_ws(' ', document_type, professional_summary, citizen_summary))"
_AFF = " + ".join(f"CASE WHEN contains({_HAY}, {A.q(w)}) THEN 1 ELSE 0 END" for w in QUERY.lower().split() if len(w) >= 3)


@query(f"SELECT id, round(({_AFF})::DOUBLE / {len(QUERY.split())}, 6) AS affinity FROM summaries")
def search_affinity(spark, d):
    hay = F.lower(F.concat_ws(" ", "document_type", "professional_summary", "citizen_summary"))
    return _records(spark, d).select("id", F.round(search.affinity(QUERY, hay), 6).alias("affinity"))


def _profiled(spark, d):
    """The records with what their document's profile and search fields are made of; a record without a document has its own
    fields alone."""
    x, docs = _analysed(spark, d)
    named = F.filter("keywords", lambda k: k.rlike("(?i)section|chapter|act"))
    panel = F.slice(F.array_distinct(F.concat("legal_references", X.references(F.coalesce("principles", F.lit(""))), named)), 1, 8)
    x = x.select("id", "keywords", "categories", "issues", panel.alias("references"), F.array_distinct(F.concat("parties", "persons", "organisations")).alias("entities"))
    docs = docs.select("id", "filename", "text", X.instruments(F.col("text")).alias("instruments"))
    records = table(spark, d, "summaries").select("id", "document_id", "document_type", "professional_summary", "citizen_summary")
    return records.join(x.join(docs, "id").withColumnRenamed("id", "document_id"), "document_id", "left")


@query()
def semantic_search(spark, d):
    """Over whole profiles and all seven search fields; ``search_affinity`` reads three of the fields, as its SQL."""
    hay = ["filename", "document_type", "professional_summary", "citizen_summary", "entities", "issues"]
    x = search.scored(_profiled(spark, d), QUERY, "text", hay, ("keywords", "categories", "issues", "instruments", "references")).select("id", "affinity", "search_score")
    # a sort reads its rows twice, for the ranges and for the order
    return cut(x).orderBy(F.desc("search_score"), "id")


@query("SELECT id, substr(citizen_summary, CAST(greatest(1, strpos(lower(citizen_summary), 'court') - 110) AS BIGINT), 260) AS snippet FROM summaries WHERE strpos(lower(citizen_summary), 'court') > 0")
def search_snippet(spark, d):
    return table(spark, d, "summaries").select("id", search.snippet(F.col("citizen_summary"), "court").alias("snippet")).filter("snippet is not null")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT query_id, e.vec_id AS neighbour_id, round(list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS similarity FROM q, embeddings e WHERE e.vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) AS rank FROM p) SELECT query_id, CAST(rank AS BIGINT) AS rank, neighbour_id, similarity FROM r WHERE rank <= 5""")
def dense_topk(spark, d):
    return search.dense_top(table(spark, d, "embeddings")).select("query_id", F.col("rank").cast("long").alias("rank"), "neighbour_id", "similarity")


def _rouge_pairs(spark, d):
    s = table(spark, d, "summaries").select("id", "document_id", "created_at", "professional_summary", "executive_summary", "citizen_summary")
    return spread(rouge.pairs(s, _legal(spark, d, "id", "extracted_text")))


_PAIRS = "p AS (SELECT s.id, l.extracted_text AS a, trim(coalesce(nullif(professional_summary, ''), nullif(executive_summary, ''), citizen_summary, '')) AS b FROM summaries s JOIN legal_documents l ON s.document_id = l.id), o AS (SELECT * FROM p WHERE length(a) >= 40 AND length(b) >= 20)"
_RT = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"


def _rouge_sql(n: int) -> str:
    def gram(c: str) -> str:
        return f"list_transform(range(1, len({_RT(c)}) - {n - 2}), lambda i: array_to_string(list_slice(t{c}, i, i + {n - 1}), ' '))"

    return f"""WITH {_PAIRS}, w AS (SELECT id, {_RT('a')} AS ta, {_RT('b')} AS tb FROM o), u AS (SELECT id, UNNEST(range(1, len(tb) - {n - 2})) AS i, tb FROM w), v AS (SELECT id, UNNEST(range(1, len(ta) - {n - 2})) AS i, ta FROM w),
c AS (SELECT id, array_to_string(list_slice(tb, i, i + {n - 1}), ' ') AS g, count(*) AS c FROM u GROUP BY ALL), r AS (SELECT id, array_to_string(list_slice(ta, i, i + {n - 1}), ' ') AS g, count(*) AS r FROM v GROUP BY ALL),
x AS (SELECT c.id, sum(least(c, coalesce(r, 0)))::DOUBLE / sum(c)::DOUBLE * 100 AS p FROM c LEFT JOIN r ON c.id = r.id AND c.g = r.g GROUP BY c.id) SELECT o.id, round(coalesce(p, 0.0), 4) AS rouge_{n} FROM o LEFT JOIN x ON o.id = x.id"""


@query(_rouge_sql(1))
def rouge_1(spark, d):
    return rouge.precision(_rouge_pairs(spark, d), "id", "source", "generated", 1).withColumn("rouge_1", F.round("rouge_1", 4))


@query(_rouge_sql(2))
def rouge_2(spark, d):
    return rouge.precision(_rouge_pairs(spark, d), "id", "source", "generated", 2).withColumn("rouge_2", F.round("rouge_2", 4))


@query()
def token_similarity(spark, d):
    s = table(spark, d, "summaries")
    return s.select("id", F.round(rouge.similarity(F.col("professional_summary"), F.col("citizen_summary")), 6).alias("similarity"))


@query()
def rouge_l(spark, d):
    return rouge.subsequence(_rouge_pairs(spark, d), "id", "source", "generated")


# --- reports ---------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(sum(CASE WHEN status = 'done' THEN 1 ELSE 0 END) AS BIGINT) AS done, CAST(sum(CASE WHEN status = 'processing' THEN 1 ELSE 0 END) AS BIGINT) AS processing, CAST(sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM legal_documents")
def status_pivot(spark, d):
    return relational.status_totals(_legal(spark, d, "status"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (CAST(created_at AS DATE) = CAST(TIMESTAMP '{AS_OF}' AS DATE)) AS BIGINT) AS documents_today, CAST(count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS BIGINT) AS documents_recent, CAST(coalesce(sum(page_count), 0) AS BIGINT) AS pages, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words FROM legal_documents")
def document_totals(spark, d):
    return relational.totals(_legal(spark, d, "created_at", "page_count", "word_count"), AS_OF)


@query("SELECT CAST(count(*) AS BIGINT) AS summaries, CAST(round(avg(processing_ms)) AS BIGINT) AS avg_processing_ms FROM summaries")
def processing_time(spark, d):
    return relational.processing(table(spark, d, "summaries").select("processing_ms"))


def _top(name: str, tbl: str, col: str):
    def f(spark, d):
        return relational.top_counts(table(spark, d, tbl).select(col), col)

    f.__name__ = name
    query(f"SELECT {col} AS label, CAST(count(*) AS BIGINT) AS total FROM {tbl} WHERE {col} IS NOT NULL AND {col} <> '' GROUP BY {col} ORDER BY total DESC, label LIMIT 5")(f)


for _n, _t, _c in (("top_roles", "users", "role"), ("top_document_types", "summaries", "document_type"), ("top_courts", "summaries", "court"), ("top_modes", "summaries", "summary_type")):
    _top(_n, _t, _c)


@query("WITH t AS (SELECT ai_provider, CAST(count(*) AS BIGINT) AS total FROM summaries GROUP BY ai_provider ORDER BY total DESC, coalesce(ai_provider, '') LIMIT 5) SELECT coalesce(ai_provider, '') AS provider, CASE lower(ai_provider) WHEN 'gemini' THEN 'remote' WHEN 'nlp_local' THEN 'local' WHEN 'nlp' THEN 'local' WHEN 'openai' THEN 'assisted' ELSE 'other' END AS label, total FROM t")
def provider_mix(spark, d):
    return relational.provider_mix(table(spark, d, "summaries").select("ai_provider"))


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(n, 0) AS documents_done, coalesce(m, 0) AS downloads FROM (SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM legal_documents WHERE status = 'done' GROUP BY user_id) a FULL JOIN (SELECT user_id, CAST(count(*) AS BIGINT) AS m FROM (SELECT DISTINCT * FROM downloads) GROUP BY user_id) b ON a.user_id = b.user_id")
def owner_counts(spark, d):
    return relational.owner_counts(_legal(spark, d, "user_id", "status"), table(spark, d, "downloads"))


@query("SELECT user_id, id, CAST(n AS BIGINT) AS position FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, id DESC) AS n FROM summaries) WHERE n <= 5")
def latest_per_owner(spark, d):
    return relational.latest(table(spark, d, "summaries").select("user_id", "id", "created_at")).select("user_id", "id", F.col("position").cast("long").alias("position"))


@query("SELECT s.id, s.document_id, l.original_name, l.status AS document_status, u.role FROM summaries s LEFT JOIN legal_documents l ON s.document_id = l.id LEFT JOIN users u ON s.user_id = u.id")
def eager_join(spark, d):
    x = relational.eager(table(spark, d, "summaries").select("id", "document_id", "user_id"), _legal(spark, d, "id", "original_name", "status"), table(spark, d, "users"))
    return x.select("id", "document_id", "original_name", "document_status", "role")


@query("SELECT w.id, w.user_id, w.downloaded_at, s.document_type, l.original_name FROM (SELECT DISTINCT * FROM downloads) w LEFT JOIN summaries s ON w.summary_id = s.id LEFT JOIN legal_documents l ON s.document_id = l.id")
def download_list(spark, d):
    x = relational.download_list(table(spark, d, "downloads"), table(spark, d, "summaries").select("id", "document_id", "document_type"), _legal(spark, d, "id", "original_name"))
    return x.select("id", "user_id", "downloaded_at", "document_type", "original_name")


@query("SELECT id FROM summaries WHERE contains(lower(document_type), 'contract') OR contains(lower(court), 'high')")
def contains_filter(spark, d):
    s = table(spark, d, "summaries").select("id", "document_type", "court")
    return relational.contains(s, document_type="contract").unionByName(relational.contains(s, court="high")).select("id").distinct()


@query("SELECT id FROM summaries s WHERE (executive_summary IS NOT NULL OR professional_summary IS NOT NULL OR citizen_summary IS NOT NULL) AND EXISTS (SELECT 1 FROM legal_documents l WHERE l.id = s.document_id AND extracted_text IS NOT NULL AND extracted_text <> '')")
def semi_join_dataset(spark, d):
    return relational.usable(table(spark, d, "summaries"), _legal(spark, d, "id", "extracted_text")).select("id")


_EX = lambda c: f"CASE WHEN length({A.squeeze(c)}) <= 280 THEN {A.squeeze(c)} ELSE regexp_replace(substr({A.squeeze(c)}, 1, 279), '[ \\t\\n\\r,.;:-]+$', '') || '...' END"


@query(f"""WITH u AS (SELECT s.*, l.original_name, l.summary_type AS dm, {A.trim("coalesce(l.extracted_text, '')")} AS input_text FROM summaries s JOIN legal_documents l ON s.document_id = l.id WHERE (executive_summary IS NOT NULL OR professional_summary IS NOT NULL OR citizen_summary IS NOT NULL) AND l.extracted_text IS NOT NULL AND l.extracted_text <> ''),
v AS (SELECT *, {A.trim("coalesce(CASE WHEN coalesce(nullif(summary_type, ''), 'general_user') = 'general_user' THEN coalesce(nullif(citizen_summary, ''), executive_summary) ELSE coalesce(nullif(professional_summary, ''), executive_summary) END, '')")} AS output_text FROM u)
SELECT sha256(concat_ws('|', CAST(document_id AS VARCHAR), CAST(id AS VARCHAR), input_text, output_text)) AS dataset_id, document_id, id AS summary_id, coalesce(nullif(summary_type, ''), nullif(dm, ''), 'general_user') AS summary_type, coalesce(nullif(document_type, ''), 'Legal Document') AS document_type, coalesce(nullif(nlp_language, ''), 'en') AS language, coalesce(nullif(ai_provider, ''), 'nlp_local') AS ai_provider, {_EX('input_text')} AS input_preview, {_EX('output_text')} AS output_preview, strftime(created_at, '%d %b %Y %H:%M') AS created_at FROM v WHERE input_text <> '' AND output_text <> ''""")
def dataset_rows(spark, d):
    x = relational.dataset_rows(table(spark, d, "summaries"), _legal(spark, d, "id", "original_name", "summary_type", "extracted_text"))
    return x.select("dataset_id", "document_id", "summary_id", "summary_type", "document_type", "language", "ai_provider", "input_preview", "output_preview", "created_at")


@query("SELECT document_id, user_id, id FROM (SELECT document_id, user_id, id, row_number() OVER (PARTITION BY document_id, user_id ORDER BY created_at DESC NULLS LAST, id DESC) AS n FROM summaries) WHERE n = 1")
def upsert_latest(spark, d):
    return relational.upsert(table(spark, d, "summaries").select("document_id", "user_id", "id", "created_at"), ["document_id", "user_id"], ["created_at", "id"]).select("document_id", "user_id", "id")


@query(f"SELECT id, CASE WHEN length({A.trim('coalesce(extracted_text, ' + chr(39) * 2 + ')')}) < 20 THEN 'failed' ELSE 'done' END AS derived_status FROM legal_documents")
def lifecycle(spark, d):
    return relational.lifecycle(_legal(spark, d, "id", "extracted_text"))


@query("SELECT id, summary_id FROM (SELECT DISTINCT * FROM downloads) w WHERE NOT EXISTS (SELECT 1 FROM summaries s WHERE s.id = w.summary_id AND s.document_id IN (SELECT id FROM legal_documents WHERE status = 'failed'))")
def anti_delete(spark, d):
    gone = table(spark, d, "summaries").select("id", "document_id").join(_legal(spark, d, "id", "status").filter("status = 'failed'").select(F.col("id").alias("document_id")), "document_id", "left_semi").select(F.col("id").alias("summary_id"))
    return relational.without(table(spark, d, "downloads").distinct().select("id", "summary_id"), gone, "summary_id")


@query("SELECT role, CASE WHEN role IN ('Legal Professional', 'Law Student', 'Researcher') THEN 'legal_professional' ELSE 'general_user' END AS mode, CAST(count(*) AS BIGINT) AS users FROM users GROUP BY role")
def role_modes(spark, d):
    return table(spark, d, "users").groupBy("role").agg(F.count("*").alias("users")).select("role", relational.mode_of(F.col("role")).alias("mode"), "users")


@query("WITH x AS (SELECT user_id, event_id, epoch(ts) AS t, CAST(floor(epoch(ts)) AS BIGINT) AS s, event_type FROM events), y AS (SELECT user_id, event_id, CAST(count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS BIGINT) AS failures FROM x) SELECT event_id, user_id, failures, failures >= 5 AS locked FROM y")
def throttle_window(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return relational.throttle(e, "user_id", "ts", F.col("event_type") == "error").select("event_id", "user_id", "failures", "locked")


@query("WITH e AS (SELECT (event_id % 500) + 1 AS document_id, event_type AS status, CAST(round(coalesce(value, 0)) AS INTEGER) AS progress, ts AS updated_at, event_id FROM events), l AS (SELECT document_id, status, progress, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC, progress DESC, status DESC) AS n FROM e) SELECT d.id AS document_id, coalesce(l.status, 'pending') AS status, CAST(CASE WHEN l.progress IS NULL THEN 0 ELSE greatest(0, least(100, l.progress)) END AS BIGINT) AS progress FROM legal_documents d LEFT JOIN l ON l.document_id = d.id AND n = 1")
def progress_latest(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 500 + 1).alias("document_id"), F.col("event_type").alias("status"), F.round(F.coalesce("value", F.lit(0.0))).cast("int").alias("progress"), F.col("ts").alias("updated_at"))
    return relational.progress(_legal(spark, d, "id"), e).withColumn("progress", F.col("progress").cast("long"))


@query("SELECT date_trunc('day', ts) AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_daily_window(spark, d):
    e = table(spark, d, "events").select("ts", "event_type", "value")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH j AS (SELECT id, CASE WHEN json_valid(parties) AND json_type(parties) = 'ARRAY' THEN CAST(parties AS VARCHAR[]) ELSE [parties] END AS p FROM summaries WHERE parties IS NOT NULL AND trim(parties) <> ''), u AS (SELECT id, generate_subscripts(p, 1) AS o, trim(regexp_replace(UNNEST(p), '\\s+', ' ', 'g')) AS v FROM j), m AS (SELECT id, lower(v) AS k, min(o) AS o, arg_min(v, o) AS v FROM u WHERE v <> '' GROUP BY id, lower(v)), r AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM m) SELECT id, CAST(n AS BIGINT) AS entity_no, v AS entity FROM r WHERE n <= 8""")
def entity_union_distinct(spark, d):
    s = table(spark, d, "summaries").select("id", "parties").filter("parties is not null and trim(parties) <> ''")
    none = F.array().cast("array<string>")
    x = s.select("id", relational.entities_involved(none, none, relational.json_or_text(F.col("parties"))).alias("e"))
    return x.select("id", F.posexplode("e").alias("i", "entity")).select("id", (F.col("i") + 1).cast("long").alias("entity_no"), "entity")


# --- learning, payloads, report shaping --------------------------------------------------------------------------------------


def _examples(spark, d):
    return learned.distinct_examples(table(spark, d, "legal_summary_dataset").select("document_id", "summary_id", "input_text", "target_summary"))


_TRIMMED = [A.trim(f"coalesce({c}, {A.q(str())})") for c in ("input_text", "target_summary")]


@query(f"SELECT CAST(count(*) AS BIGINT) AS examples FROM (SELECT DISTINCT coalesce(CAST(document_id AS VARCHAR), '') AS a, coalesce(CAST(summary_id AS VARCHAR), '') AS b, {_TRIMMED[0]} AS c, {_TRIMMED[1]} AS e FROM legal_summary_dataset) WHERE c <> '' AND e <> ''")
def example_dedupe(spark, d):
    return _examples(spark, d).agg(F.count("*").alias("examples"))


@query()
def learned_terms(spark, d):
    return learned.model(_examples(spark, d))


@query()
def learned_boosts(spark, d):
    return learned.boosts(table(spark, d, "summaries").select("id", "citizen_summary"), "id", "citizen_summary", learned.model(_examples(spark, d)))


@query()
def ai_payload_normalise(spark, d):
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct("document_type", "case_number", "court", "judge", "outcome", relational.json_list(F.col("parties")).alias("parties"))), F.lit("\n```"))
    p = table(spark, d, "summaries").select("id", payload.parsed(raw).alias("p")).select("id", payload.normalised(F.col("p")).alias("p"))
    return p.select("id", "p.document_type", "p.case_number", "p.court", "p.judge", "p.outcome", F.array_join("p.parties", "|").alias("parties"))


_PLAIN_SQL = "professional_summary"
for _w, _s in L.PLAIN.items():
    _PLAIN_SQL = A.gsub(_PLAIN_SQL, rf"\b{_w}\b", _s, "i")


@query(f"SELECT id, {A.squeeze(_PLAIN_SQL)} AS plain FROM summaries WHERE professional_summary IS NOT NULL")
def plain_words(spark, d):
    return table(spark, d, "summaries").filter("professional_summary is not null").select("id", report.plain_words(F.col("professional_summary")).alias("plain"))


@query()
def plain_language(spark, d):
    return table(spark, d, "summaries").filter("professional_summary is not null").select("id", report.plain_language(F.col("professional_summary")).alias("plain"))


_BLOCKS = " UNION ALL ".join(f"SELECT id, {i} AS o, {A.q(c)} AS label, {A.squeeze(f'coalesce({c}, {A.q(str())})')} AS text FROM summaries" for i, c in enumerate(("court", "judge", "case_number", "outcome", "citizen_summary")))


@query(f"WITH b AS ({_BLOCKS}), r AS (SELECT id, label, text, row_number() OVER (PARTITION BY id ORDER BY o) AS n FROM b WHERE text <> '') SELECT id, CAST(n AS BIGINT) AS block_no, label, text FROM r")
def report_blocks(spark, d):
    cols = ("court", "judge", "case_number", "outcome", "citizen_summary")
    x = table(spark, d, "summaries").select("id", F.posexplode(report.blocks({c: F.col(c) for c in cols})).alias("i", "b"))
    return x.select("id", (F.col("i") + 1).cast("long").alias("block_no"), "b.label", "b.text")


@query()
def report_lines(spark, d):
    return table(spark, d, "summaries").filter("citizen_summary is not null").select("id", F.posexplode(report.wrapped(F.col("citizen_summary"))).alias("line_no", "line"))
