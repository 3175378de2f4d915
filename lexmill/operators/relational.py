"""Reports over users, documents, summaries and downloads.

Inputs are the tables as read; only the columns a report names reach the scan. Ties are broken by the label or the id, so
results don't depend on partitions. Null keys are kept apart or left out as each report says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.rx import distinct_ci, missing, squeeze, trim
from lexmill.functions.text import excerpt

STATUSES = ("done", "processing", "pending", "failed")
# Provider labels.
PROVIDERS = {"gemini": "remote", "nlp_local": "local", "nlp": "local", "openai": "assisted"}


def owned(df: DataFrame, user_id: int) -> DataFrame:
    """The rows of one owner; the predicate reaches the scan."""
    return df.filter(F.col("user_id") == user_id)


def owner_counts(documents: DataFrame, downloads: DataFrame) -> DataFrame:
    """(user_id, documents_done, downloads) of every owner of either; each side is counted before the join."""
    a = documents.filter("status = 'done'").groupBy("user_id").agg(F.count("*").alias("documents_done"))
    b = downloads.distinct().groupBy("user_id").agg(F.count("*").alias("downloads"))
    return a.join(b, "user_id", "full").fillna(0)


def latest(df: DataFrame, key: str = "user_id", n: int = 5, when: str = "created_at", by: str = "id") -> DataFrame:
    """The ``n`` latest rows of each owner. A window-group limit drops the rest before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(when), F.desc(by))
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def status_totals(documents: DataFrame) -> DataFrame:
    """One row of four totals, zero where a status doesn't occur."""
    return documents.agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def top_counts(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The most frequent values of a column, null and empty ones left out: one group, which is dropped after the cut to one
    more, so a computed column isn't computed again for a filter."""
    top = df.groupBy(F.nullif(F.col(column), F.lit("")).alias("label")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "label").limit(n + 1)
    return top.filter("label is not null").orderBy(F.desc("total"), "label").limit(n)


def provider_mix(summaries: DataFrame, n: int = 5) -> DataFrame:
    """Top providers by raw key (null counts as one), labelled after the cut, so two rows may share a label."""
    top = summaries.groupBy("ai_provider").agg(F.count("*").alias("total")).orderBy(F.desc("total"), F.coalesce("ai_provider", F.lit(""))).limit(n)
    label = None
    for key, name in PROVIDERS.items():
        hit = F.lower("ai_provider") == key
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return top.select(F.coalesce("ai_provider", F.lit("")).alias("provider"), label.otherwise("other").alias("label"), "total")


def totals(documents: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """All document totals in one scan."""
    day, since = F.to_date(F.lit(as_of)), F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"interval {days} days")
    at = F.col("created_at").cast("timestamp_ntz")
    return documents.agg(
        F.count("*").alias("documents"),
        F.count_if(at.cast("date") == day).alias("documents_today"),
        F.count_if(at >= since).alias("documents_recent"),
        F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("pages"),
        F.coalesce(F.sum("word_count"), F.lit(0)).cast("long").alias("words"),
    )


def processing(summaries: DataFrame) -> DataFrame:
    """Count and mean processing time, nulls ignored, rounded half up."""
    return summaries.agg(F.count("*").alias("summaries"), F.round(F.avg("processing_ms"), 0).cast("long").alias("avg_processing_ms"))


def contains(df: DataFrame, **wanted: str) -> DataFrame:
    """Rows whose columns contain the wanted texts, without case; wildcards are ordinary characters."""
    for column, text in wanted.items():
        df = df.filter(F.lower(F.col(column)).contains(text.lower()))
    return df


def with_issue(df: DataFrame, column: str, issue: str) -> DataFrame:
    """Rows whose array has the issue as an element, or within its joined elements, without case."""
    low = issue.lower()
    return df.filter(F.exists(F.col(column), lambda x: F.lower(x) == low) | F.lower(F.array_join(F.col(column), " ")).contains(low))


def eager(summaries: DataFrame, documents: DataFrame, users: DataFrame) -> DataFrame:
    """Summaries with their document's and owner's fields, null where there is none; AQE broadcasts a side that is small."""
    d = documents.select(F.col("id").alias("document_id"), "original_name", F.col("status").alias("document_status"))
    u = users.select(F.col("id").alias("user_id"), "role", F.initcap(F.trim("organisation")).alias("organisation"))
    return summaries.join(d, "document_id", "left").join(u, "user_id", "left")


def download_list(downloads: DataFrame, summaries: DataFrame, documents: DataFrame) -> DataFrame:
    s = summaries.select(F.col("id").alias("summary_id"), "document_id", "document_type")
    d = documents.select(F.col("id").alias("document_id"), "original_name")
    return downloads.distinct().join(s, "summary_id", "left").join(d, "document_id", "left")


def usable(summaries: DataFrame, documents: DataFrame) -> DataFrame:
    """Summaries with any of three texts whose document has text: a semi join."""
    some = F.col("executive_summary").isNotNull() | F.col("professional_summary").isNotNull() | F.col("citizen_summary").isNotNull()
    d = documents.filter("extracted_text is not null and extracted_text <> ''").select(F.col("id").alias("document_id"))
    return summaries.filter(some).join(d, "document_id", "left_semi")


def target_summary(mode: Column, citizen: Column, professional: Column, executive: Column) -> Column:
    other = F.coalesce(missing(professional), executive)
    return trim(F.coalesce(F.when(F.coalesce(missing(mode), F.lit("general_user")) == "general_user", F.coalesce(missing(citizen), executive)).otherwise(other), F.lit("")))


def dataset_rows(summaries: DataFrame, documents: DataFrame) -> DataFrame:
    """One training row per usable summary, its id a hash over document, summary, input and output."""
    d = documents.select(F.col("id").alias("document_id"), "original_name", F.col("summary_type").alias("document_mode"), trim(F.coalesce("extracted_text", F.lit(""))).alias("input_text"))
    x = usable(summaries, documents).join(d, "document_id")
    out = target_summary(F.col("summary_type"), F.col("citizen_summary"), F.col("professional_summary"), F.col("executive_summary"))
    x = x.withColumn("output_text", out).filter("input_text <> '' and output_text <> ''")
    return x.select(
        F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), F.col("id").cast("string"), "input_text", "output_text"), 256).alias("dataset_id"),
        "document_id",
        F.col("id").alias("summary_id"),
        F.coalesce(missing(F.col("summary_type")), missing(F.col("document_mode")), F.lit("general_user")).alias("summary_type"),
        F.coalesce("original_name", F.concat(F.lit("Document #"), F.col("document_id").cast("string"))).alias("document_name"),
        F.coalesce(missing(F.col("document_type")), F.lit("Legal Document")).alias("document_type"),
        "court",
        "judge",
        "case_number",
        F.coalesce(missing(F.col("nlp_language")), F.lit("en")).alias("language"),
        F.coalesce(missing(F.col("ai_provider")), F.lit("nlp_local")).alias("ai_provider"),
        "input_text",
        "output_text",
        excerpt(F.col("input_text"), 280).alias("input_preview"),
        excerpt(F.col("output_text"), 280).alias("output_preview"),
        F.date_format("created_at", "dd MMM yyyy HH:mm").alias("created_at"),
    )


def newest(df: DataFrame, limit: int) -> DataFrame:
    """The latest rows, the limit held between 1 and 500."""
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(limit, 500)))


def upsert(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def onto(df: DataFrame, target: list[str]) -> DataFrame:
    """``df`` projected onto the columns the target has."""
    return df.select([c for c in df.columns if c in set(target)])


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose key was deleted: an anti join."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def lifecycle(documents: DataFrame) -> DataFrame:
    """(id, derived_status): failed where the trimmed text has fewer than 20 characters."""
    text = F.coalesce(trim(F.col("extracted_text")), F.lit(""))
    return documents.select("id", F.when(F.length(text) < 20, "failed").otherwise("done").alias("derived_status"))


def mode_of(role: Column) -> Column:
    return F.when(role.isin("Legal Professional", "Law Student", "Researcher"), "legal_professional").otherwise("general_user")


def progress(documents: DataFrame, events: DataFrame) -> DataFrame:
    """(document_id, status, progress): the latest event of each document, progress held within 0 and 100; a document without
    an event is pending at 0."""
    last = events.groupBy("document_id").agg(F.max_by(F.struct("status", "progress"), F.struct("updated_at", "progress")).alias("s"))
    d = documents.select(F.col("id").alias("document_id"))
    # the bounds would stand in for a missing value
    held = F.when(F.col("s.progress").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.col("s.progress"))))
    return d.join(last, "document_id", "left").select("document_id", F.coalesce("s.status", F.lit("pending")).alias("status"), F.coalesce(held, F.lit(0)).alias("progress"))


def throttle(events: DataFrame, user: str, when: str, failed: Column, limit: int = 5, window_s: int = 7200) -> DataFrame:
    """Events with the failures of the same user within the window before, and whether they lock the user. A user's events
    are parted by stretches of twelve windows, so a user with a third of all events is many partitions; the failures of a
    stretch's last window also stand in the next one, where they are counted but not given."""
    span = 12 * window_s
    x = events.withColumn("_t", F.unix_seconds(F.col(when).cast("timestamp"))).withColumn("_failed", failed)
    x = x.withColumn("_part", F.floor(F.col("_t") / span)).withColumn("_own", F.lit(True))
    late = x.filter(F.col("_failed") & (F.floor((F.col("_t") + window_s) / span) > F.col("_part"))).withColumn("_part", F.col("_part") + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy(user, "_part").orderBy("_t").rangeBetween(-window_s, 0)
    x = x.unionByName(late).withColumn("failures", F.count_if("_failed").over(w)).filter("_own")
    return x.withColumn("locked", F.col("failures") >= limit).drop("_t", "_failed", "_part", "_own")


def entities_involved(people: Column, organisations: Column, parties: Column, n: int = 8) -> Column:
    """People, organisations and parties as one list without repeats by case."""
    return F.slice(distinct_ci(F.transform(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in (people, organisations, parties))), squeeze)), 1, n)


def json_list(x: Column) -> Column:
    """A JSON list of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def json_or_text(x: Column) -> Column:
    """A JSON list of strings; any other text is a list of itself."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array(x))


def glossary(terms: DataFrame, wanted: str) -> DataFrame:
    """Terms whose name or meaning contains the wanted text, by name."""
    low = wanted.lower()
    return terms.filter(F.lower("term").contains(low) | F.lower("meaning").contains(low)).orderBy("term")
