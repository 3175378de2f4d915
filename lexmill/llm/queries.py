"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import os

from lexmill.session import table

from . import p01_scan_noise as p1
from . import p02_pairs as p2
from . import p03_personal as p3
from . import p04_chunks as p4
from . import p05_group_splits as p5
from . import p06_sentences as p6
from . import p07_reading as p7
from . import p08_leaks as p8
from . import p09_mixture as p9
from . import p10_subjects as p10


def p2_found(spark, sf_dir):
    return p2.defects(table(spark, sf_dir, "legal_summary_dataset").select("dataset_id", "input_text", "target_summary"))


def p2_explained(spark, sf_dir):
    return p2.explained(table(spark, sf_dir, "legal_summary_dataset").select("dataset_id", "input_text", "target_summary"))


def p4_found(spark, sf_dir):
    legal = table(spark, sf_dir, "legal_documents").select("id", "extracted_text")
    return p4.found(legal, table(spark, sf_dir, "legal_summary_dataset").select("dataset_id", "input_text"))


def p4_pieces(spark, sf_dir):
    from pyspark.sql import functions as F

    legal = p4.pieces(table(spark, sf_dir, "legal_documents").select("id", "extracted_text"), "id", "extracted_text", distinct=False)
    pairs = p4.pieces(table(spark, sf_dir, "legal_summary_dataset").select("dataset_id", "input_text"), "dataset_id", "input_text")
    return legal.withColumn("source_table", F.lit("legal_documents")).unionByName(pairs.withColumn("source_table", F.lit("legal_summary_dataset")))


def p5_found(spark, sf_dir):
    return p5.found(table(spark, sf_dir, "legal_summary_dataset").select("dataset_id", "document_id", "summary_id"))


def p5_splits(spark, sf_dir):
    return p5.splits(table(spark, sf_dir, "legal_summary_dataset").select("dataset_id", "document_id", "summary_id"))


def p5_forest(spark, sf_dir):
    return p5.forest(table(spark, sf_dir, "legal_summary_dataset").select("dataset_id", "document_id", "summary_id"))


def p6_found(spark, sf_dir):
    return p6.found(table(spark, sf_dir, "legal_documents").select("id", "mime_type", "extracted_text"))


def p6_sentences(spark, sf_dir):
    return p6.units(table(spark, sf_dir, "legal_documents").select("id", "extracted_text"), "id", "extracted_text")


def p8_found(spark, sf_dir):
    return p8.found(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def p8_matches(spark, sf_dir):
    return p8.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def p3_found(spark, sf_dir):
    return p3.found(table(spark, sf_dir, "legal_documents").select("id", "extracted_text"), table(spark, sf_dir, "summaries").select("id", "parties"))


def p3_redacted(spark, sf_dir):
    legal, summaries = table(spark, sf_dir, "legal_documents").select("id", "extracted_text"), table(spark, sf_dir, "summaries").select("id", "parties")
    # the key of a demonstration; production passes its own secret
    return p3.redacted(legal, summaries, key=b"lexmill demonstration key")


def p3_redacted_dates(spark, sf_dir):
    legal, summaries = table(spark, sf_dir, "legal_documents").select("id", "extracted_text"), table(spark, sf_dir, "summaries").select("id", "parties")
    return p3.redacted(legal, summaries, key=b"lexmill demonstration key", dates=True)


def p1_found(spark, sf_dir):
    return p1.found(table(spark, sf_dir, "legal_documents").select("id", "mime_type", "extracted_text"))


def p1_repaired(spark, sf_dir):
    return p1.repaired(table(spark, sf_dir, "legal_documents").select("id", "mime_type", "extracted_text"))


def _p7_inputs(spark, sf_dir):
    return table(spark, sf_dir, "legal_documents").select("id", "extracted_text"), table(spark, sf_dir, "summaries").select("id", "citizen_summary"), table(spark, sf_dir, "reading_labels")


def p7_found(spark, sf_dir):
    return p7.found(*_p7_inputs(spark, sf_dir))


def p7_levels(spark, sf_dir):
    return p7.levels(*_p7_inputs(spark, sf_dir))


# the driver's copy of a public vocabulary; LEXMILL_TOKENIZER names another
TOKENIZER = os.environ.get("LEXMILL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _p9_inputs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"), TOKENIZER


def p9_mixture(spark, sf_dir):
    return p9.mixture(*_p9_inputs(spark, sf_dir))


def p9_shares(spark, sf_dir):
    return p9.shares(*_p9_inputs(spark, sf_dir))


def p10_found(spark, sf_dir):
    return p10.found(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "subject_labels").select("doc_id", "subject"))


QUERIES = {
    "p1_found": p1_found,
    "p1_repaired": p1_repaired,
    "p2_found": p2_found,
    "p2_explained": p2_explained,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p3_redacted_dates": p3_redacted_dates,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_splits": p5_splits,
    "p5_forest": p5_forest,
    "p6_found": p6_found,
    "p6_sentences": p6_sentences,
    "p7_found": p7_found,
    "p7_levels": p7_levels,
    "p8_found": p8_found,
    "p8_matches": p8_matches,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}

SQL: dict[str, str] = {
    "p4_found": """
SELECT 'legal_documents' AS source_table, CAST(id AS VARCHAR) AS row_key FROM legal_documents WHERE length(extracted_text) > 6000
UNION SELECT 'legal_summary_dataset', dataset_id FROM legal_summary_dataset WHERE length(input_text) > 6000""",
    "p5_found": """
WITH RECURSIVE r AS (SELECT DISTINCT dataset_id, CASE WHEN document_id > 0 THEN document_id END d, CASE WHEN summary_id > 0 THEN summary_id END s
  FROM legal_summary_dataset WHERE dataset_id IS NOT NULL),
e AS (SELECT DISTINCT a.dataset_id x, b.dataset_id y FROM r a JOIN r b ON a.d = b.d UNION SELECT DISTINCT a.dataset_id, b.dataset_id FROM r a JOIN r b ON a.s = b.s),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
g AS (SELECT x AS dataset_id, min(y) AS group_id, count(DISTINCT y) AS n FROM reach GROUP BY x)
SELECT dataset_id, group_id FROM g WHERE n > 1""",
}
