"""The queries of this package and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load
from . import p1_notices, p2_language, p3_encoding, p4_scans, p5_level, p6_quality, p7_overlap, p8_tokens, p9_leaks, p10_sentences


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_notices.repeated_lines(load(spark, d, "all_languages"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return p1_notices.without_notices(load(spark, d, "all_languages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_language.wrong_labels(load(spark, d, "all_languages"), load(spark, d, "language_names")).select("doc_id", "line_no", "language")


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    return p2_language.judged(load(spark, d, "all_languages"), load(spark, d, "language_names"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_encoding.damaged(load(spark, d, "all_languages")).select("doc_id")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return p3_encoding.damaged(load(spark, d, "all_languages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_scans.faults(load(spark, d, "all_languages"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return p4_scans.repaired(load(spark, d, "all_languages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_level.corrected(load(spark, d, "all_languages"), load(spark, d, "language_names"))


def p5_levels(spark: SparkSession, d: str) -> DataFrame:
    return p5_level.estimated(load(spark, d, "all_languages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_quality.judged(load(spark, d, "all_languages"), load(spark, d, "language_names")).where("kind <> 'prose'").select("doc_id", "kind")


def p6_statistics(spark: SparkSession, d: str) -> DataFrame:
    return p6_quality.judged(load(spark, d, "all_languages"), load(spark, d, "language_names"))


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return load(spark, d, "all_languages"), load(spark, d, "high_resource_index"), load(spark, d, "low_resource_heldout")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_overlap.overlaps(*_p7(spark, d)).select("doc_id_a", "doc_id_b")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return p7_overlap.report(*_p7(spark, d))


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    return p7_overlap.coverage(*_p7(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return p8_tokens.token_ids(load(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_matches(spark, d).select("doc_id", "item_id")


def p9_matches(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks.leaks(load(spark, d, "documents"), load(spark, d, "benchmark"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks.without_leaks(load(spark, d, "documents"), load(spark, d, "benchmark")).select("doc_id", "lang", "source", "n_chars")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_sentences.sentence_spans(load(spark, d, "documents"))


QUERIES = (p1_found, p1_clean, p2_found, p2_labels, p3_found, p3_restored, p4_found, p4_repaired, p5_found, p5_levels, p6_found, p6_statistics, p7_found, p7_report, p7_coverage, p8_ids, p9_found, p9_matches, p9_clean, p10_found)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


P1_KEYED = """
WITH raw AS (SELECT doc_id, lower(trim(language)) AS source, string_split(text, chr(10)) AS lines FROM all_languages
             WHERE text IS NOT NULL AND language IS NOT NULL),
     split AS (SELECT doc_id, source, unnest(range(1, len(lines) + 1))::INT AS line_no, unnest(lines) AS line FROM raw),
     keyed AS (SELECT doc_id, source, line_no, regexp_replace(lower(line), '[^\\p{L}]+', '', 'g') AS letters FROM split),
     good AS (SELECT source, letters FROM keyed WHERE length(letters) >= 25 GROUP BY source, letters HAVING count(DISTINCT doc_id) >= 5)
"""


P9_WORDS = """list_filter(regexp_extract_all(strip_accents(regexp_replace(regexp_replace(lower(text), '[\\x{AD}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]', '', 'g'),
 '[-‐‑](?:\\r\\n|[\\n\\r])[ \\t]*', '', 'g')), '[\\p{L}\\p{N}\\p{M}]+'), lambda w: w <> '')"""
P9_GRAMS = """{0}w AS (SELECT {1} AS id, {2} AS w FROM {3} WHERE text IS NOT NULL),
{0}g AS (SELECT id, unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM {0}w)"""
P9_FOUND = (
    "WITH " + P9_GRAMS.format("d", "doc_id", P9_WORDS, "documents") + ", " + P9_GRAMS.format("b", "item_id", P9_WORDS, "benchmark")
    + " SELECT DISTINCT dg.id AS doc_id, bg.id AS item_id FROM dg JOIN bg ON dg.gram = bg.gram"
)


def oracle_sql() -> dict[str, str]:
    clean = """, cut AS (SELECT doc_id, list(line_no) AS lines FROM keyed JOIN good USING (source, letters) GROUP BY doc_id)
SELECT a.doc_id, a.language, CASE WHEN c.lines IS NULL THEN a.text ELSE array_to_string(list_filter(string_split(a.text, chr(10)), lambda x, i: NOT list_contains(c.lines, i::INT)), chr(10)) END AS text,
 coalesce(len(c.lines), 0)::INT AS removed FROM all_languages a LEFT JOIN cut c ON c.doc_id = a.doc_id"""
    return {
        "p1_found": P1_KEYED + "SELECT doc_id, line_no FROM keyed JOIN good USING (source, letters)", "p1_clean": P1_KEYED + clean, "p9_found": P9_FOUND,
        "p9_clean": f"SELECT d.doc_id, d.lang, d.source, d.n_chars FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM ({P9_FOUND}))",
    }
