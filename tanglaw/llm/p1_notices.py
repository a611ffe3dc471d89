"""Problem 1: lines repeated across the documents of one source.

The source is the stored language. Three steps:

1. every partition summarises its lines in counters per (source, bucket of the line's hash), a count-min sketch with one row: summaries merge by adding counters, and a counter is
   never below the true count of any line in it, so a line of ``min_docs`` documents can't be missed. The row has ``LOAD`` times as many buckets as the table has distinct lines (estimated by
   a mergeable distinct sketch), so it filters alike at every size, and is kept as a table of the buckets in use, not as an array;
2. lines whose counter reaches ``min_docs`` are candidates; they get exact counts of distinct documents,
   by a 128-bit hash, so neither a hot line nor a hot source gathers in one task (Spark counts (line, document) pairs before lines);
3. the confirmed lines are a small set of hashes that is broadcast to mark or remove them, removal running inside the scan of the texts; beyond
   ``BROADCAST_LINES`` the same is done by joins that shuffle.

Defined results: a null language or null text has no lines; a blank language is a source like any other;
repeated rows of one doc_id count as one document; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize, small, spread

#: Buckets of the summary for each distinct line.
LOAD = 4
#: Confirmed lines or candidate buckets that may be broadcast (two longs each).
BROADCAST_LINES = 1_000_000
#: Letters that a line must have to be looked at.
LEAST_LETTERS = 25


def source_key(language: Column) -> Column:
    """A stored language as it is compared: trimmed, in lower case."""
    return F.lower(F.regexp_replace(language, r"(?U)^\s+|\s+$", ""))


def line_letters(line: Column) -> Column:
    """The letters of a line in lower case, everything else left out."""
    return F.regexp_replace(F.lower(line), r"\P{L}+", "")


def hashes(source: Column, letters: Column) -> list[Column]:
    return [F.xxhash64(source, letters).alias("h1"), F.xxhash64(letters, F.lit("second"), source).alias("h2")]


def letters_hash(letters: Column) -> Column:
    """What tells a line whatever its source."""
    return F.xxhash64(letters)


def line_table(df: DataFrame, min_letters: int = LEAST_LETTERS, parts: bool = False) -> DataFrame:
    """(doc_id, line_no, sid, h1, h2, any) of every line with enough letters, ``df`` having doc_id, language and text; sid stands for the source. With ``parts`` also the part of the text
    that the line is."""
    part = [F.length("text").alias("size")] if parts else []
    # The letters are made within the generator: a filter on a column made after it would be pushed down and make them twice.
    each = F.transform(F.split("text", "\n"), lambda x: F.struct(F.length(x).alias("n"), F.when(F.length(x) >= min_letters, line_letters(x)).alias("letters")))
    lines = (
        spread(df.select("doc_id", "language", "text"))
        .where(F.col("text").isNotNull() & F.col("language").isNotNull())
        .select("doc_id", source_key(F.col("language")).alias("source"), F.posexplode(each).alias("pos", "line"), *part)
        .where(F.length("line.letters") >= min_letters)
        .select("doc_id", "source", (F.col("pos") + 1).alias("line_no"), F.col("line.letters").alias("letters"), *([(F.col("line.n") / F.col("size")).cast("float").alias("part")] if parts else []))
    )
    return lines.select("doc_id", "line_no", F.hash("source").alias("sid"), *hashes(F.col("source"), F.col("letters")), letters_hash(F.col("letters")).alias("any"), *(["part"] if parts else []))


def candidates(lines: DataFrame, min_docs: int = 5) -> DataFrame:
    """The rows of ``lines`` whose counter in their source's summary reaches ``min_docs``."""
    distinct = lines.agg(F.approx_count_distinct("h1")).first()[0]
    width = 1 << max(16, (LOAD * distinct).bit_length())
    bucket = F.pmod(F.col("h1"), F.lit(width)).alias("bucket")
    summary = lines.groupBy("sid", bucket).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("sid", "bucket")
    return lines.withColumn("bucket", bucket).join(small(summary, BROADCAST_LINES), ["sid", "bucket"], "left_semi").drop("bucket")


def confirmed(lines: DataFrame, min_docs: int = 5) -> DataFrame:
    """(h1, h2, any) of the lines that stand in at least ``min_docs`` documents of their source, as a stored table."""
    exact = candidates(lines, min_docs).groupBy("h1", "h2", "any").agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") >= min_docs)
    return materialize(exact.select("h1", "h2", "any"), "p1-confirmed")


def repeated_lines(df: DataFrame, min_letters: int = LEAST_LETTERS, min_docs: int = 5) -> DataFrame:
    """(doc_id, line_no) of every line repeated in at least ``min_docs`` documents of its source."""
    lines = materialize(line_table(df, min_letters), "p1-lines")
    keys = confirmed(lines, min_docs)
    return lines.join(small(keys.select("h1", "h2"), BROADCAST_LINES), ["h1", "h2"], "left_semi").select("doc_id", "line_no")


def notice_hashes(df: DataFrame, min_letters: int = LEAST_LETTERS, min_docs: int = 5) -> DataFrame:
    """(any): hashes of the letters of the lines of ``df`` that are confirmed in some source. Operators that leave notices aside use them in texts of every language,
    as a text without a usable label carries the same notices."""
    return confirmed(materialize(line_table(df, min_letters), "p1-lines"), min_docs).select("any").distinct()


def _remover(known: dict[int, list[int]]):
    first = np.array(sorted(known), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(3)
            inner = prints.flatten()
            h1, h2 = (np.asarray(x.fill_null(0)) for x in inner.flatten())
            hit = np.isin(h1, first)
            texts, removed = batch.column(2).to_pylist(), [0] * batch.num_rows
            ends = np.cumsum(np.asarray(prints.value_lengths().fill_null(0)))
            cut: dict[int, set[int]] = {}
            for at in np.flatnonzero(hit).tolist():
                if int(h2[at]) in known[int(h1[at])]:
                    row = int(np.searchsorted(ends, at, "right"))
                    cut.setdefault(row, set()).add(at - (int(ends[row - 1]) if row else 0))
            for row, lines in cut.items():
                texts[row] = "\n".join(x for k, x in enumerate(texts[row].split("\n")) if k not in lines)
                removed[row] = len(lines)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["doc_id", "language", "text", "removed"])

    return run


def without_notices(df: DataFrame, min_letters: int = LEAST_LETTERS, min_docs: int = 5) -> DataFrame:
    """``df`` (doc_id, language, text) with each text freed of its repeated lines and the number removed.

    The confirmed lines are broadcast and removed within the scan; texts aren't shuffled. A null text stays null. A text that consists of such lines only becomes empty.
    """
    df = df.select("doc_id", "language", "text")
    lines = materialize(line_table(df, min_letters), "p1-lines")
    keys = confirmed(lines, min_docs).select("h1", "h2")
    if keys.limit(BROADCAST_LINES + 1).count() > BROADCAST_LINES:
        return _without_by_join(df, lines.join(keys, ["h1", "h2"], "left_semi").select("doc_id", "line_no"))
    known: dict[int, list[int]] = {}
    for a, b in keys.collect():
        known.setdefault(a, []).append(b)
    source = source_key(F.col("language"))
    letters = F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) >= min_letters, line_letters(x)).otherwise(""))
    prints = F.transform(letters, lambda x: F.struct(*[F.when(F.length(x) >= min_letters, h).alias(name) for h, name in zip(hashes(source, x), ("h1", "h2"))]))
    return spread(df).select("doc_id", "language", "text", prints.alias("prints")).mapInArrow(_remover(known), "doc_id bigint, language string, text string, removed int")


def _without_by_join(df: DataFrame, found: DataFrame) -> DataFrame:
    per_doc = found.distinct().groupBy("doc_id").agg(F.collect_set("line_no").alias("cut"))
    kept = F.expr("array_join(filter(split(text, '\n'), (x, i) -> cut is null or not array_contains(cut, i + 1)), '\n')")
    return df.join(per_doc, "doc_id", "left").select("doc_id", "language", F.when(F.col("text").isNotNull(), kept).alias("text"), F.coalesce(F.size("cut"), F.lit(0)).alias("removed"))
