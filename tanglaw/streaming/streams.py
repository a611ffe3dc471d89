"""The row-local operators on streams, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import features as FE
from ..functions import text as T
from ..operators import corpus


def read(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the parquet files that appear under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def prepared(df: DataFrame) -> DataFrame:
    """Stored text as the corpus has it: normalized, with flag and surface features. Works on streams and tables alike, having no state."""
    rows = corpus.mark(df.withColumn("text", T.normalize(F.col("text"))).withColumn("flag", F.lit("")))
    docs = FE.tokenized(rows)
    return docs.select("doc_id", "language", "text", "flag", *[c.alias(n) for n, c in FE.trad(F.col("words"), F.col("n_sents"), F.col("language")).items()])


def deduplicated(df: DataFrame, time: str = "ingested_at", late: str = "7 days") -> DataFrame:
    """The first copy of each (language, text) within the watermark; state holds hashes, not texts."""
    keyed = df.withColumns({"_h1": F.xxhash64("language", T.strip(F.col("text"))), "_h2": F.xxhash64(F.lit("second"), T.strip(F.col("text")), "language")})
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["_h1", "_h2"]).drop("_h1", "_h2")


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(event_type, hour, n, total) of events by the hour; on a stream, rows later than ``late`` are dropped."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a longer gap."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
