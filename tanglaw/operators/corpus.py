"""Assembly of a corpus: flags, emission, duplicates, ids, roles, folds and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..sources.tables import materialize, small

#: Rows (hashes and a place) that may be broadcast.
REPEATED_KEYS = 500_000


def role(language: Column) -> Column:
    """high_resource, low_resource or unknown; case matters."""
    return F.when(language.isin(*L.HIGH_RESOURCE), "high_resource").when(language.isin(*L.LOW_RESOURCE), "low_resource").otherwise("unknown")


def emittable(text: Column, flag: Column) -> Column:
    return (T.strip(text) != "") & (T.word_count(text) >= L.MIN_WORDS) & ~flag.isin(*L.DROP_FLAGS)


def mark(df: DataFrame) -> DataFrame:
    """``df`` (language, text, flag) with english_heavy or too_short where the flag is empty."""
    text, flag = F.col("text"), F.coalesce(F.col("flag"), F.lit(""))
    open_ = (T.strip(text) != "") & (flag == "")
    return df.withColumn("flag", F.when(open_ & (T.english_ratio(text) >= L.ENGLISH_HEAVY), "english_heavy").when(open_ & (T.word_count(text) < L.MIN_WORDS), "too_short").otherwise(flag))


def flag_duplicates(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` (language, text, flag) with duplicate on every emittable row but the first, in ``order``, of a language and stripped text.

    Hashes and the emission test are stored with the rows once. Groups are formed over the hashes alone, and only the keys that repeat come back to the rows.
    """
    ok = F.coalesce(emittable(F.col("text"), F.col("flag")), F.lit(False))
    stripped = T.strip(F.col("text"))
    keyed = materialize(df.withColumns({"_ok": ok, "_h1": F.xxhash64("language", stripped), "_h2": F.xxhash64(F.lit("second"), stripped, "language")}), "keyed")
    return _later_flagged(keyed, order).select(*df.columns)


def _later_flagged(keyed: DataFrame, order: list[str]) -> DataFrame:
    first = keyed.where("_ok").groupBy("_h1", "_h2").agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_h1", "_h2", "_first")
    later = F.col("_ok") & F.col("_first").isNotNull() & (F.struct(*order) != F.col("_first"))
    return keyed.join(small(first, REPEATED_KEYS), ["_h1", "_h2"], "left").withColumn("flag", F.when(later, "duplicate").otherwise(F.col("flag")))


def verdicts(df: DataFrame, key: str) -> DataFrame:
    """(``key``, language, flag, emitted) of each row of ``df`` (``key``, language, text, flag): marks, then duplicates. Texts are read once and not carried along."""
    marked = mark(df.select(key, "language", "text", "flag"))
    stripped = T.strip(F.col("text"))
    ok = F.coalesce(emittable(F.col("text"), F.col("flag")), F.lit(False))
    keyed = materialize(marked.select(key, "language", "flag", ok.alias("_ok"), F.xxhash64("language", stripped).alias("_h1"), F.xxhash64(F.lit("second"), stripped, "language").alias("_h2")), "verdicts")
    return _later_flagged(keyed, [key]).select(key, "language", "flag", (F.col("_ok") & (F.col("flag") != "duplicate")).alias("emitted"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, in ``order``, of each combination of ``keys``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def numbered(df: DataFrame, name: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """``df`` with a number from 0 in ``order``, over all rows or within groups.

    Rows are sorted in range partitions over the groups and the order, so a group of any size is spread over tasks; a row's number is its place in its partition plus the
    rows of its group in the partitions before, whose counts are one small table.
    """
    within = within or []
    spark = df.sparkSession
    place = F.monotonically_increasing_id()
    parts = df.repartitionByRange(*[F.col(c) for c in (*within, *order)]).sortWithinPartitions(*within, *order).withColumn("_place", place)
    ranked = materialize(parts, "numbered").withColumns({"_part": F.shiftright("_place", 33), "_at": F.col("_place").bitwiseAND((1 << 33) - 1)})
    keys = [F.col(c).alias(f"_g{k}") for k, c in enumerate(within)]
    counts = ranked.groupBy("_part", *keys).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))  # a row for each partition and group
    names = [f"_g{k}" for k in range(len(within))]
    before = F.sum("_n").over(Window.partitionBy(*names, F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", *names, "_low", F.coalesce(before, F.lit(0)).alias("_start")).withColumnRenamed("_part", "_p")
    same = F.col("_part") == F.col("_p")
    for g, c in zip(names, within):
        same = same & F.col(c).eqNullSafe(F.col(g))
    return ranked.join(small(starts, REPEATED_KEYS), same).withColumn(name, (F.col("_start") + F.col("_at") - F.col("_low")).cast("bigint")).select(*df.columns, name)


def stratified_folds(df: DataFrame, strata: list[str], key: str = "doc_id", folds: int = L.FOLDS, seed: int = L.SEED) -> DataFrame:
    """``df`` with fold 0 to ``folds`` - 1, balanced within each stratum and over the strata in their order of first appearance.

    A row's place in its stratum is by a portable hash of the seed and its key. Places are found per bucket of the hash and bucket counts are added up, so a
    stratum with a third of all rows is ranked in many tasks.
    """
    # The first byte of the hash as the bucket: its order agrees with the order of the whole hash.
    h = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    keyed = df.withColumns({"_h": h, "_b": F.substring(h, 1, 2)})
    sizes = keyed.groupBy(*strata, "_b").agg(F.count("*").alias("_n"), F.min(key).alias("_first"))
    order = Window.orderBy("_head", *strata)
    totals = sizes.groupBy(*strata).agg(F.sum("_n").alias("_all"), F.min("_first").alias("_head"))
    totals = totals.withColumn("_offset", F.sum("_all").over(order.rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["_offset"])
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["_before"])
    start = before.join(totals, strata).select(*strata, "_b", (F.col("_before") + F.col("_offset")).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", key))
    out = keyed.withColumn("_rn", place).join(start, [*strata, "_b"])
    return out.withColumn("fold", F.pmod(F.col("_start") + F.col("_rn") - 1, F.lit(folds)).cast("int")).drop("_h", "_b", "_rn", "_start")


def buckets(df: DataFrame, languages: DataFrame) -> DataFrame:
    """(language, level, n): rows of each language and level, 0 where there are none. ``languages`` is a small dimension."""
    grid = languages.select("language").distinct().select("language", F.explode(F.array(*[F.lit(x) for x in L.LEVELS])).alias("level"))
    n = df.groupBy("language", "level").agg(F.count("*").alias("n"))
    return grid.join(n, ["language", "level"], "left").na.fill(0, ["n"])
