"""Readers and writers of corpus file formats. Row order within a file isn't kept by Spark; readers return what identifies a row instead, and ids are assigned by ``operators.corpus.numbered``.

Undecodable bytes become replacement characters, as Spark decodes UTF-8 so. A line that doesn't fit a format is dropped by the tolerant readers and fails the strict one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..operators import corpus

RECORD = "\n\n=====\n\n"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"))


def read_pipe(spark: SparkSession, path: str, strict: bool = False, stripped: bool = True) -> DataFrame:
    """(language, level, text, split_role) of ``language|level|text`` lines with a header; the text may hold further bars. Fields are trimmed if ``stripped`` and not ``strict``, which fails on a short line."""
    parts = _lines(spark, path).where(T.strip(F.col("line")) != "").select(F.split("line", r"\|", 3).alias("p")).where("p[0] <> 'language' or p[1] <> 'level'")
    if strict:
        kept = parts.where(F.coalesce(F.assert_true(F.size("p") == 3).cast("string"), F.lit("")) == "")
        fields = [F.get("p", F.lit(k)) for k in range(3)]
    else:
        kept = parts.where(F.size("p") == 3)
        fields = [T.strip(F.get("p", F.lit(k))) if stripped else F.get("p", F.lit(k)) for k in range(3)]
    return kept.select(fields[0].alias("language"), fields[1].cast("int").alias("level"), fields[2].alias("text")).withColumn("split_role", corpus.role(F.col("language")))


def read_titled(spark: SparkSession, path: str, language: str) -> DataFrame:
    """(language, level, title, text) of ``title,level,text`` lines, the title up to the first ``,digits,``; of Bikol titles what stands before three underscores, underscores as spaces."""
    pattern = r"(?s)^(.*?),(\d+),(.*)$"
    rows = _lines(spark, path).where(F.col("line").rlike(pattern))
    title = T.strip(F.regexp_extract("line", pattern, 1))
    shown = F.replace(F.split_part(title, F.lit("___"), F.lit(1)), F.lit("_"), F.lit(" ")) if language == "bikol" else title
    return rows.select(F.lit(language).alias("language"), F.regexp_extract("line", pattern, 2).cast("int").alias("level"), shown.alias("title"), F.regexp_extract("line", pattern, 3).alias("text"))


def read_comma(spark: SparkSession, path: str, blank: str | None = None) -> DataFrame:
    """(title, level, text) of lines split at their first two commas, with a level of 1 to 3; an empty text is dropped or becomes ``blank``."""
    parts = _lines(spark, path).select(F.split("line", ",", 3).alias("p")).where((F.size("p") == 3) & T.strip(F.get("p", F.lit(1))).isin("1", "2", "3"))
    rows = parts.select(T.strip(F.get("p", F.lit(0))).alias("title"), T.strip(F.get("p", F.lit(1))).cast("int").alias("level"), T.strip(F.get("p", F.lit(2))).alias("text"))
    return rows.where("text <> ''") if blank is None else rows.withColumn("text", F.when(F.col("text") == "", blank).otherwise(F.col("text")))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(language, level, title, text) of ``<language>/grade <n>/<title>.txt`` files, one text each."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    part = lambda k: F.element_at(F.split(at, "/"), k)
    name = F.regexp_replace(part(-1), r"\.txt$", "")
    return rows.select(
        part(-3).alias("language"), F.regexp_extract(part(-2), r"(\d+)", 1).cast("int").alias("level"), F.replace(F.split_part(name, F.lit("___"), F.lit(1)), F.lit("_"), F.lit(" ")).alias("title"),
        F.col("value").alias("text"),
    )


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """(level, title, text) of per-level files, one text a line; the level is in the file's name, the title is the first six words."""
    rows = _lines(spark, path).where(T.strip(F.col("line")) != "")
    return rows.select(F.regexp_extract("file", r"lvl(\d)", 1).cast("int").alias("level"), F.array_join(F.slice(T.split_words(F.col("line")), 1, 6), " ").alias("title"), F.col("line").alias("text"))


def comma_report(spark: SparkSession, path: str) -> DataFrame:
    """(lines, kept, skipped): how many lines ``read_comma`` keeps."""
    parts = F.split("line", ",", 3)
    good = (F.size(parts) == 3) & T.strip(F.get(parts, F.lit(1))).isin("1", "2", "3") & (T.strip(F.get(parts, F.lit(2))) != "")
    good = F.coalesce(good, F.lit(False))
    return _lines(spark, path).agg(F.count("*").alias("lines"), F.count_if(good).alias("kept"), F.count_if(~good).alias("skipped"))


def carry_over(spark: SparkSession, path: str) -> DataFrame:
    """The low-resource rows of an existing master or its buckets."""
    return read_pipe(spark, path).where(F.col("split_role") == "low_resource")


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """``read_pipe`` with the place of each line over the parts of a master in the order of their names."""
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    fields = F.split("value", r"\|", 3)
    out = corpus.numbered(rows.select("part", "block", "at", fields.alias("p")).where(F.size("p") == 3), "place", ["part", "block", "at"])
    language = T.strip(F.get("p", F.lit(0)))
    return out.select("place", language.alias("language"), F.get("p", F.lit(1)).cast("int").alias("level"), T.strip(F.get("p", F.lit(2))).alias("text"), corpus.role(language).alias("split_role"))


def read_records(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """(file, text) of records between separator lines; blank records are dropped. ``numbered`` adds each record's place among those of its file, for which a file is read as a whole."""
    if numbered:
        whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", RECORD).alias("r"))
        kept = F.filter(F.transform("r", lambda x: T.strip(x)), lambda x: x != "")
        return whole.select("file", F.posexplode(kept).alias("place", "text"))
    rows = spark.read.option("lineSep", RECORD).text(path).select(F.col("_metadata.file_path").alias("file"), T.strip(F.col("value")).alias("text"))
    return rows.where("text <> ''")


def read_anchors(spark: SparkSession, path: str, anchor: str, n: int) -> DataFrame:
    """(anchor, n, gram_rank, gram) of ``gram,count`` lines of one list; the rank is the order of the lines. A list is small and read as a whole."""
    whole = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("lines"))
    filled = F.filter("lines", lambda x: T.strip(x) != "")
    lines = whole.select(F.posexplode(filled).alias("place", "line"))
    return lines.select(F.lit(anchor).alias("anchor"), F.lit(n).alias("n"), (F.col("place") + 1).alias("gram_rank"), T.strip(F.split_part("line", F.lit(","), F.lit(1))).alias("gram"))


def write_grams(df: DataFrame, path: str) -> None:
    """(gram, cnt) as ``gram,count`` lines in the order of ``df``."""
    df.select(F.concat_ws(",", "gram", F.col("cnt").cast("string")).alias("value")).write.text(path)


def read_table(spark: SparkSession, path: str, schema, sep: str = ",", required: list[str] | None = None) -> DataFrame:
    """A delimited table with a header; rows without a value in ``required`` columns are dropped."""
    df = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", False).schema(schema).csv(path)
    return df.na.drop(subset=required) if required else df


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """A delimited table with a header, quotes doubled."""
    df.write.option("header", True).option("sep", sep).option("escape", '"').option("emptyValue", "").csv(path)


def write_buckets(df: DataFrame, path: str) -> None:
    """``df`` (language, level, text) as pipe-safe lines in a folder for each language and level."""
    line = F.concat_ws("|", F.col("language"), F.col("level").cast("string"), T.to_field(F.col("text")))
    df.select(line.alias("value"), F.col("language").alias("lang"), F.col("level").alias("lvl")).write.partitionBy("lang", "lvl").text(path)


def write_master(df: DataFrame, path: str, order: str) -> None:
    """``df`` (language, level, text) as pipe-safe lines over all parts, by language in its fixed order, level and ``order``."""
    place = F.array_position(F.array(*[F.lit(x) for x in L.LANGUAGES]), F.col("language"))
    line = F.concat_ws("|", F.col("language"), F.col("level").cast("string"), T.to_field(F.col("text")))
    df.orderBy(place, "level", order).select(line.alias("value")).write.text(path)


def write_records(df: DataFrame, path: str) -> None:
    """The texts of ``df`` between separator lines."""
    df.select(F.col("text").alias("value")).write.option("lineSep", RECORD).text(path)


def write_flags(df: DataFrame, path: str) -> None:
    """The rows of ``df`` with a flag as pipe-separated lines with a header."""
    df.where("flag <> ''").select("language", "level", "flag", T.to_field(F.col("title")).alias("title"), T.to_field(F.col("text")).alias("text")).write.option("sep", "|").option("header", True).option("escape", '"').csv(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row of a small result as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
