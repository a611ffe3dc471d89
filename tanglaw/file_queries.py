"""Queries of the readers and writers: tables are written in each format into the shared folder and read back, so the SQL says what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as L
from .functions import text as T
from .operators import evaluate
from .plans import pipelines
from .queries import COLLAPSE, DEDUPED, LANG_CASE, NORMAL, PREDICTED, ROLE, STRIP, WORDS, _ROUNDED, _METRICS, _round, _summary_sql, documents, predictions, query, texts, trad_features
from .queries import SHAPED, TRAD_SQL
from .sources import corpora
from .sources.tables import load, scratch, shared_dir


def _place(spark: SparkSession, name: str) -> str:
    return scratch(f"{shared_dir(spark)}/tanglaw/{name}-{uuid.uuid4().hex}")


def FIELD(x: str) -> str:
    return f"replace({COLLAPSE(x)}, '|', '/')"


PIPED = f"SELECT {LANG_CASE} AS language, level, {FIELD('text')} AS text, {ROLE.format(LANG_CASE)} AS split_role FROM documents WHERE lang IS NOT NULL AND level IS NOT NULL AND text IS NOT NULL"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", "language", "level", "title", "text").where("language is not null and level is not null and text is not null")


@query(PIPED)
def pipe_file_strict(spark: SparkSession, d: str) -> DataFrame:
    """Bucketed writer and strict reader: an ill-formed line would fail."""
    path = _place(spark, "pipe-strict")
    corpora.write_buckets(_rows(spark, d), path)
    return corpora.read_pipe(spark, path, strict=True)


@query(PIPED)
def pipe_file_tolerant(spark: SparkSession, d: str) -> DataFrame:
    """Bucketed writer and tolerant reader, with ill-formed lines between that must be dropped."""
    path = _place(spark, "pipe-tolerant")
    corpora.write_buckets(_rows(spark, d), path)
    spark.range(50).select(F.concat(F.lit("no bars "), F.col("id").cast("string")).alias("value")).write.mode("append").text(f"{path}/lang=x/lvl=0")
    return corpora.read_pipe(spark, path)


@query(f"SELECT {LANG_CASE} AS language, level, ' ' || {FIELD('text')} || ' ' AS text, {ROLE.format(LANG_CASE)} AS split_role FROM documents WHERE lang IS NOT NULL AND level IS NOT NULL AND text IS NOT NULL")
def pipe_file_unstripped(spark: SparkSession, d: str) -> DataFrame:
    """The tolerant reader that leaves texts as they are."""
    path = _place(spark, "pipe-unstripped")
    line = F.concat_ws("|", "language", F.col("level").cast("string"), F.concat(F.lit(" "), T.to_field(F.col("text")), F.lit(" ")))
    _rows(spark, d).select(line.alias("value")).write.text(path)
    return corpora.read_pipe(spark, path, stripped=False)


@query(PIPED.replace("SELECT ", "SELECT (row_number() OVER (ORDER BY list_position(['tagalog','cebuano','bikol','hiligaynon','minasbate','karay-a','rinconada'], " + LANG_CASE + "), level, doc_id) - 1)::BIGINT AS place, ", 1).replace("FROM documents WHERE", "FROM documents WHERE lang IN ('tl','ceb','bcl','hil','msb','krj','bto') AND"))
def master_file(spark: SparkSession, d: str) -> DataFrame:
    """The master file in its order: language in fixed order, level, document."""
    path = _place(spark, "master")
    corpora.write_master(_rows(spark, d).where(F.col("language").isin(*L.LANGUAGES)), path, "doc_id")
    return corpora.read_master(spark, path)


CARRY = ROLE.format(LANG_CASE)


@query(PIPED.replace("WHERE lang", f"WHERE {CARRY} = 'low_resource' AND lang"))
def low_resource_carry_over(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "carry-over")
    corpora.write_buckets(_rows(spark, d), path)
    return corpora.carry_over(spark, path)


TITLED = f"l AS (SELECT doc_id, coalesce({COLLAPSE('title')}, '') || ',' || level || ',' || {FIELD('text')} AS line FROM documents WHERE level IS NOT NULL AND text IS NOT NULL)"
LINE_PATTERN = r"(?s)^(.*?),(\d+),(.*)$"


@query(
    f"""WITH {TITLED} SELECT 'cebuano' AS language, regexp_extract(line, '{LINE_PATTERN}', 2)::INT AS level, {STRIP(f"regexp_extract(line, '{LINE_PATTERN}', 1)")} AS title,
 regexp_extract(line, '{LINE_PATTERN}', 3) AS text FROM l"""
)
def titled_file(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "titled")
    rows = documents(spark, d).where("level is not null and text is not null")
    line = F.concat(F.coalesce(T.collapse(F.col("title")), F.lit("")), F.lit(","), F.col("level").cast("string"), F.lit(","), T.to_field(F.col("text")))
    rows.select(line.alias("value")).write.text(path)
    return corpora.read_titled(spark, path, "cebuano")


@query(f"SELECT 'bikol' AS language, level, replace(replace({COLLAPSE('title')}, '_', ' '), ',', ' ') AS title, {FIELD('text')} AS text FROM documents WHERE level IS NOT NULL AND text IS NOT NULL AND {COLLAPSE('title')} <> ''")
def titled_file_with_file_names(spark: SparkSession, d: str) -> DataFrame:
    """Titles that are file names: underscores for spaces, and a suffix after three underscores."""
    path = _place(spark, "titled-bikol")
    rows = documents(spark, d).where("level is not null and text is not null").withColumn("name", F.translate(T.collapse(F.col("title")), " ,", "__")).where("name <> ''")
    line = F.concat("name", F.lit("___"), F.col("doc_id").cast("string"), F.lit(","), F.col("level").cast("string"), F.lit(","), T.to_field(F.col("text")))
    rows.select(line.alias("value")).write.text(path)
    return corpora.read_titled(spark, path, "bikol")


COMMAS = f"l AS (SELECT replace(coalesce({COLLAPSE('title')}, ''), ',', ' ') AS title, level, {FIELD('text')} AS text FROM documents WHERE text IS NOT NULL)"


def _comma_file(spark: SparkSession, d: str) -> str:
    path = _place(spark, "comma")
    line = F.concat(F.translate(F.coalesce(T.collapse(F.col("title")), F.lit("")), ",", " "), F.lit(","), F.coalesce(F.col("level").cast("string"), F.lit("")), F.lit(","), T.to_field(F.col("text")))
    documents(spark, d).where("text is not null").select(line.alias("value")).write.text(path)
    return path


@query(f"WITH {COMMAS} SELECT {STRIP('title')} AS title, level, text FROM l WHERE level IN (1, 2, 3) AND text <> ''")
def comma_file(spark: SparkSession, d: str) -> DataFrame:
    return corpora.read_comma(spark, _comma_file(spark, d))


@query(f"WITH {COMMAS} SELECT {STRIP('title')} AS title, level, CASE WHEN text = '' THEN 'blank' ELSE text END AS text FROM l WHERE level IN (1, 2, 3)")
def comma_file_with_blanks(spark: SparkSession, d: str) -> DataFrame:
    return corpora.read_comma(spark, _comma_file(spark, d), blank="blank")


@query(f"WITH {COMMAS} SELECT count(*) AS lines, count(*) FILTER (coalesce(level IN (1, 2, 3), false) AND text <> '') AS kept, count(*) FILTER (NOT (coalesce(level IN (1, 2, 3), false) AND text <> '')) AS skipped FROM l")
def comma_file_report(spark: SparkSession, d: str) -> DataFrame:
    return corpora.comma_report(spark, _comma_file(spark, d))


@query(f"SELECT level, array_to_string(({WORDS(FIELD('text'))})[1:6], ' ') AS title, {FIELD('text')} AS text FROM documents WHERE level IN (1, 2, 3) AND text IS NOT NULL AND {FIELD('text')} <> ''")
def level_files(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "levels")
    rows = documents(spark, d).where("text is not null")
    for level in L.LEVELS:
        rows.where(F.col("level") == level).select(T.to_field(F.col("text")).alias("value")).write.text(f"{path}/texts_lvl{level}")
    return corpora.read_levels(spark, f"{path}/*")


@query(f"SELECT level, (row_number() OVER (PARTITION BY level ORDER BY doc_id) - 1)::INT AS place, {STRIP('text')} AS text FROM documents WHERE level IN (1, 2, 3) AND text IS NOT NULL AND {STRIP('text')} <> ''")
def record_files(spark: SparkSession, d: str) -> DataFrame:
    """One file of records for each level, each record with its place in the file."""
    path = _place(spark, "records")
    rows = documents(spark, d).where("text is not null").where(T.strip(F.col("text")) != "")
    for level in L.LEVELS:
        corpora.write_records(rows.where(F.col("level") == level).orderBy("doc_id").coalesce(1), f"{path}/lvl{level}")
    return corpora.read_records(spark, f"{path}/*", numbered=True).select(F.regexp_extract("file", r"lvl(\d)", 1).cast("int").alias("level"), "place", "text")


@query("SELECT anchor, n, gram_rank, gram FROM anchor_ngrams")
def anchor_files(spark: SparkSession, d: str) -> DataFrame:
    """Anchor lists as files, whose order is the rank, ties of counts included."""
    anchors, path, out = load(spark, d, "anchor_ngrams"), _place(spark, "anchors"), None
    for r in anchors.select("anchor", "n").distinct().orderBy("anchor", "n").collect():  # a handful of lists
        own = anchors.where((F.col("anchor") == r.anchor) & (F.col("n") == r.n)).orderBy("gram_rank").coalesce(1)
        corpora.write_grams(own.select("gram", F.col("gram_count").alias("cnt")), f"{path}/{r.anchor}-{r.n}")
        one = corpora.read_anchors(spark, f"{path}/{r.anchor}-{r.n}", r.anchor, r.n)
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT doc_id, {LANG_CASE} AS language, level, {FIELD('text')} AS text FROM documents WHERE text IS NOT NULL AND {FIELD('text')} <> ''")
def bar_table(spark: SparkSession, d: str) -> DataFrame:
    """A table with bars between its cells, rows without a text dropped."""
    path = _place(spark, "bars")
    rows = documents(spark, d).select("doc_id", "language", "level", T.to_field(F.col("text")).alias("text"))
    corpora.write_table(rows, path, "|")
    return corpora.read_table(spark, path, "doc_id bigint, language string, level int, text string", "|", required=["text"])


@query(f"WITH {SHAPED} SELECT doc_id, {TRAD_SQL} FROM s")
def feature_file(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "features")
    df = trad_features(spark, d)
    corpora.write_table(df, path)
    return corpora.read_table(spark, path, df.schema)


@query(f"SELECT doc_id, level, {COLLAPSE('title')} AS title, {NORMAL} AS text FROM documents WHERE text IS NOT NULL AND {NORMAL} <> ''")
def corpus_file(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned corpus as a table whose texts keep their line breaks and quotes."""
    path = _place(spark, "corpus")
    df = documents(spark, d).select("doc_id", "level", T.collapse(F.col("title")).alias("title"), T.normalize(F.col("text")).alias("text")).where("text is not null and text <> ''")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query(f"WITH {DEDUPED} SELECT f.language, f.level, f.flag, {FIELD('a.title')} AS title FROM f JOIN all_languages a ON a.doc_id = f.doc_id WHERE f.flag <> ''")
def flag_log(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "flags")
    rows = texts(spark, d, "title")
    flags = pipelines.flagged(rows).where("flag <> ''").select("doc_id", "flag")
    corpora.write_flags(rows.join(flags, "doc_id"), path)
    return corpora.read_table(spark, path, "language string, level int, flag string, title string, text string", "|").drop("text")


@query("SELECT 'train' AS part, doc_id, language, label FROM high_resource_index WHERE split_role = 'train' UNION ALL SELECT split_role, doc_id, language, label FROM high_resource_index WHERE split_role <> 'train' UNION ALL SELECT 'heldout', doc_id, language, label FROM low_resource_heldout")
def split_tables(spark: SparkSession, d: str) -> DataFrame:
    """The split tables, stored by part."""
    path = _place(spark, "splits")
    index = load(spark, d, "high_resource_index").select(F.col("split_role").alias("part"), "doc_id", "language", "label")
    index.unionByName(load(spark, d, "low_resource_heldout").select(F.lit("heldout").alias("part"), "doc_id", "language", "label")).write.partitionBy("part").parquet(path)
    return spark.read.parquet(path).select("part", "doc_id", "language", "label")


@query(f"WITH {PREDICTED}, {_summary_sql('language')} SELECT b.language, n_docs, {_ROUNDED} FROM b JOIN f ON f.language = b.language")
def results_json(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "results")
    df = _round(evaluate.summary(predictions(spark, d), ["language"]), *_METRICS)
    corpora.as_json(df, "value").write.text(path)
    return spark.read.text(path).select(F.from_json("value", df.schema).alias("r")).select("r.*")


@query(
    f"""WITH {SHAPED}, v AS (SELECT s.doc_id, {TRAD_SQL} FROM s), k AS (SELECT title, level, max_by(mean_word_len, v.doc_id) AS key_value FROM v JOIN documents d ON d.doc_id = v.doc_id WHERE title IS NOT NULL AND level IS NOT NULL GROUP BY title, level)
SELECT d.doc_id, k.key_value FROM documents d LEFT JOIN k ON k.title = d.title AND k.level = d.level"""
)
def published_features(spark: SparkSession, d: str) -> DataFrame:
    """A published feature table, read from its file and looked up by (title, level), the last row of a key counting."""
    path = _place(spark, "published")
    features = trad_features(spark, d).select("doc_id", "mean_word_len").join(load(spark, d, "documents", "doc_id", "title", "level"), "doc_id")
    features.write.json(path)
    published = spark.read.schema("doc_id bigint, mean_word_len double, title string, level int").json(path)
    key = published.where("title is not null and level is not null").groupBy("title", "level").agg(F.max_by("mean_word_len", "doc_id").alias("key_value"))
    return load(spark, d, "documents", "doc_id", "title", "level").join(key, ["title", "level"], "left").select("doc_id", "key_value")
