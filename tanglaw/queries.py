"""Queries of the core operators over the tables of one data directory, and the same in SQL for DuckDB.

``QUERIES`` and ``SQL`` are filled by ``query``; a query without SQL is tested against a fixture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as L
from .functions import features as FE
from .functions import text as T
from .operators import audit, clean, corpus, evaluate, ngrams
from .plans import pipelines
from .sources.tables import load, materialize, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, language (of the ISO code) and text of the documents table."""
    code = F.create_map(*[F.lit(x) for pair in L.ISO.items() for x in pair])
    return spread(load(spark, d, "documents", "doc_id", "lang", "title", "source", "level", "text")).withColumn("language", F.coalesce(F.element_at(code, F.col("lang")), F.col("lang")))


def texts(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(load(spark, d, "all_languages", "doc_id", "language", "level", "text", *more))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, language, fold, y_true, y_pred) of a threshold rule on mean word length: a predictor whose every step SQL can repeat."""
    docs = FE.tokenized(texts(spark, d).where("level in (1, 2, 3) and language is not null"))
    n, letters = F.size("words"), F.aggregate(F.col("words"), F.lit(0), lambda a, w: a + F.length(w))
    guess = F.when(letters * 100 < n * 450, 0).when(letters * 100 < n * 530, 1).otherwise(2)
    return docs.select("doc_id", T.lower_trim(F.col("language")).alias("language"), (F.col("doc_id") % 5).cast("int").alias("fold"), (F.col("level") - 1).alias("y_true"), guess.alias("y_pred"))


# --- SQL fragments -------------------------------------------------------------------------------------------------------------------------------------------

W = L.WORD_LETTERS


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^{L.WS}+|{L.WS}+$', '', 'g')"


def COLLAPSE(x: str) -> str:
    return f"trim(regexp_replace({x}, '{L.WS}+', ' ', 'g'))"


def WORDS(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{L.WS}+'), lambda w: w <> '')"


def TOKENS(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[{W}]+')"


def SENTENCES(x: str) -> str:
    # A sentinel is put where the split is.
    return f"list_filter(string_split(regexp_replace({STRIP(x)}, '([.?!]){L.WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {STRIP('s')} <> '')"


LANG_CASE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.ISO.items()) + " ELSE lang END"
BY_LANGUAGE = "CASE WHEN lower(language) IN ('cebuano','bikol','hiligaynon','minasbate','karay-a') THEN {0} WHEN lower(language) = 'rinconada' THEN {1} ELSE {2} END"
SHAPES_SQL = BY_LANGUAGE.format(
    *[f"list_transform(words, lambda w: regexp_replace(regexp_replace(w, '[{v}]', 'V', 'g'), '[^V]', 'C', 'g'))" for v in (L.VOWELS_ACUTE, L.VOWELS_SCHWA, L.VOWELS_ALL)]
)
NUCLEI_SQL = BY_LANGUAGE.format(*[f"list_transform(words, lambda w: greatest(len(regexp_extract_all(w, '[{v}]+')), 1))" for v in (L.VOWELS_ACUTE, L.VOWELS_SCHWA, L.VOWELS_ALL)])
TOKENIZED = f"""t AS (SELECT doc_id, {LANG_CASE} AS language, {TOKENS('text')} AS words, len({SENTENCES("coalesce(text, '')")}) AS n_sents FROM documents)"""
TRAD_SQL = f"""n_words / greatest(n_sents, 1) AS mean_sentence_len,
 CASE WHEN n_words > 0 THEN letters / n_words ELSE 0 END AS mean_word_len,
 CASE WHEN n_words > 0 THEN len(list_filter(nuclei, lambda k: k >= 3)) / n_words ELSE 0 END AS polysyll_freq,
 CASE WHEN n_words > 0 THEN len(list_distinct(words)) / n_words ELSE 0 END AS type_token_ratio"""
SHAPED = f"""{TOKENIZED}, s AS (SELECT *, len(words)::DOUBLE AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::DOUBLE AS letters,
 {NUCLEI_SQL} AS nuclei, {SHAPES_SQL} AS skeletons FROM t)"""


def _shape_sql(wanted: dict[str, str]) -> str:
    return ", ".join(f"CASE WHEN n_words > 0 THEN len(list_filter(skeletons, lambda k: k = '{p}')) / n_words ELSE 0 END AS {c}" for c, p in wanted.items())


ENGLISH = "[" + ",".join(f"'{w}'" for w in L.ENG_ONLY) + "]"


def BARE(x: str) -> str:
    return f"list_filter(list_transform({WORDS(x)}, lambda w: lower(regexp_replace(w, '^[.,!?\"''()]+|[.,!?\"''()]+$', '', 'g'))), lambda w: regexp_matches(w, '^\\p{{L}}+$'))"


def ENGLISH_RATIO(x: str) -> str:
    return f"coalesce(len(list_filter({BARE(x)}, lambda w: list_contains({ENGLISH}, w))) / nullif(len({BARE(x)}), 0), 0)"


def ENTITIES(x: str) -> str:
    for pattern, new in L.ENTITIES:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x



# --- Readability features ------------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {SHAPED} SELECT doc_id, {TRAD_SQL} FROM s")
def trad_features(spark: SparkSession, d: str) -> DataFrame:
    docs = FE.tokenized(documents(spark, d))
    return docs.select("doc_id", *[c.alias(n) for n, c in FE.trad(F.col("words"), F.col("n_sents"), F.col("language")).items()])


@query(f"WITH {SHAPED} SELECT doc_id, {_shape_sql(FE.SHAPES)} FROM s")
def syll_features(spark: SparkSession, d: str) -> DataFrame:
    docs = FE.tokenized(documents(spark, d))
    return docs.select("doc_id", *[c.alias(n) for n, c in FE.syll(F.col("words"), F.col("language")).items()])


@query(
    f"""WITH {SHAPED} SELECT doc_id, n_words::BIGINT AS word_count, n_sents AS sentence_count, CASE WHEN n_words > 0 THEN list_sum(nuclei) / n_words ELSE 0 END AS mean_syll_per_word,
 len(list_filter(nuclei, lambda k: k >= 3)) AS polysyll_count,
 CASE WHEN n_words > 0 THEN list_sum(list_transform(words, lambda w: len(regexp_extract_all(w, '[^{L.VOWELS_ALL}əǝ]{{2,}}')))) / n_words ELSE 0 END AS cluster_density, {_shape_sql(FE.WIDE_SHAPES)} FROM s"""
)
def wide_features(spark: SparkSession, d: str) -> DataFrame:
    docs = FE.tokenized(documents(spark, d))
    every = FE.wide(F.col("words"), F.col("n_sents"), F.col("language")) | FE.syll(F.col("words"), F.col("language"), FE.WIDE_SHAPES)
    return docs.select("doc_id", *[c.alias(n) for n, c in every.items()])


GRAMS = """c AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS letters FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, {n} AS n, unnest(list_transform(range(1, greatest(length(letters) - {n} + 2, 1)), lambda i: substr(letters, i, {n}))) AS gram,
 unnest(range(1, greatest(length(letters) - {n} + 2, 1))) AS pos FROM c)"""


@query(f"WITH {GRAMS.format(n=3)} SELECT gram, cnt FROM (SELECT gram, count(*) AS cnt, min((doc_id, pos)) AS first FROM g GROUP BY gram ORDER BY cnt DESC, first LIMIT 25)")
def char_ngram_topk(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.corpus_profile(documents(spark, d), 3, 25)


RBO_SQL = """WITH c AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS letters FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, k.n, unnest(list_transform(range(1, greatest(length(letters) - k.n + 2, 1)), lambda i: substr(letters, i, k.n))) AS gram,
 unnest(range(1, greatest(length(letters) - k.n + 2, 1))) AS pos FROM c, (SELECT DISTINCT n FROM anchor_ngrams) k),
p AS (SELECT doc_id, n, gram, count(*) AS cnt, min(pos) AS first_pos FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY cnt DESC, first_pos) AS dr, count(*) OVER (PARTITION BY doc_id, n) AS ds FROM p),
a AS (SELECT *, count(*) OVER (PARTITION BY anchor, n) AS asz FROM anchor_ngrams),
w AS (SELECT k, sum(power(0.98, k - 1) / k) OVER (ORDER BY k) AS s FROM range(1, 2000) t(k)),
m AS (SELECT r.doc_id, a.anchor, a.n, greatest(dr, gram_rank) AS top, least(ds, asz) AS depth FROM r JOIN a ON r.gram = a.gram AND r.n = a.n),
x AS (SELECT doc_id, anchor, n, sum(w1.s - coalesce(w2.s, 0)) * 0.02 AS rbo FROM m JOIN w w1 ON w1.k = depth LEFT JOIN w w2 ON w2.k = top - 1 WHERE top <= depth GROUP BY ALL),
f AS (SELECT doc_id, {}) """.format(
    ", ".join(f"max(rbo) FILTER (anchor = '{a}' AND n = {n}) AS {c}" for a, n, c in (("tagalog", 2, "tag_bi"), ("bikol", 2, "bik_bi"), ("cebuano", 2, "ceb_bi"), ("tagalog", 3, "tag_tri"), ("bikol", 3, "bik_tri"), ("cebuano", 3, "ceb_tri")))
    + " FROM x GROUP BY doc_id"
)
RBO_COLUMNS = ("tag_bi", "bik_bi", "ceb_bi", "tag_tri", "bik_tri", "ceb_tri")


@query(RBO_SQL + f"SELECT d.doc_id, {', '.join(f'round(coalesce({c}, 0), 8) AS {c}' for c in RBO_COLUMNS)} FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id")
def rbo_features(spark: SparkSession, d: str) -> DataFrame:
    out = ngrams.rbo_features(documents(spark, d), load(spark, d, "anchor_ngrams"))
    return out.select("doc_id", *[F.round(c, 8).alias(c) for c in RBO_COLUMNS])


@query(
    RBO_SQL.replace("WITH ", f"WITH {SHAPED}, ", 1)
    + f"""SELECT s.doc_id, {TRAD_SQL}, {_shape_sql(FE.SHAPES)}, {', '.join(f'round(coalesce({c}, 0), 8) AS {c}' for c in RBO_COLUMNS)}, d.level AS label, s.language,
 CASE WHEN s.language IN ('tagalog','cebuano','bikol') THEN 'high_resource' WHEN s.language IN ('hiligaynon','minasbate','karay-a','rinconada') THEN 'low_resource' ELSE 'unknown' END AS split_role
 FROM s JOIN documents d ON d.doc_id = s.doc_id LEFT JOIN f ON f.doc_id = s.doc_id"""
)
def feature_vector14(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.features14(documents(spark, d), load(spark, d, "anchor_ngrams"))


@query(
    f"WITH {SHAPED}, v AS (SELECT {TRAD_SQL} FROM s) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(min({c}), 4) AS min, round(max({c}), 4) AS max, count(DISTINCT {c}) AS n_distinct FROM v" for c in ("mean_sentence_len", "mean_word_len", "polysyll_freq", "type_token_ratio"))
)
def feature_summary(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.describe(trad_features(spark, d), ["mean_sentence_len", "mean_word_len", "polysyll_freq", "type_token_ratio"])


@query(
    f"""WITH {SHAPED}, v AS (SELECT n_words, {TRAD_SQL}, {_shape_sql(FE.SHAPES)} FROM s)
SELECT count(*) AS rows, count(*) FILTER (type_token_ratio <= 0 OR type_token_ratio > 1) AS bad_ttr, count(*) FILTER (least(mean_sentence_len, mean_word_len, polysyll_freq, syll_cv, syll_cvc, syll_ccvc, syll_ccvccc) < 0) AS negative,
 bool_and(type_token_ratio IS NULL) AS all_null, count(DISTINCT syll_cv) <= 1 AS constant_cv FROM v"""
)
def feature_sanity(spark: SparkSession, d: str) -> DataFrame:
    docs = FE.tokenized(documents(spark, d))
    v = docs.select(*[c.alias(n) for n, c in (FE.trad(F.col("words"), F.col("n_sents"), F.col("language")) | FE.syll(F.col("words"), F.col("language"))).items()])
    least = F.least("mean_sentence_len", "mean_word_len", "polysyll_freq", *FE.SHAPES)
    return v.agg(
        F.count("*").alias("rows"), F.count_if((F.col("type_token_ratio") <= 0) | (F.col("type_token_ratio") > 1)).alias("bad_ttr"), F.count_if(least < 0).alias("negative"),
        F.bool_and(F.col("type_token_ratio").isNull()).alias("all_null"), (F.count_distinct("syll_cv") <= 1).alias("constant_cv"),
    )


# --- Text repair and normalization ---------------------------------------------------------------------------------------------------------------------------

# RE2 has no lookaround: a pattern that looks ahead at a letter is applied twice with that letter captured.
NORMAL = ENTITIES("nfc_normalize(text)")
for _p, _r in (
    (rf"([,.!?;:\)]){L.WS}*(\p{{L}})", r"\1 \2"), (rf"([,.!?;:\)]){L.WS}*(\p{{L}})", r"\1 \2"), (rf"(\p{{L}}){L.WS}*-{L.WS}*(\p{{L}})", r"\1-\2"),
    (rf"(\p{{L}}){L.WS}*-{L.WS}*(\p{{L}})", r"\1-\2"), (r"(\p{L})-{2,}(\p{L})", r"\1-\2"), (r"(\p{L})-{2,}(\p{L})", r"\1-\2"), (f"{L.WS}*[—–]{L.WS}*", " — "), (r"[ \t]+", " "),
):
    NORMAL = f"regexp_replace({NORMAL}, '{_p}', '{_r}', 'g')"
NORMAL = STRIP(NORMAL)


@query(f"SELECT doc_id, {NORMAL} AS text FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.normalize(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {ENTITIES('text')} AS text FROM documents")
def entity_scrub(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.scrub_entities(F.col("text")).alias("text"))


@query(
    f"""SELECT doc_id, regexp_replace(regexp_replace({ENTITIES("replace(text, chr(65279), '')")}, '{L.URL}', '', 'g'), '{L.NOT_WS}*[^\\P{{L}}\\p{{Latin}}]{L.NOT_WS}*', ' ', 'g') AS text FROM documents"""
)
def basic_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.basic_clean(F.col("text")).alias("text"))


@query(f"SELECT doc_id, replace({COLLAPSE('text')}, '|', '/') AS text FROM documents")
def pipe_field(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.to_field(F.col("text")).alias("text"))


@query("SELECT doc_id, strip_accents(title) AS title, length(strip_accents(title)) AS n FROM all_languages")
def accent_fold(spark: SparkSession, d: str) -> DataFrame:
    folded = T.fold_accents(F.col("title"))
    return texts(spark, d, "title").select("doc_id", folded.alias("title"), F.length(folded).alias("n"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS letters FROM documents")
def alpha_clean(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.ascii_letters(F.col("text")).alias("letters"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{2,}', chr(10), 'g') AS text FROM documents")
def squeeze_breaks(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.unify_breaks(F.col("text")).alias("text"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '{L.JUNK_GLYPHS}', ' ', 'g'), '_{{2,}}', ' ', 'g') AS text FROM documents")
def junk_glyphs(spark: SparkSession, d: str) -> DataFrame:
    glyphs = F.regexp_replace(F.regexp_replace("text", L.JUNK_GLYPHS, " "), "_{2,}", " ")
    return documents(spark, d).select("doc_id", glyphs.alias("text"))


@query()
def strip_noise(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.strip_noise(F.col("text")).alias("text"))


@query()
def caps_run_strip(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.strip_caps_runs(F.col("text")).alias("text"))


@query(f"""SELECT doc_id, array_to_string(list_filter({WORDS("coalesce(text, '')")}, lambda w: NOT regexp_matches(w, '^[0-9]{{1,3}}$')), ' ') AS text FROM documents WHERE text IS NOT NULL""")
def page_number_strip(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", T.strip_page_numbers(F.col("text")).alias("text"))


@query(f"SELECT doc_id, len({WORDS('text')}) AS words FROM documents WHERE text IS NOT NULL")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("text is not null").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query()
def normalize_first_generation(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", T.normalize_first(F.col("text")).alias("text"))


# --- Metadata removal ----------------------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {ENGLISH_RATIO('text')} AS ratio FROM all_languages WHERE text IS NOT NULL")
def english_ratio(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).where("text is not null").select("doc_id", T.english_ratio(F.col("text")).alias("ratio"))


@query(f"SELECT doc_id, regexp_replace(text, '{L.META_LABEL}', ' ', 'g') AS text FROM documents")
def meta_label_strip(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", clean.drop_labels(F.col("text")).alias("text"))


@query()
def credit_strip(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", clean.drop_credits(F.col("text")).alias("text"))


@query()
def title_strip(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", clean.strip_title(F.col("text"), F.col("title")).alias("text"))


@query()
def narrative_start(spark: SparkSession, d: str) -> DataFrame:
    out = clean.with_start(documents(spark, d).where("text is not null").withColumn("_t", T.collapse(F.col("text"))), "_t")
    return out.select("doc_id", "started", F.length("skipped").alias("skipped"), clean.prefix_flag().alias("flag"))


@query()
def clean_line_corpus(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_lines(texts(spark, d, "title")).select("doc_id", "narrative", "flag")


@query()
def clean_page_corpus(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_pages(documents(spark, d)).select("doc_id", "narrative", "flag")


@query()
def clean_tagalog_corpus(spark: SparkSession, d: str) -> DataFrame:
    tagalog = texts(spark, d).where(T.lower_trim(F.col("language")) == "tagalog")
    return clean.clean_tagalog(tagalog).select("doc_id", "narrative", "flag")


@query()
def clean_level_corpus(spark: SparkSession, d: str) -> DataFrame:
    tagalog = texts(spark, d).where(T.lower_trim(F.col("language")) == "tagalog")
    return clean.clean_levels(tagalog).select("doc_id", "narrative", "flag")


@query()
def clean_first_generation(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_first_generation(texts(spark, d, "title")).select("doc_id", "narrative", "flag")


TL_FUNC = "[" + ",".join(f"'{w}'" for w in L.TL_FUNC) + "]"
_LETTERS = "regexp_extract_all(lower(text), '\\p{L}+')"


@query(f"SELECT doc_id, coalesce(len(list_filter({_LETTERS}, lambda w: list_contains({TL_FUNC}, w))) / nullif(len({_LETTERS}), 0), 0) AS density FROM all_languages WHERE text IS NOT NULL")
def native_density(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).where("text is not null").select("doc_id", clean.native_density(F.col("text")).alias("density"))


@query()
def english_sentences_dropped(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).where("text is not null").select("doc_id", clean.drop_english(F.col("text")).alias("text"))


@query(
    f"""WITH b AS (SELECT doc_id, {COLLAPSE('title')} AS s FROM documents WHERE title IS NOT NULL)
SELECT doc_id, length(s) <= 60 AND regexp_matches(s, '{L.NAME_BLOCK.replace("'", "''")}') AND NOT regexp_matches(s, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(L.PHIL_FUNC)})(?:$|[^\\p{{L}}\\p{{N}}_])')
 AND len({WORDS('s')}) >= 2 AS is_name FROM b"""
)
def name_blocks(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).where("title is not null").select("doc_id", clean.is_name_block(F.col("title")).alias("is_name"))


# --- Corpus assembly -----------------------------------------------------------------------------------------------------------------------------------------

MARKED = f"""m AS (SELECT doc_id, language, level, text, CASE WHEN text IS NULL OR {STRIP('text')} = '' THEN '' WHEN {ENGLISH_RATIO('text')} >= 0.40 THEN 'english_heavy'
 WHEN len({WORDS('text')}) < 4 THEN 'too_short' ELSE '' END AS flag FROM all_languages)"""
EMITTABLE = f"(text IS NOT NULL AND {STRIP('text')} <> '' AND len({WORDS('text')}) >= 4 AND flag = '')"
DEDUPED = f"""{MARKED}, e AS (SELECT *, {EMITTABLE} AS ok, {STRIP('text')} AS st FROM m),
f AS (SELECT doc_id, language, level, CASE WHEN ok AND row_number() OVER (PARTITION BY language, st, ok ORDER BY doc_id) > 1 THEN 'duplicate' ELSE flag END AS flag, ok FROM e)"""


@query(f"WITH {DEDUPED} SELECT doc_id, flag, ok AND flag <> 'duplicate' AS emitted FROM f")
def flag_and_emit(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.flagged(texts(spark, d)).select("doc_id", "flag", "emitted")


@query("SELECT min(doc_id) AS doc_id, language, level, count(*) AS copies FROM all_languages WHERE text IS NOT NULL GROUP BY language, level, text")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    # The smallest id is the first row; grouping by hashes keeps texts out of the shuffle.
    keyed = texts(spark, d).where("text is not null").select("doc_id", "language", "level", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    return keyed.groupBy("language", "level", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "language", "level", "copies")


@query("SELECT pos, count(*) AS n FROM high_resource_index GROUP BY pos HAVING count(*) > 1")
def duplicate_positions(spark: SparkSession, d: str) -> DataFrame:
    return corpus.repeated_keys(load(spark, d, "high_resource_index"), ["pos"])


@query(
    """SELECT l.language, k.level::INT AS level, coalesce(n, 0) AS n FROM (SELECT DISTINCT language FROM language_names) l CROSS JOIN (VALUES (1), (2), (3)) k(level)
LEFT JOIN (SELECT lower(trim(language)) AS language, level, count(*) AS n FROM all_languages GROUP BY ALL) c ON c.language = l.language AND c.level = k.level"""
)
def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).select(T.lower_trim(F.col("language")).alias("language"), "level")
    return corpus.buckets(rows, load(spark, d, "language_names"))


@query(
    """SELECT lower(trim(language)) AS language, count(*) FILTER (level = 1) AS level_1, count(*) FILTER (level = 2) AS level_2, count(*) FILTER (level = 3) AS level_3,
 count(*) FILTER (level IN (1, 2, 3)) AS total FROM all_languages WHERE language IS NOT NULL AND level IN (1, 2, 3) GROUP BY 1"""
)
def level_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).where("language is not null and level in (1, 2, 3)").select(T.lower_trim(F.col("language")).alias("language"), "level")
    wide = rows.groupBy("language").pivot("level", [1, 2, 3]).count().na.fill(0)
    return wide.select("language", *[F.col(str(k)).alias(f"level_{k}") for k in (1, 2, 3)], (F.col("1") + F.col("2") + F.col("3")).alias("total"))


@query(f"WITH {DEDUPED} SELECT flag, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM f GROUP BY flag")
def flag_tally(spark: SparkSession, d: str) -> DataFrame:
    n = pipelines.flagged(texts(spark, d)).groupBy("flag").agg(F.count("*").alias("n"))
    return n.select("flag", "n", F.round(100.0 * F.col("n") / F.sum("n").over(pipelines.everything()), 6).alias("percent"))


@query("SELECT level, count(*) AS n FROM all_languages GROUP BY level ORDER BY n DESC, level")
def level_counts(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level")


ROLE = "CASE WHEN {0} IN ('tagalog','cebuano','bikol') THEN 'high_resource' WHEN {0} IN ('hiligaynon','minasbate','karay-a','rinconada') THEN 'low_resource' ELSE 'unknown' END"


@query(f"SELECT language, {ROLE.format('language')} AS split_role, count(doc_id) AS docs FROM all_languages GROUP BY ALL")
def split_roles(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).groupBy("language", corpus.role(F.col("language")).alias("split_role")).agg(F.count("doc_id").alias("docs"))


@query(
    "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, lower(trim(language)) AS language, level AS label, lower(trim(language)) || '_' || level AS stratum FROM all_languages "
    "WHERE lower(trim(language)) IN ('tagalog', 'cebuano', 'bikol') AND text IS NOT NULL"
)
def high_resource_positions(spark: SparkSession, d: str) -> DataFrame:
    language = T.lower_trim(F.col("language"))
    rows = texts(spark, d).where(language.isin(*L.HIGH_RESOURCE) & F.col("text").isNotNull()).select(
        "doc_id", language.alias("language"), F.col("level").alias("label"), F.concat(language, F.lit("_"), F.col("level").cast("string")).alias("stratum")
    )
    return corpus.numbered(rows, "pos", ["doc_id"])


@query("SELECT doc_id, 'tag_l' || level || '_' || printf('%03d', row_number() OVER (PARTITION BY level ORDER BY doc_id) - 1) AS id FROM all_languages WHERE lower(trim(language)) = 'tagalog' AND level IN (1, 2, 3)")
def level_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = texts(spark, d).where((T.lower_trim(F.col("language")) == "tagalog") & F.col("level").isin(1, 2, 3)).select("doc_id", "level")
    return corpus.numbered(rows, "n", ["doc_id"], within=["level"]).select("doc_id", F.format_string("tag_l%d_%03d", "level", "n").alias("id"))


FOLDS = """q AS (SELECT DISTINCT ON (doc_id) doc_id, language, label FROM high_resource_index WHERE label IN (1, 2, 3) ORDER BY doc_id),
o AS (SELECT language, label, min(doc_id) AS head FROM q GROUP BY ALL),
r AS (SELECT q.*, row_number() OVER (ORDER BY head, q.language, q.label, md5('42-' || doc_id), doc_id) - 1 AS g FROM q JOIN o ON o.language = q.language AND o.label = q.label)"""


@query(f"WITH {FOLDS} SELECT doc_id, language, label, (g % 5)::INT AS fold FROM r")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.folds(load(spark, d, "high_resource_index"))


@query(f"WITH {FOLDS} SELECT (g % 5)::INT AS fold, count(*) AS val_docs, count(DISTINCT doc_id) = count(*) AS is_disjoint, (SELECT count(*) FROM r) - count(*) AS train_docs FROM r GROUP BY 1")
def fold_integrity(spark: SparkSession, d: str) -> DataFrame:
    folds = pipelines.folds(load(spark, d, "high_resource_index"))
    per = folds.groupBy("fold").agg(F.count("*").alias("val_docs"), (F.count_distinct("doc_id") == F.count("*")).alias("is_disjoint"))
    return per.withColumn("train_docs", F.sum("val_docs").over(pipelines.everything()) - F.col("val_docs"))


@query("SELECT h.pos, h.doc_id, h.label, h.split_role, a.source FROM high_resource_index h JOIN all_languages a ON a.doc_id = h.doc_id")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    index = load(spark, d, "high_resource_index", "pos", "doc_id", "label", "split_role")
    return index.join(load(spark, d, "all_languages", "doc_id", "source"), "doc_id").select("pos", "doc_id", "label", "split_role", "source")


@query(
    """SELECT a.doc_id FROM all_languages a WHERE NOT EXISTS (SELECT 1 FROM high_resource_index h WHERE h.doc_id = a.doc_id)
AND NOT EXISTS (SELECT 1 FROM low_resource_heldout l WHERE l.doc_id = a.doc_id)"""
)
def unindexed_documents(spark: SparkSession, d: str) -> DataFrame:
    indexed = load(spark, d, "high_resource_index", "doc_id").unionByName(load(spark, d, "low_resource_heldout", "doc_id"))
    return load(spark, d, "all_languages", "doc_id").join(indexed, "doc_id", "left_anti")


# --- Evaluation ----------------------------------------------------------------------------------------------------------------------------------------------

PREDICTED = f"""t AS (SELECT doc_id, lower(trim(language)) AS language, level, {TOKENS('text')} AS words FROM all_languages WHERE level IN (1, 2, 3) AND language IS NOT NULL),
l AS (SELECT *, len(words) AS n, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS letters FROM t),
p AS (SELECT doc_id, language, (doc_id % 5)::INT AS fold, level - 1 AS y_true, CASE WHEN letters * 100 < n * 450 THEN 0 WHEN letters * 100 < n * 530 THEN 1 ELSE 2 END AS y_pred FROM l)"""


def _class_sql(by: str) -> str:
    g = f"{by}, " if by else ""
    on = f"AND a.{by} = b.{by}" if by else ""
    return f"""k AS (SELECT DISTINCT {g}y_true AS label FROM p UNION SELECT DISTINCT {g}y_pred FROM p),
c AS (SELECT {('a.' + by + ',') if by else ''} a.label, count(*) FILTER (y_true = label AND y_pred = label) AS tp, count(*) FILTER (y_true <> label AND y_pred = label) AS fp,
 count(*) FILTER (y_true = label AND y_pred <> label) AS fn FROM k a JOIN p b ON true {on} GROUP BY ALL),
m AS (SELECT {g}label, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, tp + fn AS support FROM c),
x AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)"""


def _summary_sql(by: str) -> str:
    g = f"{by}, " if by else ""
    return f"""{_class_sql(by)}, f AS (SELECT {g}avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM x {'GROUP BY ' + by if by else ''}),
b AS (SELECT {g}count(*) AS n_docs, avg((y_true = y_pred)::INT) AS accuracy, avg((abs(y_true - y_pred) >= 2)::INT) AS nonadjacent FROM p {'GROUP BY ' + by if by else ''})"""


_METRICS = ("accuracy", "nonadjacent", "macro_f1", "weighted_f1")
_ROUNDED = ", ".join(f"round({c}, 8) AS {c}" for c in _METRICS)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) for c in columns})


@query(f"WITH {PREDICTED}, {_class_sql('')} SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support FROM x")
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.per_class(predictions(spark, d)), "precision", "recall", "f1")


@query(f"WITH {PREDICTED}, {_class_sql('language')} SELECT language, label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, support FROM x")
def class_report_by_language(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.per_class(predictions(spark, d), ["language"]), "precision", "recall", "f1")


@query(f"WITH {PREDICTED}, {_summary_sql('')} SELECT n_docs, {_ROUNDED} FROM b, f")
def overall_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.summary(predictions(spark, d)), *_METRICS)


@query(f"WITH {PREDICTED}, {_summary_sql('language')} SELECT b.language, n_docs, {_ROUNDED} FROM b JOIN f ON f.language = b.language")
def per_group_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.summary(predictions(spark, d), ["language"]), *_METRICS)


@query(f"WITH {PREDICTED} SELECT y_true, " + ", ".join(f"round(count(*) FILTER (y_pred = {k}) / count(*), 4) AS p{k}" for k in (0, 1, 2)) + " FROM p GROUP BY y_true")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(predictions(spark, d))


@query(
    f"""WITH {PREDICTED}, {_summary_sql('fold')}, r AS (SELECT round(accuracy, 4) AS a, round(macro_f1, 4) AS m FROM b JOIN f ON f.fold = b.fold)
SELECT round(avg(m), 8) AS mean_macro_f1, round(stddev_pop(m), 8) AS std_macro_f1, round(avg(a), 8) AS mean_accuracy, round(stddev_pop(a), 8) AS std_accuracy FROM r"""
)
def fold_summary(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.fold_summary(predictions(spark, d)), "mean_macro_f1", "std_macro_f1", "mean_accuracy", "std_accuracy")


@query(
    f"""WITH {PREDICTED.replace('p AS (', 'p0 AS (')}, pa AS (SELECT * REPLACE (1 AS y_pred) FROM p0), pb AS (SELECT * FROM p0),
{_summary_sql('language').replace(' p ', ' pa ').replace('p b ON', 'pa b ON').replace('FROM p', 'FROM pa').replace('FROM paa', 'FROM pa')}, fa AS (SELECT language, macro_f1 AS f1_a FROM f),
{_summary_sql('language').replace('k AS', 'k2 AS').replace('c AS (', 'c2 AS (').replace('m AS (', 'm2 AS (').replace('x AS (', 'x2 AS (').replace(', f AS (', ', f2 AS (').replace('b AS (SELECT', 'b2 AS (SELECT').replace('FROM k a JOIN p b', 'FROM k2 a JOIN pb b').replace('FROM c)', 'FROM c2)').replace('FROM m)', 'FROM m2)').replace('FROM x ', 'FROM x2 ').replace('FROM p', 'FROM pb').replace('FROM pbb', 'FROM pb')},
fb AS (SELECT language, macro_f1 AS f1_b FROM f2)
SELECT coalesce(fa.language, fb.language) AS language, round(f1_a, 8) AS f1_a, round(f1_b, 8) AS f1_b, round(f1_b - f1_a, 8) AS delta, coalesce(f1_b - f1_a, 0) >= 0.03 AS accepted FROM fa FULL JOIN fb ON fa.language = fb.language"""
)
def ab_delta(spark: SparkSession, d: str) -> DataFrame:
    rule = predictions(spark, d)
    return _round(evaluate.delta(rule.withColumn("y_pred", F.lit(1)), rule, "language", L.DELTA), "f1_a", "f1_b", "delta")


@query(
    f"""WITH {SHAPED}, v AS (SELECT doc_id, {TRAD_SQL} FROM s), z AS (SELECT avg(mean_word_len) AS m, stddev_pop(mean_word_len) AS s FROM v)
SELECT doc_id, round((mean_word_len - m) / nullif(z.s, 0), 6) AS z_word_len FROM v, z"""
)
def standardize(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.standardized(trad_features(spark, d), "mean_word_len").select("doc_id", F.round("z", 6).alias("z_word_len"))


@query()
def forest_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    from .operators import model

    rows = pipelines.fold_features(texts(spark, d), load(spark, d, "high_resource_index"), load(spark, d, "anchor_ngrams"))
    return model.cross_validated(rows, pipelines.FEATURES)


# --- Validation ----------------------------------------------------------------------------------------------------------------------------------------------


@query()
def perceptron_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    from .operators import model

    rows = pipelines.fold_features(texts(spark, d), load(spark, d, "high_resource_index"), load(spark, d, "anchor_ngrams"))
    return model.perceptron_cross_validated(rows, pipelines.FEATURES)


@query()
def zero_shot_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by language of a perceptron trained on the languages of the index and applied to the held-out ones."""
    from .operators import model

    anchors = load(spark, d, "anchor_ngrams")
    train = pipelines.fold_features(texts(spark, d), load(spark, d, "high_resource_index"), anchors)
    pred = model.transferred(train, pipelines.heldout_features(texts(spark, d), load(spark, d, "low_resource_heldout"), anchors), pipelines.FEATURES)
    return _round(evaluate.summary(materialize(pred, "transferred"), ["language"]), *_METRICS)


@query()
def corpus_build(spark: SparkSession, d: str) -> DataFrame:
    """The whole build: cleaners by language, marks, duplicates, emission, normalization."""
    return pipelines.build(texts(spark, d, "title"))


@query()
def forest_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the forest on its own out-of-fold predictions, by language and over all."""
    pred = materialize(forest_cross_validation(spark, d), "forest-predictions")
    by = evaluate.summary(pred, ["language"]).unionByName(evaluate.summary(pred).select(F.lit("all").alias("language"), "*"))
    return _round(by, *_METRICS)


@query()
def idempotence_check(spark: SparkSession, d: str) -> DataFrame:
    once = documents(spark, d).where("text is not null").select("doc_id", T.normalize(F.col("text")).alias("once"))
    return once.select("doc_id", (T.normalize(F.col("once")) == F.col("once")).alias("stable"))


@query(
    "SELECT doc_id, list_sort(regexp_extract_all(nfc_normalize(text), '\\p{L}')) = list_sort(regexp_extract_all(nfc_normalize(" + NORMAL + "), '\\p{L}')) AS kept FROM documents WHERE text IS NOT NULL"
)
def grapheme_check(spark: SparkSession, d: str) -> DataFrame:
    both = documents(spark, d).where("text is not null").select("doc_id", T.nfc(F.col("text")).alias("a"), T.normalize(F.col("text")).alias("b"))
    return both.select("doc_id", (audit.letters_sorted(F.col("a")) == audit.letters_sorted(F.col("b"))).alias("kept"))


@query()
def leakage_scan(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).where("text is not null").select("doc_id", audit.leaks(F.col("text")).alias("leaks"), (T.word_count(F.col("text")) < L.MIN_WORDS).alias("degenerate"))


@query()
def raw_vs_clean_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Mean words before and after the removal of foreign sentences, by language."""
    kept = texts(spark, d).where("text is not null").select("language", "text", clean.drop_english(F.col("text")).alias("clean"))
    n = kept.select("language", T.word_count(F.col("text")).alias("raw"), T.word_count(F.col("clean")).alias("kept"))
    return n.groupBy("language").agg(F.avg("raw").alias("raw"), F.avg("kept").alias("kept"), F.avg(F.col("raw") - F.col("kept")).alias("removed"))


@query()
def removed_spans(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.removed(texts(spark, d, "title"))


@query()
def span_categories(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.span_ledger(texts(spark, d, "title"))


@query()
def cleaning_findings(spark: SparkSession, d: str) -> DataFrame:
    return audit.findings(pipelines.removed(texts(spark, d, "title")))


@query(
    """SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, count(*) FILTER (level IS NULL OR level NOT IN (1, 2, 3)) AS bad_labels, count(*) FILTER (text IS NULL) AS null_texts,
 sum(n_chars IS DISTINCT FROM length(text))::BIGINT AS wrong_lengths FROM documents"""
)
def corpus_integrity(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return docs.agg(
        F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.coalesce(~F.col("level").isin(1, 2, 3), F.lit(True))).alias("bad_labels"),
        F.count_if(F.col("text").isNull()).alias("null_texts"), F.count_if(~F.col("n_chars").eqNullSafe(F.length("text"))).alias("wrong_lengths"),
    )


@query("SELECT a.doc_id, a.level AS left_value, h.label AS right_value FROM all_languages a JOIN (SELECT DISTINCT doc_id, label FROM high_resource_index) h ON a.doc_id = h.doc_id WHERE a.level IS DISTINCT FROM h.label")
def stale_labels(spark: SparkSession, d: str) -> DataFrame:
    index = load(spark, d, "high_resource_index").select("doc_id", F.col("label").alias("level")).distinct()
    stored = load(spark, d, "all_languages", "doc_id", "level").join(index.select("doc_id"), "doc_id", "left_semi")
    return audit.differing(stored, index, "doc_id", "level")


@query()
def reproduction(spark: SparkSession, d: str) -> DataFrame:
    """Word and sentence counts of the texts against an answer key by (title, level) made from the normalized texts, the last row of a key winning."""
    rows = documents(spark, d).where("text is not null").select("doc_id", "title", "level", T.word_count(F.col("text")).alias("words"), F.size(T.sentences(F.col("text"))).alias("sents"))
    normal = documents(spark, d).where("text is not null and title is not null and level is not null").select("doc_id", "title", "level", T.normalize(F.col("text")).alias("text"))
    key = normal.select("doc_id", "title", "level", T.word_count(F.col("text")).alias("words"), F.size(T.sentences(F.col("text"))).alias("sents"))
    return pipelines.against_key(rows, key)


# --- Streaming -----------------------------------------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from .streaming import streams

    return streams.hourly(load(spark, d, "events")).select("event_type", "hour", "n", F.round("total", 4).alias("total"))


def _all() -> None:
    from . import file_queries, part_queries  # noqa: F401  (they register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
