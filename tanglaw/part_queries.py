"""Queries of the parts of the cleaners and the validation, each with its SQL. Texts get phrases of the kinds that the parts look for before and after them, the same in both engines, as the tables hold few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexicon as L
from .functions import text as T
from .operators import audit, clean, corpus
from .plans import pipelines
from .queries import BARE, COLLAPSE, ENGLISH_RATIO, NORMAL, SENTENCES, SHAPED, SQL, STRIP, TRAD_SQL, WORDS, documents, query, texts, trad_features
from .sources.tables import load


def RE(pattern: str) -> str:
    """A Java pattern in Unicode mode as one for RE2, within an SQL string."""
    out, inside, k = "", False, 0
    spaces = L.WS[1:-1]
    kinds = {"s": (L.WS, spaces), "S": (L.NOT_WS, None), "w": (r"[\p{L}\p{M}\p{N}_]", r"\p{L}\p{M}\p{N}_"), "d": (r"\p{Nd}", r"\p{Nd}")}
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and pattern[k + 1] in kinds:
            out += kinds[pattern[k + 1]][inside]
            k += 2
        elif c == "\\":
            out += pattern[k : k + 2]
            k += 2
        else:
            inside = c == "[" or (inside and c != "]")
            out += c
            k += 1
    return out.replace("'", "''")


def REMOVE(x: str, pattern: str, new: str = " ") -> str:
    return f"regexp_replace({x}, '{RE(pattern)}', '{new}', 'g')"


def CUT(x: str, pattern: str) -> str:
    """``x`` up to the first hit."""
    return f"regexp_replace({x}, '(?:{RE(pattern)})(?s:.*)', '')"


def CUT_FROM(x: str, patterns: tuple[str, ...], least: int) -> str:
    ends = [f"CASE WHEN regexp_matches({x}, '{RE(p)}') AND length({CUT(x, p)}) >= {least - 1} THEN length({CUT(x, p)}) END" for p in patterns]
    return f"coalesce(substr({x}, 1, least({', '.join(ends)})::BIGINT), {x})" if len(ends) > 1 else f"coalesce(substr({x}, 1, ({ends[0]})::BIGINT), {x})"


def LIST(words: list[str]) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


BEFORE = (
    "A book of CANVAS is free. Salamat. ", "Ubos sa pagtambag ni Ana Cruz sa Liwayway Publications, Manila ", "Cebuano Story Book ", "Pinulongan: Cebuano, ", "Ang Aso, 2, Ang ",
    "Ang Aso Sa Dalan Si Ana naglakaw. ", "The lion and the cow were with the bird. ", "Department of Education Region V Ang bata. ", "Karapatang-ari ng Kagawaran. ",
)
AFTER = (
    " KATAPUSAN Room to Read", " Dapit sa Kagsurat Si Ana taga Naga.", " 1. Sino? 2. Saan? 3. Kailan?", "\nAktibidad\nIsulat.", " Mga Tanong 1. Sino siya?", " 12 34 56 78 ", " Released under CC BY 4.0", " Tabang sa Pag-aadal", "",
)


def _phrases(choices: tuple[str, ...], step: int) -> str:
    return f"CASE (doc_id + {step}) % {len(choices)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(choices)) + " END"


#: The text with phrases, for DuckDB; Spark reads line breaks in strings alike.
PLANTED = f"concat({_phrases(BEFORE, 0)}, text, {_phrases(AFTER, 3)})"
RAW = f"p AS (SELECT doc_id, language, level, title, text AS raw, {PLANTED} AS t FROM all_languages WHERE text IS NOT NULL)"


def planted(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, language, level, title, raw, t): texts of all_languages, t with the phrases."""
    cases = [F.expr(_phrases(x, k).replace("\n", "\\n")) for x, k in ((BEFORE, 0), (AFTER, 3))]
    return texts(spark, d, "title").where("text is not null").select("doc_id", "language", "level", "title", F.col("text").alias("raw"), F.concat(cases[0], F.col("text"), cases[1]).alias("t"))


def _part(name: str, sql: str, build) -> None:
    """Register a part: (doc_id, text) of ``build`` on the planted texts."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return planted(spark, d).select("doc_id", build(F.col("t")).alias("text"))

    run.__name__ = name
    query(f"WITH {RAW} SELECT doc_id, {sql} AS text FROM p")(run)


def _guarded(word: str, x: str, pattern: str) -> str:
    return f"CASE WHEN contains(lower({x}), '{word}') THEN {REMOVE(x, pattern)} ELSE {x} END"


_part("canvas_strip", _guarded("canvas", "t", L.CANVAS), clean.drop_canvas)
_part("editorial_strip", _guarded("pagtambag", "t", L.EDITORIAL), clean.drop_editorial)
_part("genre_strip", REMOVE(REMOVE("t", L.GENRE_TAG), L.GENRE_PHRASE), clean.drop_genre)
_part("end_marker_cut", CUT("t", r"\bKATAPUSAN\b"), lambda t: clean.cut_at(t, r"\bKATAPUSAN\b"))
_part("page_tail_cut", CUT("t", L.BASAHA_TAIL), lambda t: clean.cut_at(t, L.BASAHA_TAIL))
_part("earliest_tail_cut", CUT_FROM("t", (L.TL_QUESTIONS, L.TL_PUBLISHER, L.TL_INSTITUTION), 41), lambda t: clean.cut_at_earliest(t, (L.TL_QUESTIONS, L.TL_PUBLISHER, L.TL_INSTITUTION), 41))
_part("container_prefix_strip", r"regexp_replace(t, '^" + L.WS + r"*[^,\n]{1,60}," + L.WS + r"*[1-3]" + L.WS + r"*," + L.WS + r"*(\p{Lu})', '\1')", lambda t: clean.remove(t, L.TL_CONTAINER_JAVA, ""))
_part("boilerplate_strip", REMOVE(REMOVE("t", L.TL_BOILERPLATE), L.TL_LABEL), lambda t: clean.remove(clean.remove(t, L.TL_BOILERPLATE), L.TL_LABEL))
_part("structure_strip", REMOVE("t", L.TL_STRUCTURE), lambda t: clean.remove(t, L.TL_STRUCTURE))


def BIO(x: str) -> str:
    before = CUT(x, L.BIO_TAIL)
    return f"CASE WHEN regexp_matches({x}, '{RE(L.BIO_TAIL)}') THEN {STRIP(f'''coalesce(nullif(regexp_extract({before}, '(?s)^(.*[.!?])', 1), ''), {before})''')} ELSE {x} END"


_part("bio_tail_cut", BIO("t"), clean.bio_tail)


def TITLE_AGAIN(x: str) -> str:
    title, rest = (f"regexp_extract({x}, '{RE(L.TITLE_REPEAT)}', {k})" for k in (1, 2))
    return f"CASE WHEN {rest} <> '' AND len(regexp_extract_all({title}, '\\p{{Lu}}\\p{{Ll}}')) >= 2 AND len({WORDS(rest)}) >= 3 THEN {rest} END"


def CAPTION(x: str) -> str:
    pattern = RE(r"(?s)^\s*(.*?[.!?])(\s+)(\p{Lu}.*)$")
    first, rest = f"regexp_extract({x}, '{pattern}', 1)", f"regexp_extract({x}, '{pattern}', 3)"
    return f"CASE WHEN {rest} <> '' AND len({BARE(first)}) >= 4 AND {ENGLISH_RATIO(first)} >= 0.6 AND len({WORDS(rest)}) >= 3 THEN {rest} END"


def QUESTIONS(x: str) -> str:
    run = f"regexp_extract({x}, '{RE(L.NUMBERED)}', 0)"
    return f"CASE WHEN {run} <> '' AND len(regexp_extract_all({run}, '\\?')) >= 2 THEN regexp_replace({CUT(x, L.NUMBERED)}, '{RE(L.QA_HEAD)}', '', 'g') ELSE {x} END"


_part("title_repeat_cut", f"coalesce({TITLE_AGAIN('t')}, t)", lambda t: F.coalesce(clean.title_repeat(t), t))
_part("english_caption_cut", f"coalesce({CAPTION('t')}, t)", lambda t: F.coalesce(clean.english_caption(t), t))
_part("question_cut", QUESTIONS("t"), clean.cut_questions)


@query(
    f"WITH {RAW} SELECT doc_id, regexp_matches(t, '{RE(L.DIGIT_INTERLEAVE)}') AS digits, regexp_matches(t, '{RE(L.BIKOL_SIGNAL)}') AS bilingual, regexp_matches(t, '{RE(L.BIO_TAIL)}') AS bio FROM p"
)
def text_signals(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return planted(spark, d).select("doc_id", t.rlike(L.DIGIT_INTERLEAVE).alias("digits"), t.rlike("(?U)" + L.BIKOL_SIGNAL).alias("bilingual"), clean.has_bio_tail(t).alias("bio"))


TOKENS_OF_SENTENCE = "list_filter(list_transform(" + WORDS("s") + ", lambda w: regexp_replace(w, '^{0}+|{0}+$', '', 'g')), lambda w: regexp_matches(w, '\\p{{L}}'))".format("[.,!?\"''()\\[\\]:;·—–“”’]")
SENTENCE_LIST = f"string_split(regexp_replace(t, '([.!?]){L.WS}+', '\\1' || chr(1), 'g'), chr(1))"
META_SQL = f"""(n = 0 OR regexp_matches(s, '{RE(L.LEVEL_META)}') OR (n >= 3 AND english >= 0.5) OR (caps >= 2 AND native = 0) OR (n >= 4 AND native = 0 AND plain >= 0.7 * n))"""
SENTENCES_SQL = f"""x AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS place FROM (SELECT doc_id, {SENTENCE_LIST} AS l FROM p)),
k AS (SELECT doc_id, place, s, {TOKENS_OF_SENTENCE} AS w FROM x),
c AS (SELECT doc_id, place, s, len(w) AS n, len(list_filter(w, lambda x: list_contains({LIST(L.LEVEL_NATIVE)}, lower(x)))) AS native,
 coalesce(len(list_filter(w, lambda x: list_contains({LIST(L.TL_ENGLISH)}, lower(x)))) / nullif(len(w), 0), 0) AS english,
 len(list_filter(w, lambda x: length(x) >= 2 AND regexp_matches(x, '\\p{{Lu}}') AND upper(x) = x)) AS caps, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]+$'))) AS plain FROM k),
m AS (SELECT doc_id, place, {META_SQL} AS meta, CASE WHEN {META_SQL} OR regexp_matches({STRIP('s')}, '\\?$') OR n < 4 OR english >= 0.25 OR caps > greatest(2, floor(n / 4)) THEN -1 ELSE native END AS score FROM c)"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return planted(spark, d).select("doc_id", F.posexplode(F.split("t", rf"(?<=[.!?]){L.WS}+")).alias("place", "s"))


@query(f"WITH {RAW}, {SENTENCES_SQL} SELECT doc_id, place::INT AS place, meta, score::INT AS score FROM m")
def sentence_scores(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    return _sentences(spark, d).select("doc_id", (F.col("place") + 1).alias("place"), clean.is_meta(s).alias("meta"), clean.narrative_score(s).cast("int").alias("score"))


@query(
    f"""WITH {RAW}, {SENTENCES_SQL} SELECT doc_id, count(*) FILTER (score >= 3) > 0 OR count(*) FILTER (score >= 2) >= 2 AS is_story,
 coalesce(min(place) FILTER (score >= 2), 0)::INT AS first FROM m WHERE NOT meta GROUP BY doc_id"""
)
def story_gate(spark: SparkSession, d: str) -> DataFrame:
    told = _sentences(spark, d).where(~clean.is_meta(F.col("s"))).select("doc_id", "place", clean.narrative_score(F.col("s")).alias("score"))
    first = F.coalesce(F.min(F.when(F.col("score") >= 2, F.col("place") + 1)), F.lit(0)).cast("int").alias("first")
    return told.groupBy("doc_id").agg(((F.count_if(F.col("score") >= 3) > 0) | (F.count_if(F.col("score") >= 2) >= 2)).alias("is_story"), first)


@query(
    f"""WITH {RAW}, f AS (SELECT doc_id, level, regexp_extract(t, '^.{{1,100}}?,{L.WS}*([0-9]+){L.WS}*,{L.WS}*', 1) AS hit, t FROM p)
SELECT doc_id, CASE WHEN hit = level::VARCHAR THEN regexp_replace(t, '^.{{1,100}}?,{L.WS}*[0-9]+{L.WS}*,{L.WS}*', '') ELSE t END AS text FROM f"""
)
def level_container_strip(spark: SparkSession, d: str) -> DataFrame:
    return planted(spark, d).select("doc_id", clean.strip_container(F.col("t"), F.col("level")).alias("text"))


@query(f"WITH {RAW} SELECT doc_id, {REMOVE(REMOVE(REMOVE(REMOVE(REMOVE(REMOVE('t', L.LEVEL_CREDIT), L.LEVEL_CREDIT), L.LEVEL_CREDIT), L.LEVEL_CREDIT), L.LEVEL_CREDIT_NOUN), L.LEVEL_ORPHAN)} AS text FROM p")
def level_credit_strip(spark: SparkSession, d: str) -> DataFrame:
    out = planted(spark, d)
    for _ in range(4):
        out = out.withColumn("t", clean.remove(F.col("t"), L.LEVEL_CREDIT))
    return out.select("doc_id", clean.remove(clean.remove(F.col("t"), L.LEVEL_CREDIT_NOUN), L.LEVEL_ORPHAN).alias("text"))


# --- What the cleaners are checked by ------------------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, language, level, {NORMAL} AS text FROM (SELECT doc_id, lang AS language, level, text FROM documents) WHERE text IS NOT NULL AND {NORMAL} <> ''")
def normalized_corpus(spark: SparkSession, d: str) -> DataFrame:
    out = documents(spark, d).select("doc_id", F.col("lang").alias("language"), "level", T.normalize(F.col("text")).alias("text"))
    return out.where("text is not null and text <> ''")


@query(f"SELECT doc_id, len({WORDS('text')}) AS words FROM documents WHERE text IS NOT NULL AND len({WORDS('text')}) >= 8")
def long_enough(spark: SparkSession, d: str) -> DataFrame:
    return clean.long_enough(documents(spark, d), "text").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(
    f"""WITH {RAW} SELECT doc_id, len(regexp_extract_all(raw, '\\p{{L}}+')) > 0 AND len(regexp_extract_all({CUT('raw', L.LEVEL_PUBLISHER)}, '\\p{{L}}+')) = 0 AS over_deleted FROM p"""
)
def over_deletion_check(spark: SparkSession, d: str) -> DataFrame:
    return planted(spark, d).select("doc_id", audit.over_deleted(F.col("raw"), clean.cut_at(F.col("raw"), L.LEVEL_PUBLISHER)).alias("over_deleted"))


@query(
    """SELECT a.doc_id, lower(trim(a.language)) AS language, a.level AS label, a.source, 'low_resource' AS split_role FROM all_languages a
WHERE lower(trim(a.language)) IN ('hiligaynon', 'minasbate', 'karay-a', 'rinconada') AND a.text IS NOT NULL"""
)
def heldout_set(spark: SparkSession, d: str) -> DataFrame:
    language = T.lower_trim(F.col("language"))
    rows = load(spark, d, "all_languages", "doc_id", "language", "level", "source", "text").where(language.isin(*L.LOW_RESOURCE) & F.col("text").isNotNull())
    return rows.select("doc_id", language.alias("language"), F.col("level").alias("label"), "source", corpus.role(language).alias("split_role"))


@query(f"WITH p AS (SELECT doc_id, text AS raw, {NORMAL} AS clean FROM documents WHERE text IS NOT NULL) SELECT doc_id, len({WORDS('raw')}) AS raw_words, len({WORDS('clean')}) AS clean_words FROM p")
def raw_and_clean(spark: SparkSession, d: str) -> DataFrame:
    """The raw-and-clean table, its sides checked against each other and the source by key before it is given out."""
    raw = documents(spark, d).where("text is not null").select("doc_id", "text")
    both = raw.select("doc_id", F.col("text").alias("raw"), T.normalize(F.col("text")).alias("clean"))
    checked = audit.assert_aligned(both.select("*", F.col("raw").alias("text")), raw, "doc_id", "text")
    return checked.select("doc_id", T.word_count(F.col("raw")).alias("raw_words"), T.word_count(F.col("clean")).alias("clean_words"))




# --- SQL of queries that stand elsewhere ----------------------------------------------------------------------------------------------------------------------

SQL["idempotence_check"] = f"WITH o AS (SELECT doc_id, {NORMAL} AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, {NORMAL} = text AS stable FROM o"
SQL["leakage_scan"] = (
    f"SELECT doc_id, regexp_matches(text, '(?i:{RE(L.PUBLISHER)})') OR {ENGLISH_RATIO('text')} >= {L.ENGLISH_HEAVY} AS leaks, len({WORDS('text')}) < {L.MIN_WORDS} AS degenerate "
    "FROM all_languages WHERE text IS NOT NULL"
)
_NOISE = "text"
for _p in (L.JUNK_GLYPHS, "_{2,}", L.PRODUCT_CODE, L.PAGE_BANNER, L.EMPTY_QUOTES):
    _NOISE = REMOVE(_NOISE, _p)
SQL["strip_noise"] = f"SELECT doc_id, {_NOISE} AS text FROM documents"

# A pattern that looks ahead at a letter is applied twice with that letter captured.
_FIRST = "text"
for _p, _r in (
    ("&nbsp;", " "), ("&amp;", "&"), (r"&#\d+;", ""), (rf"([,.!?;:\"'»\)]){L.WS}*(\p{{L}})", r"\1 \2"), (rf"([,.!?;:\"'»\)]){L.WS}*(\p{{L}})", r"\1 \2"),
    (rf"(\p{{L}}){L.WS}*-{L.WS}*(\p{{L}})", r"\1-\2"), (rf"(\p{{L}}){L.WS}*-{L.WS}*(\p{{L}})", r"\1-\2"), (r"(\p{L})-{2,}(\p{L})", r"\1-\2"), (r"(\p{L})-{2,}(\p{L})", r"\1-\2"),
    (f"{L.WS}*[—–]{L.WS}*", " — "), (r"[ \t]+", " "), (r" +\n", "\n"),
):
    _FIRST = f"regexp_replace({_FIRST}, '{_p.replace(chr(39), chr(39) * 2)}', '{_r}', 'g')"
SQL["normalize_first_generation"] = f"SELECT doc_id, {STRIP(_FIRST)} AS text FROM documents"

_TL = "list_filter(list_transform(" + WORDS("s") + ", lambda w: lower(regexp_replace(w, '^{0}+|{0}+$', '', 'g'))), lambda w: regexp_matches(w, '\\p{{L}}'))".format("[.,!?\"''()\\[\\]:;·—–]")
SQL["english_sentences_dropped"] = f"""WITH x AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS place FROM (SELECT doc_id, {SENTENCE_LIST.replace('(t,', '(text,')} AS l FROM all_languages WHERE text IS NOT NULL)),
k AS (SELECT doc_id, place, s, {_TL} AS w FROM x), c AS (SELECT *, len(w) AS n, len(list_filter(w, lambda v: list_contains({LIST(L.TL_FUNC)}, v))) AS native, len(list_filter(w, lambda v: list_contains({LIST(L.TL_ENGLISH)}, v))) AS english FROM k)
SELECT doc_id, coalesce(string_agg(s, ' ' ORDER BY place) FILTER (NOT (n >= 5 AND native = 0) AND NOT (n >= 3 AND english / n >= 0.55)), '') AS text FROM c GROUP BY doc_id"""

_WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]"
SQL["title_strip"] = f"""WITH p AS (SELECT doc_id, {COLLAPSE('text')} AS t, {COLLAPSE('title')} AS h FROM documents),
e AS (SELECT *, length(h) > 0 AND starts_with(lower(t), lower(h)) AND CASE WHEN regexp_matches(right(h, 1), '{_WORD}') THEN NOT regexp_matches(substr(t, length(h) + 1, 1), '{_WORD}')
 ELSE regexp_matches(substr(t, length(h) + 1, 1), '{_WORD}') END AS opens FROM p)
SELECT doc_id, CASE WHEN coalesce(opens, false) THEN ltrim(substr(t, length(h) + 1)) ELSE t END AS text FROM e"""

SQL["narrative_start"] = f"""WITH w AS (SELECT doc_id, string_split({COLLAPSE('text')}, ' ') AS tokens FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM w),
c AS (SELECT *, regexp_replace(token, '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g') AS core FROM x),
f AS (SELECT *, regexp_matches(core, '^\\p{{Ll}}') AND NOT list_contains({LIST(L.ENG_STOP)}, lower(core)) AS low FROM c),
n AS (SELECT *, coalesce(lead(low) OVER o, false) AS one, coalesce(lead(low, 2) OVER o, false) AS two FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT doc_id, min(i) FILTER (core <> '' AND NOT regexp_matches(core, '^\\p{{Ll}}') AND (one OR (list_contains({LIST(L.OPENERS)}, lower(core)) AND two))) AS first FROM n GROUP BY doc_id),
s AS (SELECT w.doc_id, first IS NOT NULL AS started, CASE WHEN first > 1 THEN array_to_string(tokens[1:first - 1], ' ') ELSE '' END AS skipped FROM w JOIN b USING (doc_id))
SELECT doc_id, started, length(skipped)::INT AS skipped, CASE WHEN NOT started THEN 'no_opener' WHEN skipped = '' OR regexp_matches(skipped, '{RE(L.META_WORD)}') THEN '' ELSE 'residual_prefix' END AS flag FROM s"""

_KEPT = SQL["english_sentences_dropped"].split("SELECT doc_id, coalesce(string_agg", 1)
SQL["raw_vs_clean_lengths"] = (
    _KEPT[0] + ", kept AS (SELECT doc_id, coalesce(string_agg" + _KEPT[1] + f") SELECT language, avg(raw) AS raw, avg(n) AS kept, avg(raw - n) AS removed FROM (SELECT a.language, len({WORDS('a.text')})::DOUBLE AS raw, "
    f"len({WORDS('kept.text')})::DOUBLE AS n FROM all_languages a JOIN kept ON kept.doc_id = a.doc_id) GROUP BY language"
)
SQL["reproduction"] = f"""WITH x AS (SELECT doc_id, title, level, len({WORDS('text')}) AS words, len({SENTENCES('text')}) AS sents, len({WORDS(NORMAL)}) AS w, len({SENTENCES(NORMAL)}) AS s FROM documents WHERE text IS NOT NULL),
k AS (SELECT title, level, max_by(w, doc_id) AS w, max_by(s, doc_id) AS s, max(doc_id) AS doc_id FROM x WHERE title IS NOT NULL AND level IS NOT NULL GROUP BY title, level)
SELECT count(*) FILTER (x.words = k.w AND x.sents = k.s) AS both_match, count(*) FILTER (x.words = k.w) AS word_match, count(*) FILTER (k.doc_id IS NULL) AS missing FROM x LEFT JOIN k ON k.title = x.title AND k.level = x.level"""


@query(f"SELECT doc_id, n_chars AS left_value, length({NORMAL})::BIGINT AS right_value FROM documents WHERE n_chars IS DISTINCT FROM length({NORMAL})")
def stale_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose stored length isn't that of their text as it is normalized now."""
    stored = load(spark, d, "documents", "doc_id", "n_chars")
    now = documents(spark, d).select("doc_id", F.length(T.normalize(F.col("text"))).cast("bigint").alias("n_chars"))
    return audit.differing(stored, now, "doc_id", "n_chars")


@query(
    f"""WITH {SHAPED}, v AS (SELECT s.doc_id, {TRAD_SQL} FROM s), f AS (SELECT doc_id, mean_word_len AS x, (doc_id % 5)::INT AS fold FROM v),
o AS (SELECT k.fold, avg(x) AS m, stddev_pop(x) AS dev FROM f JOIN (SELECT DISTINCT fold FROM f) k ON k.fold <> f.fold GROUP BY k.fold)
SELECT doc_id, f.fold, round((x - m) / nullif(dev, 0), 6) AS z FROM f JOIN o ON o.fold = f.fold"""
)
def standardize_by_fold(spark: SparkSession, d: str) -> DataFrame:
    """Each fold scaled by the mean and deviation of the other folds; these come from sums of the folds, in one pass."""
    rows = trad_features(spark, d).select("doc_id", F.col("mean_word_len").alias("x"), (F.col("doc_id") % 5).cast("int").alias("fold"))
    return pipelines.standardized_by_fold(rows, "x").select("doc_id", "fold", F.round("z", 6).alias("z"))


# --- Composed cleaners and their folds over tokens -------------------------------------------------------------------------------------------------------------

_NATIVE_WORD = "|".join(L.NATIVE_FUNC)
_PUB = f"(?i:{RE(L.PUBLISHER)})"
_MARK = f"regexp_extract(body, '{_PUB}', 0)"
_BEFORE = f"regexp_replace(body, '{_PUB}(?s:.*)', '')"
_AFTER = f"substr(body, length({_BEFORE}) + length({_MARK}) + 1)"
_RESUMED = r"regexp_replace(after, '(?is)^(?:.*?[^\p{L}])??((?:" + _NATIVE_WORD + r")(?:[^\p{L}].*)?)$', '\1')"


@query(
    f"""WITH RECURSIVE {RAW}, w AS (SELECT doc_id, t AS body, '' AS flag, false AS done, 0 AS k FROM p
UNION ALL SELECT doc_id, CASE WHEN NOT hit THEN body WHEN tail THEN before ELSE trim(before || ' ' || CASE WHEN natives > 0 THEN {_RESUMED} ELSE '' END) END,
 CASE WHEN hit AND NOT tail AND flag = '' THEN 'pub_marker_in_body' ELSE flag END, NOT hit OR tail, k + 1
 FROM (SELECT *, natives <= 3 AS tail FROM (SELECT *, len(list_filter(regexp_extract_all(lower(after), '\\p{{L}}+'), lambda x: list_contains({LIST(L.NATIVE_FUNC)}, x))) AS natives
 FROM (SELECT doc_id, body, flag, k, regexp_matches(body, '{_PUB}') AS hit, {_BEFORE} AS before, {_AFTER} AS after FROM w WHERE NOT done AND k < 10))))
SELECT doc_id, arg_max(body, k) AS text, arg_max(flag, k) AS flag FROM w GROUP BY doc_id"""
)
def publisher_walk(spark: SparkSession, d: str) -> DataFrame:
    """The walk over publisher marks of the texts, each with a mark before and after it."""
    out = planted(spark, d).withColumn("s", clean.walk_publishers(F.col("t"), F.lit("")))
    return out.select("doc_id", F.col("s.body").alias("text"), F.col("s.flag").alias("flag"))


_NAME_END = r"[.,!?\"''’()\[\]:;\-–—]"
_CORE = f"regexp_replace(token, '^{_NAME_END}+|{_NAME_END}+$', '', 'g')"
_TITLED = f"regexp_matches(core, '^\\p{{Lu}}') AND NOT list_contains({LIST(L.LEVEL_NATIVE)}, lower(core))"
TOKEN_ROWS = f"""x AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {WORDS('t')} AS l FROM p)),
c AS (SELECT *, {_CORE} AS core FROM x)"""


@query(
    f"""WITH {RAW}, {TOKEN_ROWS}, f AS (SELECT doc_id, i, token, {_TITLED} AND NOT (regexp_matches(core, '\\p{{Lu}}') AND upper(core) = core) AS name FROM c),
b AS (SELECT *, CASE WHEN name AND coalesce(lag(name) OVER o, false) AND NOT coalesce(regexp_matches(lag(token) OVER o, '[.!?]$'), false) THEN 0 ELSE 1 END AS fresh FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS size FROM g)
SELECT p.doc_id, coalesce(string_agg(token, ' ' ORDER BY i) FILTER (NOT (name AND size >= 4)), '') AS text FROM p LEFT JOIN n ON n.doc_id = p.doc_id GROUP BY p.doc_id"""
)
def name_run_strip(spark: SparkSession, d: str) -> DataFrame:
    return planted(spark, d).select("doc_id", clean.strip_name_runs(F.col("t")).alias("text"))


@query(
    f"""WITH {RAW}, {TOKEN_ROWS}, f AS (SELECT doc_id, i, token, {_TITLED} AS name FROM c),
s AS (SELECT doc_id, coalesce(min(i) FILTER (i <= 14 AND NOT name) - 1, least(count(*), 14)) AS names, count(*) AS n, min(token) FILTER (i = 1) AS one, min(token) FILTER (i = 2) AS two FROM f GROUP BY doc_id),
q AS (SELECT *, regexp_replace(one, '^[\".,!?]+|[\".,!?]+$', '', 'g') AS stub FROM s),
r AS (SELECT doc_id, CASE WHEN names >= 2 THEN names WHEN n > 1 AND length(stub) <= 2 AND NOT list_contains({LIST("si sa ng ay na at ni o ba pa po ho ka ko mo a".split())}, lower(stub)) AND regexp_matches(two, '^\\p{{Lu}}') THEN 1 ELSE 0 END AS cut FROM q)
SELECT p.doc_id, CASE WHEN coalesce(cut, 0) > 0 THEN array_to_string(({WORDS('t')})[cut + 1:], ' ') ELSE t END AS text FROM p LEFT JOIN r ON r.doc_id = p.doc_id"""
)
def leading_name_strip(spark: SparkSession, d: str) -> DataFrame:
    return planted(spark, d).select("doc_id", clean.strip_leading_names(F.col("t")).alias("text"))


@query(
    f"""WITH {RAW}, x AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS place FROM (SELECT doc_id, {SENTENCE_LIST} AS l FROM p)),
g AS (SELECT *, NOT (regexp_matches({STRIP('s')}, '\\?$') OR len(list_filter({WORDS('s')}, lambda w: regexp_matches(w, '\\p{{L}}'))) < 3) AS good FROM x),
e AS (SELECT *, max(place) FILTER (good) OVER (PARTITION BY doc_id) AS last FROM g)
SELECT doc_id, coalesce(string_agg(s, ' ' ORDER BY place) FILTER (place <= last), '') AS text FROM e GROUP BY doc_id"""
)
def trailing_junk_cut(spark: SparkSession, d: str) -> DataFrame:
    return planted(spark, d).select("doc_id", clean.cut_trailing_junk(F.col("t")).alias("text"))


def _is_name(x: str) -> str:
    name = L.NAME_BLOCK.replace("'", "''")
    return (
        f"(length({COLLAPSE(x)}) <= 60 AND regexp_matches({COLLAPSE(x)}, '{name}') AND NOT regexp_matches({COLLAPSE(x)}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(L.PHIL_FUNC)})(?:$|[^\\p{{L}}\\p{{N}}_])')"
        f" AND len({WORDS(COLLAPSE(x))}) >= 2)"
    )


def _field(x: str) -> str:
    return f"replace({COLLAPSE(x)}, '|', '/')"


_BASIC = SQL["basic_clean_documents"].split("SELECT doc_id, ", 1)[1].rsplit(" AS text FROM documents", 1)[0]
_RUN = f"regexp_extract(b, '{RE(L.NUMBERED)}', 0)"
SQL["clean_page_corpus"] = f"""WITH a AS (SELECT doc_id, {_BASIC} AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
c AS (SELECT doc_id, {_guarded('canvas', 't', L.CANVAS)} AS t FROM (SELECT doc_id, regexp_replace(t, '\\r\\n?', chr(10), 'g') AS t FROM a)),
k AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '\\n{L.WS}*\\n'), lambda b: {STRIP('b')} <> '') AS l FROM c),
u AS (SELECT doc_id, unnest(l) AS b, generate_subscripts(l, 1) AS i FROM k), f AS (SELECT doc_id, i, b, i = 1 OR {_is_name('b')} OR regexp_matches({COLLAPSE('b')}, '{RE(L.LEAD_ATTRIBUTION)}') AS skipped FROM u),
g AS (SELECT doc_id, min(i) FILTER (NOT skipped) AS first FROM f GROUP BY doc_id), h AS (SELECT f.doc_id, string_agg(b, chr(10) ORDER BY i) AS b FROM f JOIN g ON g.doc_id = f.doc_id WHERE i >= first GROUP BY f.doc_id),
j AS (SELECT k.doc_id, coalesce(b, '') AS b FROM k LEFT JOIN h ON h.doc_id = k.doc_id),
m AS (SELECT doc_id, {CUT('b', L.BASAHA_TAIL)} AS b FROM j), n AS (SELECT doc_id, {QUESTIONS('b')} AS b FROM m),
o AS (SELECT doc_id, {_field(REMOVE("replace(b, chr(10), ' ')", L.PAGE_MARKER))} AS b FROM n),
q AS (SELECT doc_id, regexp_matches(b, '{RE(L.BIO_TAIL)}') AS bio, {_field(BIO('b'))} AS b FROM o),
r AS (SELECT doc_id, bio, {TITLE_AGAIN('b')} AS again, b FROM q), s AS (SELECT doc_id, bio, again IS NOT NULL AS titled, {_field('coalesce(again, b)')} AS b FROM r),
v AS (SELECT doc_id, bio, titled, {CAPTION('b')} AS rest, b FROM s), w AS (SELECT doc_id, bio, titled, rest IS NOT NULL AS english, {_field('coalesce(rest, b)')} AS b FROM v)
SELECT doc_id, b AS narrative, CASE WHEN b = '' THEN 'empty' WHEN regexp_matches(b, '{RE(L.DIGIT_INTERLEAVE)}') THEN 'digit_interleave' WHEN {_RUN} <> '' AND len(regexp_extract_all({_RUN}, '\\?')) < 2 THEN 'numbered_list'
 WHEN english THEN 'english_caption' WHEN titled THEN 'title_repeat' WHEN bio THEN 'bio_tail' ELSE '' END AS flag FROM w"""


@query(
    f"""WITH {SHAPED}, v AS (SELECT s.doc_id, {TRAD_SQL} FROM s) SELECT vec_id AS doc_id, len(embedding) + 4 AS dims,
 round(list_sum(embedding::DOUBLE[]) + mean_sentence_len + mean_word_len + polysyll_freq + type_token_ratio, 4) AS total FROM embeddings JOIN v ON v.doc_id = vec_id"""
)
def hybrid_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid model's inputs, an embedding and the features of a text in one vector, here by their length and sum."""
    features = trad_features(spark, d)
    own = F.array("mean_sentence_len", "mean_word_len", "polysyll_freq", "type_token_ratio")
    both = load(spark, d, "embeddings", "vec_id", "embedding").join(features.select(F.col("doc_id").alias("vec_id"), own.alias("own")), "vec_id")
    vector = F.concat(F.col("embedding").cast("array<double>"), "own")
    return both.select(F.col("vec_id").alias("doc_id"), F.size(vector).alias("dims"), F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
