import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tanglaw.functions import features as FE
from tanglaw.functions import text as T


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "text string").select(build(F.col("text")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "build, text, want",
    [
        (T.alpha_tokens, "Niño ay mabait.", ["ni", "o", "ay", "mabait"]),
        (T.sentences, "Si A. Ang B?  C! d", ["Si A.", "Ang B?", "C!", "d"]),
        (T.ascii_letters, "Ang bá!", "angb"),
        (T.normalize, 'mag -uban , bata.Sila "Oo"', 'mag-uban , bata. Sila "Oo"'),
        (T.normalize, "dali - dali—3 - 4", "dali-dali — 3 - 4"),
        (T.normalize, "a - b - c", "a-b-c"),
        (T.scrub_entities, "a&amp;quot;b", "ab"),
        (T.scrub_entities, "a&nbsp;b &amp; c", "a b & c"),
        (T.strip_page_numbers, "Si 12 Ana 1. Una", "Si Ana 1. Una"),
        (T.to_field, "  a b|c\n", "a b/c"),
        (T.undo_latin1, "piÃ±a", "piña"),
        (T.undo_latin1, "piña “x”", "piña “x”"),
        (T.fold_accents, "Señora à ə", "Senora a ə"),
        (T.drop_foreign_tokens, "bata ភូមិ aso", "bata   aso"),
        (T.unify_breaks, "a\r\nb\n\n\nc", "a\nb\nc"),
        (T.english_ratio, "", 0.0),
        (T.english_ratio, "The lion and bata", 0.75),
        (T.word_count, "   ", 0),
    ],
)
def test_micro_cases(spark, build, text, want):
    assert one(spark, text, build) == want


@pytest.mark.parametrize("build", [T.normalize, T.to_field, T.ascii_letters, T.basic_clean, T.fold_accents, T.sentences, T.alpha_tokens])
def test_null_stays_null(spark, build):
    assert one(spark, None, build) is None


def shape(spark, word, language):
    return spark.createDataFrame([([word], language)], "w array<string>, l string").select(FE.shapes(F.col("w"), F.col("l"))).first()[0][0]


@pytest.mark.parametrize("word, language, want", [("mag", "tagalog", "CVC"), ("krus", "tagalog", "CCVC"), ("strikto", "tagalog", "CCCVCCV"), ("kà", "cebuano", "CC"), ("kà", "tagalog", "CV"), ("kə", "rinconada", "CV"), ("kə", "bikol", "CC")])
def test_skeletons(spark, word, language, want):
    assert shape(spark, word, language) == want


@pytest.mark.parametrize("word, want", [("aso", 2), ("maaga", 2), ("ng", 1)])
def test_syllables(spark, word, want):
    assert spark.createDataFrame([([word],)], "w array<string>").select(FE.syllables(F.col("w"), F.lit("tagalog"))).first()[0] == [want]


def test_features_of_empty_text_are_zero(spark):
    docs = FE.tokenized(spark.createDataFrame([(1, None), (2, " ")], "doc_id int, text string"))
    rows = docs.select(*[c.alias(n) for n, c in FE.trad(F.col("words"), F.col("n_sents"), F.lit("tagalog")).items()]).collect()
    assert all(v == 0 for r in rows for v in r)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abñé ,.!-—&;\ń", max_size=30), min_size=5, max_size=20))
def test_normalization_is_idempotent_and_keeps_letters(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.normalize(F.col("text")).alias("a"))
    letters = lambda s: sorted(c for c in unicodedata.normalize("NFC", s) if c.isalpha())
    for text, a, b in rows.select("text", "a", T.normalize(F.col("a")).alias("b")).collect():
        if "&" not in text:
            assert letters(text) == letters(a)
            assert b == a or "- " in a or " -" in a or "--" in a


def test_sentences_are_cut_and_dropped_by_the_same_white_space(spark):
    """Trimming by signs and dropping blank sentences do what the patterns of ``strip`` do, for every white space and others like it."""
    from tanglaw import lexicon as L

    signs = [chr(k) for k in (*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    texts = [t for c in signs for t in (c, f"{c}Oo.{c}Hindi!{c}", f"Ano?{c} {c}", f".{c}.{c}", f"a{c}\n", f"{c}\n")] + ["", " . "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    strip = lambda x: F.regexp_replace(x, f"^{L.WS}+|{L.WS}+$", "")
    want = F.filter(F.split(strip(F.col("t")), rf"(?<=[.?!]){L.WS}+"), lambda s: strip(s) != "")
    rows = df.select("t", T.sentences(F.col("t")).alias("got"), want.alias("want")).collect()
    assert [r.t for r in rows if r.got != r.want] == []
    plan = df.select(T.sentences(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
