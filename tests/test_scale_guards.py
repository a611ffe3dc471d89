import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from tanglaw.functions import text as T
from tanglaw.operators import audit, clean, corpus, ngrams
from tanglaw.sources import corpora, tables
from tanglaw.sources.tables import load


def test_a_megabyte_without_a_space_is_read_once(spark):
    rows = [(1, "a" * 1_000_000), (2, "b" * 500_000 + "ж" + "b" * 500_000 + " tapos"), (3, "ang Дом ay жж dito"), (4, None), (5, "")]
    began = time.time()
    out = {r.k: r.t for r in spark.createDataFrame(rows, "k int, text string").select("k", T.drop_foreign_tokens(F.col("text")).alias("t")).collect()}
    assert out[1] == rows[0][1] and out[2] == "  tapos" and out[3] == "ang   ay   dito" and out[4] is None and out[5] == ""
    assert time.time() - began < 30


def test_alignment_of_long_texts_is_that_of_short_ones():
    rng = random.Random(1)
    for _ in range(200):
        letters = "abcd"[: rng.randint(1, 4)]
        a = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        b = [x for x in a if rng.random() < 0.7] if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        assert audit.Aligner(a, b, 0).get_opcodes() == difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()
    a = [str(rng.randrange(300)) for _ in range(100_000)]
    began = time.time()
    assert [x[0] for x in audit.Aligner(a, a[500:40_000] + a[40_400:]).get_opcodes()] == ["delete", "equal", "delete", "equal"] and time.time() - began < 20


def test_overlap_by_rows_and_by_joins_agree(spark, data):
    df, anchors = load(spark, data, "documents", "doc_id", "text"), load(spark, data, "anchor_ngrams")
    key = lambda r: (r.doc_id, r.anchor, r.n)
    rows, joins = ({key(r): r.rbo for r in f(df, anchors).collect()} for f in (ngrams.rbo, ngrams.rbo_by_join))
    assert rows.keys() == joins.keys() and all(abs(rows[k] - joins[k]) < 1e-9 for k in rows)
    assert ngrams.rbo_features(df, anchors)._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1


def test_numbers_within_a_hot_group(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).otherwise("x").alias("g"))
    out = corpus.numbered(df, "n", ["doc_id"], within=["g"])
    for g in ("g is null", "g = 'x'"):
        assert [r.n for r in out.where(g).orderBy("doc_id").collect()] == list(range(df.where(g).count()))


def test_findings_and_guards(spark):
    spans = spark.createDataFrame([(1, "interior", 2, 0, "ang sa"), (2, "leading", 3, 0, "ang sa mga"), (3, "interior", 1, 4, "aso")], "doc_id int, position string, words int, added int, span string")
    out = {r.doc_id: (r.interior_native, r.deletion_only, r.review) for r in audit.findings(spans).collect()}
    assert out == {1: (2, True, True), 2: (0, True, False), 3: (0, False, False)}
    texts = spark.createDataFrame([("may salita", ""), ("may salita", "salita"), ("12 !", ""), (None, None)], "a string, b string")
    assert [r.o for r in texts.select(audit.over_deleted(F.col("a"), F.col("b")).alias("o")).collect()] == [True, False, False, False]
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, t string")
    assert audit.assert_aligned(a, a, "k", "t").count() == 2
    for b in ([(1, "y"), (2, None)], [(1, "x")], [(1, "x"), (2, None), (2, None)]):
        with pytest.raises(ValueError):
            audit.assert_aligned(a, spark.createDataFrame(b, "k int, t string"), "k", "t")
    few = spark.createDataFrame([("a b c d e f g h",), ("a b",), (None,)], "narrative string")
    assert clean.long_enough(few).count() == 1


def test_ties_keep_the_order_of_the_file(spark, tmp_path):
    (tmp_path / "anchors.txt").write_text("zz,5\naa,5\n\nmm,5\n")
    assert [(r.gram_rank, r.gram) for r in corpora.read_anchors(spark, str(tmp_path / "anchors.txt"), "x", 2).orderBy("gram_rank").collect()] == [(1, "zz"), (2, "aa"), (3, "mm")]
    docs = spark.createDataFrame([(2, "ba"), (1, "ab")], "doc_id int, text string")
    assert [r.gram for r in ngrams.corpus_profile(docs, 2, 2).collect()] == ["ab", "ba"]


def test_stored_tables_are_released(spark):
    import os

    table = tables.materialize(spark.range(3).toDF("x"), "released")
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    tables.release()
    assert not os.path.exists(path)
