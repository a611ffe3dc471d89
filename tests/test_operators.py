import difflib

import pytest
from pyspark.sql import functions as F

from tanglaw import lexicon as L
from tanglaw.operators import audit, clean, corpus, evaluate, model, ngrams
from tanglaw.plans import pipelines
from tanglaw.streaming import streams


def cleaned(spark, f, rows, schema):
    return [(r["narrative"], r["flag"]) for r in f(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()]


def test_line_cleaner(spark):
    rows = [
        (1, "Ang Aso", "Ang Aso Gisulat ni Juan Cruz Cebuano Story Book Si Pedro adunay aso sa balay. KATAPUSAN Copyright 2010"),
        (2, "X", "Green Star Si Ana ang bata sa balay nga dako."),
        (3, None, None),
        (4, "Y", "Si Ana ug ang bata. Room to Read The Asia Foundation"),
    ]
    out = cleaned(spark, clean.clean_lines, rows, "doc_id int, title string, text string")
    assert out[0] == ("Si Pedro adunay aso sa balay.", "")
    assert out[1] == ("Si Ana ang bata sa balay nga dako.", "residual_prefix")
    assert out[2] == ("", "no_opener")
    assert out[3][0] == "Si Ana ug ang bata."


def test_publisher_in_body_is_cut_out_only(spark):
    text = "Si Ana ang bata. Room to Read Ang bata sa balay ug ang aso sa dagat. Siya ug ako."
    out = cleaned(spark, clean.clean_lines, [(1, "", text)], "doc_id int, title string, text string")
    assert out == [("Si Ana ang bata. Ang bata sa balay ug ang aso sa dagat. Siya ug ako.", "pub_marker_in_body")]


def test_page_cleaner(spark):
    rows = [
        (1, "Ang Titulo\n\nJuan Cruz\n\nAng bata sa balay.\nNaglakat siya.\n\nMga Hapot\n1. Ano?"),
        (2, "Titulo\n\nAng bata sa balay. 1. Sin-o siya? 2. Diin siya? 3. Ano ini? Tapos."),
        (3, ""),
        (4, "T\n\nAng mga bata: 1. Ana 2. Ben 3. Carl nagadulaan."),
    ]
    out = cleaned(spark, clean.clean_pages, rows, "doc_id int, text string")
    assert out[0] == ("Ang bata sa balay. Naglakat siya.", "")
    assert out[1] == ("Ang bata sa balay.", "")
    assert out[2] == ("", "empty")
    assert out[3][1] == "numbered_list"


def test_tagalog_and_level_cleaners(spark):
    text = "Si Ana ay isang bata sa nayon na masaya. Siya ay naglaro sa ilog at sa puno ng mangga. This book was released under a license by the foundation."
    out = cleaned(spark, clean.clean_tagalog, [(1, text), (2, None)], "doc_id int, text string")
    assert out[0][0].startswith("Si Ana ay isang bata") and "license" not in out[0][0] and out[0][1] == ""
    assert out[1][0] == ""
    levels = cleaned(spark, clean.clean_levels, [(1, 2, f"Ang Bata,2,{text}"), (2, 1, "Walang kuwento")], "doc_id int, level int, text string")
    assert levels[0][0].startswith("Si Ana ay isang bata") and levels[1] == ("", "empty")


def test_first_generation(spark):
    rows = [(1, "cebuano", "Aso", "Aso Gisulat ni Juan Cruz Ang aso .Dako KATAPUSAN"), (2, "minasbate", "T", "Title\nAng bata sa balay\nAktibidad\nx"), (3, "minasbate", "T", "Title\nAng bata")]
    out = cleaned(spark, clean.clean_first_generation, rows, "doc_id int, language string, title string, text string")
    assert out[0] == ("Ang aso . Dako", "") and out[1] == ("Ang bata sa balay", "") and out[2] == ("Ang bata", "unmatched")


@pytest.mark.parametrize("text, title, want", [("Ang Aso dako", "ang aso", "dako"), ("Ang Asong dako", "Ang Aso", "Ang Asong dako"), ("x", "", "x"), ("Aso", "Aso", "")])
def test_title(spark, text, title, want):
    assert spark.createDataFrame([(text, title)], "a string, b string").select(clean.strip_title(F.col("a"), F.col("b"))).first()[0] == want


def test_name_runs(spark):
    run = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert run(clean.strip_name_runs, "Syeda Basarat Midhat Kazim ang bata sa Paaralang Marcos Pimentel") == "ang bata sa Paaralang Marcos Pimentel"
    assert run(clean.strip_leading_names, "Vinita Krishna Ang bata") == "Ang bata"
    assert run(clean.strip_leading_names, "Maganda ang umaga") == "Maganda ang umaga"


def test_flags_and_duplicates(spark):
    rows = [(1, "tagalog", "ang aso ay dako"), (2, "tagalog", " ang aso ay dako "), (3, "cebuano", "ang aso ay dako"), (4, "tagalog", "isa dalawa"), (5, "tagalog", "the and of lion cow"), (6, "tagalog", None), (7, None, "ang aso ay dako"), (8, None, "ang aso ay dako")]
    out = {r.doc_id: r.flag for r in pipelines.flagged(spark.createDataFrame(rows, "doc_id int, language string, text string")).collect()}
    assert out == {1: "", 2: "duplicate", 3: "", 4: "too_short", 5: "english_heavy", 6: "", 7: "", 8: "duplicate"} or out[7] == "" and out[2] == "duplicate"


def test_numbers_and_folds(spark):
    rows = spark.range(997).select("id", (F.col("id") % 3).alias("label"), F.lit("tagalog").alias("language")).withColumnRenamed("id", "doc_id")
    assert [r[0] for r in corpus.numbered(rows, "n", ["doc_id"]).orderBy("doc_id").select("n").collect()] == list(range(997))
    folds = corpus.stratified_folds(rows, ["language", "label"])
    counts = folds.groupBy("label", "fold").count().collect()
    assert folds.count() == 997 and len(counts) == 15
    for k in range(3):
        sizes = [r["count"] for r in counts if r.label == k]
        assert max(sizes) - min(sizes) <= 1


def rbo_loop(doc, anchor, p=0.98):
    depth, total = min(len(doc), len(anchor)), 0.0
    for k in range(1, depth + 1):
        total += p ** (k - 1) * len(set(doc[:k]) & set(anchor[:k])) / k
    return (1 - p) * total


def test_rbo_against_loop(spark):
    anchors = [("tagalog", 2, k + 1, g, 9 - k) for k, g in enumerate(["an", "ng", "sa", "at", "ga"])]
    texts = [(1, "anng"), (2, "Ang bata sa anga."), (3, ""), (4, None), (5, "zzzz")]
    got = {r.doc_id: r.tag_bi for r in ngrams.rbo_features(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(anchors, "anchor string, n int, gram_rank int, gram string, gram_count bigint")).collect()}
    for doc, text in texts:
        letters = "".join(c for c in (text or "").lower() if "a" <= c <= "z")
        grams = [letters[i : i + 2] for i in range(len(letters) - 1)]
        order = sorted(dict.fromkeys(grams), key=lambda g: (-grams.count(g), grams.index(g)))
        assert got[doc] == pytest.approx(rbo_loop(order, [a[3] for a in anchors]))


def test_metrics(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 0)]
    pred = spark.createDataFrame([("a", *r) for r in rows], "language string, y_true int, y_pred int")
    s = evaluate.summary(pred).first()
    assert s.accuracy == pytest.approx(0.5) and s.nonadjacent == pytest.approx(1 / 6)
    f1 = {r.label: r.f1 for r in evaluate.per_class(pred).collect()}
    assert f1[0] == pytest.approx(4 / 7) and f1[1] == pytest.approx(0.5) and f1[2] == 0
    assert s.macro_f1 == pytest.approx((4 / 7 + 0.5) / 3)
    absent = evaluate.summary(pred.where("y_true < 2 and y_pred < 2")).first()
    assert absent.n_docs == 5


def test_alignment(spark):
    rows = [(1, "Gisulat ni Juan Ang bata sa balay", "Ang bata sa balay"), (2, "ang aso", None), (3, None, "ang"), (4, "a b c d", "a x d")]
    out = audit.removed_spans(spark.createDataFrame(rows, "doc_id bigint, raw string, clean string")).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.position, r.span, r.words, r.added))
    assert by[1] == [("leading", "Gisulat ni Juan", 3, 0)]
    assert by[2] == [("leading", "ang aso", 2, 0)] and by[3] == [("inserted", "ang", 0, 1)]
    assert by[4] == [("interior", "b c", 2, 1)]
    assert difflib.SequenceMatcher(a="abcd", b="axd").ratio() > 0


@pytest.mark.parametrize(
    "span, title, position, want",
    [(" ", "", "interior", "whitespace"), ("KATAPUSAN", "", "trailing", "end_marker"), ("Dapit sa Kagsurat", "", "trailing", "author_bio"), ("Gisulat ni Juan", "", "leading", "credit"),
     ("Room to Read", "", "trailing", "publisher"), ("Cebuano", "", "leading", "genre_tag"), ("Ang Aso Juan Cruz", "Ang Aso", "leading", "title_author"), ("Juan Cruz", "", "interior", "names_or_title"),
     ("ang bata sa balay", "", "interior", "REVIEW_narrative"), ("wutwut bla", "", "interior", "other")],
)
def test_categories(spark, span, title, position, want):
    df = spark.createDataFrame([(span, title, position)], "s string, t string, p string")
    assert df.select(audit.category(F.col("s"), F.col("t"), F.col("p"))).first()[0] == want


def test_buckets_and_empty_tables(spark):
    empty = spark.createDataFrame([], "language string, level int")
    names = spark.createDataFrame([("tagalog",), ("bikol",)], "language string")
    assert sorted((r.language, r.level, r.n) for r in corpus.buckets(empty, names).collect()) == [(x, k, 0) for x in ("bikol", "tagalog") for k in L.LEVELS]
    none = spark.createDataFrame([], "doc_id bigint, language string, level int, title string, text string")
    assert pipelines.build(none).count() == 0 and pipelines.flagged(none).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, "tagalog", f"Ang aso {k} ay dako. Oo!") for k in range(40)], "doc_id bigint, language string, text string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = streams.prepared(streams.read(spark, str(tmp_path / "in"), rows.schema, 1))
    q = stream.writeStream.format("memory").queryName("prepared").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("prepared").collect())) == sorted(map(tuple, streams.prepared(rows).collect()))


def test_weights_and_standardizing(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (1.0, 3.0)], "label double, x double")
    assert {r.label: round(r.weight, 6) for r in model.balanced(df).collect()} == {0.0: 0.75, 1.0: 1.5}
    z = [r.x for r in model.standardize(df, df, ("x",)).orderBy("x").collect()]
    assert z == pytest.approx([-1.2247448, 0, 1.2247448])
