import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tanglaw.llm import p3_encoding, p4_scans, p7_overlap, p10_sentences


def garbled(text, codec):
    table = {b: c for c, b in p3_encoding.TABLES[codec].items()}
    return "".join(chr(b) if b < 128 else table[b] for b in text.encode())


@pytest.mark.parametrize(
    "text, codec",
    [("你好世界", "cp1252"), ("你好", "latin-1"), ("Καλημέρα", "cp1252"), ("مرحبا", "cp1252"), ("नमस्ते", "latin-1"), ("Привет мир", "cp1251"), ("niño “hola”", "cp1252"), ("ảnh đẹp", "cp1252"), ("ñ" * 3000, "cp1252")],
)
def test_restored_in_any_script(text, codec):
    once = garbled(text, codec)
    assert p3_encoding.restore(once)[::2] == (text, 0) and p3_encoding.restore(once)[1] > 0


def test_many_steps_are_undone():
    text = "ñ"
    for _ in range(11):
        text = garbled(text, "latin-1")
    assert p3_encoding.restore(text)[0] == "ñ"


def test_double_byte_encodings():
    assert p3_encoding.restore("你好世界，早上好".encode().decode("gbk"))[0] == "你好世界，早上好"


@pytest.mark.parametrize(
    "text", ["page?id=3", "see http://a.b/c?d=e&f now", "x?q=1", "SÃO PAULO", "IRMÃ", "JOSÉ» MARÍ”", "Сёмга и Рівне", "репа рабрам", "中文字符没有问题", "联通", "ελληνικά", "Ano? Oo. ¿Qué?"]
)
def test_sound_text_stays(text):
    assert p3_encoding.restore(text) == (text, 0, 0)


def test_damaged_texts_of_other_scripts_are_found(spark):
    rows = [(1, garbled("你好世界", "cp1252")), (2, garbled("مرحبا", "cp1252")), (3, "Привет"), (4, "http://a.b/?x=y"), (5, None), (6, "")]
    assert {r.doc_id for r in p3_encoding.damaged(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {1, 2}


def test_headers_with_numbers_on_long_lines():
    line = "Ang " + "haba " * 100_000
    assert p4_scans._head(line + "   12") == line.rstrip() and p4_scans._head("12   " + line) == line and p4_scans._head("   12   14") == "   12   14"
    assert p4_scans._head(" " * 200_000 + "x") == " " * 200_000 + "x"


def test_readings_of_words_with_many_signs(spark):
    word, read = "ilililililililili" + "s", "1!1!1!1!1!1!1!1!15"[:17] + "5"
    parts = spark.createDataFrame([(1, 1, "char", read, ""), (1, 1, "char", "st0ry!", "")], "doc_id bigint, line_no int, kind string, word string, other string")
    lex = spark.createDataFrame([(word, 9), ("kita", 5)], "word string, n bigint")
    assert [(r.word, r.repair) for r in p4_scans.readings(parts, lex).collect()] == [(read, word)]


@pytest.mark.parametrize("read, word, n, want", [("nagdalgan", "nagdalagan", 100, True), ("nagdalaagan", "nagdalagan", 100, True), ("nagdalgan", "nagdalagan", 10, False), ("bta", "bata", 100, False), ("ccntcr", "center", 9, True)])
def test_dropped_added_and_double_misreadings(spark, read, word, n, want):
    assert p4_scans.explains(read, word, n) is want
    keys = spark.createDataFrame([(read, word)], "a string, b string").select(F.arrays_overlap(p4_scans.deletes(F.col("a")), p4_scans.deletes(F.col("b"))).alias("m"))
    assert keys.first().m or not want


def test_unrelated_texts_of_another_script_make_no_candidates(spark):
    rng = random.Random(5)
    letters = "абвгдежзиклмнопрстуфхцчшэюя"
    rows = [(k, None, "".join(" " if rng.random() < 0.15 else rng.choice(letters) for _ in range(400))) for k in range(2000)]
    rows[1999] = (1999, None, rows[0][2].upper())
    df = spark.createDataFrame(rows, "doc_id bigint, title string, text string").withColumn("language", F.lit("x")).withColumn("source", F.lit("s"))
    index = spark.createDataFrame([(k, "train" if k % 2 == 0 else "test") for k in range(2000)], "doc_id bigint, split_role string")
    none = spark.createDataFrame([], "doc_id bigint")
    bodies = df.select("doc_id", F.col("text").alias("body"), (F.col("doc_id") % 2 == 0).alias("train"), (F.col("doc_id") % 2 == 1).alias("eval")).withColumn("cid", F.col("doc_id"))
    sketch = p7_overlap.sketches(bodies.select("cid", "train", "eval", F.lower("body").alias("body")), p7_overlap.ranks(bodies))
    assert {(r.a, r.b) for r in p7_overlap.candidates(sketch).collect()} == {(0, 1999)}
    assert [(r.doc_id_a, r.doc_id_b) for r in p7_overlap.overlaps(df, index, none).collect()] == [(0, 1999)]


def test_coverage_and_report(spark):
    words = [f"salita{k}" for k in range(60)]
    text = " ".join(words)
    near = " ".join(words[:50] + ["iba"] * 10)
    far = " ".join(f"malayo{k}" for k in range(60))
    rows = [(1, text), (2, text), (3, text.upper()), (4, near), (5, far), (6, text)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"title": F.lit(None).cast("string"), "language": F.lit("x"), "source": F.when(F.col("doc_id") < 5, "s")})
    index = spark.createDataFrame([(1, "train"), (2, "train"), (3, "val"), (5, "val"), (6, "train"), (6, "test")], "doc_id bigint, split_role string")
    held = spark.createDataFrame([(4,)], "doc_id bigint")
    cover = {(r.doc_id, r.split_role): (r.partners, round(r.share, 3)) for r in p7_overlap.coverage(df, index, held).collect()}
    assert cover == {(3, "val"): (3, 1.0), (4, "heldout"): (3, round(50 / 60, 3)), (6, "test"): (2, 1.0)}
    report = {(r.split_role, r.source): (r.eval_docs, r.overlapping, r.links) for r in p7_overlap.report(df, index, held).collect()}
    assert report == {("val", "s"): (1, 1, 3), ("heldout", "s"): (1, 1, 3), ("test", None): (1, 1, 2)}


def test_equal_first_hashes_are_told_apart(spark):
    rows = [(1, True, False, "a", 7, 1), (2, False, True, "b", 7, 2), (3, False, True, "a", 7, 1)]
    bodies, classes = p7_overlap._classes(spark.createDataFrame(rows, "doc_id bigint, train boolean, eval boolean, body string, cid bigint, check bigint"))
    ids = {r.doc_id: r.cid for r in bodies.collect()}
    assert ids[1] == ids[3] != ids[2] and classes.count() == 2


@pytest.mark.parametrize(
    "text, lang, want",
    [
        ("Use fruit, e.g. Mango. It is good.", "en", 2), ("Vino La Sra. Gomez. Bien.", "es", 2), ("Siehe Abb. 3 und z.B. Hunde. Ende.", "de", 2), ("M. Dupont et Mme. Curie. Fin.", "fr", 2),
        ("The U.S. Army came. It left.", "en", 2), ("Umaga, 7 a.m. Tapos na.", "tl", 2), ("Si B.C. Santos ay narito. Oo.", None, 2), ("ສະບາຍດີ ຂ້ອຍ", "lo", 2), ("Es war gut. Hr. Meier kam.", "de", 2),
    ],
)
def test_abbreviations_by_language(text, lang, want):
    found = p10_sentences.sentences(text, lang)
    assert len(found) == want and np.all(np.diff([x for pair in found for x in pair]) >= 0)
