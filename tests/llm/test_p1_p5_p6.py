import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tanglaw.llm import p1_notices, p5_level, p6_quality
from tanglaw.sources.tables import load

SCHEMA = "doc_id bigint, language string, level int, text string, source string, n long"
NOTICE = "Copy and share this little story freely, number {}"


def brute(rows):
    docs, lines = defaultdict(set), []
    for doc, language, text in rows:
        if language is None or text is None:
            continue
        for k, line in enumerate(text.split("\n"), 1):
            letters = "".join(c for c in line.lower() if c.isalpha())
            if len(letters) >= 25:
                docs[(language.strip().lower(), letters)].add(doc)
                lines.append((doc, k, (language.strip().lower(), letters)))
    return sorted((d, k) for d, k, key in lines if len(docs[key]) >= 5)


def test_notices_against_brute_force(spark, data):
    rows = [(r.doc_id, r.language, r.text) for r in load(spark, data, "all_languages").select("doc_id", "language", "text").collect()]
    rows += [(10_000 + k, "x", NOTICE.format(k) + "\n" + NOTICE.format(k).upper()) for k in range(5)] + [(20_000 + k, "y", NOTICE.format(k)) for k in range(4)]
    rows += [(30_000, None, NOTICE.format(1)), (30_001, "", None), (30_002, "", ""), (30_003, "z", "a" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, language string, text string")
    assert sorted(map(tuple, p1_notices.repeated_lines(df).collect())) == brute(rows)
    cleaned = {r.doc_id: r for r in p1_notices.without_notices(df).collect()}
    assert cleaned[10_000].text == "" and cleaned[10_000].removed == 2 and cleaned[30_001].text is None and cleaned[20_000].removed == 0


def test_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(1, "x", NOTICE)] * 5 + [(2, "x", NOTICE)] * 3, "doc_id bigint, language string, text string")
    assert p1_notices.repeated_lines(df).count() == 0


def test_empty_table_and_extra_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert p1_notices.repeated_lines(none).count() == 0
    assert p5_level.estimated(none).count() == 0
    assert p6_quality.judged(none).count() == 0


def texts_of_each_kind(rng, n):
    common, nouns = ["ang", "sa", "mga", "ay"], ["bata", "asong", "balay", "naglaro", "mangga", "ilogan", "punong", "bulaklak", "hayop"]
    sentence = lambda: " ".join(rng.choice(common) if k % 3 == 0 else rng.choice(nouns) for k in range(9)).capitalize() + "."
    out = []
    for k in range(n):
        out.append(("prose", "\n".join(sentence() for _ in range(8)) if k % 2 else " ".join(sentence() for _ in range(8))))
        if k % 4 == 0:
            out.append(("list", "\n".join(f"- {rng.choice(nouns)} {rng.choice(nouns)}" for _ in range(9))))
            out.append(("table", "\n".join(f"{rng.choice(nouns)}\t{rng.randint(1, 99)}\t{rng.randint(1, 99)}" for _ in range(9))))
            out.append(("junk", "\n".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(60)) for _ in range(4))))
    return out


def test_signals_and_learned_rules(spark):
    made = texts_of_each_kind(random.Random(1), 300)
    common, known = {"ang", "sa", "mga", "ay"}, {w for _, t in made for w in t.lower().replace(".", " ").split() if len(w) < 15}
    told = [p6_quality.kind_by_signals([x for x in t.split("\n") if x], common, known) for _, t in made]
    assert all(a == b for a, (b, _) in zip(told, made) if a) and sum(x is None for x in told) < 0.05 * len(told)
    df = spark.createDataFrame([(k, "x", t) for k, (_, t) in enumerate(made)] + [(9001, "x", None), (9002, "x", "  ")], "doc_id bigint, language string, text string")
    found = {r.doc_id: r.kind for r in p6_quality.judged(df).collect()}
    assert len(found) == len(made) and sum(found[k] == kind for k, (kind, _) in enumerate(made)) > 0.98 * len(made)
    some = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    none = spark.createDataFrame([], "any bigint")
    assert {r.doc_id: r.kind for r in p6_quality.kinds_of(df, None, none, some).collect()} == {k: found[k] for k in (1, 2)}


def test_case_and_rules_agree(spark):
    rules = [("table", [(0, "<=", 2.5), (3, ">", 0.1)]), ("junk", [(5, "<=", 0.05)])]
    rows = [[1.0] + [0.0] * 2 + [0.2] + [0.0] * 8, [9.0] + [0.0] * 4 + [0.01] + [0.0] * 6, [9.0] + [0.0] * 4 + [0.5] + [0.0] * 6]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in p6_quality.FEATURES))
    assert [r.k for r in df.select(F.expr(p6_quality.as_case(rules)).alias("k")).collect()] == ["table", "junk", "prose"] == list(p6_quality.assign(rules, np.array(rows)))


def test_summary_keeps_every_repeated_line(spark):
    line = "ito ay isang linya na inuulit sa maraming teksto"
    rows = [(k, "a" if k < 5 else "b", f"{line}\nsariling linya ng tekstong may bilang na {'x' * k}") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, language string, text string")
    lines = p1_notices.line_table(df)
    assert p1_notices.candidates(lines).select("doc_id").distinct().count() == 5  # of source a only
    assert sorted(map(tuple, p1_notices.repeated_lines(df).collect())) == [(k, 1) for k in range(5)]
    clean = {r.doc_id: (r.text, r.removed) for r in p1_notices.without_notices(df).collect()}
    assert clean[0] == (rows[0][2].split("\n")[1], 1) and clean[7] == (rows[7][2], 0)
    plan = p1_notices.without_notices(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # the spread of a scan with few partitions


def test_levels_on_held_out_texts(spark):
    rng = random.Random(2)
    easy, hard = ["aso", "bata", "sa", "ang", "puno"], ["pagkalubos", "kasingganda", "ipinagmalaki", "ang", "sa"]
    text = lambda pool: " ".join(rng.choice(pool) for _ in range(40))
    rows = [(k, "x", 1, text(easy)) for k in range(60)] + [(100 + k, "x", 3, text(hard)) for k in range(60)] + [(200 + k, "x", 2, text(easy + hard)) for k in range(60)]
    rows += [(300, "x", None, text(easy)), (301, "x", 9, text(hard)), (302, "x", None, None), (303, "x", None, " "), (304, "x", None, "..."), (305, "x", 1, text(hard))]
    out = {r.doc_id: r.estimate for r in p5_level.estimated(spark.createDataFrame(rows, "doc_id bigint, language string, level int, text string")).collect()}
    assert out[300] == 1 and out[301] == 3 and out[305] == 3 and not {302, 303, 304} & set(out)
    assert np.mean([out[k] == 1 for k in range(60)]) > 0.9


def test_grades_without_words():
    none = np.full(p5_level.WORDS, -1, np.int64)
    x = p5_level.grades([None, "", "aso"], ["a", None, "b"], [1, None, 2], np.zeros((p5_level.WORDS, 3)), np.zeros((p5_level.SHAPES, 3)), p5_level.Words(none))
    assert np.isnan(x[:2]).all() and x[2, 0] == 2.0


def test_a_word_has_a_grade_in_each_language(spark):
    # "sala" is easy in one language and hard in the other; the words around it are even.
    rows = [(k, lang, level, f"sala sala sala {'dito doon' if k % 2 else 'doon dito'}") for k, (lang, level) in enumerate([("una", 1), ("dua", 3)] * 60)]
    rows += [(1000 + k, lang, 2, "dito doon gitna") for k, lang in enumerate(["una", "dua"] * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, language string, level int, text string")
    words, check, shapes = p5_level.level_counts(df)
    known = p5_level.Words(check)
    x = p5_level.grades(["sala", "sala"], ["una", "dua"], [None, None], words, shapes, known)
    assert x[0, -1] < 1.5 and x[1, -1] > 2.5


def test_bucket_of_another_word_is_not_used():
    words, check = np.zeros((p5_level.WORDS, 3)), np.full(p5_level.WORDS, -1, np.int64)
    bucket, second = p5_level.place("aso", "")
    words[bucket], check[bucket] = (0, 0, 1000), second + 1
    x = p5_level.grades(["aso"], [""], [None], words, np.zeros((p5_level.SHAPES, 3)), p5_level.Words(check))
    assert x[0, -1] == 2.0
