import random
import unicodedata

import numpy as np
import pyarrow as pa

from tanglaw.llm import p1_notices, p7_overlap, p9_leaks

rng = random.Random(6)
VOCABULARY = ["".join(rng.choice("bdgklmnprst") + rng.choice("aiou") for _ in range(rng.randint(2, 5))) for _ in range(900)]


def found(spark, train, evaluation):
    """The pairs (number in train, number in evaluation) that ``overlaps`` finds, and those that alignment of all finds."""
    rows = [(k, t) for k, t in enumerate(train)] + [(10_000 + k, t) for k, t in enumerate(evaluation)]
    df = spark.createDataFrame([(d, None, None, " ".join(t), "s") for d, t in rows], "doc_id bigint, language string, title string, text string, source string")
    index = spark.createDataFrame([(d, d, "train" if d < 10_000 else "test") for d, _ in rows], "pos bigint, doc_id bigint, split_role string")
    got = {(r.doc_id_a, r.doc_id_b - 10_000) for r in p7_overlap.overlaps(df, index, spark.createDataFrame([], "doc_id bigint")).collect()}
    a, b = ([p7_overlap.body(" ".join(t), None).split() for t in side] for side in (train, evaluation))
    return got, {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if p7_overlap.common_words(x, y) >= 0.7 * max(len(x), len(y))}


def test_family_of_near_copies(spark):
    """Every part of the text stands in more than 10,000 pairs; each copy has its own edits."""
    base = [rng.choice(VOCABULARY) for _ in range(120)]
    copies = [[w if rng.random() > 0.1 else rng.choice(VOCABULARY) for w in base] for _ in range(400)]
    got, want = found(spark, copies[:200], copies[200:])
    assert got == want and len(want) > 10_000


def test_evenly_spaced_edits(spark):
    train = [[rng.choice(VOCABULARY) for _ in range(rng.randint(150, 300))] for _ in range(40)]
    every = [(4,), (5,), (6,), (4, 3, 3), (3,)]  # 75, 80, 83, 70 and, below the limit, 67 % of the words stay
    copies = []
    for k, words in enumerate(train):
        at, copy, steps = -1, list(words), every[k % len(every)]
        for i in range(len(words)):
            at += steps[i % len(steps)]
            if at >= len(copy):
                break
            copy[at] = "zz" + copy[at]
        copies.append(copy)
    got, want = found(spark, train, copies)
    assert got == want == {(k, k) for k in range(40) if k % 5 < 4}


def test_short_texts(spark):
    train = [["isa", "bukid"], ["isa"], ["ana", "bata", "doon", "niya"], ["puno"]]
    got, want = found(spark, train, [["isa", "bata"], ["ana", "bata", "doon", "siya"], ["puno"], ["isa", "bukid"]])
    assert got == want == {(0, 3), (2, 1), (3, 2)}


def stories(spark, texts, language="x"):
    """The pairs that ``overlaps`` finds and the report's links, for ``texts`` of lines, every second one in training."""
    rows = [(k, language, None, "\n".join(" ".join(line) for line in lines), "s") for k, lines in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, language string, title string, text string, source string")
    index = spark.createDataFrame([(k, k, "test" if k % 2 else "train") for k in range(len(texts))], "pos bigint, doc_id bigint, split_role string")
    none = spark.createDataFrame([], "doc_id bigint")
    return {(r.doc_id_a, r.doc_id_b) for r in p7_overlap.overlaps(df, index, none).collect()}, sum(r.links or 0 for r in p7_overlap.report(df, index, none).collect())


def lines_of(n, words=9):
    return [[rng.choice(VOCABULARY) for _ in range(words)] for _ in range(n)]


def test_texts_copied_so_often_that_their_lines_are_repeated(spark):
    """Ten copies of a text, five with a line of their own, and ten of a text of one line: all their lines stand in five documents, but aren't notices."""
    base, one = lines_of(10), lines_of(1, 30)
    texts = [list(base) for _ in range(10)] + [list(one) for _ in range(10)]
    for k in range(5):
        texts[k][k] = lines_of(1)[0]
    got, links = stories(spark, texts)
    assert got == {(min(a, b), max(a, b)) for at in (0, 10) for a in range(at, at + 10, 2) for b in range(at + 1, at + 10, 2)} and links == 50


def test_copies_that_each_have_a_line_of_their_own(spark):
    base = lines_of(10)
    texts = [[lines_of(1)[0] if k == at else line for k, line in enumerate(base)] for at in range(10)]
    assert stories(spark, texts)[0] == {(min(a, b), max(a, b)) for a in range(0, 10, 2) for b in range(1, 10, 2)}


def test_notices_still_make_no_difference(spark):
    """Short texts with nothing but a notice in common are no copies, and a text with the notice is one of the text without it."""
    notice = lines_of(1, 12)
    texts = [lines_of(5) + notice for _ in range(20)] + [notice, notice]
    texts[1] = texts[0][:-1]
    assert stories(spark, texts)[0] == {(0, 1)}


def test_rows_of_a_large_band_are_sent_to_few_blocks():
    train, near = 470_000, 1_400_000
    t, e = p7_overlap.shares(train, near)
    assert train * e + near * t < 6 * (train + near) and train / t <= 1 << 17 and near / e <= 1 << 18


def test_block_counts_only_lengths_that_fit(monkeypatch):
    """A block gives the pairs that share enough of their first tokens and of all, whatever part is counted first."""
    side = lambda n: [np.sort(rng_np.choice(400, rng_np.integers(20, 60), replace=False)).astype(np.uint32) for _ in range(n)]
    rng_np = np.random.default_rng(4)
    left, right = side(60), side(40)
    right += [np.sort(np.concatenate((x[: len(x) - 4], x[-4:] + 400))).astype(np.uint32) for x in left[:30]]
    cut = lambda x: x[: min(len(x), len(x) - int(p7_overlap.needed(np.array([len(x)]))[0]) + p7_overlap.DEPTH)]
    table = lambda rows, at: pa.table({"cid": np.arange(len(rows)) + at, "words": pa.array([len(x) for x in rows], pa.int32()), "tokens": [cut(x).tobytes() for x in rows]})
    need = lambda x, y: int(p7_overlap.needed(np.array([max(len(x), len(y))]))[0])
    want = {(i, 1000 + j) for i, x in enumerate(left) for j, y in enumerate(right) if min(len(x), len(y)) >= need(x, y) and len(np.intersect1d(cut(x), cut(y))) >= min(p7_overlap.DEPTH, need(x, y))}
    for first in (1, 4, 12, 24):
        monkeypatch.setattr(p7_overlap, "FIRST", first)
        met = p7_overlap._met(table(left, 0), table(right, 1000))
        got = set(zip(met["a"].to_pylist(), met["b"].to_pylist()))
        assert len(got) == met.num_rows and want >= got and {(i, 1040 + i) for i in range(30)} <= got
        assert got == want or first < p7_overlap.DEPTH


def test_long_texts_of_one_language_are_few_candidates(spark):
    """Of the 4,200 pairs of texts that share more than half of their words, the frequent ones, few are aligned; near copies are."""
    draw = np.random.default_rng(8)
    weights = 1 / np.arange(1, len(VOCABULARY) + 1)
    texts = [[VOCABULARY[k] for k in draw.choice(len(VOCABULARY), 450, p=weights / weights.sum())] for _ in range(120)]
    copies = [[w if rng.random() > 0.2 else rng.choice(VOCABULARY) for w in words] for words in texts[:10]]
    rows = [(k, k < 60, k >= 60, " ".join(words)) for k, words in enumerate(texts + copies)]
    first = spark.createDataFrame(rows, "cid bigint, train boolean, eval boolean, body string")
    met = {(r.a, r.b) for r in p7_overlap.candidates(p7_overlap.sketches(first, p7_overlap.ranks(first))).collect()}
    assert met >= {(k, 120 + k) for k in range(10)} and len(met) < 60


def shuffled(spark):
    """The rows that all stages so far have written for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_rows_shuffled_do_not_grow_with_blocks(spark, monkeypatch):
    """With shares of 20 classes the pairs are the same, and each class is sent to its share only, whether or not Python reads the shared folder."""
    base = [[rng.choice(VOCABULARY) for _ in range(60)] for _ in range(20)]
    copies = [[w if rng.random() > 0.05 else rng.choice(VOCABULARY) for w in base[k // 2 % 20]][: rng.randint(50, 60)] for k in range(400)]
    rows = [(k, k % 2 == 0, k % 2 == 1, " ".join(words)) for k, words in enumerate(copies)]
    first = spark.createDataFrame(rows, "cid bigint, train boolean, eval boolean, body string")
    sketch = p7_overlap.sketches(first, np.zeros(1 << p7_overlap.BUCKETS, np.int16))
    want = {(r.a, r.b) for r in p7_overlap.candidates(sketch).collect()}
    assert len(want) > 1000
    for name, most in (("BLOCK", 20), ("OTHERS", 20), ("MOST_OTHERS", 40)):
        monkeypatch.setattr(p7_overlap, name, most)
    before = shuffled(spark)
    found = p7_overlap.candidates(sketch)
    assert shuffled(spark) - before < 1.5 * len(rows)
    pairs = [(r.a, r.b) for r in found.collect()]
    assert len(pairs) == len(want) and set(pairs) == want
    monkeypatch.setattr(p7_overlap, "_readable", lambda file: False, raising=False)
    pairs = [(r.a, r.b) for r in p7_overlap.candidates(sketch).collect()]
    assert len(pairs) == len(want) and set(pairs) == want


def test_texts_are_not_shuffled_to_tell_their_partitions(spark, monkeypatch):
    """``spread`` asks a table for its partitions, which runs the shuffles of one that is joined."""
    plans = []
    monkeypatch.setattr(p7_overlap, "spread", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    assert stories(spark, [lines_of(3)] * 2)[0] == {(0, 1)}
    assert plans and not any("Exchange" in plan for plan in plans)


def test_letters_of_a_line_are_made_once(spark):
    """The filter on the number of letters isn't pushed below the column that makes them."""
    df = spark.createDataFrame([(1, "x", "Isang mahabang linya ng mga titik dito\nmaikli\n" + "1" * 40)], "doc_id bigint, language string, text string")
    lines = p1_notices.line_table(df, parts=True)
    assert lines._jdf.queryExecution().optimizedPlan().toString().count(r"\P{L}+") == 1
    assert [(r.doc_id, r.line_no, round(r.part, 3)) for r in lines.collect()] == [(1, 1, round(38 / 86, 3))]


def test_words_of_copies_are_ranked_once(spark, monkeypatch):
    """Ranks of tokens are made from one text of each class, however many copies there are."""
    rows, ranks = [], p7_overlap.ranks
    monkeypatch.setattr(p7_overlap, "ranks", lambda bodies: rows.append(bodies.count()) or ranks(bodies))
    assert len(stories(spark, [lines_of(4)] * 12 + [lines_of(4)])[0]) == 36 and set(rows) == {2}


def test_words_are_those_of_the_pattern():
    """Texts whose other signs only separate are cut as bytes, with the same words; hyphens at any break join."""
    pool = [*map(chr, range(0x250)), *"“”‘’–—…•·‐‑­  Kİßﬁ١²ªКий"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) if rng.random() < 0.1 else rng.choice("abcXYZ01 _-\n.?@!|") for _ in range(40))
        flat = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if c in p9_leaks.PLAIN or unicodedata.category(c) not in ("Mn", "Cf"))
        assert p9_leaks.words(text) == p9_leaks.WORD.findall(p9_leaks.HYPHENED.sub("", flat))
