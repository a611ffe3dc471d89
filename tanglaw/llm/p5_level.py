"""Problem 5: the reading level of each text.

Each word's acquisition grade comes from its counts in texts of each labelled level: counts per level, equalised between the levels, give the probability of each level, and its mean is
the grade. A word is counted for its language and for all languages together: a word that is rare in its language leans on its counts in all, and those on the words of the same beginning
and length. Counts are kept in ``WORDS`` and ``SHAPES`` hashed buckets, so the tables have a fixed size for any corpus and merge by addition; of the words that meet in a bucket the most frequent
owns it, which a second hash tells, and the others lean on their shape. A text's level is a softmax over calibrated quantiles of its words' grades, fitted on at most about
``CALIBRATION`` labelled texts and evaluated natively. A labelled text's own words are taken out of the counts when it is graded.

Defined results: null and blank texts, and texts without a word, get no level; a level outside 1-3 counts as none; texts of problem 6 are graded but never called mislabelled;
repeated rows are each graded.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import adler32, crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize, spread
from . import p1_notices, p6_quality

WORDS, SHAPES = 1 << 20, 1 << 14
QUANTILES = (0.1, 0.25, 0.5, 0.7, 0.8, 0.9, 0.95)
FEATURES = (*(f"q{int(100 * q)}" for q in QUANTILES), "mean")
#: Labelled texts for the calibration, about.
CALIBRATION = 20_000
#: Tokens whose words a task remembers; beyond that it starts anew, which changes nothing but time.
KEPT = 400_000
#: How likely the other end of the scale must be before a label of 1 or 3 is called wrong.
SURE = 0.6
#: Weight of the shape's distribution, in occurrences of the word.
SHRINK = 4.0

def place(word: str, language: str) -> tuple[int, int]:
    """The bucket of a word of a language ('' for all together), and the second hash that tells it from others there."""
    raw = f"{language}|{word}".encode()
    h = crc32(raw)
    return h & (WORDS - 1), (h >> 20) << 16 | adler32(raw) & 0xFFFF


def shape(word: str) -> int:
    return crc32(f"{word[:3]}~{min(len(word), 16)}".encode()) & (SHAPES - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts: dict[tuple[str, int], list[str]] = defaultdict(list)
        for language, level, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            texts[language or "", level].append(text)
        # (table, bucket, second hash) to the counts of the levels; tables: words and shapes
        out: dict[tuple[bool, int, int], list[int]] = defaultdict(lambda: [0, 0, 0])
        for (language, level), own in texts.items():
            for token, n in Counter("\n".join(own).lower().split()).items():
                for w in (token,) if token.isalpha() else p6_quality.WORD.findall(token):
                    keys = [(False, *place(w, "")), (True, shape(w), 0)]
                    if language:
                        keys.append((False, *place(w, language)))
                    for key in keys:
                        out[key][level - 1] += n
        keys, counts = list(zip(*out)) or [(), (), ()], list(zip(*out.values())) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[0], pa.bool_()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int64()), *[pa.array(c, pa.int64()) for c in counts]], ["shape", "bucket", "check", "l1", "l2", "l3"]
        )


def level_counts(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences by word bucket and level, the second hash of each bucket's owner, and occurrences by shape bucket and level, in the texts of ``df`` (language, level, text) with a sound level."""
    texts = spread(df.select(p1_notices.source_key(F.col("language")).alias("language"), "level", "text")).where("level in (1, 2, 3) and text is not null")
    parts = texts.mapInArrow(_counted, "shape boolean, bucket int, check bigint, l1 bigint, l2 bigint, l3 bigint")
    sums = parts.groupBy("shape", "bucket", "check").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in (1, 2, 3)])
    owner = F.max_by(F.struct("check", "l1", "l2", "l3"), F.struct(F.col("l1") + F.col("l2") + F.col("l3"), F.col("check"))).alias("o")
    rows = materialize(sums.groupBy("shape", "bucket").agg(owner).select("shape", "bucket", "o.*"), "p5-words")
    out = []
    for wanted, size in ((False, WORDS), (True, SHAPES)):
        part = rows.where(F.col("shape") == wanted).select("bucket", "check", "l1", "l2", "l3").toArrow()
        counts, check = np.zeros((size, 3), np.float32), np.full(size, -1, np.int64)
        if part.num_rows:
            at = part.column(0).to_numpy()
            counts[at] = np.column_stack([part.column(k).to_numpy() for k in (2, 3, 4)])
            check[at] = part.column(1).to_numpy()
        out.append((counts, check))
    return out[0][0], out[0][1], out[1][0]


class Words:
    """Numbers for the words of each language met so far, with their buckets (-1 where another word owns it)."""

    def __init__(self, check: np.ndarray):
        self.check = check
        self.clear()

    def clear(self) -> None:
        self.tokens: dict[str, dict[str, list[int]]] = defaultdict(dict)
        self.number: dict[tuple[str, str], int] = {}
        self.rows: list[tuple[int, int, int]] = []
        self.held = 0

    def _number(self, word: str, language: str) -> int:
        n = self.number.get((language, word))
        if n is None:
            n = self.number[language, word] = len(self.rows)
            found = []
            for key in (language, ""):
                bucket, second = place(word, key)
                found.append(bucket if self.check[bucket] == second else -1)
            self.rows.append((found[0] if language else -1, found[1], shape(word)))
        return n

    def numbers(self, text: str, language: str) -> list[int]:
        known, out = self.tokens[language], []
        for token in text.lower().split():
            found = known.get(token)
            if found is None:
                self.held += 1
                found = known[token] = [self._number(w, language) for w in ((token,) if token.isalpha() else p6_quality.WORD.findall(token))]
            out += found
        return out


def _share(counts: np.ndarray, own: np.ndarray, label: np.ndarray, factor: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
    """The probability of each level from ``counts`` less the text's ``own`` occurrences, leaning on ``prior`` with ``weight``."""
    counts = counts.astype(np.float64)
    mine = np.flatnonzero(label)
    counts[mine, label[mine] - 1] -= own[mine]
    counts = np.maximum(counts, 0) * factor
    return (counts + weight * prior) / (counts.sum(axis=1, keepdims=True) + weight)


def _own(doc: np.ndarray, what: np.ndarray) -> np.ndarray:
    """How often each token's ``what`` occurs in its own document."""
    _, inverse, n = np.unique(doc * (int(what.max()) + 1) + what, return_inverse=True, return_counts=True)
    return n[inverse]


def grades(texts: list[str | None], languages: list[str | None], levels: list[int | None], words: np.ndarray, shapes: np.ndarray, known: Words) -> np.ndarray:
    """The quantiles and the mean of the word grades of each text, NaN for a text without words."""
    if known.held > KEPT:
        known.clear()
    flat: list[int] = []
    size = []
    for text, language in zip(texts, languages):
        found = known.numbers(text, language or "") if text else ()
        size.append(len(found))
        flat += found
    n = np.array(size, np.int64)
    out = np.full((len(texts), len(FEATURES)), np.nan)
    if not flat:
        return out
    number = np.array(flat, np.int64)
    every, inverse = np.unique(number, return_inverse=True)
    rows = np.array([known.rows[k] for k in every.tolist()], np.int64)[inverse]
    doc = np.repeat(np.arange(len(n)), n)
    label = np.array([x if x in (1, 2, 3) else 0 for x in levels], np.int64)[doc]
    same = _own(doc, inverse)
    p = _share(shapes[rows[:, 2]], _own(doc, rows[:, 2]), label, _equal(shapes), np.full(3, 1 / 3), 2.0)
    factor = _equal(words)
    for column in (1, 0):  # all languages, then the text's own
        bucket = rows[:, column]
        there = (bucket >= 0)[:, None]
        p = _share(np.where(there, words[bucket], 0), same * there[:, 0], label, factor, p, SHRINK)
    grade = p @ np.array([1.0, 2.0, 3.0])
    order = np.lexsort((grade, doc))
    grade = grade[order]
    start = np.cumsum(n) - n
    some = n > 0
    for k, q in enumerate(QUANTILES):
        at = start[some] + q * (n[some] - 1)
        low = np.floor(at).astype(np.int64)
        high = np.minimum(low + 1, start[some] + n[some] - 1)
        out[some, k] = grade[low] + (at - low) * (grade[high] - grade[low])
    out[some, -1] = np.add.reduceat(grade, start[some]) / n[some]
    return out


def _equal(counts: np.ndarray) -> np.ndarray:
    """Factors that give the three levels the same total."""
    total = np.maximum(counts.sum(axis=0, dtype=np.float64), 1)
    return total.mean() / total


def graded(df: DataFrame) -> DataFrame:
    """(doc_id, level, features) of each text of ``df`` with a word, as a stored table."""
    df = df.select("doc_id", "language", "level", "text")
    shared = df.sparkSession.sparkContext.broadcast(level_counts(df))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, check, shapes = shared.value
        known = Words(check)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                level, language, text = (part.column(k).to_pylist() for k in (1, 2, 3))
                x = grades(text, language, level, words, shapes, known)
                keep = ~np.isnan(x[:, 0])
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask), *[pa.array(x[keep, k]) for k in range(x.shape[1])]], ["doc_id", "level", *FEATURES])

    schema = "doc_id bigint, level int, " + ", ".join(f"{f} double" for f in FEATURES)
    texts = spread(df).where("text is not null").select("doc_id", "level", p1_notices.source_key(F.col("language")).alias("language"), "text")
    return materialize(texts.mapInArrow(run, schema), "p5-grades")


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Softmax regression of levels 1-3 on ``x``."""
    w, goal = np.zeros((x.shape[1], 3)), np.eye(3)[y - 1]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        s = x @ w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - goal) / len(x) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimated(df: DataFrame) -> DataFrame:
    """(doc_id, level, estimate, p1, p2, p3) of each text of ``df`` (doc_id, language, level, text); level as stored."""
    table = graded(df)
    labelled = table.where("level in (1, 2, 3)")
    share = min(1.0, CALIBRATION / max(labelled.count(), 1))
    part = F.xxhash64("doc_id").bitwiseAND((1 << 53) - 1).cast("double") / float(1 << 53)
    sample = labelled.where(part < share).orderBy("doc_id").select("level", *FEATURES).toPandas()
    x = sample[list(FEATURES)].to_numpy(float)
    mean, std = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    z = np.clip((x - mean) / std, -4, 4)
    w = fit(np.column_stack([z, z**2, np.ones(len(z))]), sample["level"].to_numpy()) if len(x) else np.zeros((2 * len(FEATURES) + 1, 3))
    place = {f: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (F.col(f) - F.lit(float(mean[k]))) / F.lit(float(std[k])))) for k, f in enumerate(FEATURES)}
    scaled = table.select("doc_id", "level", *[v.alias(f) for f, v in place.items()])
    score = [
        sum((F.col(f) * float(w[k, c]) + F.col(f) * F.col(f) * float(w[k + len(FEATURES), c]) for k, f in enumerate(FEATURES)), F.lit(float(w[-1, c]))) for c in range(3)
    ]
    scored = scaled.select("doc_id", "level", *[s.alias(f"s{k + 1}") for k, s in enumerate(score)]).withColumn("top", F.greatest("s1", "s2", "s3"))
    parts = [F.exp(F.col(f"s{k}") - F.col("top")) for k in (1, 2, 3)]
    total = parts[0] + parts[1] + parts[2]
    return scored.select(
        "doc_id", "level", F.when(F.col("s1") == F.col("top"), 1).when(F.col("s2") == F.col("top"), 2).otherwise(3).alias("estimate"), *[(p / total).alias(f"p{k + 1}") for k, p in enumerate(parts)]
    )


def corrected(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(doc_id, level) of each text whose stored level is missing, impossible, or at the other end of the scale from how it reads; level is the estimate.

    ``names`` has the valid languages."""
    result = materialize(estimated(df), "p5-levels")
    unsound = F.col("level").isNull() | ~F.col("level").isin(1, 2, 3)
    flipped = ((F.col("level") == 1) & (F.col("p3") >= SURE)) | ((F.col("level") == 3) & (F.col("p1") >= SURE))
    doubtful = result.where(F.coalesce(flipped, F.lit(False)))
    # Only texts in doubt are looked at for problem 6.
    kinds = p6_quality.kinds_of(df, names, p1_notices.notice_hashes(df), doubtful).where("kind <> 'prose'").select("doc_id")
    return result.where(unsound).unionByName(doubtful.join(kinds, "doc_id", "left_anti")).select("doc_id", F.col("estimate").alias("level"))
