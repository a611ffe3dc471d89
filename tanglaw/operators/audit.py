"""Validation of a cleaning: alignment of raw and cleaned texts, removed spans and their categories, invariants."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..sources.tables import spread

U = "(?U)"
LETTERS = re.compile(r"[^\W\d_]+")


BASE = 0x9E3779B97F4A7C15


class Aligner(difflib.SequenceMatcher):
    """Longest matching block first, then the same on both sides of it. In stretches of more than ``small`` pairs of words the block is found by hashes of all runs of a length and a search for the
    greatest length, which is linear but for a logarithm and gives the same block."""

    def __init__(self, a: list[str], b: list[str], small: int = 1_000_000):
        super().__init__(a=a, b=b, autojunk=False)
        self.small = small
        number: dict[str, int] = {}
        self.numbers = tuple(np.array([number.setdefault(w, len(number) + 1) for w in side], np.uint64) for side in (a, b)) if len(a) * len(b) > small else ()

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> difflib.Match:
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        if not self.numbers or (ahi - alo) * (bhi - blo) <= self.small:
            return super().find_longest_match(alo, ahi, blo, bhi)
        a, b = self.numbers[0][alo:ahi], self.numbers[1][blo:bhi]
        sums = []
        for x in (a, b):
            power = np.full(len(x) + 1, BASE, np.uint64)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            back = np.full(len(x) + 1, pow(BASE, -1, 1 << 64), np.uint64)
            back[0] = 1
            np.multiply.accumulate(back, out=back)
            # sum of x[i] * BASE^-i, so a run's hash is a difference times BASE^start
            sums.append((np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * back[:-1], dtype=np.uint64))), power))

        def hashes(side: int, k: int) -> np.ndarray:
            total, power = sums[side]
            return (total[k:] - total[: len(total) - k]) * power[: len(total) - k]

        low, high = 0, min(len(a), len(b))
        while low < high:
            k = (low + high + 1) // 2
            low, high = (k, high) if np.isin(hashes(0, k), hashes(1, k)).any() else (low, k - 1)
        if low == 0:
            return difflib.Match(alo, blo, 0)
        left, right = hashes(0, low), hashes(1, low)
        i = int(np.flatnonzero(np.isin(left, right))[0])
        j = int(np.flatnonzero(right == left[i])[0])
        if not np.array_equal(a[i : i + low], b[j : j + low]):  # unlike runs with one hash
            return super().find_longest_match(alo, ahi, blo, bhi)
        return difflib.Match(alo + i, blo + j, low)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc, raw, clean in zip(*(batch.column(k).to_pylist() for k in range(3))):
            marks = [(m.group().lower(), m.start(), m.end()) for m in LETTERS.finditer(raw or "")]
            a, b = [m[0] for m in marks], [w.lower() for w in LETTERS.findall(clean or "")]
            for op, i, j, k, m in Aligner(a, b).get_opcodes():
                if op == "equal":
                    continue
                if i < j:
                    s, e = marks[i][1], marks[j - 1][2]
                    rows.append((doc, s, e, "leading" if i == 0 else "trailing" if j == len(a) else "interior", j - i, m - k, raw[s:e]))
                else:
                    rows.append((doc, -1, -1, "inserted", 0, m - k, " ".join(b[k:m])))
        cols = list(zip(*rows)) or [()] * 7
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "char_start", "char_end", "position", "words", "added", "span"])


def removed_spans(df: DataFrame) -> DataFrame:
    """(doc_id, char_start, char_end, position, words, added, span) of the token runs that differ between ``raw`` and ``clean`` of ``df``.

    position is leading, trailing or interior for removed runs (added tells words put in their place) and inserted for words that the raw text doesn't have. Null texts count as empty.
    """
    return spread(df.select("doc_id", "raw", "clean")).mapInArrow(_spans, "doc_id bigint, char_start int, char_end int, position string, words int, added int, span string")


def category(span: Column, title: Column, position: Column) -> Column:
    """The kind of a removed span; the first that fits of the fixed order."""
    s = T.strip(span)
    hit = lambda pattern: s.rlike(U + pattern)
    tokens = F.regexp_extract_all(s, F.lit(r"(\p{L}+)"), F.lit(1))
    native = F.exists(tokens, lambda w: F.lower(w).isin(*L.NATIVE_FUNC))
    capital = F.size(F.filter(tokens, lambda w: w.rlike(r"^\p{Lu}")))
    cores, title_cores = F.transform(tokens, lambda w: F.lower(w)), T.letter_tokens(F.coalesce(title, F.lit("")))
    n = F.size(title_cores)
    rest = F.slice(tokens, n + 1, F.greatest(F.size(tokens), F.lit(1)))
    # What is left of the rest when the capitalised words at its end are taken off.
    from_end = F.array_position(F.transform(F.reverse(rest), lambda w: w.rlike(r"^\p{Lu}")), False).cast("int")
    middle = F.when(from_end > 0, F.slice(rest, F.lit(1), F.size(rest) - from_end + 1)).otherwise(F.array().cast("array<string>"))
    titled = (position == "leading") & (n > 0) & (F.slice(cores, F.lit(1), F.greatest(n, F.lit(1))) == title_cores) & ~F.exists(middle, lambda w: F.lower(w).isin(*L.NATIVE_FUNC))
    low_title = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(s == "", "whitespace").when(hit(r"(?i)\bKATAPUSAN\b"), "end_marker").when(hit(L.BIO_TAIL) | hit(L.BIO_WORDS), "author_bio").when(hit(rf"(?i){L.TRIGGERS}"), "credit")
        .when(hit(f"(?i:{L.PUBLISHER})"), "publisher").when(hit(rf"(?i)\b(?:{L.LANGUAGE_NAMES})\b") | hit(L.GENRE_PHRASE), "genre_tag").when(hit(L.META_LABEL), "meta_label")
        .when(s.rlike(r"[^\P{L}\p{IsLatin}]|&[a-zA-Z#0-9]+;"), "foreign_entity").when(titled, "title_author")
        .when((F.size(tokens) > 0) & ~native & (capital >= F.size(tokens) - 1), "names_or_title").when((low_title != "") & F.contains(F.lower(s), low_title), "title")
        .when(native, "REVIEW_narrative").otherwise("other")
    )


def findings(spans: DataFrame) -> DataFrame:
    """(doc_id, introduced_tokens, interior_native, deletion_only, review): words added by the cleaning, native words lost from inside texts, whether nothing was added, and whether
    ``L.INTERIOR_NATIVE`` native words or more were lost inside, which is for people to look at."""
    native = F.size(F.filter(T.letter_tokens(F.col("span")), lambda w: w.isin(*L.NATIVE_FUNC)))
    per = spans.groupBy("doc_id").agg(F.sum("added").alias("introduced_tokens"), F.sum(F.when(F.col("position") == "interior", native).otherwise(0)).alias("interior_native"))
    return per.select("*", (F.col("introduced_tokens") == 0).alias("deletion_only"), (F.col("interior_native") >= L.INTERIOR_NATIVE).alias("review"))


def over_deleted(raw: Column, clean: Column) -> Column:
    """Whether a cleaning left no word of a text that had some."""
    return (F.size(T.letter_tokens(F.coalesce(raw, F.lit("")))) > 0) & (F.size(T.letter_tokens(F.coalesce(clean, F.lit("")))) == 0)


def assert_aligned(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """``a`` if each key stands on both sides once with the same ``column``; else reading it fails."""
    left = a.groupBy(key).agg(F.count("*").alias("_n"), F.min(F.xxhash64(F.col(column))).alias("_h"))
    right = b.groupBy(key).agg(F.count("*").alias("_m"), F.min(F.xxhash64(F.col(column))).alias("_g"))
    wrong = left.join(right, key, "full").where(~(F.col("_n").eqNullSafe(F.lit(1)) & F.col("_m").eqNullSafe(F.lit(1)) & F.col("_h").eqNullSafe(F.col("_g"))))
    bad = wrong.limit(1).collect()
    if bad:
        raise ValueError(f"the tables differ, first at {key} {bad[0][key]}")
    return a


def letters_sorted(text: Column) -> Column:
    """The letters of a text as a sorted array, to compare multisets."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"(\p{L})"), F.lit(1)))


def leaks(text: Column) -> Column:
    """Whether publisher wording or mostly English words are left."""
    return text.rlike(U + f"(?i:{L.PUBLISHER})") | (T.english_ratio(text) >= L.ENGLISH_HEAVY)


def differing(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of either side whose ``column`` isn't the same on the other, by a null-safe full join."""
    left, right = a.select(key, F.col(column).alias("left_value")), b.select(key, F.col(column).alias("right_value"))
    return left.join(right, key, "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))
