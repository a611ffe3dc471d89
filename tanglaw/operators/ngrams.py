"""Character n-gram profiles and rank-biased overlap with anchor lists, as relational plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as L
from ..functions import text as T
from ..sources.tables import small, spread

#: Anchor rows that may be sent to the tasks.
ANCHOR_ROWS = 100_000
#: Letters of a gram that is handled as a number: with more, the number of a text of a batch and a gram don't fit into 63 bits.
LONGEST_GRAM = 8


def grams(df: DataFrame, n: int) -> DataFrame:
    """(doc_id, gram, cnt, first_pos): overlapping n-grams of the ASCII letters of each text; they cross word and sentence boundaries."""
    clean = spread(df.select("doc_id", T.ascii_letters(F.col("text")).alias("letters")))
    every = clean.select("doc_id", F.posexplode(F.regexp_extract_all("letters", F.lit(f"(?=([a-z]{{{n}}}))"), F.lit(1))).alias("pos", "gram"))
    return every.groupBy("doc_id", "gram").agg(F.count("*").alias("cnt"), F.min("pos").alias("first_pos"))


def ranked(df: DataFrame, n: int) -> DataFrame:
    """``grams`` with the rank of each within its document, most frequent and then first first, and the number of distinct grams."""
    w = Window.partitionBy("doc_id")
    return grams(df, n).select(
        "doc_id", "gram", F.row_number().over(w.orderBy(F.desc("cnt"), "first_pos")).alias("doc_rank"), F.count("*").over(w).alias("doc_size")
    )


def weights(longest: int, p: float) -> list[float]:
    """Prefix sums of p^(k-1) / k for k up to ``longest``, from 0.

    With m the larger of a common gram's two ranks and d the depth, the smaller of the two sizes, the truncated rank-biased overlap is (1 - p) times the sum over common grams with m <= d of
    the terms from m to d, so prefix sums make it one pass over the common grams.
    """
    out, total = [0.0], 0.0
    for k in range(1, longest + 1):
        total += p ** (k - 1) / k
        out.append(total)
    return out


def _codes(letters: np.ndarray, n: int) -> np.ndarray:
    """The number of the n-gram that begins at each place of ``letters`` (0-25), as long as one fits."""
    out = np.zeros(max(len(letters) - n + 1, 0), np.int64)
    for k in range(n):
        out = out * 26 + letters[k : k + len(out)]
    return out


def ranks_of(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the n-grams of all ``texts`` (letters a-z): the text of each, its number, its rank there (most frequent, then first, first) and the number of distinct grams of each text."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode(), np.uint8).astype(np.int64) - 97
    code = _codes(flat, n)
    doc = np.repeat(np.arange(len(size)), size)[: len(code)]
    inside = np.arange(len(code)) + n <= np.cumsum(size)[doc] if len(code) else np.zeros(0, bool)
    code, doc = code[inside], doc[inside]
    key, first, count = np.unique(doc * 26**n + code, return_index=True, return_counts=True)
    doc, code = key // 26**n, key % 26**n
    order = np.lexsort((first, -count, doc))
    distinct = np.bincount(doc, minlength=len(size))
    rank = np.arange(len(order)) - (np.cumsum(distinct) - distinct)[doc[order]] + 1
    return doc[order], code[order], rank, distinct


def _scores(texts: list[str], lists: dict[tuple[str, int], list[str]], p: float) -> dict[tuple[str, int], np.ndarray]:
    """The rank-biased overlap of each text's grams with each list, -1 where no gram within reach is common."""
    weight = np.array(weights(max(map(len, lists.values()), default=0), p))
    out = {}
    for n in sorted({n for _, n in lists}):
        doc, code, rank, distinct = ranks_of(texts, n)
        for (name, k), grams in lists.items():
            if k != n:
                continue
            number = _codes(np.frombuffer("".join(grams).encode(), np.uint8).astype(np.int64) - 97, n)[::n]
            place = np.argsort(number)
            at = np.minimum(np.searchsorted(number, code, sorter=place), len(grams) - 1)
            both = number[place[at]] == code
            d, top = doc[both], np.maximum(rank[both], place[at[both]] + 1)
            depth = np.minimum(distinct[d], len(grams))
            good = top <= depth
            total = np.bincount(d[good], weight[depth[good]] - weight[top[good] - 1], len(texts)) * (1 - p)
            out[name, n] = np.where(np.bincount(d[good], minlength=len(texts)) > 0, total, -1.0)
    return out


def anchor_lists(anchors: DataFrame) -> dict[tuple[str, int], list[str]] | None:
    """The grams of each list (anchor, n) by rank, or None if they are too many or not short grams of a-z."""
    rows = anchors.select("anchor", "n", "gram_rank", "gram").orderBy("anchor", "n", "gram_rank").limit(ANCHOR_ROWS + 1).collect()
    lists: dict[tuple[str, int], list[str]] = {}
    for r in rows:
        if r.n > LONGEST_GRAM or not r.gram or len(r.gram) != r.n or not (r.gram.isascii() and r.gram.isalpha() and r.gram.islower()):
            return None
        lists.setdefault((r.anchor, r.n), []).append(r.gram)
    return lists if len(rows) <= ANCHOR_ROWS else None


def rbo(df: DataFrame, anchors: DataFrame, p: float = L.RBO_P) -> DataFrame:
    """(doc_id, anchor, n, rbo): truncated rank-biased overlap of each text's n-grams with each anchor list, for the pairs that overlap.

    Anchor lists are a small table: up to ``ANCHOR_ROWS`` rows they go to the tasks and a text's grams are counted, ranked and compared where the text is read, so nothing is shuffled. Beyond that, or for grams
    longer than ``LONGEST_GRAM`` or of other letters than a-z, ``rbo_by_join`` does the same with joins. Null texts have no grams.
    """
    lists = anchor_lists(anchors)
    if lists is None:
        return rbo_by_join(df, anchors, p)
    keys = list(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scores(batch.column(1).to_pylist(), lists, p)
            for name, n in keys:
                some = np.flatnonzero(found[name, n] >= 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(some)), pa.array([name] * len(some), pa.string()), pa.array([n] * len(some), pa.int32()), pa.array(found[name, n][some])], ["doc_id", "anchor", "n", "rbo"]
                )

    clean = spread(df.select("doc_id", "text")).select("doc_id", F.coalesce(T.ascii_letters(F.col("text")), F.lit("")).alias("letters"))
    return clean.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, anchor string, n int, rbo double")


def rbo_by_join(df: DataFrame, anchors: DataFrame, p: float = L.RBO_P) -> DataFrame:
    """``rbo`` for anchor lists of any size and any grams, as joins on the grams."""
    anchors = anchors.select("anchor", "n", F.col("gram_rank").alias("anchor_rank"), "gram")
    sizes = anchors.groupBy("anchor", "n").agg(F.count("*").alias("anchor_size"))
    listed = small(anchors.join(sizes, ["anchor", "n"]), ANCHOR_ROWS)
    longest = sizes.agg(F.max("anchor_size")).first()[0] or 0
    weight = F.array(*[F.lit(x) for x in weights(longest, p)])
    parts = None
    for n in sorted(r[0] for r in sizes.select("n").distinct().collect()):
        one = ranked(df, n).where(F.col("doc_rank") <= longest).join(listed.where(F.col("n") == n), "gram")
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        return df.select("doc_id", F.lit("").alias("anchor"), F.lit(0).alias("n"), F.lit(0.0).alias("rbo")).limit(0)
    top, depth = F.greatest("doc_rank", "anchor_rank").cast("int"), F.least("doc_size", "anchor_size").cast("int")
    common = parts.where(top <= depth).select("doc_id", "anchor", "n", (F.element_at(weight, depth + 1) - F.element_at(weight, top)).alias("w"))
    return common.groupBy("doc_id", "anchor", "n").agg((F.sum("w") * (1 - p)).alias("rbo"))


#: The six features by anchor list and n.
NAMES = {("tagalog", 2): "tag_bi", ("bikol", 2): "bik_bi", ("cebuano", 2): "ceb_bi", ("tagalog", 3): "tag_tri", ("bikol", 3): "bik_tri", ("cebuano", 3): "ceb_tri"}


def with_rbo(df: DataFrame, text: str, anchors: DataFrame, p: float = L.RBO_P) -> DataFrame:
    """``df`` with the six overlaps of its column ``text`` in place of it, 0 where nothing overlaps; row by row and without a shuffle while the anchor lists are small."""
    kept = [c for c in df.columns if c != text]
    lists = anchor_lists(anchors)
    if lists is None:
        scores = rbo_by_join(df.select("doc_id", F.col(text).alias("text")), anchors, p)
        wide = scores.groupBy("doc_id").agg(*[F.max(F.when((F.col("anchor") == a) & (F.col("n") == n), F.col("rbo"))).alias(c) for (a, n), c in NAMES.items()])
        return df.select(*kept).join(wide, "doc_id", "left").na.fill(0.0, list(NAMES.values()))
    used = {k: v for k, v in lists.items() if k in NAMES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scores(batch.column(len(kept)).to_pylist(), used, p)
            zero = np.zeros(batch.num_rows)
            scores = [pa.array(np.maximum(found.get(key, zero), 0)) for key in NAMES]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *scores], [*kept, *NAMES.values()])

    clean = spread(df).select(*kept, F.coalesce(T.ascii_letters(F.col(text)), F.lit("")).alias("_letters"))
    fields = df.select(*kept).schema
    for c in NAMES.values():
        fields = fields.add(c, "double")
    return clean.mapInArrow(run, fields)


def rbo_features(df: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, tag_bi, bik_bi, ceb_bi, tag_tri, bik_tri, ceb_tri), 0 where nothing overlaps."""
    return with_rbo(df.select("doc_id", "text"), "text", anchors)


def corpus_profile(df: DataFrame, n: int, top: int) -> DataFrame:
    """(gram, cnt): the ``top`` n-grams of all texts, ties by where a gram first occurs in the order of doc_id; those that would span two documents are not counted, which keeps the counts
    independent of document order."""
    clean = spread(df.select("doc_id", T.ascii_letters(F.col("text")).alias("letters")))
    every = clean.select("doc_id", F.posexplode(F.regexp_extract_all("letters", F.lit(f"(?=([a-z]{{{n}}}))"), F.lit(1))).alias("pos", "gram"))
    return every.groupBy("gram").agg(F.count("*").alias("cnt"), F.min(F.struct("doc_id", "pos")).alias("first")).orderBy(F.desc("cnt"), "first").limit(top).select("gram", "cnt")
