"""Problem 9: evaluation passages inside training text.

Every batch of documents is a shard with its own suffix array over words, restricted to runs of words that occur in the evaluation
items at all (no other word can take part in a match). Every suffix of every item is binary-searched in each shard; its neighbours
in the array give the longest verbatim match and its place. Nothing is shuffled but the matches.

Words are compared as ``words`` makes them: lower case, accents and invisible format characters left out, halves of a word joined that a hyphen
directly before a line break parts; other characters only separate.

Defined results: null and empty documents or items match nothing; items of fewer than ``min_words`` words can't match; equal items each get their rows;
repeated rows of a document give its rows once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

#: Items that are sent to the executors at once; a larger table is searched for block by block.
ITEMS_PER_BLOCK = 20_000



#: Characters that need no look at their category.
PLAIN = frozenset(map(chr, range(128))) | frozenset("“”‘’«»…–—·•")
HYPHENED = re.compile(r"[-‐‑](?:\r\n|[\n\r\x0b\x0c\x85  ])[ \t]*")
#: What a text with a plain hyphen must have for ``HYPHENED``; a pattern that begins with one sign is searched for fast.
BROKEN = re.compile(r"-[\n\r\x0b\x0c\x85\u2028\u2029]")
WORD = re.compile(r"[^\W_]+")
NON_ASCII = re.compile(r"[^\x00-\x7f]+")
#: The letters and digits of ASCII as they are, spaces for the rest.
LETTERS = bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(256))


def words(text: str) -> list[str]:
    """The words of ``text`` as they are compared."""
    text, plain = text.lower(), True
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        for c in set("".join(NON_ASCII.findall(text))).difference(PLAIN):
            if unicodedata.category(c) in ("Mn", "Cf"):
                text = text.replace(c, "")
            else:
                plain = False
    if "‐" in text or "‑" in text or BROKEN.search(text):
        text = HYPHENED.sub("", text)
    if plain:  # what isn't ASCII only separates
        return text.encode("ascii", "replace").translate(LETTERS).decode().split()
    return WORD.findall(text)


class Items:
    """The evaluation items as one array of word numbers (0 ends an item), with the places where a suffix may start."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int):
        self.vocabulary: dict[str, int] = {}
        seq, starts, owner = [], [], []
        for item, text in rows:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text or "")]
            starts += range(len(seq), len(seq) + len(w) - min_words + 1)
            owner += [item] * max(0, len(w) - min_words + 1)
            seq += [*w, 0]
        self.seq, self.starts, self.owner, self.min_words = np.array(seq + [0], np.int32), np.array(starts, np.int64), np.array(owner, np.int64), min_words


def runs(ids: np.ndarray, least: int) -> np.ndarray:
    """The positions of ``ids`` that lie in a run of at least ``least`` numbers other than 0, with the 0 after each run."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids != 0).view(np.int8), [0]))))
    a, b = edge[::2], edge[1::2]
    keep = b - a >= least
    a, b = a[keep], b[keep]
    n = b - a + 1
    return np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """The start places of the suffixes of ``seq`` in order, by prefix doubling."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    k, order = 1, np.argsort(rank, kind="stable")
    while k < n:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = fresh
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


def common(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """How many words agree from places ``x`` of ``a`` and ``y`` of ``b`` on, up to ``most`` and to a 0."""
    n = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    while len(live):
        u, v = a[x[live] + n[live]], b[y[live] + n[live]]
        live = live[(u == v) & (u != 0)]
        n[live] += 1
        live = live[n[live] < most]
    return n


def bound(shard: np.ndarray, sa: np.ndarray, items: Items, upper: bool) -> np.ndarray:
    """For each item suffix the first place in ``sa`` whose suffix doesn't come before (``upper``: comes after) its first words."""
    m, w = len(items.starts), items.min_words
    lo, hi = np.zeros(m, np.int64), np.full(m, len(sa), np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        x, y = sa[mid], items.starts[live]
        n = common(shard, x, items.seq, y, w)
        less = np.where(n == w, upper, shard[x + np.minimum(n, w - 1)] < items.seq[y + np.minimum(n, w - 1)])
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)


def search(ids: np.ndarray, doc: np.ndarray, at: np.ndarray, items: Items) -> dict[str, np.ndarray]:
    """The longest match of each (document, item) pair in a shard of word numbers ``ids``; doc and at: each word's document and place there."""
    where = runs(ids, items.min_words)
    shard = np.append(ids[where], np.zeros(1, np.int32))
    none = np.zeros(0, np.int64)
    if len(where) == 0 or len(items.starts) == 0:
        return {"doc": none, "item": none, "longest": none, "doc_word": none}
    sa = suffix_array(shard)
    lo, hi = bound(shard, sa, items, False), bound(shard, sa, items, True)
    n = hi - lo
    q = np.repeat(np.arange(len(n)), n)
    s = sa[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
    size = common(shard, s, items.seq, items.starts[q], 1 << 40)
    d, i = doc[where[s]], items.owner[q]
    order = np.lexsort((at[where[s]], -size, i, d))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(d[order]) != 0) | (np.diff(i[order]) != 0)
    pick = order[first]
    return {"doc": d[pick], "item": i[pick], "longest": size[pick], "doc_word": at[where[s[pick]]]}


def _searcher(rows: list[tuple[int, str]], min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, min_words)
        get = items.vocabulary.get
        for batch in batches:
            numbers, lengths = [], []
            for text in batch.column(1).to_pylist():
                w = words(text) if text else ()
                numbers += [get(x, 0) for x in w]
                numbers.append(0)
                lengths.append(len(w) + 1)
            n = np.array(lengths, np.int64)
            start = np.cumsum(n) - n
            ids = np.array(numbers, np.int32)
            found = search(ids, np.repeat(np.arange(len(n)), n), np.arange(len(ids)) - np.repeat(start, n), items)
            docs = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)[found["doc"]] if len(found["doc"]) else found["doc"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(found["item"], pa.int64()), pa.array(found["longest"], pa.int32()), pa.array(found["doc_word"], pa.int32())],
                ["doc_id", "item_id", "longest", "doc_word"],
            )

    return run


def leaks(docs: DataFrame, items: DataFrame, min_words: int = 8) -> DataFrame:
    """(doc_id, item_id, longest, doc_word): each document (doc_id, text) that holds at least ``min_words`` consecutive words of an item
    (item_id, text), with the number of words of the longest match and the number of the word where it begins."""
    source = spread(docs.select("doc_id", "text").where("doc_id is not null and text is not null"))
    items = items.select("item_id", "text").where("item_id is not null and text is not null")
    blocks = -(-items.count() // ITEMS_PER_BLOCK) or 1
    out = None
    for k in range(blocks):
        rows = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()]
        part = source.mapInArrow(_searcher(rows, min_words), "doc_id bigint, item_id bigint, longest int, doc_word int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.min_by("doc_word", F.struct(-F.col("longest"), F.col("doc_word"))).alias("doc_word"))


def without_leaks(docs: DataFrame, items: DataFrame, min_words: int = 8) -> DataFrame:
    """``docs`` without the documents that hold a passage of an item."""
    bad = leaks(docs, items, min_words).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
