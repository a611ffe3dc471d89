"""Problem 7: the same or nearly the same texts in training and evaluation.

Texts are compared as words: accents, case and punctuation out, the lines of problem 1 and the damage of problems 3 and 4 undone as far as they can be. Equal word sequences form one class;
all further work is on class representatives.

Candidates come from an exact prefix filter, which loses no pair. A token is a word with its number among the text's equal words, so that common tokens count words as often as they stand in both.
Two texts of which the longer has n words must share t = ceil(SHARE n) tokens. With the tokens of each text in one order for all texts, rarest first, the first n - t + DEPTH of
each text hold at least DEPTH of the shared ones (all of them where t is smaller). Longer texts have longer prefixes; within a pair t is that of its longer text. Texts of like length (bands) meet in blocks of bounded size, where shared tokens are counted through postings; the
prefixes are stored once in shares that the blocks read, not sent to each block; neither a template nor a third of all rows in one family changes what is found, as no token is dropped or replaced. Pairs with enough shared tokens are aligned word by word (longest common
subsequence). At the end classes are expanded to the documents.

Defined results: null and blank texts form no pairs; an index row that stands twice counts once; a document in training and evaluation doesn't pair with itself.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialize, small, spread
from . import p1_notices, p3_encoding, p4_scans
from .p9_leaks import NON_ASCII, words

#: Classes that may be broadcast.
SHARED_PRINTS = 2_000_000
#: The share of the longer text's words that must stand in the same order in the other.
SHARE = 0.7
#: Shared tokens that a pair must have in its prefixes, and one more for each 16 words: more makes the prefixes longer and the candidates fewer; the result is the same.
DEPTH = 24
#: Shared tokens that are counted for all pairs of a block, before the others: fewer make the lists that are gone through shorter; the result is the same.
FIRST = 8
#: Training classes in a block.
BLOCK = 1 << 17
#: Evaluation classes in a block where there are few, and at most.
OTHERS, MOST_OTHERS = 1 << 15, 1 << 18
#: Bits of a class's place in its block.
PLACE = np.uint64(32)
#: Buckets of the tokens' frequencies, as a power of two; they only decide the order.
BUCKETS = 19

BASE = np.uint64(0x5851F42D4C957F2D)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words are compared without what scans change in letters.
SIGNS = str.maketrans({"0": "o", "1": "l", "5": "s", "9": "g", "6": "b", "8": "b", "i": "l", "t": "l", "q": "g", "c": "e", "a": "o", "h": "b"})
SOUND = frozenset(map(chr, range(128))) | frozenset("áéíóúàèìòùêôûñÁÉÍÓÚÀÈÌÒÙÊÔÛÑ“”‘’«»–—…")
SIGN = re.compile(r"[-¬\u00ad‐]\s|[¬\u00ad]")
MISREAD = re.compile(r"[@!|]\w|@")
INSIDE = re.compile(r"(?<=[^\W\d_])[@!|](?=[^\W\d_])|@(?=[^\W\d_]{2})|(?<=[^\W\d_]{2})@")
JOINED = re.compile(r"([^\W\d_])[-¬\u00ad‐]\s*\n\s*(?=[a-zñáéíóúàèìòùâêîôû])|([^\W\d_])[¬\u00ad]\s*(?=[a-zñ])|([^\W\d_]{2})- (?=[a-zñ])")


CUT = re.compile(r"[-\u00ad¬‐][^\S\n]*\n")
#: ``SIGN`` and ``CUT`` for the hyphen alone; patterns that begin with one sign are searched for fast.
PLAIN_SIGN, PLAIN_CUT = re.compile(r"-\s"), re.compile(r"-[^\S\n]*\n")


def _maybe_scanned(text: str) -> bool:
    """Whether a text has a sign at a line's end or a line short enough for a page number: a cheap test before ``Page``."""
    cut = PLAIN_CUT.search(text) or (any(c in text for c in "\u00ad¬‐") and CUT.search(text))
    return bool(cut) or any(0 < len(line) <= 16 for line in text.split("\n"))


def body(text: str, title: str | None) -> str:
    """The words of ``text`` as they are compared, between spaces."""
    if not text.isascii() and not SOUND.issuperset("".join(NON_ASCII.findall(text))) and p3_encoding.GARBLED.search(text):
        text = p3_encoding.restore(text)[0]
    if "\n" in text and _maybe_scanned(text):
        page = p4_scans.Page(text, title)
        if page.scanned:
            text = "\n".join(page.lines[k] for k in page.story)
    if PLAIN_SIGN.search(text) or (any(c in text for c in "\u00ad¬‐") and SIGN.search(text)):
        text = JOINED.sub(lambda m: m.group(1) or m.group(2) or m.group(3), text)
    if any(c in text for c in "@!|") and MISREAD.search(text):
        text = INSIDE.sub(lambda m: "a" if m.group() == "@" else "l", text)
    flat = " ".join(words(text))
    for read, written in (("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("li", "h")):
        flat = flat.replace(read, written)
    return flat.translate(SIGNS)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [body(t, x) if t else "" for t, x in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(texts, pa.string())], ["doc_id", "train", "eval", "body"])


def needed(n: np.ndarray) -> np.ndarray:
    """The least number of words that a text whose longer partner has ``n`` words must share with it."""
    return np.ceil(SHARE * n - 1e-9).astype(np.int64)


def tokens(bodies: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all ``bodies``, the number of the body of each, and the number of words of each body. Tokens are hashes: unlike words that meet only add candidates."""
    raw = np.frombuffer((" ".join(bodies) + " ").encode(), np.uint8)
    end = np.flatnonzero(raw == 32)
    start = np.concatenate(([0], end[:-1] + 1))
    # Words are hashed by prefix sums with inverse powers of the base.
    power, back, prefix = np.full(len(raw) + 1, BASE, np.uint64), np.full(len(raw), pow(int(BASE), -1, 1 << 64), np.uint64), np.zeros(len(raw) + 1, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * back, out=prefix[1:])
    h = (prefix[end] - prefix[start]) * power[end]
    size = np.array([b.count(" ") + 1 for b in bodies], np.int64)
    doc = np.repeat(np.arange(len(bodies)), size)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(len(h))
    h = h + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * MIX
    h ^= h >> np.uint64(29)
    h *= MIX
    return (h >> np.uint64(32)).astype(np.uint32), doc, size


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(1 << BUCKETS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            found = tokens(batch.column(0).slice(at, 2000).to_pylist())[0]
            count += np.bincount(found >> np.uint32(32 - BUCKETS), minlength=1 << BUCKETS)
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some])], ["bucket", "n"])


def ranks(bodies: DataFrame) -> np.ndarray:
    """The rank of each bucket of tokens by their frequency in ``bodies``, in steps of a twelfth of an octave."""
    rows = bodies.select("body").mapInArrow(_frequencies, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(1 << BUCKETS, np.int64)
    count[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return np.minimum(np.log2(count + 1) * 12, 1000).astype(np.int16)


def sketches(first: DataFrame, rank: np.ndarray) -> DataFrame:
    """(cid, train, eval, words, band, tokens) of each class: the first of its tokens, rarest first, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found, doc, size = tokens(part.column(3).to_pylist())
                order = np.lexsort((found, rank[found >> np.uint32(32 - BUCKETS)], doc))
                length = np.minimum(size, size - needed(size) + DEPTH + size // 16)  # long texts share more frequent tokens
                keep = np.arange(len(doc)) - (np.cumsum(size) - size)[doc] < length[doc]
                raw, cuts = found[order][keep].tobytes(), 4 * np.cumsum(length)
                band = np.floor(np.log(size) / -np.log(SHARE)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(3)), pa.array(size, pa.int32()), pa.array(band), pa.array([raw[b - 4 * n : b] for b, n in zip(cuts.tolist(), length.tolist())], pa.binary())],
                    ["cid", "train", "eval", "words", "band", "tokens"],
                )

    return materialize(first.select("cid", "train", "eval", "body").mapInArrow(run, "cid bigint, train boolean, eval boolean, words int, band int, tokens binary"), "p7-sketches")


def _flat(side: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cid, words, tokens of all rows in one array and the number of tokens of each row."""
    raw = side.column("tokens").to_pylist()
    return side.column("cid").to_numpy(), side.column("words").to_numpy().astype(np.int64), np.frombuffer(b"".join(raw), np.uint32), np.array([len(x) // 4 for x in raw], np.int64)


def _deep(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many shared tokens the stored prefixes of ``n`` tokens hold at least; texts that are stored whole hold all."""
    return np.where(n < words, n - words + needed(words), np.iinfo(np.int64).max)


def _first(size: np.ndarray) -> np.ndarray:
    """How many shared tokens are counted first for partners of ``size`` words: ``FIRST``, and more where long texts share many frequent ones."""
    return np.minimum(FIRST + size // 32, max(FIRST, DEPTH))


def _place(keys: np.ndarray) -> np.ndarray:
    """The lower half of each key."""
    return keys.view(np.uint32)[0 if sys.byteorder == "little" else 1 :: 2]


def _rest(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The number of tokens that stand after each token in its text."""
    return np.repeat((words - 1 + np.cumsum(n) - n).astype(np.int32), n) - np.arange(n.sum(), dtype=np.int32)


class _Postings:
    """The first tokens of the training classes of a block, as pairs of a token and the place of a class that has it. Classes stand in the order of their words."""

    def __init__(self, words: np.ndarray, token: np.ndarray, n: np.ndarray, most: int) -> None:
        """``most``: the words of the longest partner."""
        self.words, self.least, self.high = words, needed(words), -1
        row = np.repeat(np.arange(len(n), dtype=np.uint32), n)
        rest = _rest(words, n)  # the words after a token; that many and those before must hold what is asked of a pair
        use = rest + np.int32(_first(np.int64(most))) >= self.least.astype(np.int32)[row]
        row, rest = row[use], rest[use]
        keys = token[use].astype(np.uint64)
        keys <<= PLACE
        keys |= row
        del row, use
        order = np.argsort(keys)
        self.rest = rest[order]
        self.all = keys[order]
        del keys, order, rest
        self.spare = self.rest - self.least.astype(np.int32)[_place(self.all)]

    def fit(self, low: int, high: int) -> None:
        """Keep the tokens that count for partners of ``low`` to ``high`` words."""
        if high <= self.high:
            return
        self.high = max(high, low * 21 // 20)
        asked = needed(np.array([low]))[0]
        first, place = int(_first(np.int64(self.high))), _place(self.all)
        fits = (place >= np.uint32(np.searchsorted(self.words, asked))) & (place < np.uint32(np.searchsorted(self.least, self.high, "right")))
        self.keys = self.place = None  # not kept beside the new ones
        self.keys = self.all[fits & (self.spare >= -first) & (self.rest >= int(asked) - first)]
        self.place = _place(self.keys).copy()

    def runs(self, size: np.ndarray, read: np.ndarray, m: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """The runs of places that hold a token of each partner, of lengths that fit: their beginnings and ends, and the number of runs up to the end of each partner."""
        own, of = needed(size), np.repeat(np.arange(len(m)), m)
        most = _rest(size, m) + _first(size)[of]
        use = np.flatnonzero(most >= own[of])
        use = use[np.argsort(read[use])]  # searching in order is faster
        of, key = of[use], read[use].astype(np.uint64) << PLACE
        low = np.searchsorted(self.words, own)[of]
        high = np.searchsorted(self.least, np.arange(size.max() + 1), "right")[np.minimum(size[of], most[use])]
        i, j = np.searchsorted(self.keys, key | low.astype(np.uint64)), np.searchsorted(self.keys, key | high.astype(np.uint64))
        some = np.flatnonzero(i < j)
        some = some[np.argsort(of[some], kind="stable")]
        return i[some].tolist(), j[some].tolist(), np.cumsum(np.bincount(of[some], minlength=len(m))).tolist()


def _met(left: pa.Table, right: pa.Table) -> pa.Table:
    """The pairs (a, b) of a block whose prefixes share as many tokens as a pair above ``SHARE`` must: ``FIRST`` in the first part of each, which is counted for all pairs of lengths that fit,
    and as many as are stored for in the whole, which is counted for the pairs that are left. How long both parts are depends on the longer text of a pair. Only places that a token leads to are
    counted, by sorting them: one that stands ``FIRST`` times follows itself at that distance."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if left.num_rows and right.num_rows:
        left, right = left.sort_by("words"), right.sort_by("words")
        cid, words, token, n = _flat(left)
        least, start, deep = needed(words), np.cumsum(n) - n, _deep(words, n)
        posts = _Postings(words, token, n, right.column("words")[-1].as_py())
        for at in range(0, right.num_rows, 4096):
            others, size, read, m = _flat(right.slice(at, 4096))
            posts.fit(int(size[0]), int(size[-1]))
            i, j, ends = posts.runs(size, read, m)
            own, own_deep, whole, place, done = needed(size), _deep(size, m), np.cumsum(m) - m, posts.place, 0
            for k, (end, t, far) in enumerate(zip(ends, own.tolist(), (np.minimum(_first(size), own) - 1).tolist())):
                if end - done > far:
                    met = np.concatenate([place[p:q] for p, q in zip(i[done:end], j[done:end])])
                    met.sort()
                    hit = met[far:][met[far:] == met[: len(met) - far]]
                    if len(hit):
                        hit = hit[np.concatenate(([True], hit[1:] != hit[:-1]))]
                        most = np.maximum(least[hit], t)
                        asked = np.minimum(np.minimum(deep[hit], own_deep[k]), most)
                        mine = read[whole[k] : whole[k] + m[k]]
                        order = np.argsort(mine, kind="stable")
                        mine, sizes = mine[order], np.minimum(n[hit], words[hit] - most + asked)
                        cuts = np.cumsum(sizes) - sizes
                        theirs = token[np.arange(sizes.sum()) + np.repeat(start[hit] - cuts, sizes)]
                        where = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                        both = np.add.reduceat((mine[where] == theirs) & (order[where] < np.repeat(size[k] - most + asked, sizes)), cuts, dtype=np.int64)
                        hit = hit[(both >= asked) & (cid[hit] != others[k])]
                        a.append(cid[hit])
                        b.append(np.full(len(hit), others[k]))
                done = end
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def shares(train: int, near: int) -> tuple[int, int]:
    """The numbers of shares into which the training and the evaluation classes that a band meets go; each share of one side meets each of the other in a block of its own."""
    return -(-train // BLOCK), max(min(8, -(-near // OTHERS)), -(-near // MOST_OTHERS))


def _readable(file: str) -> bool:
    """Whether Python reads ``file`` where Spark does; not every kind of shared folder is known to it."""
    try:
        system, path = fs.FileSystem.from_uri(file)
        return system.get_file_info(path).is_file
    except (pa.ArrowException, OSError):
        return False


def _share(files: list[str]) -> pa.Table:
    """The classes in ``files``."""
    parts = []
    for file in files:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as source:
            parts.append(pq.ParquetFile(source).read(columns=["cid", "words", "tokens"]))
    return pa.concat_tables(parts)


def _met_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield from _met(_share(left), _share(right)).to_batches()


def candidates(sketch: DataFrame) -> DataFrame:
    """(a, b) of the training and evaluation classes that may share enough words, each pair once, as a stored table. Each class is stored in one share of its band and side, and blocks read the
    shares that meet in them, so what is shuffled and stored grows with the classes and not with the blocks."""
    spark = sketch.sparkSession
    sides = sketch.where("train or eval").groupBy("band").agg(F.count_if("train").alias("t"), F.count_if("eval").alias("e")).collect()
    train, near = {r.band: r.t for r in sides}, {r.band: 0 for r in sides}
    for r in sides:
        for band in (r.band - 1, r.band, r.band + 1):  # lengths in a ratio of SHARE or more are in the same band or the next
            near[band] = near.get(band, 0) + r.e
    use = sorted((k for k in train if train[k] and near[k]), key=lambda k: -train[k] * near[k])
    if not use:
        return materialize(spark.createDataFrame([], "a bigint, b bigint"), "p7-candidates")
    counts = F.broadcast(spark.createDataFrame([(r.band, max(1, shares(r.t, r.e)[0]), max(1, -(-r.e // OTHERS))) for r in sides], "band int, ts int, es int"))  # one row a band
    place = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int").alias("share")
    side = lambda name, n: sketch.where(F.col(name)).join(counts, "band").select(F.lit(name).alias("side"), "band", place(n), "cid", "words", "tokens")
    kept = side("train", "ts").unionByName(side("eval", "es")).repartition("side", "band", "share")
    files: dict[tuple[str, int], dict[int, list[str]]] = {}
    stored = materialize(kept, "p7-shares", "side", "band", "share")
    for file in (names := stored.inputFiles()):
        of, band, number = re.search(r"/side=(\w+)/band=(\d+)/share=(\d+)/[^/]*$", file).groups()
        files.setdefault((of, int(band)), {}).setdefault(int(number), []).append(file)
    blocks = []  # the training classes' share, and the shares of the evaluation classes that it meets
    for k in use:
        others = [(band, number) for band in (k - 1, k, k + 1) for number in sorted(files.get(("eval", band), {}))]
        parts = min(len(others), shares(train[k], near[k])[1])
        blocks += [(k, number, others[at::parts]) for number in sorted(files["train", k]) for at in range(parts)]
    if _readable(names[0]):
        rows = [(files["train", k][number], [x for band, other in met for x in files["eval", band][other]]) for k, number, met in blocks]
        kind = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("left", "right")])
        met = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), kind).mapInArrow(_met_files, "a bigint, b bigint")
    else:
        met = _sent(stored, blocks)
    return materialize(met, "p7-candidates")


def _sent(stored: DataFrame, blocks: list[tuple[int, int, list[tuple[int, int]]]]) -> DataFrame:
    """(a, b) of ``blocks`` where Python can't read the shared folder: copies of the shares are sent to each of their blocks."""
    rows = [("train", k, number, at) for at, (k, number, _) in enumerate(blocks)] + [("eval", *x, at) for at, (_, _, met) in enumerate(blocks) for x in met]
    copies = stored.join(F.broadcast(stored.sparkSession.createDataFrame(rows, "side string, band int, share int, block int")), ["side", "band", "share"])
    left, right = (copies.where(F.col("side") == x).select(*[F.col(c).alias(c) for c in ("block", "cid", "words", "tokens")]) for x in ("train", "eval"))
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(_met, "a bigint, b bigint")


def common_words(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, in bit-parallel form."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & where.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        share = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = x.split(), y.split()
            share.append(common_words(a, b) / max(len(a), len(b), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], ["a", "b", "share"])


def roles(index: DataFrame, heldout: DataFrame) -> DataFrame:
    """(doc_id, train, eval) of each document of the two indexes."""
    high = index.select("doc_id", (F.col("split_role") == "train").alias("train"), F.col("split_role").isin("val", "test").alias("eval"))
    low = heldout.select("doc_id", F.lit(False).alias("train"), F.lit(True).alias("eval"))
    return high.unionByName(low).where("doc_id is not null and (train or eval)").groupBy("doc_id").agg(F.bool_or("train").alias("train"), F.bool_or("eval").alias("eval"))


def notices(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no) of the lines of problem 1 that are notices in texts. Where whole texts are copied, their own lines are repeated as well: a line isn't a notice if in most of the documents
    in which it stands repeated lines are so great a part of the text that without them no copy could be seen as one."""
    lines = materialize(p1_notices.line_table(docs, parts=True), "p1-lines")
    keys = p1_notices.confirmed(lines).select("h1", "h2")
    found = materialize(lines.join(small(keys, p1_notices.BROADCAST_LINES), ["h1", "h2"], "left_semi").select("doc_id", "line_no", "h1", "h2", "part"), "p7-repeated")
    held = found.groupBy("doc_id").agg((F.sum("part") > 1 - SHARE).alias("copy"))
    copied = found.join(held, "doc_id").groupBy("h1", "h2").agg(F.count_if("copy").alias("n"), F.count("*").alias("all")).where("2 * n > all").select("h1", "h2")
    return found.join(small(materialize(copied, "p7-copied"), SHARED_PRINTS), ["h1", "h2"], "left_anti").select("doc_id", "line_no")


def _classes(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``bodies`` (doc_id, train, eval, body, cid, check), stored, and (cid, train, eval, doc_id, copies) of each class of equal words. Texts are equal if two hashes are; where texts with
    the same first hash have different second ones, each gets a class of its own."""
    bodies = materialize(bodies, "p7-bodies")
    clash = materialize(bodies.groupBy("cid").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("cid", "low"), "p7-clash")
    if clash.limit(1).count():
        apart = F.when(F.col("low").isNotNull() & (F.col("check") != F.col("low")), F.xxhash64("cid", "check")).otherwise(F.col("cid"))
        bodies = materialize(bodies.join(small(clash, SHARED_PRINTS), "cid", "left").withColumn("cid", apart).drop("low"), "p7-bodies")
    per = bodies.groupBy("cid").agg(F.bool_or("train").alias("train"), F.bool_or("eval").alias("eval"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return bodies, materialize(per, "p7-classes")


def class_pairs(df: DataFrame, index: DataFrame, heldout: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, share) of the training classes a and evaluation classes b that overlap, each class with itself included, and the members (doc_id, train, eval, cid) of the classes."""
    docs = df.select("doc_id", "language", "title", "text")
    sides = roles(index, heldout)
    cut = notices(docs).join(sides.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_set("line_no").alias("cut"))
    kept = F.expr("array_join(filter(split(text, '\n'), (x, i) -> cut is null or not array_contains(cut, i + 1)), '\n')")
    # Spread before the join: to tell the partitions of a join, Spark runs its shuffles, and then once more for the result.
    texts = spread(docs).where("text is not null").join(sides.join(cut, "doc_id", "left"), "doc_id").select("doc_id", "train", "eval", kept.alias("text"), "title")
    found = texts.mapInArrow(_bodies, "doc_id bigint, train boolean, eval boolean, body string").where("body <> ''")
    bodies, classes = _classes(found.withColumns({"cid": F.xxhash64("body"), "check": F.xxhash64(F.lit("second"), "body")}))
    # One document stands for all with the same words.
    many = classes.where("copies > 1").select("cid", "train", "eval", F.col("doc_id").alias("first"))
    marked = bodies.select("doc_id", "cid", "body", F.col("train").alias("t"), F.col("eval").alias("e")).join(small(many, SHARED_PRINTS), "cid", "left").where("first is null or doc_id = first")
    first = marked.select("cid", F.coalesce("train", "t").alias("train"), F.coalesce("eval", "e").alias("eval"), "body")
    pairs = candidates(sketches(first, ranks(first)))
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct().join(classes.select("cid", "doc_id"), "cid")
    text = materialize(bodies.select("doc_id", "cid", "body").join(small(wanted, SHARED_PRINTS), ["doc_id", "cid"]).select("cid", "body"), "p7-texts")
    full = pairs.join(text.select(F.col("cid").alias("a"), F.col("body").alias("ta")), "a").join(text.select(F.col("cid").alias("b"), F.col("body").alias("tb")), "b")
    near = full.select("a", "b", "ta", "tb").mapInArrow(_aligned, "a bigint, b bigint, share double").where(F.col("share") >= SHARE)
    same = classes.where("train and eval").select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("share"))
    return near.unionByName(same), bodies.select("doc_id", "train", "eval", "cid")


def overlaps(df: DataFrame, index: DataFrame, heldout: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b, share), smaller id first, of each training and evaluation text of which at least ``SHARE`` of the longer one's words stand in order in the other."""
    near, members = class_pairs(df, index, heldout)
    left = members.where("train").select(F.col("doc_id").alias("t"), F.col("cid").alias("a"))
    right = members.where("eval").select(F.col("doc_id").alias("e"), F.col("cid").alias("b"))
    found = near.join(left, "a").join(right, "b").where("t <> e")
    return found.select(F.least("t", "e").alias("doc_id_a"), F.greatest("t", "e").alias("doc_id_b"), "share").groupBy("doc_id_a", "doc_id_b").agg(F.max("share").alias("share"))


def coverage(df: DataFrame, index: DataFrame, heldout: DataFrame) -> DataFrame:
    """(doc_id, split_role, source, partners, share) of each evaluation document that overlaps with training: how many training documents it overlaps with, and the largest share of words.
    Classes of equal texts are counted, not expanded into pairs."""
    near, members = class_pairs(df, index, heldout)
    near, sizes = materialize(near, "p7-near"), members.where("train").groupBy(F.col("cid").alias("a")).agg(F.count("*").alias("n"))
    per = near.join(sizes, "a").groupBy("b").agg(F.sum("n").alias("n"), F.max("share").alias("share"), F.max_by("n", F.col("a") == F.col("b")).alias("own"), F.max(F.when(F.col("a") != F.col("b"), F.col("share"))).alias("other"))
    # A document that is on both sides itself doesn't overlap with itself.
    docs = members.where("eval").join(per.withColumnRenamed("b", "cid"), "cid").withColumn("partners", F.col("n") - F.col("train").cast("int"))
    kept = docs.where("partners > 0").select("doc_id", "partners", F.when(F.col("train") & (F.col("own") == 1), F.col("other")).otherwise(F.col("share")).alias("share"))
    return kept.join(eval_splits(index, heldout), "doc_id").join(df.select("doc_id", "source"), "doc_id").select("doc_id", "split_role", "source", "partners", "share")


def eval_splits(index: DataFrame, heldout: DataFrame) -> DataFrame:
    high = index.select("doc_id", "split_role").where("split_role in ('val', 'test')")
    return high.unionByName(heldout.select("doc_id", F.lit("heldout").alias("split_role"))).where("doc_id is not null").distinct()


def report(df: DataFrame, index: DataFrame, heldout: DataFrame) -> DataFrame:
    """By split and source: evaluation documents, how many of them overlap with training and their share, the training documents they overlap with (summed over them) and the mean share of words."""
    found = coverage(df, index, heldout).groupBy("split_role", "source").agg(F.count("*").alias("overlapping"), F.sum("partners").alias("links"), F.avg("share").alias("mean_share"))
    every = eval_splits(index, heldout).join(df.select("doc_id", "source"), "doc_id").groupBy("split_role", "source").agg(F.count("*").alias("eval_docs"))
    both = every.withColumnRenamed("source", "s").withColumnRenamed("split_role", "r").join(found, (F.col("r") == F.col("split_role")) & F.col("s").eqNullSafe(F.col("source")))
    return both.select("split_role", "source", "eval_docs", "overlapping", (F.col("overlapping") / F.col("eval_docs")).alias("covered"), "links", "mean_share")
