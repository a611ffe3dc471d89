"""Problem 8: the corpus as token ids of a public byte-level BPE.

Speculate and verify. A text is cut into words by the vocabulary's own pattern; each distinct word of a batch that the worker hasn't met is
covered greedily by the longest tokens (all words at once, by rolling hashes), and every adjacent pair of proposed tokens is tested at once for
compatibility. If all pairs of a word are compatible the proposal is its encoding: a token sequence is what merging by rank yields exactly when
merging the bytes of each two neighbours yields these two. Only words with a failing pair are merged exactly.

Pairs are tested by undoing merges at their border, latest first: the pair is incompatible if some two pieces that meet at the border would have been
merged before one of them was itself merged further.

Defined results: null and empty texts have an empty list; repeated texts get equal lists; whole texts at any length; lone surrogates can't occur in Spark strings.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from ..sources.tables import spread

# Fixed value: the pattern that cuts a text into words, as the vocabulary's description states it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words that a worker keeps; beyond that it starts afresh.
CACHE = 500_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The vocabulary file, in ``TANGLAW_TOKENIZERS`` or where the installed public_tokenizers has it."""
    folder = os.environ.get("TANGLAW_TOKENIZERS", "/opt/tokenizers")
    if os.path.exists(f"{folder}/{name}"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Tokens, the pair each was merged from, and hashes for finding the longest token at a place."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        n = max(self.ranks.values()) + 1
        self.spelled = [b""] * n
        for token, rank in self.ranks.items():
            self.spelled[rank] = token
        self.n, self.left, self.right = n, np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        self.longest = max(map(len, self.ranks))
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = self.merge(token, rank)
                if len(parts) == 2:
                    self.left[rank], self.right[rank] = parts
        pairs = np.flatnonzero(self.left != np.arange(n))
        key = self.left[pairs] * n + self.right[pairs]
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], pairs[order]
        # Tokens that merging never yields from their own bytes may not be proposed.
        whole = np.ones(n, bool)
        whole[pairs] = self.compatible(self.left[pairs], self.right[pairs], pairs)
        for token in sorted(self.ranks, key=len):
            rank = self.ranks[token]
            if len(token) > 1:
                whole[rank] &= self.left[rank] != rank and whole[self.left[rank]] and whole[self.right[rank]]
        by_len: dict[int, list[tuple[bytes, int]]] = {}
        for token, rank in self.ranks.items():
            if whole[rank]:
                by_len.setdefault(len(token), []).append((token, rank))
        self.tables = []
        for size in sorted(by_len, reverse=True):
            if size > 1:
                h = np.zeros(len(by_len[size]), np.uint64)
                for column in np.frombuffer(b"".join(t for t, _ in by_len[size]), np.uint8).reshape(-1, size).T:
                    h = h * BASE + (column.astype(np.uint64) + np.uint64(1))
                order = np.argsort(h)
                self.tables.append((size, h[order], np.array([r for _, r in by_len[size]], np.int64)[order]))

    def merge(self, word: bytes, limit: int = 1 << 60) -> list[int]:
        """The exact encoding of ``word`` using merges of a rank below ``limit``."""
        ranks, parts = self.ranks, [word[i : i + 1] for i in range(len(word))]
        if len(parts) > 64:
            return self.merge_long(parts, limit)
        while len(parts) > 1:
            best, at = limit, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def merge_long(self, parts: list[bytes], limit: int) -> list[int]:
        """``merge`` for long words: a heap of pairs over a linked list, so that time grows as n log n."""
        import heapq

        ranks, n = self.ranks, len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                r = ranks.get(parts[i] + parts[j])
                if r is not None and r < limit:
                    heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ranks[p] for p, x in zip(parts, alive) if x]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, or a number above all."""
        key = a * self.n + b
        k = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[k] == key, self.pair_rank[k], 1 << 60)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the tokens of each pair stay apart when their bytes are merged together; with ``limit``, up to the merge of that rank."""
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        born = np.full(len(a), 1 << 60, np.int64) if limit is None else limit.astype(np.int64).copy()
        while len(live):
            joined = self.rank_of(a[live], b[live])
            clash = joined < born[live]
            ok[live[clash]] = False
            live = live[~clash]
            x, y = a[live], b[live]
            # The piece made last is undone; single bytes can't be.
            sx, sy = np.where(self.left[x] == x, -1, x), np.where(self.left[y] == y, -1, y)
            more = (sx >= 0) | (sy >= 0)
            live, x, y, sx, sy = live[more], x[more], y[more], sx[more], sy[more]
            on_left = sx > sy
            # A merge right of the border comes before an equal one left of it only if its rank is smaller, as merging goes from the left.
            a[live] = np.where(on_left, self.right[x], x)
            b[live] = np.where(on_left, y, self.left[y])
            born[live] = np.where(on_left, x, y + 1)
        return ok

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest tokens of all words: the tokens, and how many each word has."""
        size = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(size)
        value = text.astype(np.uint64) + np.uint64(1)
        # Window hashes by doubling would need one pass per length; prefix sums with inverse powers give any window at once.
        total = len(text)
        power = np.ones(total + 1, np.uint64)
        np.multiply.accumulate(np.full(total, BASE, np.uint64), out=power[1:])
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        back = np.ones(total + 1, np.uint64)
        np.multiply.accumulate(np.full(total, inverse, np.uint64), out=back[1:])
        prefix = np.zeros(total + 1, np.uint64)
        np.cumsum(value * back[1:], out=prefix[1:])
        at, live = end - size, np.arange(len(words))
        steps, owners = [], []
        while len(live):
            p, room = at[live], end[live] - at[live]
            token, length = self.byte[text[p]], np.ones(len(live), np.int64)
            todo = np.arange(len(live))
            for n, table, rank in self.tables:
                try_ = todo[room[todo] >= n]
                if not len(try_):
                    continue
                q = p[try_]
                h = (prefix[q + n] - prefix[q]) * power[q + n]
                k = np.minimum(np.searchsorted(table, h), len(table) - 1)
                hit = table[k] == h
                token[try_[hit]], length[try_[hit]] = rank[k[hit]], n
                if hit.any():
                    todo = todo[length[todo] == 1]
            steps.append(token)
            owners.append(live)
            at[live] += length
            live = live[at[live] < end[live]]
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(steps)[order], np.bincount(owner, minlength=len(words))

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The exact encodings of distinct non-empty words."""
        tokens, count = self.propose(words)
        owner = np.repeat(np.arange(len(words)), count)
        inner = owner[1:] == owner[:-1]
        bad = np.zeros(len(words), bool)
        bad[owner[1:][inner][~self.compatible(tokens[:-1][inner], tokens[1:][inner])]] = True
        out = np.split(tokens.astype(np.int32), np.cumsum(count)[:-1])
        # Tokens are proposed by hash; what they spell is held against the words.
        spelled = list(map(self.spelled.__getitem__, tokens.tolist()))
        if b"".join(spelled) != b"".join(words):
            end = np.cumsum(count).tolist()
            for i, word in enumerate(words):
                bad[i] |= b"".join(spelled[end[i] - int(count[i]) : end[i]]) != word
        for i in np.flatnonzero(bad):
            out[i] = np.array(self.merge(words[i]), np.int32)
        return out


class Encoder:
    """Encodes batches of texts; keeps the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.find = vocabulary, regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.parts, self.pending = [], []
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if len(self.number) > CACHE:
            self.clear()
        number, counts, codes = self.number, [], []
        for text in texts:
            found = self.find(text) if text else ()
            counts.append(len(found))
            for w in set(found).difference(number) if found else ():
                number[w] = len(number)
                self.pending.append(w)
            codes.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        if self.pending:
            fresh = self.vocabulary.encode([w.encode() for w in self.pending])
            self.pending = []
            size = np.array([len(x) for x in fresh], np.int64)
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, *fresh))
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        size = self.size[code] if len(code) else code
        upto = np.cumsum(size)
        flat = self.flat[np.repeat(self.start[code] - (upto - size), size) + np.arange(upto[-1])] if len(code) else np.zeros(0, np.int32)
        ends = np.concatenate(([0], upto))[np.cumsum(counts)] if counts else np.zeros(0, np.int64)
        return flat, np.diff(ends, prepend=0)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(Vocabulary(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, count = _encoders[path].batch(part.column(1).to_pylist())
                offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return run


def token_ids(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every row of ``df`` (doc_id, text). The vocabulary file goes with the job, so only the driver must have it."""
    path = path or vocabulary_path()
    df.sparkSession.sparkContext.addFile(path)
    return spread(df.select("doc_id", "text")).mapInArrow(_encoder(path), "doc_id bigint, ids array<int>")
