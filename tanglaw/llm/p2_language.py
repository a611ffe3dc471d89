"""Problem 2: the language of each text and of each line in another language, with a confidence.

A byte convolutional network: text in lower case, without accents, is cut as UTF-8 into windows of ``WINDOW`` bytes; filters of several widths, max pooling over the window
and a softmax over the languages. Letters, the hyphen and every byte from 0x80 on that is not rare in training have a symbol of their own, so any script can be learned; rare and unseen bytes
share one. It is trained in numpy on the driver, on about ``SAMPLE`` texts a language that carry a valid label. For use the filters of
a width are folded into tables over symbol triples where the alphabet is small enough (``TRIPLES``), so a window costs a few gathers, whatever the width.

Each line (without the lines of problem 1) gets the log-probabilities of its windows, or ``OTHER`` if most of its letters are ones that training hasn't seen; a text's language is the one in which
most of its letters stand; a line is in another language if it is likelier by ``LINE_ODDS``.

Defined results: null and blank texts get no row; a text without letters, or of repeated lines only, gets no language and the confidence 0; rows with the same doc_id count as one text. Texts of
problem 6 get a language like others but are never reported as wrong.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize, small, spread
from . import p1_notices, p6_quality

#: Labelled texts for each language that the network is trained on, at most, and windows taken from them.
SAMPLE, WINDOWS = 700, 4000
#: Filters of each width.
WINDOW, FILTERS = 96, {3: 32, 6: 144}
WIDTHS = tuple(FILTERS)
EPOCHS, BATCH, RATE = 5, 256, 6e-3
#: A line counts as foreign from this log-odds on; short lines weigh less, so they must be clearer.
LINE_ODDS = 3.0
#: What a text in none of the known languages is called.
OTHER = "other"
#: Largest table over symbol triples; larger alphabets use a table for each place.
TRIPLES = 1 << 16
#: Share of the letters in training from which on a byte has a symbol of its own.
RARE = 1e-4

PAD = max(WIDTHS)
NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
_folds: dict[str, str] = {}


def _fold(m: re.Match) -> str:
    run = m.group()
    out = _folds.get(run)
    if out is None:
        if len(_folds) > 100_000:
            _folds.clear()
        plain = (c for c in unicodedata.normalize("NFD", run) if unicodedata.category(c) != "Mn")
        out = _folds[run] = "".join(c if c.isalpha() or c.isascii() else " " for c in plain)
    return out


def folded(text: str) -> bytes:
    """The UTF-8 bytes of ``text`` in lower case, without accents; other characters than letters that aren't ASCII are spaces."""
    text = text.lower()
    return text.encode() if text.isascii() else NOT_ASCII.sub(_fold, text).encode("utf-8", "replace")


def alphabet(lines: list[bytes]) -> np.ndarray:
    """The symbol of each byte: 0 for what separates words, 1-26 for a-z, 27 for the hyphen, 28 for rare bytes, and further ones for the bytes from 0x80 on that ``lines`` hold often enough."""
    out = np.zeros(256, np.int32)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("-")] = 27
    out[0x80:] = 28
    count = np.bincount(np.frombuffer(b"".join(lines), np.uint8), minlength=256)
    often = np.flatnonzero(count[0x80:] > RARE * count[out > 0].sum()) + 0x80
    out[often] = 29 + np.arange(len(often))
    return out


def windows(texts: list[str], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol windows of all ``texts``, one row each of WINDOW + PAD columns, and the number of the text of each."""
    rows, owner = [], []
    for k, text in enumerate(texts):
        b = folded(text)
        n = max(1, -(-len(b) // WINDOW))
        step = -(-len(b) // n) or 1
        for i in range(n):
            rows.append(b[i * step : (i + 1) * step].ljust(WINDOW + PAD - 1))
            owner.append(k)
    joined = b"".join(b" " + r for r in rows)
    return symbol[np.frombuffer(joined, np.uint8)].reshape(len(rows), WINDOW + PAD), np.array(owner, np.int64)


class Network:
    """Filters as one table per place of a width: tables[width][place, symbol, filter]."""

    def __init__(self, languages: list[str], symbol: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages, self.symbol, self.size = languages, symbol, max(int(symbol.max()), 28) + 1
        self.step = 3 if self.size**3 <= TRIPLES else 1
        self.tables = {w: rng.normal(0, 1 / np.sqrt(w), (w, self.size, FILTERS[w])).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS[w], np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (sum(FILTERS.values()), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def fold(self) -> None:
        """The tables of each three places as one table over symbol triples, if these are few enough."""
        if self.step == 1:
            self.parts = {w: list(t) for w, t in self.tables.items()}
            return
        self.parts = {
            w: [(t[k][:, None, None] + t[k + 1][None, :, None] + t[k + 2][None, None, :]).reshape(-1, FILTERS[w]) for k in range(0, w, 3)] for w, t in self.tables.items()
        }

    def codes(self, x: np.ndarray) -> np.ndarray:
        """What the folded tables are indexed with at each place of ``x``."""
        if self.step == 1:
            return x
        n = x.shape[1]
        return (x[:, : n - 2] * self.size + x[:, 1 : n - 1]) * self.size + x[:, 2:]

    def features(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Pooled filter values of symbol windows ``x`` and where each maximum stands."""
        n, code = x.shape[1], self.codes(x)
        pooled, where = [], {}
        for w in WIDTHS:
            m = n - w + 1
            z = self.parts[w][0][code[:, :m]]
            for j, table in enumerate(self.parts[w][1:], 1):
                z += table[code[:, self.step * j : self.step * j + m]]
            where[w] = z.argmax(axis=1)
            pooled.append(np.maximum(z.max(axis=1) + self.bias[w], 0))
        return np.concatenate(pooled, axis=1), where

    def quantize(self) -> None:
        """The folded tables as 16-bit numbers, scaled so that no sum overflows: half the memory traffic, which is what use of the network costs."""
        self.small = {}
        for w, tables in self.parts.items():
            scale = 32_000 / max(sum(float(np.abs(t).max()) for t in tables), 1e-6)
            self.small[w] = ([np.round(t * scale).astype(np.int16) for t in tables], np.float32(1 / scale))

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """``features`` from the 16-bit tables."""
        n, code = x.shape[1], self.codes(x)
        out = []
        for w, (tables, unit) in self.small.items():
            m = n - w + 1
            z = np.take(tables[0], code[:, :m], axis=0, mode="clip")
            for j, table in enumerate(tables[1:], 1):
                z += np.take(table, code[:, self.step * j : self.step * j + m], axis=0, mode="clip")
            out.append(np.maximum(z.max(axis=1) * unit + self.bias[w], 0))
        return np.concatenate(out, axis=1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        # Windows of like fill go together, and of the spaces at their ends only as many are read as make a place of spaces alone, whose values are the same wherever it is.
        fill = x.shape[1] - (x[:, ::-1] > 0).argmax(axis=1)
        fill[~(x > 0).any(axis=1)] = 0
        order = np.argsort(fill, kind="stable")
        for at in range(0, len(x), 16):
            rows = order[at : at + 16]
            s = self.pooled(x[rows, : fill[rows[-1]] + PAD + 1]) @ self.out + self.out_bias
            s -= s.max(axis=1, keepdims=True)
            out[rows] = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        return out

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
        """Adam on the cross entropy, labels smoothed a little as some are wrong."""
        rng = np.random.default_rng(seed)
        k = len(self.languages)
        params = [*self.tables.values(), *self.bias.values(), self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, steps = 0, EPOCHS * -(-len(x) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                pick = order[at : at + BATCH]
                a, t = x[pick], y[pick]
                self.fold()
                h, where = self.features(a)
                keep = (rng.random(h.shape) < 0.8).astype(np.float32) / 0.8
                d = h * keep
                s = d @ self.out + self.out_bias
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                goal = np.full_like(p, 0.03 / k)
                goal[np.arange(len(t)), t] += 0.97
                g = (p - goal) / len(t)
                gh = (g @ self.out.T) * keep * (h > 0)
                grads = []
                parts = np.split(gh, np.cumsum([FILTERS[w] for w in WIDTHS])[:-1], axis=1)
                for w, gw in zip(WIDTHS, parts):
                    table = np.empty_like(self.tables[w])
                    for q in range(w):
                        c = np.take_along_axis(a, where[w] + q, axis=1)
                        table[q] = np.bincount((c * FILTERS[w] + np.arange(FILTERS[w])).ravel(), gw.ravel(), self.size * FILTERS[w]).reshape(self.size, FILTERS[w])
                    grads.append(table)
                grads += [gw.sum(axis=0) for gw in parts]
                grads += [d.T @ g, g.sum(axis=0)]
                step += 1
                rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for i, grad in enumerate(grads):
                    m[i] += 0.1 * (grad - m[i])
                    v[i] += 0.001 * (grad * grad - v[i])
                    params[i] -= (rate * m[i] / (np.sqrt(v[i]) + 1e-8)).astype(np.float32)
        self.fold()
        self.quantize()


def training_windows(rows: list[tuple[str, str]], languages: list[str], seed: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of random length from labelled lines (language, line), as many for each language, the number of the language of each, and the alphabet."""
    rng = np.random.default_rng(seed)
    number = {x: k for k, x in enumerate(languages)}
    by: dict[int, list[bytes]] = {k: [] for k in number.values()}
    for language, line in rows:
        by[number[language]].append(folded(line))
    symbol = alphabet([b for lines in by.values() for b in lines])
    xs, ys = [], []
    for k, lines in by.items():
        if not lines:
            continue
        size = np.array([len(b) for b in lines], float)
        for i in rng.choice(len(lines), WINDOWS, p=size / size.sum()):
            b = lines[i]
            n = int(rng.integers(24, WINDOW + 1))
            a = int(rng.integers(0, max(1, len(b) - n + 1)))
            xs.append(b" " + b[a : a + n].ljust(WINDOW + PAD - 1))
            ys.append(k)
    return symbol[np.frombuffer(b"".join(xs), np.uint8)].reshape(len(xs), WINDOW + PAD), np.array(ys), symbol


def trained(texts: DataFrame, notices: DataFrame, languages: list[str]) -> Network:
    """The network trained on the lines of a bounded sample of the labelled texts (doc_id, source, text), drawn by hash."""
    labelled = texts.where(F.col("source").isin(languages))
    count = {r[0]: r[1] for r in labelled.groupBy("source").agg(F.count("*")).collect()}
    place = F.xxhash64("doc_id").bitwiseAND((1 << 53) - 1).cast("double") / float(1 << 53)
    share = F.element_at(F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, SAMPLE / max(count.get(x, 1), 1)))]), F.col("source"))
    sample = text_lines(labelled.where(place < share), notices).where(F.length("line") >= 30)
    x, y, symbol = training_windows(sorted((r[0], r[1]) for r in sample.select("source", "line").collect()), languages)
    net = Network(languages, symbol)
    if len(x):
        net.train(x, y)
    else:
        net.fold()
        net.quantize()
    return net


def text_lines(texts: DataFrame, notices: DataFrame) -> DataFrame:
    """(doc_id, source, line_no, letters, line) of the lines of ``texts`` (doc_id, source, text) that aren't among ``notices``."""
    lines = texts.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''")
    found = p1_notices.line_letters(F.col("line"))
    # Both columns in one projection, so that the letters are taken once.
    hashed = F.when(F.length(found) >= p1_notices.LEAST_LETTERS, p1_notices.letters_hash(found)).alias("any")
    lines = lines.select("doc_id", "source", (F.col("pos") + 1).alias("line_no"), F.length(found).alias("letters"), "line", hashed)
    return lines.join(small(notices, p1_notices.BROADCAST_LINES), "any", "left_anti").drop("any")


def _reader(net: Network):
    columns = [f"s{k}" for k in range(len(net.languages))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                part = part.filter(pa.compute.greater(part.column(2), 0))
                if not part.num_rows:
                    continue
                texts = part.column(3).to_pylist()
                x, owner = windows(texts, net.symbol)
                share = (x > 0).sum(axis=1).astype(np.float32)
                score = net.log_probabilities(x)
                # A window counts by its letters, as a short rest says little.
                weight = np.minimum(1, share / 40)[:, None]
                total = np.zeros((len(texts), score.shape[1]), np.float32)
                np.add.at(total, owner, score * weight)
                strange = np.bincount(owner, (x == 28).sum(axis=1), len(texts)) > 0.5 * np.bincount(owner, share, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(strange), *[pa.array(total[:, k]) for k in range(total.shape[1])]], ["doc_id", "line_no", "letters", "strange", *columns])

    return run, "doc_id bigint, line_no int, letters int, strange boolean, " + ", ".join(f"{c} float" for c in columns)


def line_scores(df: DataFrame, names: DataFrame, notices: DataFrame) -> tuple[DataFrame, list[str]]:
    """(doc_id, line_no, letters, strange, s0, s1, ...) of each line with letters that isn't among ``notices``, and the languages that the scores belong to."""
    languages = sorted({r[0].strip().lower() for r in names.select("language").collect() if r[0]})
    texts = spread(df).where("text is not null and doc_id is not null").select("doc_id", p1_notices.source_key(F.col("language")).alias("source"), "text")
    net = trained(texts, notices, languages)
    run, schema = _reader(net)
    return text_lines(texts, notices).select("doc_id", "line_no", "letters", "line").mapInArrow(run, schema), languages


def scored(df: DataFrame, names: DataFrame, notices: DataFrame) -> DataFrame:
    """(doc_id, line_no, language, confidence): line_no 0 for each text with letters, and each line in another language than most of its text."""
    table, languages = line_scores(df, names, notices)
    table = materialize(table, "p2-lines")
    n = len(languages)
    cols = [F.col(f"s{k}") for k in range(n)]
    best = F.greatest(*cols)
    at = F.when(F.col("strange"), n + 1).otherwise(F.array_position(F.array(*cols), best).cast("int"))
    named = F.array(*[F.lit(x) for x in (*languages, OTHER)])
    lines = table.withColumn("at", at)
    per = lines.groupBy("doc_id").agg(
        *[F.sum(F.when(F.col("at") == k + 1, F.col("letters")).otherwise(0)).alias(f"n{k}") for k in range(n + 1)],
        *[F.sum(F.when(~F.col("strange"), F.col(f"s{k}"))).alias(f"t{k}") for k in range(n)], F.sum("letters").alias("all"),
    )
    # Most letters decide; the summed scores break ties.
    strength = [F.col(f"n{k}") + F.lit(1e-6) * (F.coalesce(F.col(f"t{k}"), F.lit(0.0)) if k < n else F.lit(0.0)) for k in range(n + 1)]
    index = F.array_position(F.array(*strength), F.greatest(*strength)).cast("int")
    docs = per.select("doc_id", index.alias("i"), (F.element_at(F.array(*[F.col(f"n{k}") for k in range(n + 1)]), index) / F.col("all")).alias("confidence"))
    own = F.coalesce(F.get(F.array(*cols), F.col("i") - 1), F.lit(-1e9))
    foreign = (
        lines.join(docs.select("doc_id", "i"), "doc_id").where((F.col("at") != F.col("i")) & (F.col("strange") | (best - own >= LINE_ODDS)))
        .select("doc_id", "line_no", F.element_at(named, F.col("at")).alias("language"), F.when(F.col("strange"), 1.0).otherwise(1 / (1 + F.exp(own - best))).alias("confidence"))
    )
    return docs.select("doc_id", F.lit(0).alias("line_no"), F.element_at(named, F.col("i")).alias("language"), "confidence").unionByName(foreign)


def judged(df: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, line_no, language, confidence): line_no 0 for each text that isn't blank, and each line in another language than most of its text."""
    df = df.select("doc_id", "language", "text")
    result = materialize(scored(df, names, p1_notices.notice_hashes(df)), "p2-labels")
    told = F.col("text").isNotNull() & F.col("text").rlike(r"(?U)\S") & F.col("doc_id").isNotNull()
    silent = df.where(told).select("doc_id").distinct().join(result.where("line_no = 0"), "doc_id", "left_anti")
    return result.unionByName(silent.select("doc_id", F.lit(0).alias("line_no"), F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence")))


def wrong_labels(df: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of ``scored`` that correct something: texts whose stored language is null, unknown or another, and foreign lines, those of problem 6's texts left out."""
    df = df.select("doc_id", "language", "text")
    notices = p1_notices.notice_hashes(df)
    result = scored(df, names, notices)
    stored = df.select("doc_id", p1_notices.source_key(F.col("language")).alias("stored"))
    wrong = (F.col("line_no") > 0) | F.col("stored").isNull() | (F.col("stored") != F.col("language"))
    found = materialize(result.where(F.col("language") != OTHER).join(stored, "doc_id").where(wrong).drop("stored"), "p2-wrong")
    # Only texts in question are looked at for problem 6.
    odd = p6_quality.kinds_of(df, names, notices, found).where("kind <> 'prose'").select("doc_id")
    return found.join(small(odd, p1_notices.BROADCAST_LINES), "doc_id", "left_anti")
