"""Problem 6: statistics of each text, and texts that are not natural prose.

Statistics are taken of all lines of an Arrow batch at once and summed per document (partial sums before the shuffle), without the lines that problem 1 finds repeated. An ordered
list of rules is induced by incremental reduced-error pruning on labelled documents and exported as one SQL CASE expression that Spark evaluates on the sums.

The labelled documents are real ones: a sample of at most about ``SAMPLE`` texts, drawn by hash whatever the language. As no kind is stored, each gets the kind that independent signals agree
on (``kind_by_signals``: sentences, running lines, regular cells, items, words known to other texts); a text on which they disagree or say nothing is left out. The signals aren't
the statistics that the rules test. A third of the labelled texts is held out, to choose among rule lists grown in several orders. The common words are the
``COMMON`` most frequent words of each language, however few its texts.

Defined results: null and blank texts have no statistics; a text of repeated lines only has no rest and is called prose; repeated rows of a doc_id are summed, so ids should be unique.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import small, spread
from . import p1_notices

#: Texts that rules are learned and held out on, about; drawn by hash.
SAMPLE = 15_000
#: Words called common, of each language.
COMMON = 30
#: Orders in which rules are grown; the best on held-out documents is kept.
ORDERS = 4
KINDS = ("table", "junk", "list")

FEATURES = ("words_per_line", "word_length", "symbol_share", "digit_share", "end_share", "common_share", "bullet_share", "gaps_per_line", "break_share", "hump_share", "cluster_share", "letter_share")


WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts: dict[str, list[str]] = defaultdict(list)
        for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts[source].append(text)
        for source, own in texts.items():
            # Words hold no white space, so tokens are counted first and only distinct ones are taken apart.
            n: Counter[str] = Counter()
            for token, times in Counter("\n".join(own).lower().split()).items():
                for w in (token,) if token.isalpha() else WORD.findall(token):
                    n[w] += times
            yield pa.RecordBatch.from_arrays([pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["source", "word", "n"])


def word_counts(df: DataFrame) -> DataFrame:
    """(source, word, n) of all texts of ``df``, counted per batch before the shuffle."""
    texts = spread(df.select("language", "text")).where("text is not null and language is not null").select(p1_notices.source_key(F.col("language")).alias("source"), "text")
    return texts.mapInArrow(_counted, "source string, word string, n bigint").groupBy("source", "word").agg(F.sum("n").alias("n"))


def common_words(df: DataFrame, names: DataFrame | None = None, most: int = COMMON) -> list[str]:
    """The ``most`` most frequent words of each language in ``names`` (language), else of each stored label that isn't blank, in order."""
    counts = word_counts(df).where("source <> ''")
    if names is not None:
        valid = names.select(p1_notices.source_key(F.col("language")).alias("source")).distinct()
        counts = counts.join(F.broadcast(valid), "source", "left_semi")  # a few names
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "word"))
    return sorted(r[0] for r in counts.withColumn("place", place).where(F.col("place") <= most).select("word").distinct().collect())


# Classes of the characters of the basic plane, as bits.
LETTER, DIGIT, SPACE, SYMBOL, UPPER, LOWER, CONSONANT, PART = (1 << k for k in range(8))
ENDS = re.compile(r"[.!?…][”’\"»')]*\s*$")
BULLET = re.compile(r"\s*(?:[-•*·–—▪◦●]|\d+[.)])\s")
BASE = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class bits and the lower case of every character of the basic plane."""
    bits, low = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32)
    plain = frozenset(".,!?…\"“”‘’«»':;()–—-")
    for c in range(0x10000):
        x = chr(c)
        if x.isalpha():
            bits[c] = LETTER | PART | (UPPER if x.isupper() else LOWER if x.islower() else 0) | (CONSONANT if x.lower() in "bcdfghjklmnpqrstvwxyz" else 0)
            if len(x.lower()) == 1:
                low[c] = ord(x.lower())
        elif x.isspace():
            bits[c] = SPACE
        elif "0" <= x <= "9":
            bits[c] = DIGIT
        elif not x.isnumeric() and x not in plain and not 0x300 <= c <= 0x36F:
            bits[c] = SYMBOL
    return bits, low


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def word_hash(word: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for c in word:
        h = h * BASE + np.uint64(ord(c) + 1)
    return h[0]


def measured(lines: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each line, all lines at once; ``common`` holds the sorted hashes of the common words."""
    if not _tables:
        _tables.append(_classes())
    bits, low = _tables[0]
    size = np.array([len(x) for x in lines], np.int64) + 1
    c = np.minimum(np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "replace"), np.uint32), 0xFFFF)
    start = np.cumsum(size) - size
    b = bits[c]
    per = lambda hits: np.add.reduceat(hits.astype(np.int32), start)
    has = lambda bit: (b & bit) != 0
    shift = lambda a, k: np.concatenate((np.zeros(k, a.dtype), a[:-k]))
    after = lambda a, k: np.concatenate((a[k:], np.zeros(k, a.dtype)))
    letter, space, digit = has(LETTER), has(SPACE), has(DIGIT)
    blank = c == 32
    separator = (c == 44) | (c == 59)
    wide = blank & after(blank, 1) & after(blank, 2)
    dots = (c == 46) & after(c == 46, 1) & after(c == 46, 2) & after(blank, 3)
    gap = (c == 9) | (c == 124) | (separator & ~after(space, 1)) | (wide & ~shift(wide, 1)) | dots
    seen = np.cumsum(~space)
    gap &= seen > np.repeat(seen[start] - (~space[start]), size)  # something stands before it in its line
    consonant = has(CONSONANT)
    plain = consonant & (low[c] != ord("n"))
    four, three = consonant & shift(consonant, 1) & shift(consonant, 2) & shift(consonant, 3), plain & shift(plain, 1) & shift(plain, 2)
    cluster = four | three
    # Words with inner hyphens, hashed by prefix sums with inverse powers of the base.
    part = letter | ((c == 45) & shift(letter, 1) & after(letter, 1))
    first, last = np.flatnonzero(part & ~shift(part, 1)), np.flatnonzero(part & ~after(part, 1))
    total = len(c)
    power, back = np.ones(total + 1, np.uint64), np.ones(total + 1, np.uint64)
    np.multiply.accumulate(np.full(total, BASE, np.uint64), out=power[1:])
    np.multiply.accumulate(np.full(total, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64), out=back[1:])
    prefix = np.zeros(total + 1, np.uint64)
    np.cumsum((low[c].astype(np.uint64) + np.uint64(1)) * back[1:], out=prefix[1:])
    h = (prefix[last + 1] - prefix[first]) * power[last + 1]
    known = np.zeros(total, bool)
    if len(common) and len(h):
        known[first] = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
    return {
        "letters": per(letter), "chars": per(~space), "words": per(letter & ~shift(letter, 1)), "digits": per(digit), "symbols": per(has(SYMBOL)),
        "ends": np.array([ENDS.search(x) is not None for x in lines], np.int32), "bullets": np.array([BULLET.match(x) is not None for x in lines], np.int32), "gaps": per(gap),
        "breaks": per((separator | (c == 0x2022) | (c == 47)) & after(blank, 1)), "common": per(known),
        "humps": per((has(LOWER) & after(has(UPPER), 1)) | (letter & after(digit, 1)) | (digit & after(letter, 1))), "clusters": per(cluster & ~shift(cluster, 1)),
    }


def text_lines(df: DataFrame, notices: DataFrame | None) -> DataFrame:
    """(doc_id, line, pos) of each line that isn't blank and not among ``notices``."""
    base = spread(df.select("doc_id", "text")).where(F.col("text").isNotNull())
    lines = base.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"(?U)\S"))
    if notices is not None:
        # Only a line with enough letters can be a notice.
        letters = F.when(F.length("line") >= p1_notices.LEAST_LETTERS, p1_notices.letters_hash(p1_notices.line_letters(F.col("line"))))
        lines = lines.withColumn("any", letters).join(small(notices, p1_notices.BROADCAST_LINES), "any", "left_anti")
    return lines.select("doc_id", "line", "pos")


def line_statistics(df: DataFrame, common: list[str], notices: DataFrame | None) -> DataFrame:
    """One row per line that isn't blank and not among ``notices``, with what is summed per document."""
    hashes = np.sort(np.array([word_hash(w) for w in common], np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = measured(batch.column(1).to_pylist(), hashes)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(m[c], pa.int32()) for c in SUMS]], ["doc_id", *SUMS])

    return text_lines(df, notices).select("doc_id", "line").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} int" for c in SUMS))


SUMS = ("letters", "chars", "words", "digits", "symbols", "ends", "bullets", "gaps", "breaks", "common", "humps", "clusters")


def statistics(df: DataFrame, common: list[str], notices: DataFrame | None = None) -> DataFrame:
    """The statistics of each text of ``df`` (doc_id, language, text) without the lines whose hashes are in ``notices``."""
    lines = line_statistics(df, common, notices)
    sums = lines.groupBy("doc_id").agg(F.count("*").alias("lines"), *[F.sum(c).alias(c) for c in SUMS])
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).alias
    return sums.select(
        "doc_id", "lines", "words", "letters",
        per("words", "lines")("words_per_line"), per("letters", "words")("word_length"), per("symbols", "chars")("symbol_share"), per("digits", "chars")("digit_share"),
        per("ends", "lines")("end_share"), per("common", "words")("common_share"), per("bullets", "lines")("bullet_share"), per("gaps", "lines")("gaps_per_line"), per("breaks", "words")("break_share"),
        per("humps", "words")("hump_share"), per("clusters", "words")("cluster_share"), per("letters", "chars")("letter_share"),
    )


SENTENCE_END = re.compile(r"[.!?…]+[\"”’»')]*(?:\s+|$)")
MARKED = re.compile(r"\s*(?:[-•*·–—▪◦●]\s|\d{1,3}[.)]\s|\w[.)]\s)")
PAIRED = re.compile(r"\s*[^\s–—=:-]+(?:\s[^\s–—=:-]+){0,2}\s*[–—=:-]\s*\S+(?:\s\S+){0,2}\s*$")
CELL_ENDS = tuple(re.compile(p) for p in (r",(?!\s\w+\s\w+\s\w+)", ";", "\t", r"\|", r"\.{3,}| {3,}"))
#: Cell ends that a row has at least, for each sort: commas and semicolons also stand in sentences.
LEAST_ENDS = (2, 2, 1, 1, 1)
PARTED = re.compile(r"[,;•/]\s")
NUMBER = re.compile(r"(?<![^\s,;|])-?\d+(?:\.\d+)?(?![^\s,;|])")


def kind_by_signals(lines: list[str], common: set[str], known: set[str]) -> str | None:
    """The kind on which the signals of a text's lines agree, or None.

    Signals: the share of its letters in sentences (four words or more, a common one, an end mark) and in running lines (words with common ones among them), the share of lines that are
    items or rows of cells, the parts between separators of a text of few lines, and the share of its letters in words that other texts have.
    """
    flat = " ".join(x.strip() for x in lines)
    words = WORD.findall(flat.lower())
    letters = sum(map(len, words))
    if not letters:
        return "junk"
    size = lambda found: sum(map(len, found))
    familiar = sum(len(w) for w in words if len(w) > 2 and w in known) / letters
    told = at = 0
    for m in SENTENCE_END.finditer(flat):
        unit = WORD.findall(flat[at : m.start()].lower())
        at = m.end()
        if len(unit) >= 4 and not common.isdisjoint(unit):
            told += size(unit)
    running = items = 0
    ends: list[list[int]] = [[] for _ in CELL_ENDS]
    for x in lines:
        unit = WORD.findall(x.lower())
        for k, p in enumerate(CELL_ENDS):
            ends[k].append(len(p.findall(x)))
        among = sum(w in common for w in unit)
        if MARKED.match(x) or PAIRED.match(x) or (len(unit) <= 4 and not among and not SENTENCE_END.search(x)):
            items += 1
        elif len(unit) >= 3 and among >= 0.15 * len(unit):
            running += size(unit)
    n, told, running, items = len(lines), told / letters, running / letters, items / len(lines)
    cells = max(sum(e >= least for e in x) for least, x in zip(LEAST_ENDS, ends)) / n
    regular = max(max((times for e, times in Counter(x).items() if e >= least), default=0) for least, x in zip(LEAST_ENDS, ends)) / n
    numbers = len(NUMBER.findall(flat))
    tabular = n >= 3 and told < 0.3 and cells >= 0.7 and (regular >= 0.5 or numbers >= 0.25 * (numbers + len(words)))
    parts = len(PARTED.findall(flat)) + 1
    votes = []
    if familiar < 0.3 and told < 0.2 and running < 0.2 and not tabular:
        votes.append("junk")
    if tabular and (familiar >= 0.3 or numbers >= n):
        votes.append("table")
    if familiar >= 0.4 and told < 0.1 and ((n >= 4 and items >= 0.8 and cells < 0.3) or (n <= 3 and parts > 6 and len(words) <= 2.6 * parts)):
        votes.append("list")
    if (told >= 0.5 or running >= 0.6) and items < 0.5 and cells < 0.3:
        votes.append("prose")
    return votes[0] if len(votes) == 1 else None


def labelled(df: DataFrame, common: list[str], notices: DataFrame | None, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The statistics and the kinds of about ``most`` texts of ``df`` on which the signals agree."""
    texts = df.where("text is not null and doc_id is not null")
    share = min(1.0, most / max(texts.count(), 1))
    place = F.xxhash64("doc_id").bitwiseAND((1 << 53) - 1).cast("double") / float(1 << 53)
    sample = texts.where(place < share).select("doc_id", "language", "text")
    lines = text_lines(sample, notices)
    words = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(r"\p{L}+(?:-\p{L}+)*"), F.lit(0)))
    seen = lines.select("doc_id", F.explode(words).alias("word")).groupBy("word").agg(F.count_distinct("doc_id").alias("n")).where("n >= 3")
    known, usual = {r[0] for r in seen.select("word").collect()}, set(common)
    whole = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines")).select("doc_id", "lines.line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kind_by_signals(x, usual, known) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "kind"])

    kinds = {r[0]: r[1] for r in whole.mapInArrow(run, "doc_id bigint, kind string").where("kind is not null").collect()}
    pdf = statistics(sample, common, notices).toPandas().sort_values("doc_id")
    pdf = pdf[pdf["doc_id"].isin(list(kinds))]
    return pdf[list(FEATURES)].to_numpy(float), np.array([kinds[d] for d in pdf["doc_id"]], object)


# Rules are lists of conditions (feature, "<=" or ">", threshold).


def _covers(rule: list[tuple[int, str, float]], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, op, t in rule:
        hit &= x[:, f] <= t if op == "<=" else x[:, f] > t
    return hit


def _grow(x: np.ndarray, y: np.ndarray) -> list[tuple[int, str, float]]:
    """Adds the condition of the most information gained until the rule covers no other kind."""
    rule: list[tuple[int, str, float]] = []
    live = np.ones(len(x), bool)
    while (~y[live]).any() and len(rule) < 6:
        p0, n0 = y[live].sum(), (~y[live]).sum()
        best = (1e-9, None)
        for f in range(x.shape[1]):
            order = np.argsort(x[live, f], kind="stable")
            v, c = x[live, f][order], y[live][order]
            p, n = np.cumsum(c), np.cumsum(~c)
            cut = np.flatnonzero(np.diff(v) > 0)
            if not len(cut):
                continue
            for op, pp, nn in (("<=", p[cut], n[cut]), (">", p0 - p[cut], n0 - n[cut])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0))), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, op, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= _covers([best[1]], x)
    return rule


def _prune(rule: list, x: np.ndarray, y: np.ndarray) -> list:
    """Drops final conditions as long as (right - wrong) / covered on the pruning part doesn't fall."""

    def worth(r: list) -> float:
        hit = _covers(r, x)
        p, n = y[hit].sum(), (~y[hit]).sum()
        return (p - n) / max(p + n, 1)

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def induce(x: np.ndarray, kinds: np.ndarray, seed: int = 11) -> list[tuple[str, list[tuple[int, str, float]]]]:
    """The ordered rules (kind, conditions) by incremental reduced-error pruning; what none covers is prose."""
    rng = np.random.default_rng(seed)
    rules, left = [], np.ones(len(x), bool)
    for kind in KINDS:
        while (kinds[left] == kind).any():
            at = rng.permutation(np.flatnonzero(left))
            grow, prune = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
            if not (kinds[grow] == kind).any():
                break
            rule = _prune(_grow(x[grow], kinds[grow] == kind), x[prune], kinds[prune] == kind)
            hit = _covers(rule, x[prune])
            if not rule or not hit.any() or (kinds[prune][hit] == kind).mean() < 0.95:
                break
            rules.append((kind, rule))
            left &= ~_covers(rule, x)
    return rules


def assign(rules: list[tuple[str, list[tuple[int, str, float]]]], x: np.ndarray) -> np.ndarray:
    """The kind that the ordered rules give each row."""
    out = np.full(len(x), "prose", object)
    for kind, rule in reversed(rules):
        out[_covers(rule, x)] = kind
    return out


def as_case(rules: list[tuple[str, list[tuple[int, str, float]]]]) -> str:
    """The rules as an SQL expression over the columns of ``statistics``."""
    whens = "".join(f" WHEN {' AND '.join(f'{FEATURES[f]} {op} {t:.6g}D' for f, op, t in rule)} THEN '{kind}'" for kind, rule in rules)
    return f"CASE{whens} ELSE 'prose' END" if whens else "'prose'"


def learned_rules(x: np.ndarray, kinds: np.ndarray) -> tuple[list[tuple[str, list[tuple[int, str, float]]]], float]:
    """The best of ``ORDERS`` rule lists on a third of the documents that none of them saw, and its share of right kinds there, each kind weighing the same."""
    held = np.random.default_rng(5).random(len(x)) < 1 / 3
    some = [k for k in ("prose", *KINDS) if (kinds[held] == k).any()]

    def worth(rules: list) -> float:
        given = assign(rules, x[held])
        right = lambda k: ((given == k) & (kinds[held] == k)).sum()
        return float(np.mean([2 * right(k) / ((given == k).sum() + (kinds[held] == k).sum()) for k in some])) if some else 0.0

    tried = [induce(x[~held], kinds[~held], seed) for seed in range(11, 11 + ORDERS)]
    best = max(tried, key=worth)
    return best, worth(best)


def learned_case(df: DataFrame, common: list[str], notices: DataFrame | None) -> str:
    """The CASE expression learned on a sample of ``df``."""
    x, kinds = labelled(df, common, notices)
    return as_case(learned_rules(x, kinds)[0]) if len(x) else "'prose'"


def kinds_of(df: DataFrame, names: DataFrame | None, notices: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The statistics and the kind of each text of ``df`` (doc_id, language, text), or of those whose doc_id is in ``only``; everything that is learned comes from all of ``df``."""
    df = df.select("doc_id", "language", "text")
    common = common_words(df, names)
    case = learned_case(df, common, notices)
    wanted = df if only is None else df.join(small(only.select("doc_id").distinct(), p1_notices.BROADCAST_LINES), "doc_id", "left_semi")
    return statistics(wanted, common, notices).withColumn("kind", F.expr(case))


def judged(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The statistics of each text of ``df`` (doc_id, language, text) and its kind: prose, list, table or junk; ``names`` has the valid languages."""
    return kinds_of(df, names, p1_notices.notice_hashes(df))
