"""Problem 4: noise in text from scanned pages.

``Page`` finds, in one text, the lines that are running headers or page numbers and the words cut apart. Misread words are found with a symmetric-delete index over
the corpus frequency lexicon: words are reduced to a skeleton in which what scans take for one letter (rn, ri, ii, vv, cl, and c for e, q for g) is that letter, every word of the lexicon and every
doubtful word is filed under its skeleton and its skeleton less one letter, and words that meet are compared by a weighted edit distance that knows the confusion pairs and, for long words, a
dropped or added letter. Words with signs or digits among their letters meet the lexicon's words that these can stand for. Where several repairs
remain, the count of the bigram with the word before picks one, then frequency.

Defined results: null and blank texts and texts that don't look scanned have no rows and stay as they are; a compound that owns a hyphen keeps it; repeated rows are each reported. Whole texts are processed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize, spread
from . import p3_encoding

# What scans make of letters (read as, written).
PAIRS = (("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("cl", "d"), ("h", "li"))
SURE = (("c", "e"), ("q", "g"))
SINGLES = (("o", "a"), ("a", "o"), ("e", "c"), ("t", "l"), ("l", "t"), ("b", "h"), ("h", "b"), ("i", "l"), ("l", "i"), ("u", "n"), ("n", "u"))
SIGNS = {"@": "a", "0": "o", "1": "il", "!": "il", "|": "il", "5": "s", "9": "g", "6": "b", "8": "b", "$": "s"}
#: A word counts as misread if the likeliest reading is at least this many times as frequent in texts that weren't scanned, and itself at least LEAST times there.
RATIO, LEAST = 400, 4
#: Letters from which on a word may have lost or gained one.
LONG = 8

HYPHENS = "-­¬‐"
CUT_END = regex.compile(rf"(\p{{L}}[\p{{L}}\p{{M}}'@!0-9-]*)[{HYPHENS}]\s*$")
CUT_IN = regex.compile(rf"(?<![\p{{L}}{HYPHENS}])(\p{{L}}[\p{{L}}\p{{M}}@!0-9]*)[{HYPHENS}]\s+(\p{{Ll}}[\p{{L}}\p{{M}}]*)|(\p{{L}}+)[­¬](\p{{L}}+)")
HEAD = regex.compile(r"^\s*([\p{L}@!0-9][\p{L}\p{M}@!0-9]*)")
NUMBER = r"(?:[0-9lIOoSsBZ|!]{0,3}[0-9][0-9lIOoSsBZ!]{0,3}|[ivxlcIVXLC]{1,8}|[lIO]{1,3})"
PAGE = regex.compile(
    rf"^[\s\W]*(?:(?:page|pahina|panid|pag|pah|pg|p|dahon|bilang|no|numero)\b\.?\s*)?{NUMBER}(?:\s*(?:\||/|of|sa|ng|kan|:)\s*{NUMBER})?[\s\W]*$", regex.IGNORECASE
)
# A header's page number after or before it; both patterns read a line once.
NUMBER_AFTER = regex.compile(rf"(?<!\s)\s{{2,}}+{NUMBER}\s*$")
NUMBER_BEFORE = regex.compile(rf"^\s*{NUMBER}\s{{2,}}")
LETTER = regex.compile(r"\p{L}")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MIXED = regex.compile(
    r"(?<![\p{L}\p{N}@!])(?:\p{L}+[@!|$015689]+\p{L}[\p{L}@!|$015689]*|[@!015689]+\p{Ll}[\p{L}@!015689]*\p{L}|\p{L}{2,}[@015689](?![\p{L}\p{N}@!])|\p{L}{2,}!(?=\s+\p{Ll}))"
)
#: A native test that every scanned text meets.
SIGN_OF_SCAN = rf"\p{{L}}[{HYPHENS}]\s*\n|\p{{L}}[{HYPHENS}] \p{{Ll}}|(?m:^[^\p{{L}}\n]*(?:\p{{L}}+\.? )?[0-9ivxlIO|/ ]{{1,9}}[^\p{{L}}\n]*$)|\p{{L}}[­¬]\p{{L}}|   ?[0-9ivxl]{{1,4}}\s*\n"


def _letters(line: str) -> str:
    return "".join(filter(str.isalpha, line.lower()))


#: One letter for all that a scan may make of it, to compare headers.
FOLD = str.maketrans({"@": "a", "0": "a", "o": "a", "1": "i", "!": "i", "|": "i", "l": "i", "t": "i", "5": "s", "9": "g", "q": "g", "6": "b", "8": "b", "h": "b", "c": "e", "n": "u"})


def _folded(line: str) -> str:
    line = line.lower()
    for read, written in (("rn", "m"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("li", "h")):
        line = line.replace(read, written)
    return _letters(line.translate(FOLD))


def _head(line: str) -> str:
    """``line`` without a page number that stands apart at its end or beginning."""
    m = NUMBER_AFTER.search(line)
    if m and LETTER.search(line, 0, m.start()):
        return line[: m.start()]
    m = NUMBER_BEFORE.match(line)
    return line[m.end() :] if m and LETTER.search(line, m.end()) else line


class Page:
    """One text: its lines, their kinds (header, page or none), and the words cut apart."""

    def __init__(self, text: str, title: str | None):
        if p3_encoding.GARBLED.search(text):
            text = p3_encoding.restore(text)[0]
        self.lines = text.split("\n")
        n = len(self.lines)
        self.kind: list[str | None] = [None] * n
        full = [k for k in range(n) if self.lines[k].strip()]
        for k in full:
            s = self.lines[k].strip()
            if len(s) <= 16 and PAGE.match(s) and (any(c.isdigit() for c in s) or len(s) <= 8):
                self.kind[k] = "page"
        heads = [_head(x) for x in self.lines]
        keys = [_letters(h) for h in heads]
        own, own_folded = _letters(title or ""), _folded(title or "")
        widths = sorted(len(self.lines[k]) for k in full if self.kind[k] is None)
        width = widths[len(widths) // 2] if widths else 0
        count: dict[str, int] = {}
        for k in full:
            if self.kind[k] is None:
                count[keys[k]] = count.get(keys[k], 0) + 1
        for k in full:
            if self.kind[k] or not 4 <= len(keys[k]) <= 70 or len(self.lines[k].split()) > 11:
                continue
            plain = self.lines[k].rstrip()[-1:] not in ".!?,”’\"»;:"
            numbered = heads[k] != self.lines[k]
            titled = bool(own) and len(own) > 5 and (keys[k].startswith(own) or own in keys[k] or (len(keys[k]) > 8 and _near(keys[k], own)) or own_folded[:9] in _folded(self.lines[k]))
            beside = any(0 <= j < n and self.kind[j] == "page" for j in self._around(k))
            repeated = count.get(keys[k], 0) > 1
            named = len(self.lines[k].strip()) <= 0.75 * width and bool(re.search(r"\b(?:ni|of|n1|n!)\b|·", self.lines[k].lower()))
            if plain and ((beside and named) or (titled and (k or numbered or repeated)) or numbered or (beside and repeated) or (repeated and count[keys[k]] > 2)):
                self.kind[k] = "header"
        headers = {keys[k] for k in full if self.kind[k] == "header"}
        for k in full:  # a header that was misread once
            if self.kind[k] is None and headers and len(self.lines[k].split()) <= 11 and any(0 <= j < n and self.kind[j] == "page" for j in self._around(k)):
                if any(_near(keys[k], h) for h in headers) and self.lines[k].rstrip()[-1:] not in ".!?,”’\"»;:":
                    self.kind[k] = "header"
        self.story = [k for k in full if self.kind[k] is None]
        self.cuts: list[tuple[int, int, str, str]] = []  # first line, second line, left, right
        for i, k in enumerate(self.story):
            if not any(c in self.lines[k] for c in HYPHENS):  # no cut is without one
                continue
            for m in CUT_IN.finditer(self.lines[k]):
                self.cuts.append((k, k, m.group(1) or m.group(3), m.group(2) or m.group(4)))
            m = CUT_END.search(self.lines[k])
            if m and i + 1 < len(self.story):
                j = self.story[i + 1]
                h = HEAD.match(self.lines[j])
                if h and (h.group(1)[0].islower() or not h.group(1)[0].isalpha() or m.group(1).isupper()):
                    self.cuts.append((k, j, m.group(1), h.group(1)))
        wrapped = sum(self.lines[k].rstrip()[-1:].isalpha() for k in self.story[:-1]) >= max(2, 0.3 * len(self.story))
        furniture = sum(x is not None for x in self.kind)
        ended = any(a != b for a, b, _, _ in self.cuts)
        self.scanned = ended or (wrapped and furniture > 0 and any(x == "page" for x in self.kind)) or (wrapped and bool(self.cuts)) or (furniture > 1 and len(self.story) > furniture and wrapped)

    def _around(self, k: int) -> list[int]:
        """The full lines next to line k."""
        out = []
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(self.lines) and not self.lines[j].strip():
                j += step
            out.append(j)
        return out

    def words(self) -> list[tuple[int, str, str]]:
        """(line, word, word before) of the story's words, in lower case; a cut word stands whole on the line where it begins."""
        ends = {(a, left): right for a, b, left, right in self.cuts if a != b}
        skip = {(b, right) for a, b, left, right in self.cuts if a != b}
        out, before = [], ""
        for k in self.story:
            line = self.lines[k]
            found = list(WORD.finditer(line))
            for i, m in enumerate(found):
                w = m.group()
                if i == 0 and (k, w) in skip:
                    continue
                if i == len(found) - 1 and (k, w) in ends and line[m.end() :].strip(HYPHENS + " \t") == "":
                    w += ends[(k, w)]
                elif m.end() < len(line) and line[m.end()] in "@!0156789|" and (m.end() + 1 >= len(line) or not line[m.end() + 1].isspace()):
                    continue
                elif m.start() and line[m.start() - 1] in "@0156789|":
                    continue
                w = w.lower()
                out.append((k, w, before))
                before = w
        return out


def _near(a: str, b: str) -> bool:
    """Whether two keys differ by little: one is most of the other, or they share beginning and end."""
    if not a or not b or abs(len(a) - len(b)) > 4:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= max(len(a), len(b)) - 4 and p + s >= 5


def skeleton(word: Column) -> Column:
    """A word with what scans confuse with one letter as that letter."""
    out = F.regexp_replace(word, "rn", "m")
    for read, written in (("ri", "n"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("cl", "d")):
        out = F.regexp_replace(out, read, written)
    return F.translate(out, "cq", "eg")


def deletes(word: Column) -> Column:
    """The skeleton of ``word`` and it less each one letter, for words of three letters or more."""
    s = skeleton(word)
    less = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    return F.array_distinct(F.when(F.length(s) > 2, F.array_append(less, s)).otherwise(F.array(s)))


def explains(read: str, word: str, n: int) -> bool:
    """Whether ``read`` is ``word`` with one or two misread places: the weighted edit distance where sure confusions cost 1, letters that also make
    another word of the language cost 2 (and only count against a frequent ``word``), a dropped or added letter costs 2 in a word of ``LONG`` letters or more, and all else is out of reach."""
    cost = {(0, 0): 0}
    unsure = 2 if n >= 25 and len(read) > 3 else 9
    lost = 2 if n >= 25 and len(word) >= LONG else 9
    for i in range(len(read) + 1):
        for j in range(len(word) + 1):
            c = cost.get((i, j), 9)
            if c > 2:
                continue
            if i < len(read) and j < len(word) and read[i] == word[j]:
                cost[(i + 1, j + 1)] = min(c, cost.get((i + 1, j + 1), 9))
            for at in ((i + 1, j), (i, j + 1)):
                if 0 < at[0] < len(read) and 0 < at[1] < len(word):  # not at either end, where endings of the language are
                    cost[at] = min(c + lost, cost.get(at, 9))
            for pairs, price in ((PAIRS, 1), (SURE, 1), (SINGLES, unsure)):
                for a, b in pairs:
                    if read.startswith(a, i) and word.startswith(b, j):
                        at = (i + len(a), j + len(b))
                        cost[at] = min(c + price, cost.get(at, 9))
    return 0 < cost.get((len(read), len(word)), 9) <= 2


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows: list[tuple] = []
            part = batch.slice(at, 500)
            for doc, title, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                page = Page(text, title)
                if not page.scanned:
                    continue
                rows += [(doc, k + 1, kind, "", "") for k, kind in enumerate(page.kind) if kind]
                rows += [(doc, a + 1, "cut", left.lower(), right.lower()) for a, _, left, right in page.cuts]
                rows += [(doc, k + 1, "char", m.group().lower(), "") for k in page.story for m in MIXED.finditer(page.lines[k])]
                rows += [(doc, k + 1, "word", w, before) for k, w, before in page.words() if len(w) > 1]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(columns[k], pa.string()) for k in (2, 3, 4)]], ["doc_id", "line_no", "kind", "word", "other"]
            )


def scanned_parts(df: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, word, other) of the scanned texts of ``df`` (doc_id, title, text), as a stored table; kind: header, page, cut, char or word."""
    suspects = spread(df.select("doc_id", "title", "text")).where(F.col("text").rlike(SIGN_OF_SCAN))
    return materialize(suspects.mapInArrow(_scan, "doc_id bigint, line_no int, kind string, word string, other string"), "p4-parts")


def lexicon(df: DataFrame, parts: DataFrame) -> DataFrame:
    """(word, n) of the words of texts that weren't scanned, compounds whole, as a stored table."""
    clean = df.select("doc_id", "text").where("text is not null").join(parts.select("doc_id").distinct(), "doc_id", "left_anti")
    words = spread(clean).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{M}]*(?:-\p{L}+)*"), F.lit(0))).alias("word"))
    return materialize(words.groupBy("word").agg(F.count("*").alias("n")), "p4-lexicon")


def misread(parts: DataFrame, lex: DataFrame) -> DataFrame:
    """(word, repair, n) of the words of scanned texts that misread a far more frequent one, by the symmetric-delete index, as a stored table."""
    seen = parts.where("kind = 'word'").select("word").distinct().join(lex, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("own"))
    index = lex.where((F.col("n") >= LEAST) & (F.length("word") > 1) & ~F.col("word").contains("-")).select(F.col("word").alias("repair"), "n", F.explode(deletes(F.col("word"))).alias("key"))
    filed = seen.select("word", "own", F.explode(deletes(F.col("word"))).alias("key"))
    pairs = filed.join(index, "key").where((F.col("word") != F.col("repair")) & (F.col("own") * RATIO <= F.col("n"))).select("word", "repair", "n").distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [explains(*x) for x in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return materialize(pairs.mapInArrow(check, "word string, repair string, n bigint"), "p4-misread")


def true_cuts(parts: DataFrame, lex: DataFrame) -> DataFrame:
    """(doc_id, line_no, word, other) of words that the scan cut apart; compounds with a hyphen of their own are left out."""
    cuts = parts.where("kind = 'cut'").select("doc_id", "line_no", "word", "other")
    joined, own = F.concat("word", "other"), F.concat_ws("-", "word", "other")
    counts = cuts.select(F.explode(F.array(joined, own)).alias("word")).distinct().join(lex, "word")
    found = (
        cuts.join(counts.select(F.col("word").alias("j"), F.col("n").alias("nj")), joined == F.col("j"), "left")
        .join(counts.select(F.col("word").alias("o"), F.col("n").alias("no")), own == F.col("o"), "left")
    )
    compound = (F.coalesce("no", F.lit(0)) > F.coalesce("nj", F.lit(0))) | (F.coalesce("nj", F.lit(0)) == 0) & (F.col("word") == F.col("other"))
    return found.where(~compound).select("doc_id", "line_no", "word", "other")


def faults(df: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind) of the faults of the scanned texts of ``df`` (doc_id, title, text): header, page, hyphen, char."""
    parts = scanned_parts(df)
    lex = lexicon(df, parts)
    wrong = misread(parts, lex).select("word").distinct()
    plain = parts.where("kind in ('header', 'page')").select("doc_id", "line_no", "kind")
    # A word with signs is a misread one only if the lexicon has a word that they can stand for.
    mixed = parts.where("kind = 'char'").join(readings(parts, lex).select("word").distinct(), "word", "left_semi").select("doc_id", "line_no", "kind")
    hyphen = true_cuts(parts, lex).select("doc_id", "line_no", F.lit("hyphen").alias("kind"))
    char = parts.where("kind = 'word'").join(wrong, "word", "left_semi").select("doc_id", "line_no", F.lit("char").alias("kind"))
    return plain.unionByName(mixed).unionByName(hyphen).unionByName(char).distinct()


# One letter for all that a sign may stand for, to file words under.
_SIGNED, _LETTERED = "i@01!|5968$", "laolllsgbbs"


def readings(parts: DataFrame, lex: DataFrame) -> DataFrame:
    """(word, repair, n) of words with signs or digits for letters: every reading that the lexicon has. Words are filed under one letter for each sign, so no reading is spelled out."""
    key = lambda c: F.translate(c, _SIGNED, _LETTERED).alias("key")
    mixed = parts.where("kind = 'char'").select("word").distinct().select("word", key(F.col("word")))
    met = mixed.join(lex.select(F.col("word").alias("repair"), "n", key(F.col("word"))), "key").select("word", "repair", "n")

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [all(b in SIGNS.get(a, a) for a, b in zip(x, y)) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(fits, "word string, repair string, n bigint")


def chosen(df: DataFrame, parts: DataFrame, lex: DataFrame) -> DataFrame:
    """(doc_id, word, repair): for each misread word of a text the repair that most often follows the word before it, else the most frequent."""
    options = materialize(misread(parts, lex).unionByName(readings(parts, lex)), "p4-options")
    places = parts.where("kind in ('word', 'char')").select("doc_id", "word", F.when(F.col("kind") == "word", F.col("other")).otherwise("").alias("before")).distinct().join(options, "word")
    wanted = materialize(places.where("before <> ''").select("before", "repair").distinct(), "p4-bigrams")
    clean = spread(df.select("doc_id", "text").where("text is not null"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{M}]*"), F.lit(0))
    pairs = clean.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("before"), F.expr("slice(w, 2, size(w) - 1)").alias("repair"))).alias("p"))
    counts = pairs.select("p.before", "p.repair").join(wanted, ["before", "repair"], "left_semi").groupBy("before", "repair").agg(F.count("*").alias("seen"))
    ranked = places.join(counts, ["before", "repair"], "left").groupBy("doc_id", "word").agg(F.max_by("repair", F.struct(F.coalesce("seen", F.lit(0)), F.col("n"), F.col("repair"))).alias("repair"))
    return ranked


def paragraphs(text: str, title: str | None, repairs: dict[str, str]) -> str | None:
    """A scanned text without page furniture, cut words whole, misread words repaired and each paragraph on one line; None if it wasn't scanned."""
    page = Page(text, title)
    if not page.scanned:
        return None
    lines = {k: page.lines[k].strip() for k in page.story}
    for a, b, left, right in page.cuts:
        if a == b:
            lines[a] = re.sub(rf"{re.escape(left)}[{HYPHENS}]\s*{re.escape(right)}", lambda m, x=left + right: x, lines[a])
        else:
            whole = f"{left}-{right}" if left.lower() == right.lower() else left + right
            lines[a] = CUT_END.sub(lambda m, x=whole: x, lines[a])
            lines[b] = lines[b][len(right) :].lstrip() if lines[b].startswith(right) else lines[b]

    def repair(m: re.Match) -> str:
        new = repairs.get(m.group().lower())
        return m.group() if new is None else new.upper() if m.group().isupper() and len(new) > 1 else new.capitalize() if m.group()[0].isupper() else new

    out, last = [""], None
    for k in page.story:
        if last is not None and any(not page.lines[j].strip() and not any(page.kind[i] for i in page._around(j) if 0 <= i < len(page.lines)) for j in range(last + 1, k)):
            out.append("")
        out[-1] = f"{out[-1]} {lines[k]}".strip()
        last = k
    return "\n\n".join(re.sub(r"[^\W_][\w@!|$]*", repair, p) for p in out if p)


def repaired(df: DataFrame) -> DataFrame:
    """(doc_id, text) of each scanned text of ``df`` (doc_id, title, text) as continuous paragraphs."""
    df = df.select("doc_id", "title", "text")
    parts = scanned_parts(df)
    lex = lexicon(df, parts)
    maps = chosen(df, parts, lex).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "repair"))).alias("repairs"))
    scanned = df.join(parts.select("doc_id").distinct().join(maps, "doc_id", "left"), "doc_id")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [paragraphs(x, t, dict(r or ())) for t, x, r in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return scanned.select("doc_id", "title", "text", "repairs").mapInArrow(mend, "doc_id bigint, text string").where("text is not null")
