"""Problem 3: text garbled by a wrong decoding or encoding step.

A native scan keeps texts with any character that correct text here doesn't have. For these, characters are mapped back to the bytes of each legacy
encoding, a byte-structure automaton (compiled as a regular expression over the encoding's characters) finds the maximal spans of well-formed
multibyte sequences, and these spans alone are decoded; the step repeats while it finds spans, for text that went through it several times (each step makes the text shorter, so it ends). Whether
a span is more than chance is judged by what comes out, in any script: a single short sequence must give a usual sign or Latin letter, longer spans letters of one script (``coherent``).
Runs of East Asian characters are mapped back through the double-byte encodings in the same way. What can't be decoded
(replacement characters, question marks inside words, stray lead or control characters) is counted as lost; question marks in addresses and queries aren't.

Defined results: null and blank texts are no case and stay as they are; NFC and NFD accents are no case; repeated rows are each reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

# Legacy encodings in the order in which they are tried.
ENCODINGS = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp866", "koi8_r", "cp1253", "cp1254")
WIDE_ENCODINGS = ("gbk", "big5", "shift_jis", "euc_kr")

# Characters of correct text besides ASCII, as the inside of a character class.
SOUND = "áéíóúàèìòùâêîôûäëïöüñçÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÑÇ“”‘’«»‹›„‚–—…·•©®™°§₱€½¼¾×ə̀-̃̈ ­¬‐‑−​-‏﻿   -  　"
#: What one short sequence may stand for; anything else there is taken for chance.
USUAL = regex.compile(r"[ -ſ̀-ͯḀ-ỿ -⁯₠-₿™ʼəǝ−←-⇿─-➿﻿\U0001f300-\U0001faff]+")
#: A native test that every damaged text meets. A question mark inside a word stands for a lost letter.
SUSPECT = rf"[^\x00-\x7f{SOUND}]|\p{{Ll}}\?\p{{Ll}}|\p{{Lu}}\?\p{{Lu}}|(?:^|\s)\?\p{{L}}|[ÂÄÊËÎÏâäêëîï][\u0080-¿‘’“”–—…•€‹›„‚™]"
#: A quicker test in Python for characters that may belong to a garbled span.
GARBLED = re.compile(rf"[^\x00-\x7f{SOUND}]|[ÂÄÊËÎÏâäêëîï][\u0080-\u00bf‘’“”–—…•€‹›„‚™]")
#: Tokens in which a question mark belongs: addresses, and anything with a query after the mark.
ADDRESS = regex.compile(r"\S*(?:://|www\.)\S*|\S*\?[\w.%+-]*=\S*|\w+(?:[./]\w+)+/?\?\S*", regex.IGNORECASE)
LOST = regex.compile(r"�|(?<=\p{Ll})\?(?=\p{Ll})|(?<=\p{Lu})\?(?=\p{Lu}\p{Lu})|(?<=\p{Lu}\p{Lu})\?(?=\p{Lu})|[\u0080-\u0084\u0086-\u009f]|(?<=^|\s)\?(?=\p{Lu}\p{Ll})")
STRAY = regex.compile(r"(?<!\p{Lu})Ã(?!\p{Lu})|â€|(?<=[a-z])[ÐÑ√├┬Γ\p{Cyrillic}]|[√├┬ΓÐ\p{Cyrillic}](?=[a-z])|Ã‚|Â(?=[\s«»]|$)(?<!\p{Lu}\p{Lu}Â)|\p{Lu}?в(?=Ђ)")


def _table(codec: str) -> dict[str, int]:
    """The byte of each character; bytes that the codec leaves open stand for the control characters of their number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def _automaton(table: dict[str, int]) -> regex.Pattern:
    def some(a: int, z: int) -> str:
        return "[" + "".join(regex.escape(c) if c in r"\]^-[" else c for c, b in table.items() if a <= b <= z) + "]"

    tail = some(0x80, 0xBF)
    return regex.compile(f"(?:{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{{2}}|{some(0xF0, 0xF4)}{tail}{{3}})+")


TABLES = {name: _table(name) for name in ENCODINGS}
AUTOMATA = {name: _automaton(table) for name, table in TABLES.items()}


#: What a span has that is more than a part of a word: a sign, or a capital after a small letter.
ODD = regex.compile(r"[^\p{L}\p{M}]|\p{Ll}\p{Lu}")
ASSIGNED = regex.compile(r"[^\p{Cn}\p{Co}\p{Cc}]+")
SCRIPTS = tuple(
    regex.compile(rf"(?:[{x}]|[\p{{Common}}\p{{Inherited}}])+")
    for x in (
        r"\p{Latin}", r"\p{Greek}", r"\p{Cyrillic}", r"\p{Armenian}", r"\p{Hebrew}", r"\p{Arabic}", r"\p{Syriac}", r"\p{Thaana}", r"\p{Devanagari}", r"\p{Bengali}", r"\p{Gurmukhi}", r"\p{Gujarati}",
        r"\p{Oriya}", r"\p{Tamil}", r"\p{Telugu}", r"\p{Kannada}", r"\p{Malayalam}", r"\p{Sinhala}", r"\p{Thai}", r"\p{Lao}", r"\p{Tibetan}", r"\p{Myanmar}", r"\p{Georgian}", r"\p{Ethiopic}",
        r"\p{Khmer}", r"\p{Mongolian}", r"\p{Tagalog}", r"\p{Hangul}", r"\p{Han}\p{Hiragana}\p{Katakana}",
    )
)


def coherent(fixed: str) -> bool:
    """Whether a decoded span is assigned characters of one script, and long enough not to be chance: two characters, or one of three bytes or more."""
    return (len(fixed) > 1 or fixed > "\u07ff") and bool(ASSIGNED.fullmatch(fixed)) and any(s.fullmatch(fixed) for s in SCRIPTS)


#: Characters that UTF-8 read as a double-byte encoding becomes.
WIDE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\uff61-\uff9f\u2e80-\u303f\u20ac\ue000-\uf8ff\p{Greek}\p{Cyrillic}\p{Bopomofo}]{2,}")


def _wide(text: str) -> tuple[str, int]:
    """``text`` with the runs decoded that a double-byte encoding garbled, and their number; three characters must come out, as fewer can be chance."""
    spans = 0

    def undo(m: regex.Match) -> str:
        nonlocal spans
        for codec in WIDE_ENCODINGS:
            try:
                fixed = m.group().encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            if len(fixed) >= 3 and ASSIGNED.fullmatch(fixed) and any(s.fullmatch(fixed) for s in SCRIPTS):
                spans += 1
                return fixed
        return m.group()

    return WIDE.sub(undo, text), spans


def _decoded(text: str, codec: str) -> tuple[str, int, int]:
    """``text`` with the spans decoded that ``codec`` garbled, the number of spans and of the characters in them."""
    table, spans, size = TABLES[codec], 0, 0

    def undo(m: regex.Match) -> str:
        nonlocal spans, size
        try:
            fixed = bytes(table[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        s = m.start()
        if len(m.group()) == 2 and m.group()[0].isupper() and s and text[s - 1].isupper() and not fixed.isalpha():
            return m.group()  # a capital with its accent before a sign
        if not USUAL.fullmatch(fixed) and not (ODD.search(m.group()) and coherent(fixed)) and not (STRAY.search(fixed) or _spans(fixed)):
            return m.group()
        spans += 1
        size += len(m.group())
        return fixed

    return AUTOMATA[codec].sub(undo, text), spans, size


def _spans(text: str) -> bool:
    return any(a.search(text) for a in AUTOMATA.values())


def restore(text: str) -> tuple[str, int, int]:
    """The text with garbled spans decoded, their number, and the number of characters that stay lost."""
    total = 0
    while True:
        best, most, explained = text, 0, 0
        for codec in ENCODINGS:  # the one that explains the most characters
            fixed, n, size = _decoded(text, codec)
            if size > explained:
                best, most, explained = fixed, n, size
        if not most:
            best, most = _wide(text)
            if not most or len(best) >= len(text):
                break
        text, total = best, total + most
    plain = ADDRESS.sub(" ", text) if "?" in text else text
    return text, total, len(LOST.findall(plain)) + len(STRAY.findall(text))


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [restore(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int32()), pa.array([x[2] for x in done], pa.int32())],
            ["doc_id", "text", "spans", "lost"],
        )


def damaged(df: DataFrame) -> DataFrame:
    """(doc_id, text, spans, lost) of each text of ``df`` (doc_id, text) that a wrong step damaged, the text restored as far as it can be."""
    suspects = spread(df.select("doc_id", "text")).where(F.col("text").rlike(SUSPECT))
    return suspects.mapInArrow(_restore, "doc_id bigint, text string, spans int, lost int").where("spans > 0 or lost > 0")
