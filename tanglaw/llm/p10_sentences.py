"""Problem 10: sentence boundaries across languages and scripts.

Every run of characters with the Unicode property Sentence_Terminal (and the ellipsis) is a possible end; closing quotes and
brackets go with it. What follows, and the token before, decide: standard sentence-break rules (no break before a lower-case
letter, inside numbers, versions and file names, after initials, dotted abbreviations and the listed abbreviations of the text's language), list numbers at the start of a sentence,
speaker tags after a closing quote in scripts without letter case. A blank line always ends a sentence; where Thai or Lao letters prevail,
every white space does.

Abbreviations are those of the text's language (``lang``, an ISO code; Philippine languages and English share one list, as they borrow from each other); where the code is null those of all
languages hold, where it isn't listed those of the Philippine languages. Defined results: null and blank texts have no sentences; a text without any end mark is one sentence per paragraph; offsets count
code points of the text as stored; repeated rows give repeated sentences. Whole texts are processed, at any length, in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

# Abbreviations by what they suppress. Titles stand before a name, references before a number, and dotted times may end a sentence.
TITLES = {
    "ph": "dr dra mr mrs ms prof engr atty arch kap kgg gng bb g gg gen gob gov hon pres sen rep sec sto sta st fr sr sra srta jr rev bro ptr capt col maj lt sgt cpl insp",
    "es": "sr sra srta sres dr dra d dña ud uds vd lic ing prof gral cap sto sta fr",
    "fr": "m mm mme mmes mlle mlles dr me mgr st ste prof",
    "de": "hr fr dr prof st frl dipl ing",
    "it": "sig sigg dott dr prof avv ing on mons",
    "pt": "sr sra srta dr dra prof d exmo eng",
    "nl": "dhr mevr mr dr drs ir prof",
}
REFERENCES = {
    "ph": "no nos p pp pg pah blg bil bgy brgy vol vols ch kab sek sec fig tab art par num nr",
    "es": "núm núms no pág págs p pp cap vol art fig",
    "fr": "no nos p pp chap vol art fig",
    "de": "nr abb abs art bd kap s tab vgl ca",
    "it": "n nn p pp pag pagg cap vol art fig",
    "pt": "n nº no p pp pág págs cap vol art fig",
    "nl": "nr blz p pp afb art hfst dl",
}
TIMES = frozenset("a.m p.m n.u n.h n.g".split())
PHILIPPINE = ("tl", "fil", "ceb", "bcl", "bik", "hil", "msb", "krj", "bto", "ilo", "war", "pam", "pag", "en")
TITLES, REFERENCES = ({k: frozenset(v.split()) for k, v in x.items()} for x in (TITLES, REFERENCES))
ALL_LISTS = (frozenset().union(*TITLES.values()), frozenset().union(*REFERENCES.values()))


def lists(lang: str | None) -> tuple[frozenset[str], frozenset[str]]:
    """The titles and references of a language."""
    key = (lang or "").strip().lower()
    key = "ph" if key in PHILIPPINE else key
    return (TITLES[key], REFERENCES[key]) if key in TITLES else ALL_LISTS if not key else (TITLES["ph"], REFERENCES["ph"])


# Words that name the speaker after a closing quote in scripts without letter case.
SPEAKERS = regex.compile(
    r"と(?:言|い|聞|叫|答|思)|[一-鿿]{1,4}?(?:说|說|问|問|喊|叫|答|道)(?:道|着|著)?[。，！？!?,.]|(?:उसने|उन्होंने)\s+(?:कहा|पूछा)\s*[।,.!?]"
    r"|(?:قال|قالت|سأل|سألت)(?:\s+\w+)?\s*[.،!؟]"
)
OPENERS = "“‘«‹\"'([{「『【〈《（［¿¡„‚"
CLOSERS = "”’»›\"')]}」』】〉》）］"
NO_END = "᜵"

CANDIDATE = regex.compile(
    rf"(?:(?![{NO_END}])[\p{{Sentence_Terminal}}…‥])+[{regex.escape(CLOSERS)}]*(\s*)|((?:\r\n|[\n\r\x0b\x0c\x85  ])\s*?(?:\r\n|[\n\r\x0b\x0c\x85  ])\s*)"
)
BREAKS = regex.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
TOKEN = regex.compile(r"[^\s“‘«‹\"'(\[{「『【]*$")
SIGNIFICANT = regex.compile(rf"[{regex.escape(OPENERS)}\p{{Cf}}]*")
THAI = regex.compile(r"[ก-๛\u0e80-\u0eff]")
DOTTED = regex.compile(r"\p{L}(?:\.\p{L})+")
LETTER = regex.compile(r"\p{L}")
SPACES = regex.compile(r"\s+")
INITIAL = regex.compile(r"\p{Lu}\p{M}*")
NUMBER = regex.compile(r"\p{Nd}{1,4}")


def _ends(text: str, start: int, mark: int, close: int, after: int, known: tuple[frozenset[str], frozenset[str]]) -> bool:
    """Whether the marks from ``mark``, with closers up to ``close``, end the sentence begun at ``start``; the text goes on at ``after``. ``known``: titles and references."""
    c = text[after]
    k = after
    if not c.isalnum():
        k = SIGNIFICANT.match(text, after).end()
        if k >= len(text):
            return True
        c = text[k]
    if c.islower():
        return False
    gap = after > close
    if text[mark] == "." and close == mark + 1:
        if not gap and c.isdigit() and mark and text[mark - 1].isdigit():
            return False
        token = TOKEN.search(text, max(start, mark - 24), mark).group()
        low = token.casefold()
        first = mark - len(token) <= start or not text[start : mark - len(token)].strip(OPENERS + " ")
        if low in known[0] and c.isupper() and k == after:
            return False
        if low in known[1] and c.isdigit():
            return False
        if not gap and len(token) == 1 and token.isalpha() and text[after + 1 : after + 2] == ".":
            return False
        if k == after and DOTTED.fullmatch(token) and low not in TIMES:
            return False
        quoted = mark > len(token) and text[mark - len(token) - 1] in OPENERS  # a quotation's first word, unless another initial follows
        if INITIAL.fullmatch(token) and not first and c.isupper() and k == after and (not quoted or text[after + 1 : after + 2] == "."):
            return False
        if first and NUMBER.fullmatch(token):
            return False
    if text[close - 1] in CLOSERS and not c.isupper() and SPEAKERS.match(text, after):
        return False
    return True


def sentences(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """The (start, end) offsets of the sentences of ``text``."""
    known = lists(lang)
    out: list[tuple[int, int]] = []
    n = len(text)
    if THAI.search(text):
        thai = len(THAI.findall(text))
        if 2 * thai > len(LETTER.findall(text)):
            at = 0
            for m in SPACES.finditer(text):
                if m.start() > at:
                    out.append((at, m.start()))
                at = m.end()
            if at < n:
                out.append((at, n))
            return out
    start = len(text) - len(text.lstrip())
    for m in CANDIDATE.finditer(text, start):
        s, e = m.span()
        if m.start(2) >= 0:  # a blank line
            while s > start and text[s - 1].isspace():
                s -= 1
            if s > start:
                out.append((start, s))
            start = e
            continue
        gap = m.start(1)
        if e >= n:
            out.append((start, gap))
            start = n
        elif (e - gap > 1 and len(BREAKS.findall(text, gap, e)) > 1) or _ends(text, start, s, gap, e, known):
            if gap > start:
                out.append((start, gap))
            start = e
    if start < n:
        end = len(text.rstrip())
        if end > start:
            out.append((start, end))
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, starts, ends = [], [], []
        for doc, text, lang in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if text:
                found = sentences(text, lang)
                ids.extend([doc] * len(found))
                starts.extend([a for a, _ in found])
                ends.extend([b for _, b in found])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "char_start", "char_end"])


def sentence_spans(df: DataFrame) -> DataFrame:
    """(doc_id, char_start, char_end) of each sentence of ``df`` (doc_id, text, and lang if it is known)."""
    lang = F.col("lang") if "lang" in df.columns else F.lit(None).cast("string").alias("lang")
    return spread(df.select("doc_id", "text", lang).where("text is not null")).mapInArrow(_split, "doc_id bigint, char_start int, char_end int")
