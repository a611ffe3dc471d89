"""Text repair, normalization and tokens as native column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import lexicon as L


def strip(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.regexp_replace(text, f"^{L.WS}+|{L.WS}+$", "")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, L.WS + "+", " "))


def to_field(text: Column) -> Column:
    """One line that is safe in a pipe-separated file."""
    return F.replace(collapse(text), F.lit("|"), F.lit("/"))


def split_words(text: Column) -> Column:
    """The parts between white space."""
    return F.filter(F.split(text, L.WS + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def alpha_tokens(text: Column) -> Column:
    """Lower-case words of the letters that the feature extractors know."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{L.WORD_LETTERS}]+)"), F.lit(1))


def letter_tokens(text: Column) -> Column:
    """Lower-case runs of any letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def sentences(text: Column) -> Column:
    """Sentences: a split at white space after ``.``, ``!`` or ``?``; blank ones are dropped."""
    return F.filter(F.split(F.btrim(text, F.lit(L.WS_SIGNS)), rf"(?<=[.?!]){L.WS}+"), lambda s: s.rlike(L.NOT_WS))


def scrub_entities(text: Column) -> Column:
    """HTML entities replaced in their fixed order."""
    for pattern, new in L.ENTITIES:
        text = F.regexp_replace(text, pattern, new)
    return text


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, L.URL, "")


def drop_foreign_tokens(text: Column) -> Column:
    """Tokens with a letter of another script than Latin become a space.

    A match starts where a token does and its parts don't give back, so a text without white space is read once.
    """
    return F.regexp_replace(text, rf"(?<!{L.NOT_WS})[{L.NOT_WS}&&[\P{{L}}\p{{IsLatin}}]]*+[\p{{L}}&&[^\p{{IsLatin}}]]{L.NOT_WS}*+", " ")


def undo_latin1(text: Column) -> Column:
    """Text whose UTF-8 bytes were read as Latin-1, restored when all of it went through that step; other text is unchanged."""
    raw = F.encode(text, "ISO-8859-1")
    fits = ~text.rlike(r"[^\x{00}-\x{FF}]") & text.rlike(r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]")
    return F.when(fits & F.is_valid_utf8(F.when(fits, raw).cast("string")), F.decode(F.when(fits, raw), "UTF-8")).otherwise(text)


def basic_clean(text: Column) -> Column:
    """Wrong decoding, byte-order marks, entities, URLs and foreign tokens."""
    return drop_foreign_tokens(strip_urls(scrub_entities(F.replace(undo_latin1(text), F.lit("﻿"), F.lit("")))))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalize(text: Column, compose: bool = True) -> Column:
    """The corpus normalization. ``compose`` may be off where no text has combining marks, which keeps it native."""
    text = scrub_entities(nfc(text) if compose else text)
    text = F.regexp_replace(text, rf"([,.!?;:\)]){L.WS}*(?=\p{{L}})", "$1 ")
    text = F.regexp_replace(text, rf"(?<=\p{{L}}){L.WS}*-{L.WS}*(?=\p{{L}})", "-")
    text = F.regexp_replace(text, r"(?<=\p{L})-{2,}(?=\p{L})", "-")
    text = F.regexp_replace(text, f"{L.WS}*[—–]{L.WS}*", " — ")
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def normalize_first(text: Column) -> Column:
    """The first-generation normalization: quotes count as closing marks, line breaks stay."""
    for pattern, new in (("&nbsp;", " "), ("&amp;", "&"), (r"&#\d+;", "")):
        text = F.regexp_replace(text, pattern, new)
    text = F.regexp_replace(text, rf"([,.!?;:\"'»\)]){L.WS}*(?=\p{{L}})", "$1 ")
    text = F.regexp_replace(text, rf"(?<=\p{{L}}){L.WS}*-{L.WS}*(?=\p{{L}})", "-")
    text = F.regexp_replace(text, r"(?<=\p{L})-{2,}(?=\p{L})", "-")
    text = F.regexp_replace(text, f"{L.WS}*[–—]{L.WS}*", " — ")
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), " +\n", "\n"))


# A precomposed Latin letter to its base letter, by Unicode decomposition.
_FOLDS = {chr(c): d for c in range(0xC0, 0x250) if (d := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) != chr(c) and len(d) == 1}


def fold_accents(text: Column) -> Column:
    """Latin letters without their accents; other scripts and the schwa stay."""
    return F.regexp_replace(F.translate(text, "".join(_FOLDS), "".join(_FOLDS.values())), r"[\x{300}-\x{36F}]", "")


def ascii_letters(text: Column) -> Column:
    """Only a-z of the lower-cased text."""
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def unify_breaks(text: Column, most: int = 1) -> Column:
    """CR LF and CR as LF, and runs of more than ``most`` line breaks as that many."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), f"\n{{{most + 1},}}", "\n" * most)


def strip_noise(text: Column) -> Column:
    """Junk glyphs, fill-in underscores, product codes, page banners and empty quotes become a space."""
    for pattern in (L.JUNK_GLYPHS, "_{2,}", L.PRODUCT_CODE, L.PAGE_BANNER, L.EMPTY_QUOTES):
        text = F.regexp_replace(text, "(?U)" + pattern, " ")
    return text


def strip_caps_runs(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)" + L.CAPS_RUN, " ")


def strip_page_numbers(text: Column) -> Column:
    """Isolated numbers of one to three digits become a space."""
    return collapse(F.regexp_replace(text, rf"(?<!{L.NOT_WS})\d{{1,3}}(?!{L.NOT_WS})", " "))


def strip_page_markers(text: Column) -> Column:
    return F.regexp_replace(text, L.PAGE_MARKER, " ")


def lower_trim(text: Column) -> Column:
    """A stored language as it is compared."""
    return F.lower(strip(text))


def bare_tokens(text: Column) -> Column:
    """Lower-case tokens of letters only after ``.,!?"'()`` are taken off their ends, in one pass over the text."""
    ends = "[.,!?\"'()]*+"
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?<!{L.NOT_WS}){ends}(\p{{L}}++){ends}(?!{L.NOT_WS})"), F.lit(1)), lambda w: F.lower(w))


def share_of(tokens: Column, words: list[str]) -> Column:
    """The share of ``tokens`` that are in ``words``; 0 without tokens."""
    return F.coalesce(F.size(F.filter(tokens, lambda w: w.isin(*words))) / F.nullif(F.size(tokens), F.lit(0)), F.lit(0.0))


def english_ratio(text: Column) -> Column:
    return share_of(bare_tokens(text), L.ENG_ONLY)
