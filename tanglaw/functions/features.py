"""Readability features as native column expressions over token arrays.

Materialize the tokens in one ``select`` before taking features from them, so that they are extracted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as L
from . import text as T

SHAPES = {"syll_cv": "CV", "syll_cvc": "CVC", "syll_ccvc": "CCVC", "syll_ccvccc": "CCVCCC"}
WIDE_SHAPES = {"v": "V", "vc": "VC", "cv": "CV", "cvc": "CVC", "vcc": "VCC", "cvcc": "CVCC", "ccv": "CCV", "ccvc": "CCVC", "ccvcc": "CCVCC", "ccvccc": "CCVCCC"}


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _nuclei(word: Column, inside: str) -> Column:
    return F.greatest(F.regexp_count(word, F.lit(f"[{inside}]+")), F.lit(1))


def by_vowels(language: Column, build) -> Column:
    """``build`` for the vowels of each language. The branches hold constant patterns, so they compile once."""
    low = F.lower(language)
    return F.when(low.isin("cebuano", "bikol", "hiligaynon", "minasbate", "karay-a"), build(L.VOWELS_ACUTE)).when(low == "rinconada", build(L.VOWELS_SCHWA)).otherwise(build(L.VOWELS_ALL))


def syllables(words: Column, language: Column) -> Column:
    """The vowel clusters of each word, 1 at least, by the language's vowels."""
    return by_vowels(language, lambda inside: F.transform(words, lambda w: _nuclei(w, inside)))


def _shape(word: Column, inside: str) -> Column:
    return F.regexp_replace(F.regexp_replace(word, f"[{inside}]", "V"), "[^V]", "C")


def shapes(words: Column, language: Column) -> Column:
    """The consonant-vowel skeleton of each word, by the language's vowels."""
    return by_vowels(language, lambda inside: F.transform(words, lambda w: _shape(w, inside)))


def tokenized(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``words`` and ``n_sents``; a null text counts as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"words": T.alpha_tokens(value), "n_sents": F.size(T.sentences(value))})


def line_of(words: Column) -> Column:
    """``words`` (without white space in them) as one text between spaces, in which patterns count words many times as fast as functions of each word do."""
    return F.array_join(words, " ")


def trad(words: Column, n_sents: Column, language: Column, line: Column | None = None) -> dict[str, Column]:
    """Mean sentence length, mean word length, share of words of three syllables or more, type-token ratio. ``line`` is ``line_of(words)``, where it is there as a column."""
    n, line = F.size(words), line_of(words) if line is None else line
    letters = F.length(line) - F.greatest(n - 1, F.lit(0))
    return {
        "mean_sentence_len": n / F.greatest(n_sents, F.lit(1)),
        "mean_word_len": share(letters, n),
        "polysyll_freq": share(by_vowels(language, lambda v: F.regexp_count(line, F.lit(f"[{v}]++[^{v} ]++[{v}]++[^{v} ]++[{v}][^ ]*+"))), n),
        "type_token_ratio": share(F.size(F.array_distinct(words)), n),
    }


def syll(words: Column, language: Column, wanted: dict[str, str] = SHAPES, line: Column | None = None) -> dict[str, Column]:
    """The share of words whose whole skeleton is each shape. ``line`` is ``line_of(words)``, where it is there as a column."""
    line = line_of(words) if line is None else line

    def number(shape: str) -> Column:
        return by_vowels(language, lambda v: F.regexp_count(line, F.lit("(?<![^ ])" + "".join(f"[{v}]" if c == "V" else f"[^{v} ]" for c in shape) + "(?![^ ])")))

    return {name: share(number(shape), F.size(words)) for name, shape in wanted.items()}


def wide(words: Column, n_sents: Column, language: Column) -> dict[str, Column]:
    """Counts and densities beyond the fourteen features; definitions are this package's own."""
    n = F.size(words)
    nuclei = syllables(words, language)
    total = F.aggregate(nuclei, F.lit(0), lambda a, k: a + k)
    clusters = F.aggregate(words, F.lit(0), lambda a, w: a + F.regexp_count(w, F.lit(f"[^{L.VOWELS_ALL}əǝ]{{2,}}")))
    return {
        "word_count": n,
        "sentence_count": n_sents,
        "mean_syll_per_word": share(total, n),
        "polysyll_count": F.size(F.filter(nuclei, lambda k: k >= 3)),
        "cluster_density": share(clusters, n),
    }
