"""Tokens, word positions, match predicates, relevance rank and trigrams as Spark columns.

A text is kept as ``array<string>``: element *i* is the lexeme at position *i + 1*, and ``''`` marks a
stop word, so positions still advance over it. The array is linear in the text, needs no shuffle to
build and can be stored beside the description as the text index.

Known deviation from the usual database tokeniser: hyphenated compounds, decimals, addresses and
URLs are split into their parts and not also kept whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from larder.functions.italian import stem

WORD = r"[\p{L}\p{N}]+"
CONFIGS = ("simple", "italian")

# Fixed values of the published rank formula.
WEIGHT = 0.1
ZETA_2 = 1.64493406685
MAX_POSITION = 16383
MAX_POSITIONS = 256
NO_PAIR = 1e-20
FAR_PAIR = 1e-30
FAR_DISTANCE = 100


def italian_stop_words(spark: SparkSession) -> frozenset[str]:
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(StopWordsRemover.loadDefaultStopWords("italian"))


def split_words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def italian_lexeme(word: str, stops: frozenset[str]) -> str:
    if word in stops:
        return ""
    return stem(word) if word.isalpha() else word


def tokens(text: Column, config: str = "simple") -> Column:
    """The text's lexemes in order; stop words become ``''``."""
    if config == "simple":
        return split_words(text)
    if config != "italian":
        raise ValueError(f"unknown text configuration {config!r}; use one of {CONFIGS}")
    stops = italian_stop_words(SparkSession.getActiveSession())

    @F.arrow_udf("array<string>")
    def italian(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for start, length in parts(lists):
                yield lexeme_lists(lists.slice(start, length), lambda w: italian_lexeme(w, stops))

    return italian(split_words(text))


#: Words handled at once in Python: a batch of long texts is taken in parts, so memory does not follow their length.
PART_WORDS = 1 << 18


def parts(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows that hold PART_WORDS words at most, or one row."""
    ends = np.cumsum(word_counts(lists))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PART_WORDS, "right")))
        yield start, stop - start
        start = stop


def word_counts(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def lexeme_lists(lists: pa.Array, lexeme: Callable[[str], str]) -> pa.Array:
    """Lists of words as lists of lexemes; only the distinct words become Python strings, the rest stays in Arrow."""
    ends = pa.array(np.append(0, np.cumsum(word_counts(lists))), pa.int32())
    words = lists.flatten().dictionary_encode()
    lexemes = pa.array([lexeme(w) for w in words.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(ends, lexemes.take(words.indices), mask=lists.is_null())


def analyse(text: str, config: str, stops: frozenset[str]) -> list[str]:
    """The same lexemes for one query text (queries only; product texts go through ``tokens``)."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return words if config == "simple" else [italian_lexeme(w, stops) for w in words]


def positions(toks: Column, lexeme: Column) -> Column:
    """Ascending positions of one lexeme, with the stored-vector limits on value and count."""
    at = F.transform(toks, lambda t, i: F.when(t == lexeme, F.least(i + 1, F.lit(MAX_POSITION))))
    return F.slice(F.array_distinct(F.filter(at, lambda p: p.isNotNull())), 1, MAX_POSITIONS)


def phrase_match(toks: Column, phrase: Column) -> Column:
    """True where the phrase, an ``array<struct<lexeme, offset>>``, occurs at its offsets."""
    head = F.get(phrase, F.lit(0))
    starts = F.filter(F.transform(toks, lambda t, i: F.when(t == head["lexeme"], i)), lambda p: p.isNotNull())
    at_offsets = F.exists(
        starts,
        lambda p: F.forall(
            phrase, lambda w: F.coalesce(F.get(toks, p + w["offset"]) == w["lexeme"], F.lit(False))
        ),
    )
    return F.array_contains(toks, head["lexeme"]) & ((F.size(phrase) == 1) | at_offsets)


def clause_match(toks: Column, clause: Column) -> Column:
    return F.forall(clause["required"], lambda p: phrase_match(toks, p)) & ~F.exists(
        clause["excluded"], lambda p: phrase_match(toks, p)
    )


def _spread(spots: Column) -> Column:
    """Distances between positions of every two different lexemes; zero distances are left out."""
    pairs = F.flatten(
        F.transform(
            spots,
            lambda a, i: F.flatten(
                F.transform(
                    F.slice(spots, i + 2, F.size(spots)),
                    lambda b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y)))),
                )
            ),
        )
    )
    return F.filter(pairs, lambda d: d > 0)


def _closeness(d: Column) -> Column:
    near = 1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2.0))
    return WEIGHT * F.sqrt(F.when(d > FAR_DISTANCE, F.lit(FAR_PAIR)).otherwise(near))


def rank_from_positions(spots: Column, n_lexemes: Column, together: Column) -> Column:
    """Relevance rank from the positions of each query lexeme (``array<array<int>>``).

    ``together``: the query is one AND or phrase. Pass ``spots`` as a real column, it is used often.
    """
    harmonic = F.aggregate(
        F.flatten(F.transform(spots, lambda ps: F.transform(ps, lambda p, j: WEIGHT / ((j + 1) * (j + 1))))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    distances = _spread(spots)
    miss = F.aggregate(distances, F.lit(0.0), lambda acc, d: acc + F.log1p(-_closeness(d)))
    near = F.when(F.size(distances) > 0, -F.expm1(miss)).otherwise(F.lit(NO_PAIR))
    return F.when(together & (n_lexemes >= 2), near).otherwise(harmonic / ZETA_2 / n_lexemes)


_D = np.arange(FAR_DISTANCE + 1)
_NEAR_LOG = np.log1p(-WEIGHT * np.sqrt(1.0 / (1.005 + 0.05 * np.exp(_D / 1.5 - 2.0))))
_FAR_LOG = float(np.log1p(-WEIGHT * np.sqrt(FAR_PAIR)))


def _pair_rank(spots: list[np.ndarray]) -> float:
    total, pairs = 0.0, 0
    for i, a in enumerate(spots):
        for b in spots[i + 1 :]:
            d = np.abs(np.subtract.outer(a, b)).ravel()
            counts = np.bincount(np.minimum(d, FAR_DISTANCE + 1), minlength=FAR_DISTANCE + 2)
            total += counts[1:-1] @ _NEAR_LOG[1:] + counts[-1] * _FAR_LOG
            pairs += d.size - counts[0]
    return -np.expm1(total) if pairs else NO_PAIR


@F.pandas_udf(DoubleType())
def rank_long_texts(spots: pd.Series, n_lexemes: pd.Series, together: pd.Series) -> pd.Series:
    """The same rank over Arrow batches, for texts with hundreds of positions per lexeme."""

    def one(found, n, both):
        if both and n >= 2:
            return _pair_rank([np.asarray(ps) for ps in found])
        return sum((WEIGHT / np.arange(1, len(ps) + 1) ** 2).sum() for ps in found) / ZETA_2 / n

    return pd.Series([one(f, n, b) for f, n, b in zip(spots, n_lexemes, together)], dtype=float)


# Three characters of padded words: two blanks and a letter, or anything around a letter.
TRIGRAM = "(?=(  [^ ]|.[^ ].))"


def trigrams(text: Column) -> Column:
    """Distinct trigrams over all words, each padded with two leading and one trailing blank."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    padded = F.concat(F.lit("  "), F.replace(words, F.lit(" "), F.lit("   ")), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(TRIGRAM), F.lit(1)))


CODE_SHIFT = 1 << 21
BLANK = 32


def trigram_codes(text: Column) -> Column:
    """The trigrams as numbers, one code point per 21 bits: set operations on numbers are cheap."""

    def code(g):
        a, b, c = (F.ascii(F.substring(g, n, 1)).cast("long") for n in (1, 2, 3))
        return (a * CODE_SHIFT + b) * CODE_SHIFT + c

    return F.transform(trigrams(text), code)


def letters_in(code: Column) -> Column:
    """How many of a trigram's characters are not padding: word starts and ends are commoner."""
    first, second, third = F.floor(code / CODE_SHIFT**2), F.floor(code / CODE_SHIFT) % CODE_SHIFT, code % CODE_SHIFT
    return sum((x != BLANK).cast("int") for x in (first, second, third))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared share of two distinct arrays; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigram_codes(a), trigram_codes(b))


def contains_ignore_case(text: Column, part: Column) -> Column:
    """Literal substring without case; ``%`` and ``_`` have no special meaning."""
    return F.contains(F.lower(text), F.lower(part))


def escape_like(text: Column) -> Column:
    """Escape the LIKE wildcards and the escape character itself."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


_BLANK = r"[\s\p{Z}\x1C-\x1F\x85\x{FEFF}]+"
_DIGITS = "[0-9]+(?:_[0-9]+)*"
_NUMBER = rf"^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))$"


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end; ``trim`` alone takes blanks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, f"^{_BLANK}|{_BLANK}$", "")


def number(c: Column | str) -> Column:
    """The number a text spells in decimal, NULL for any other text.

    A cast alone would also read type suffixes and hexadecimal floats such as ``12d`` and ``0x1p3``.
    """
    text = strip(c)
    return F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
