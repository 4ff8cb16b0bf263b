"""Text functions: normalisation, blanks, word tokens, character n-grams."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SPACES

#: Fixed value: the letter, number, mark and private-use classes of a word.
WORD = r"[\p{L}\p{N}\p{M}\p{Co}]+"


def normalize(value: str) -> str:
    """Compatibility form, case folded, runs of white space as one blank."""
    return " ".join(unicodedata.normalize("NFKC", value).casefold().split())


def _normalize_batch(values: pd.Series) -> pd.Series:
    known = {v: normalize(v) for v in values.dropna().unique()}
    return pd.Series([known.get(v) if isinstance(v, str) else None for v in values], dtype=object, index=values.index)


def normalize_text(column) -> Column:
    """``normalize`` of a column; null stays null.

    ASCII has no other forms: its texts are lower-cased and trimmed by built-in
    functions, and only other ones go to Python, by Arrow batches, where each
    distinct text of a batch is handled once.
    """
    text = F.col(column) if isinstance(column, str) else column
    plain = ~has_non_ascii(text)
    blanks = F.regexp_replace(F.lower(text), r"[\t-\r\x1c-\x20]+", " ")
    return F.coalesce(F.when(plain, F.btrim(blanks)), F.pandas_udf(_normalize_batch, "string")(F.when(~plain, text)))


def is_blank(column: Column) -> Column:
    return column.rlike(rf"\A[{SPACES}]*\z")


def has_non_ascii(column: Column) -> Column:
    return column.rlike(r"[^\x00-\x7F]")


def word_occurrences(normalized: Column) -> Column:
    """All words of a normalised text, in order."""
    return F.regexp_extract_all(normalized, F.lit(WORD), F.lit(0))


def word_tokens(normalized: Column) -> Column:
    """Distinct words of a normalised text, sorted."""
    return F.array_sort(F.array_distinct(word_occurrences(normalized)))


def char_grams(normalized: Column, low: int, high: int) -> Column:
    """Character n-grams inside words, each padded by a blank on both sides.

    A padded word that is no longer than n is one gram, and no larger n is
    taken of it.
    """
    words = F.transform(F.filter(F.split(normalized, " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_word(w):
        sizes = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda n: (n == low) | (F.length(w) >= n))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substr(w, i, n))))

    return F.flatten(F.transform(words, of_word))
