"""Measures as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def f05(tp: Column, n_truth: Column, n_chosen: Column) -> Column:
    """F0.5 of one key; without true links 1 for an empty choice, else 0."""
    fp, fn = n_chosen - tp, n_truth - tp
    return F.when(n_truth == 0, (n_chosen == 0).cast("double")).otherwise(5 * tp / (5 * tp + 4 * fp + fn))


def hash_rank(key: Column, seed) -> Column:
    """32 hex digits of SHA-256 over the seed, a NUL and the key: a stable random order."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}\0"), key), 256), 1, 32)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.when(b != 0, a / b)


def record_hash(*columns) -> Column:
    """SHA-256 of the columns' texts as a compact JSON array: one digest for a whole record."""
    return F.sha2(F.to_json(F.array(*[F.col(c) if isinstance(c, str) else c for c in columns])), 256)


def _short_batch(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v else format(v, ".12g") for v in values], dtype=object, index=values.index)


def short_number(column) -> Column:
    """A double with twelve significant digits, without trailing zeros; null stays null."""
    return F.pandas_udf(_short_batch, "string")(column)
