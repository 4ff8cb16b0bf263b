"""The functions of this package by name, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import measures, similarity, text


def register(spark: SparkSession) -> list[str]:
    """Register ``normalize_text``, ``indel_ratio`` and ``short_number`` (Arrow batches) in the session; gives the names."""
    ship(spark)
    found = {
        "normalize_text": F.pandas_udf(text._normalize_batch, "string"),
        "indel_ratio": F.pandas_udf(similarity._indel_batch, "double"),
        "short_number": F.pandas_udf(measures._short_batch, "string"),
    }
    for name, f in found.items():
        spark.udf.register(name, f)
    return list(found)
