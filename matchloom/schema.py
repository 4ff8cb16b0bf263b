"""The data model: schemas, identifiers, settings, and the error that bad data raise."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F


class DataFormatError(ValueError):
    """The data break the contract."""


# Fixed values of the files' format: column names, channels, variants and identifier prefixes.
SOURCE_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_COLUMNS = ("source1_entity_id", "candidate_entity_ids")
ID_COLUMNS = ("source1_entity_id",)
TRACE_COLUMNS = ("source1_entity_id", "target_entity_id", "rank", "retrieval_score", "channels")
CHANNELS = ("exact_name", "exact_address", "name_words", "address_words")
VARIANTS = ("name_only", "exact_name_address", "hybrid")
QUERY_PREFIXES, TARGET_PREFIXES = ("S1-",), ("S2-", "S3-")

#: Literal texts that are counted, never taken for missing values.
LITERAL_TOKENS = ("NA", "N/A", "NULL", "null", "NaN", "nan", "None", "<NA>")

#: What counts as white space in identifiers, blanks and normalisation.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), False) for c in columns])


def id_ok(column: Column, prefixes) -> Column:
    """An identifier: one of the prefixes and more, without white space and commas."""
    return F.coalesce(column.rlike(rf"\A(?:{'|'.join(prefixes)})[^,{SPACES}]+\z"), F.lit(False))


def _positive(name: str, value) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer, not {value!r}")


def threshold_ok(value) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or not 0 <= value <= 1:
        raise ValueError(f"a threshold must lie between 0 and 1, not {value!r}")
    return float(value)


@dataclass(frozen=True)
class RetrievalSettings:
    """Limits of the token and exact-key retrieval."""

    per_channel: int = 50
    max_candidates: int = 100
    max_terms: int = 4
    max_token_documents: int = 20_000

    def __post_init__(self):
        for name, value in vars(self).items():
            _positive(name, value)


@dataclass(frozen=True)
class TfidfSettings:
    """Limits of the character n-gram retrieval."""

    top_k: int = 4
    minimum_similarity: float = 0.25
    low: int = 2
    high: int = 4

    def __post_init__(self):
        for name in ("top_k", "low", "high"):
            _positive(name, getattr(self, name))
        if threshold_ok(self.minimum_similarity) == 0:
            raise ValueError("minimum_similarity must exceed 0")
        if self.low > self.high:
            raise ValueError("low must not exceed high")


@dataclass(frozen=True)
class SplitSettings:
    """How the experiment's roles and samples are drawn."""

    seed: int = 42
    development_fraction: float = 0.5
    train: int = 5000
    development: int = 1000
    evaluation: int = 1000

    def __post_init__(self):
        for name in ("train", "development", "evaluation"):
            _positive(name, getattr(self, name))
        if not 0 < self.development_fraction < 1:
            raise ValueError("development_fraction must lie between 0 and 1")
