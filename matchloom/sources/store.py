"""The saved target index: Parquet tables and a metadata file, published together."""

from __future__ import annotations

import json
import time
import unicodedata
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..operators import index
from ..schema import TARGET_PREFIXES, DataFormatError
from .tsv import Staged, exists, read_text, write_text

VERSION = 1
TABLES = ("records", "postings", "term_frequency", "lengths")
NORMALIZATION = f"NFKC+casefold, Unicode {unicodedata.unidata_version}"


def build_index(targets: DataFrame, path: str, scope: str, inputs: dict | None = None) -> dict:
    """Check, normalise and index target records; refuses an existing place.  Gives the metadata."""
    spark = targets.sparkSession
    started, begun = datetime.now(timezone.utc).isoformat(), time.monotonic()
    with Staged(spark, path) as staged:
        records = index.prepare(targets, TARGET_PREFIXES)
        records.write.parquet(f"{staged}/records")
        records = spark.read.parquet(f"{staged}/records")
        # token order keeps a token's postings in few row groups, so token joins prune
        index.postings(records).sortWithinPartitions("field", "token").write.partitionBy("field").parquet(f"{staged}/postings")
        posted = spark.read.parquet(f"{staged}/postings")
        index.term_frequency(posted).write.parquet(f"{staged}/term_frequency")
        index.lengths(records).write.parquet(f"{staged}/lengths")
        stats = index.statistics(records, spark.read.parquet(f"{staged}/term_frequency")).first().asDict()
        meta = {"version": VERSION, "status": "complete", "normalization": NORMALIZATION, "scope": scope, "inputs": inputs or {}, "statistics": stats, "countries": {r["country"]: r["count"] for r in records.groupBy("country").count().collect()}, "started_at_utc": started, "elapsed_seconds": round(time.monotonic() - begun, 3)}
        write_text(spark, f"{staged}/index.json", json.dumps(meta, ensure_ascii=False, allow_nan=False, indent=1))
    return meta


def open_index(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """(tables, metadata); raises where the index is unfinished or of another kind."""
    if not exists(spark, f"{path}/index.json"):
        raise DataFormatError(f"{path} is no finished index")
    meta = json.loads(read_text(spark, f"{path}/index.json"))
    if (meta.get("version"), meta.get("status"), meta.get("normalization")) != (VERSION, "complete", NORMALIZATION):
        raise DataFormatError(f"{path} was made by another version")
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    if tables["records"].count() != meta["statistics"]["targets"]:
        raise DataFormatError(f"{path} has lost records")
    return tables, meta
