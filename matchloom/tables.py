"""Materialised steps: Parquet tables in the folder that all executors share, scoped to a run."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; only where the session names none and runs on this machine alone (tests, bench) a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="matchloom-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Tables of the runs that are open, the innermost last.
_open: list[list[DataFrame]] = []


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    The files are replicated like any other table of the store, so a lost
    executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    # nothing reads the shuffles of this plan again; without this they stay until the driver collects its garbage
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._matchloom_path = path
    if _open:
        _open[-1].append(out)
    return out


@contextmanager
def tables():
    """Delete, at the end, the tables that ``written`` made inside, but those handed to the function this gives.

    What is kept belongs to the enclosing run, or, outside of any, to the caller.
    """
    mine: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _open.append(mine)
    try:
        yield keep
    finally:
        _open.pop()
        discard(*[df for df in mine if not any(df is k for k in kept)])
        if _open:
            _open[-1].extend(kept)


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_matchloom_path", None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
            df._matchloom_path = None
