"""Sessions: how workers find this package, and a session for local use."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
#: Rows of an Arrow batch: whole texts and their hashes must fit a worker's memory some times over.
BATCH_ROWS = 1000
_LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the place it has on the driver, and bound their batches.

    Clusters whose machines lack that place get the package by ``--py-files``.
    A batch size that the session sets lower stays.
    """
    if not 0 < int(spark.conf.get(_LIMIT)) <= BATCH_ROWS:
        spark.conf.set(_LIMIT, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, as the bench and the commands use it."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("matchloom")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
