"""An extension beyond batch retrieval: queries that arrive as a stream meet a saved index.

Each micro-batch of query records is normalised and joined to the index's
records by exact text; the targets of a text are ranked once, on the static
side.  No state is kept, so the checkpoint holds offsets only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index, retrieve
from ..schema import RetrievalSettings


def exact_lookup(queries: DataFrame, records: DataFrame, settings: RetrievalSettings = RetrievalSettings()) -> DataFrame:
    """(query, target, channel) of a stream of source records by equal name or address."""
    asked = index.prepare(queries)
    out = None
    for field in index.FIELDS:
        place = F.row_number().over(Window.partitionBy(field).orderBy("entity_id"))
        first = records.where(F.col(field) != "").select(F.col("entity_id").alias("target"), field, place.alias("place")).where(F.col("place") <= settings.per_channel)
        hits = asked.select(F.col("entity_id").alias("query"), field).join(first, field).select("query", "target", F.lit(f"exact_{field}").alias("channel"))
        out = hits if out is None else out.unionByName(hits)
    return out


def retrieve_batches(queries: DataFrame, tables: dict[str, DataFrame], output: str, checkpoint: str, settings: RetrievalSettings = RetrievalSettings()) -> StreamingQuery:
    """Full retrieval of each micro-batch; its trace is written to ``output`` under the batch's number, so a rerun replaces it."""

    def run(batch: DataFrame, number: int) -> None:
        _, ranked = retrieve.retrieve(index.prepare(batch), tables["records"], settings, tables)
        retrieve.trace(ranked).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
