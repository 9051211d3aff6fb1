"""Edges that arrive as a stream, kept as a growing table; an addition to the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_edges(edges: DataFrame, path: str, checkpoint: str, recompute=None) -> StreamingQuery:
    """Appends each micro-batch's new edges under ``path``; ``recompute(spark, path)`` runs after it, if given.

    A batch's folder carries its id, so a batch that is replayed replaces itself.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(["source_id", "target_id"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if recompute:
            recompute(batch.sparkSession, path)

    return edges.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
