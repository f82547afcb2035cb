"""Selection over a stream of scored pairs: each micro-batch holds whole lists and is selected like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from matchloom.operators.selection import select


def select_stream(scored: DataFrame, path: str, checkpoint: str, tau: float, margin: float = 0.0) -> DataStreamWriter:
    """Write the selected pairs of each micro-batch of (s1, cand, p) to its own folder; a repeated batch overwrites its own."""

    def one(batch: DataFrame, number: int) -> None:
        select(batch, tau, margin).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scored.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
