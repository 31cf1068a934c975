"""Masking of a stream: the same expressions as on a table, which keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabularium.operators.anonymize import masked


def masked_stream(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Writes the masked stream as Parquet, each row once. Without an interval it ends when all that is there is done."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return masked(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
