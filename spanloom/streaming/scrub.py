"""Redaction of a stream: the same narrow chain, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.redact import Scrubber


def scrub_stream(stream: DataFrame, scrubber: Scrubber | None = None, text: str = "text", entities: set[str] | None = None) -> DataFrame:
    """A streaming frame with ``spans, redacted_text, mapping``; it keeps no state, so late rows need no watermark."""
    return (scrubber or Scrubber()).scrub(stream, text, entities)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet exactly once and stops when what is there has been read."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
