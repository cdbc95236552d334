"""Encoding a stream: every text by itself, without state.

``encode`` of a pipeline is a projection and an explode, so a streaming DataFrame goes
through it as a bounded one does; what needs a whole table (padding to the
longest, training) refuses a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from glyphflow.plans.pipeline import Pipeline


def encode_stream(pipeline: Pipeline, source: DataFrame, sink: str, checkpoint: str, text_col: str = "text", trigger: dict | None = None, **options) -> StreamingQuery:
    """Append encodings of a stream of texts to Parquet files, exactly once by the checkpoint."""
    if not source.isStreaming:
        raise ValueError("a streaming DataFrame is needed; use Pipeline.encode for a bounded one")
    encoded = pipeline.encode(source, text_col, **options)
    return encoded.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(sink)
