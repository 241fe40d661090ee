"""Masking in Structured Streaming: a masked stream is a projection, so any output mode, watermark and window goes with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.lines import mask_json_lines, read_lines


def mask_lines_stream(masker, spark, source: str, target: str, checkpoint: str, diagnostics: bool = False) -> StreamingQuery:
    """Masks the JSON lines that are in a folder now, file by file exactly once, into another; again for new ones on the next call."""
    lines = mask_json_lines(masker, read_lines(spark, source, stream=True), diagnostics=diagnostics)
    return lines.writeStream.format("text").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mask_stream(masker, stream: DataFrame, target: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """A stream with a schema, masked column by column, into files."""
    return masker.mask_dataframe(stream).writeStream.format(form).option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_lines_stream(masker, lines: DataFrame, target: str, checkpoint: str, column: str = "value", diagnostics: bool = False) -> StreamingQuery:
    """Any stream's lines into text files, masked on the way, each exactly once: file sinks commit by batch."""
    masked = mask_json_lines(masker, lines.select(F.col(column).alias("value")), diagnostics=diagnostics)
    return masked.writeStream.format("text").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
