"""Structured Streaming: step logs in tumbling windows, and incremental sinks that write each row once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def tumbling_log(stream: DataFrame, time: str, width: str, late: str, value: str, by: str | None = None) -> DataFrame:
    """(start, by, rows, mean) of event-time windows; rows later than ``late`` are left out, as the watermark says."""
    keys = [F.window(time, width)] + ([F.col(by)] if by else [])
    out = stream.withWatermark(time, late).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), *([by] if by else []), "rows", "mean")


def once_sink(stream: DataFrame, path: str, checkpoint: str, key: str, late: str | None = None, time: str | None = None) -> StreamingQuery:
    """Append each key once to parquet, then stop; a restart goes on where the checkpoint stands.

    With ``time`` and ``late`` the keys that are remembered are bounded by the watermark.
    """
    rows = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time and late else stream.dropDuplicates([key])
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
