"""Incremental histograms and frequent constants over a stream (an extra beside the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def histogram_stream(stream: DataFrame, column: str, *, time: str | None = None, window: str | None = None, late: str = "1 hour") -> DataFrame:
    """Running counts of the present values; with ``time`` and ``window`` by event-time window behind a watermark."""
    c = F.nullif(F.col(column).cast("string"), F.lit(""))
    if time and window:
        return stream.withWatermark(time, late).where(c.isNotNull()).groupBy(F.window(time, window).alias("w"), c.alias("value")).agg(F.count("*").alias("n"))
    return stream.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("n"))


def write_counts(counts: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Each batch's full counts replace the last ones as Parquet."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    writer = counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
