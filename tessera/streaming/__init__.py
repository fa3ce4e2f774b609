"""Relations over streams: the stateless operators hold as they are, and
windows with a watermark aggregate events in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grouped(events: DataFrame, time: str, window, names: tuple[str, str], by: list[str], late: str, made: dict[str, Column]) -> DataFrame:
    """Watermarks need a time with a zone, so a stream's time without one is
    read in the session's zone and given back without it."""
    kind = events.schema[time].dataType.simpleString()
    if events.isStreaming:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = events.groupBy(window().alias("w"), *by).agg(*(e.alias(n) for n, e in made.items()))
    return grouped.select(*(F.col(f"w.{end}").cast(kind).alias(name) for end, name in zip(("start", "end"), names, strict=True)), *by, *made)


def windowed(events: DataFrame, time: str, width: str, by: list[str], late: str = "10 minutes", slide: str | None = None, **made: Column) -> DataFrame:
    """Tumbling or sliding windows; works on batch and streaming frames."""
    window = lambda: F.window(time, width, slide) if slide else F.window(time, width)
    return _grouped(events, time, window, ("window_start", "window_end"), by, late, made)


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str = "10 minutes", **made: Column) -> DataFrame:
    """Sessions that end when no event comes for `gap`; works on both kinds of frames."""
    return _grouped(events, time, lambda: F.session_window(time, gap), ("session_start", "session_end"), by, late, made)


def drained(stream: DataFrame, path: str, state: str) -> DataFrame:
    """What a stream gives until its source has no more, appended as Parquet
    below `path` and read back. `state` is the folder of its checkpoint, from
    which a later call goes on."""
    run = (stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
           .option("checkpointLocation", state).start(path))
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
