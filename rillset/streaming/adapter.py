"""Structured Streaming: micro-batches of a stream are the changes of steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rillset.engine import Engine
from rillset.zset import ZSet


def feed(engine: Engine, table: str, stream: DataFrame, checkpoint: str, after: Callable[[Engine, int], None] | None = None, available_now: bool = True, event_time: str | None = None) -> StreamingQuery:
    """Push each micro-batch to a table and step. Every batch counts once, also over restarts of the process.

    The batch's number is part of the step's manifest: a batch that Spark runs again is skipped by an engine that has it, also
    by one opened anew on the folder. A checkpoint that is ahead of the engine is refused, as its batches would be lost.
    event_time names a numeric column: its largest value in a batch sets the clock. after(engine, batch) runs behind each step.
    """

    def run(batch: DataFrame, number: int) -> None:
        last = engine.feeds.get(checkpoint, -1)
        if number <= last:
            return
        if number > last + 1:
            raise RuntimeError(f"the stream is at batch {number}, the engine has taken {last + 1}; open it on the folder that it had")
        t = batch.agg(F.max(event_time)).first()[0] if event_time else None
        engine.push(table, ZSet(batch), None if t is None else int(t))
        try:
            engine.step((checkpoint, number))
        except Exception:
            engine.discard()  # Spark brings the batch again
            raise
        if after:
            after(engine, number)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _timed(stream: DataFrame, time_column: str, late: str) -> DataFrame:
    """The stream with a watermark. A time without zone is taken as one of UTC, so that windows begin where its days do."""
    if isinstance(stream.schema[time_column].dataType, T.TimestampNTZType):
        stream = stream.withColumn(time_column, F.from_utc_timestamp(F.col(time_column).cast("timestamp"), F.current_timezone()))
    return stream.withWatermark(time_column, late)


def wall(time: Column) -> Column:
    """A window's end as the time without zone that it stands for, where the stream's times have none."""
    return F.to_utc_timestamp(time, F.current_timezone()).cast("timestamp_ntz")


def tumbling(stream: DataFrame, time_column: str, width: str, late: str, *aggregates, keys: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates by windows of one width, with a watermark for late rows."""
    return _timed(stream, time_column, late).groupBy(F.window(time_column, width), *keys).agg(*aggregates)


def sliding(stream: DataFrame, time_column: str, width: str, slide: str, late: str, *aggregates, keys: tuple[str, ...] = ()) -> DataFrame:
    return _timed(stream, time_column, late).groupBy(F.window(time_column, width, slide), *keys).agg(*aggregates)


def sessions(stream: DataFrame, time_column: str, gap: str, late: str, *aggregates, keys: tuple[str, ...] = ()) -> DataFrame:
    return _timed(stream, time_column, late).groupBy(F.session_window(time_column, gap), *keys).agg(*aggregates)
