"""Bitemporal sinks: what was in a view or table, from when to when.

Every change of a row is an event at the clock's time. A retraction ends the oldest open insertion of the row; one that
finds none open is a record of its own that starts and ends at once. Both follow from running sums over a row's events,
so the records are one window and one aggregate, without a queue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillset.operators.state import Log, Store
from rillset.zset import WEIGHT

START, END = "start_time", "end_time"


class BitemporalSink:
    def __init__(self, store: Store, name: str, schema: T.StructType):
        self.data = [f.name for f in schema.fields if f.name != WEIGHT]
        extra = [T.StructField("__step__", T.LongType()), T.StructField("__time__", T.LongType())]
        self.log = Log(store, f"{name}-bitemporal", T.StructType([f for f in schema.fields if f.name != WEIGHT] + extra))
        self.steps, self.closed_at = 0, None

    def schema(self) -> T.StructType:
        return T.StructType([*self.log.data.fields[:-2], T.StructField(START, T.LongType()), T.StructField(END, T.LongType())])

    def record(self, delta: DataFrame | None, clock: int) -> None:
        """One step's compacted change at the clock's time."""
        self.stage(delta, clock)
        self.commit()

    def stage(self, delta: DataFrame | None, clock: int) -> None:
        if self.closed_at is not None:
            raise RuntimeError("the sink is closed")
        if delta is not None:
            self.log.stage(delta.withColumn("__step__", F.lit(self.steps).cast("long")).withColumn("__time__", F.lit(clock).cast("long")))

    def commit(self) -> None:
        self.log.commit()
        self.steps += 1

    def abort(self) -> None:
        self.log.abort()

    def tidy(self) -> None:
        self.log.tidy()

    def saved(self) -> dict:
        return self.log.saved() | {"steps": self.steps + 1}

    def restore(self, saved: dict) -> None:
        self.log.restore(saved)
        self.steps = saved["steps"]

    def _records(self) -> DataFrame:
        row = [F.col(f"`{c}`") for c in self.data]
        sign, unit, total, inserted, retracted, orphans, orphan, pair = (f"__{x}__" for x in ("sign", "unit", "total", "inserted", "retracted", "orphans", "orphan", "pair"))
        times = F.explode(F.sequence(F.lit(1).cast("long"), F.abs(WEIGHT))).alias(unit)
        units = self.log.old().select(*row, "__step__", "__time__", F.signum(WEIGHT).cast("int").alias(sign), times)
        before = W.partitionBy(*row).orderBy("__step__", unit)
        order = before.rowsBetween(W.unboundedPreceding, W.currentRow)
        ever = lambda is_one: F.sum(F.when(is_one, 1).otherwise(0)).over(order)
        summed = units.withColumn(total, F.sum(sign).over(order)).withColumn(inserted, ever(F.col(sign) > 0)).withColumn(retracted, ever(F.col(sign) < 0))
        low = summed.withColumn(orphans, -F.least(F.lit(0), F.min(total).over(order)))
        alone = (F.col(sign) < 0) & (F.col(orphans) > F.coalesce(F.lag(orphans).over(before), F.lit(0)))
        number = F.when(F.col(sign) > 0, F.col(inserted)).when(F.col(orphan), -F.col(retracted)).otherwise(F.col(retracted) - F.col(orphans))
        paired = low.withColumn(orphan, alone).withColumn(pair, number)
        start = F.min(F.when((F.col(sign) > 0) | F.col(orphan), F.col("__time__")))
        end = F.max(F.when(F.col(sign) < 0, F.col("__time__")))
        return paired.groupBy(*row, pair).agg(start.alias(START), end.alias(END)).drop(pair)

    def rows(self, clock: int) -> DataFrame:
        """Closed records, and open ones as if they ended now (at the clock's time, or when the sink was closed)."""
        now = self.closed_at if self.closed_at is not None else clock
        return self._records().withColumn(END, F.coalesce(END, F.lit(now).cast("long")))

    def closed_rows(self) -> DataFrame:
        """Records that a retraction has ended, and all once the sink is closed."""
        if self.closed_at is not None:
            return self.rows(self.closed_at)
        return self._records().where(F.col(END).isNotNull())

    def close(self, clock: int) -> None:
        if self.closed_at is None:
            self.closed_at = clock


class ParquetSink(BitemporalSink):
    """A bitemporal sink whose records are written to a folder when it closes."""

    def __init__(self, store: Store, name: str, schema: T.StructType, path: str):
        super().__init__(store, name, schema)
        self.path = path

    def close(self, clock: int) -> None:
        if self.closed_at is None:
            super().close(clock)
            self.rows(clock).write.mode("overwrite").parquet(self.path)
