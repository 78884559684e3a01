"""Signed multisets: a DataFrame with a weight column, and their algebra.

Every operation is a DataFrame plan; nothing runs before an action. Weights are BIGINT and ANSI arithmetic raises on
overflow. Rows are equal when all their columns are, nulls included.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillset.types import struct_of

WEIGHT = "__weight__"


class ZSet:
    """df: the data columns and, last, the weight."""

    def __init__(self, df: DataFrame):
        if WEIGHT not in df.columns:
            df = df.withColumn(WEIGHT, F.lit(1).cast("long"))
        data = [c for c in df.columns if c != WEIGHT]
        self.df = df.select(*[F.col(f"`{c}`") for c in data], F.col(WEIGHT).cast("long").alias(WEIGHT))

    # -- construction -------------------------------------------------------------------------------------------------
    @classmethod
    def empty(cls, spark: SparkSession, schema: str | T.StructType) -> ZSet:
        return cls(spark.createDataFrame([], struct_of(schema)))

    @classmethod
    def from_data(cls, spark: SparkSession, schema: str | T.StructType, rows: Iterable[Sequence], weights: Iterable[int] | None = None) -> ZSet:
        """Rows of weight 1, or of the given weights."""
        fields = struct_of(schema)
        rows = [tuple(r) for r in rows]
        full = T.StructType([*fields.fields, T.StructField(WEIGHT, T.LongType(), False)])
        return cls(spark.createDataFrame([(*r, w) for r, w in zip(rows, weights or [1] * len(rows), strict=True)], full))

    @classmethod
    def from_root(cls, df: DataFrame) -> ZSet:
        """A DataFrame that has the weight column already."""
        if WEIGHT not in df.columns:
            raise ValueError(f"no column {WEIGHT}")
        return cls(df)

    # -- inspection ---------------------------------------------------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return self.df.columns[:-1]

    @property
    def schema(self) -> T.StructType:
        return T.StructType(self.df.schema.fields[:-1])

    def raw_row_count(self) -> int:
        return self.df.count()

    def entry_count(self) -> int:
        return self.compact().df.count()

    def is_empty(self) -> bool:
        return self.compact().df.isEmpty()

    def to_dict(self) -> dict[tuple, int]:
        """Compacted rows to weights; for small results."""
        return {tuple(r)[:-1]: r[-1] for r in self.compact().df.collect()}

    def collect(self) -> list[Row]:
        return self.df.collect()

    def show(self, n: int = 20) -> None:
        self.df.show(n, truncate=False)

    def __repr__(self) -> str:
        return f"ZSet[{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in self.schema)}]"

    # -- group --------------------------------------------------------------------------------------------------------
    def compact(self) -> ZSet:
        """Equal rows as one, zero weights dropped. One shuffle, with partial sums before it."""
        named = self.df.groupBy(*[F.col(f"`{c}`") for c in self.columns]).agg(F.sum(WEIGHT).alias(WEIGHT))
        return ZSet(named.where(F.col(WEIGHT) != 0))

    def add(self, other: ZSet) -> ZSet:
        return ZSet(self.df.union(other.df))

    union_all = add

    def negate(self) -> ZSet:
        return ZSet(self.df.withColumn(WEIGHT, -F.col(WEIGHT)))

    def subtract(self, other: ZSet) -> ZSet:
        return self.add(other.negate())

    def scale(self, n: int) -> ZSet:
        return ZSet(self.df.withColumn(WEIGHT, F.col(WEIGHT) * F.lit(n)))

    def equals(self, other: ZSet) -> bool:
        return self.subtract(other).is_empty()

    @staticmethod
    def concat(parts: Sequence[ZSet]) -> ZSet:
        return reduce(ZSet.add, parts)

    append = add

    # -- rows ---------------------------------------------------------------------------------------------------------
    def filter(self, condition: Column | str) -> ZSet:
        return ZSet(self.df.where(condition))

    def map(self, *columns: Column | str) -> ZSet:
        """Row to row, weights kept; not compacted."""
        return ZSet(self.df.select(*columns, WEIGHT))

    def positive(self, as_set: bool = False) -> ZSet:
        some = self.compact().df.where(F.col(WEIGHT) > 0)
        return ZSet(some.withColumn(WEIGHT, F.lit(1)) if as_set else some)

    def distinct(self) -> ZSet:
        return self.positive(as_set=True)

    def expand(self) -> DataFrame:
        """The multiset as rows: a row of weight n comes n times. Negative weights don't."""
        some = self.compact().df.where(F.col(WEIGHT) > 0)
        times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(WEIGHT)))
        return some.select(*[F.col(f"`{c}`") for c in self.columns], times.alias(WEIGHT)).drop(WEIGHT)

    # -- two sets -----------------------------------------------------------------------------------------------------
    def union(self, other: ZSet) -> ZSet:
        return self.add(other).distinct()

    def except_(self, other: ZSet) -> ZSet:
        return self.distinct().subtract(other.distinct()).positive(as_set=True)

    def intersect(self, other: ZSet) -> ZSet:
        both = self.distinct().add(other.distinct()).compact().df.where(F.col(WEIGHT) >= 2)
        return ZSet(both.withColumn(WEIGHT, F.lit(1)))

    def multiply(self, other: ZSet | int) -> ZSet:
        """The product with another set, weights multiplied and names of the other's columns kept, or with a number."""
        if isinstance(other, int):
            return self.scale(other)
        right = other.df.withColumnRenamed(WEIGHT, "__right_weight__")
        both = self.df.crossJoin(right)
        w = F.col(WEIGHT) * F.col("__right_weight__")
        return ZSet(both.withColumn(WEIGHT, w).drop("__right_weight__").where(F.col(WEIGHT) != 0))

    def join(self, other: ZSet, on: Sequence[str], how: str = "inner") -> ZSet:
        """An equi-join on columns of one name; SQL's rule for nulls. Outer sides keep their own weight, semi and anti the left's.

        Outer joins compact both sides first, as rows that cancel must not count as matches.
        """
        if how in ("left_semi", "left_anti"):
            return ZSet(self.df.join(other.positive().df.select(*on).distinct(), list(on), how).select(*self.df.columns))
        left, right = (self, other) if how == "inner" else (self.compact(), other.compact())
        both = left.df.join(right.df.withColumnRenamed(WEIGHT, "__right_weight__"), list(on), how)
        w = F.coalesce(F.col(WEIGHT), F.lit(1)) * F.coalesce(F.col("__right_weight__"), F.lit(1))
        return ZSet(both.withColumn(WEIGHT, w).drop("__right_weight__"))

    # -- keys ---------------------------------------------------------------------------------------------------------
    def group_count(self, keys: Sequence[str]) -> int:
        return self.compact().df.select(*keys).distinct().count()

    def deindex(self, keys: Sequence[str]) -> ZSet:
        """Without the key columns."""
        return ZSet(self.df.drop(*keys))

    def aggregate(self, *columns: Column, keys: Sequence[str] = ()) -> DataFrame:
        """Aggregates over the rows as often as their weights say, by keys or over all."""
        return self.expand().groupBy(*keys).agg(*columns)

    def hash_partition(self, keys: Sequence[str], n: int) -> list[ZSet]:
        part = F.pmod(F.hash(*keys), F.lit(n))
        return [ZSet(self.df.where(part == k)) for k in range(n)]

    def repartition(self, keys: Sequence[str], n: int) -> ZSet:
        return ZSet(self.df.repartition(n, *keys))


def integrate(deltas: Sequence[ZSet]) -> list[ZSet]:
    """The running sums of a stream of changes."""
    sums: list[ZSet] = []
    for d in deltas:
        sums.append((sums[-1].add(d) if sums else d).compact())
    return sums


def differentiate(states: Sequence[ZSet]) -> list[ZSet]:
    """The changes between the states of a stream, the first against nothing."""
    return [s if k == 0 else s.subtract(states[k - 1]).compact() for k, s in enumerate(states)]

