"""Scalar, aggregate and table functions by users."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillset.types import spark_type
from rillset.zset import WEIGHT


class AggregateUdf:
    """The contract of an aggregate: initialize(), accumulate(acc, value, weight), finalize(acc). Nulls come as None."""

    def initialize(self) -> Any:
        raise NotImplementedError

    def accumulate(self, acc: Any, value: Any, weight: int) -> Any:
        raise NotImplementedError

    def finalize(self, acc: Any) -> Any:
        raise NotImplementedError


class UdfRegistry:
    """Names are case-insensitive; a name can be registered once."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.scalars: dict[str, tuple[list[T.DataType], T.DataType]] = {}
        self.aggregates: dict[str, tuple[T.DataType, T.DataType]] = {}

    def _claim(self, name: str) -> str:
        key = name.lower()
        if key in self.scalars or key in self.aggregates:
            raise ValueError(f"function {name} is registered already")
        return key

    def scalar(self, name: str, f: Callable, argument_types: Iterable[str | T.DataType], return_type: str | T.DataType, vectorized: bool = False) -> None:
        """A function of cells, or with vectorized of pandas Series (Arrow batches)."""
        key, result = self._claim(name), spark_type(return_type)
        self.spark.udf.register(name, F.pandas_udf(f, result) if vectorized else F.udf(f, result, useArrow=True))
        self.scalars[key] = ([spark_type(t) for t in argument_types], result)

    def aggregate(self, name: str, f: AggregateUdf, argument_type: str | T.DataType, return_type: str | T.DataType) -> None:
        """An aggregate of one argument. A group's values come sorted, each distinct one once with its weight."""
        key, result = self._claim(name), spark_type(return_type)

        def fold(values: pd.Series) -> Any:
            acc, some = f.initialize(), values.dropna()
            for value, n in some.value_counts(sort=False).sort_index().items():
                acc = f.accumulate(acc, value, int(n))
            if len(values) > len(some):
                acc = f.accumulate(acc, None, len(values) - len(some))
            return f.finalize(acc)

        fold.__annotations__ = {"values": pd.Series, "return": Any}
        self.spark.udf.register(name, F.pandas_udf(fold, result, F.PandasUDFType.GROUPED_AGG))
        self.aggregates[key] = (spark_type(argument_type), result)


def apply_table_udf(df: DataFrame, columns: list[str], f: Callable[..., Iterable[tuple] | None], schema: T.StructType) -> DataFrame:
    """Each weighted row to no, one or many rows of the schema, with the weight of the row; other columns go."""
    out = T.StructType([*schema.fields, T.StructField(WEIGHT, T.LongType())])
    names = out.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = [b[c].astype(object).where(b[c].notna(), None) for c in columns]
            rows = []
            for *values, w in zip(*cells, b[WEIGHT]):
                for r in f(*values) or ():
                    if len(r) != len(names) - 1:
                        raise ValueError(f"a row of {len(r)} values for {len(names) - 1} columns")
                    rows.append((*r, w))
            yield pd.DataFrame(rows, columns=names)

    return df.select(*columns, WEIGHT).mapInPandas(run, out)
