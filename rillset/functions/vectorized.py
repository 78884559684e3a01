"""Batch expressions by name: what a stand-alone expression library would offer is a Column in Spark, compiled with its plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

field = F.col
literal = F.lit


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


BINARY = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: a / F.nullif(b, F.lit(0)),
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
}
UNARY = {"negate": lambda a: -a, "not": lambda a: ~a, "upper": F.upper, "lower": F.lower, "char_length": F.char_length}


def call(name: str, *arguments: Column) -> Column:
    return (BINARY if len(arguments) == 2 else UNARY)[name](*arguments)


def filter_batch(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def project_batch(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(*columns)
