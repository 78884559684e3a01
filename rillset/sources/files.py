"""Readers and writers for table changes: any Spark source is a source of rows of weight 1, or of a weight column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rillset.types import struct_of
from rillset.zset import ZSet


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | T.StructType | None = None, **options: str) -> ZSet:
    """Parquet, ORC, JSON, CSV or text files as a Z-set; rows weigh 1 unless the files have a weight column."""
    reader = spark.read.format(kind).options(**options)
    if schema is not None:
        reader = reader.schema(struct_of(schema))
    return ZSet(reader.load(path))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> ZSet:
    return ZSet(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load())


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.format(kind).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
