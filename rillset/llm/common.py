"""What the corpus operators share: column selection, scratch tables in the shared folder, block sizes."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillset.scratch import shared_folder


#: A key is hot where more than one in so many rows have it.
HOT = 1000


def select_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), a null text as the empty one; other columns, whatever their names, stay out of the plan."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return shared_folder(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rillset-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any longer; what was made of them has been written itself."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def hot_keys(rows: DataFrame, key: str, share: int = HOT) -> DataFrame:
    """(key) of those that more than one in `share` rows have: fewer than `share` of them, whatever the size of the table."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    whole = rows.agg(F.count(F.lit(1)).alias("__all"))
    return counts.join(F.broadcast(whole), F.col("__n") * share > F.col("__all")).select(key)


def look_up(rows: DataFrame, key: str, table: DataFrame, node: str, hot: DataFrame | None) -> DataFrame:
    """rows with the columns of table, which has one row for each node, where key = node.

    hot: the keys of hot_keys(rows, key), written, or None where there are none; they meet by a broadcast and move no row.
    """
    if hot is None:
        return rows.join(table, F.col(key) == F.col(node))
    named = hot.select(F.col(key).alias("__hot"))
    few = table.join(F.broadcast(named), F.col(node) == F.col("__hot"), "left_semi")
    often = rows.join(F.broadcast(few), F.col(key) == F.col(node))
    rest = rows.join(F.broadcast(named), F.col(key) == F.col("__hot"), "left_anti")
    return often.unionByName(rest.join(table, F.col(key) == F.col(node)))


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tidy() -> None:
    """Give memory that a task no longer uses back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run: Callable[..., Iterable]) -> Callable[..., Iterator]:
    """A function of batches that tidies up behind its last one."""

    @functools.wraps(run)
    def whole(*batches: Iterable) -> Iterator:
        try:
            yield from run(*batches)
        finally:
            tidy()

    return whole


def tidied_group(run: Callable) -> Callable:
    """A function of a group's tables that tidies up behind it. Its parameters are named by position."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            tidy()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            tidy()

    return one if run.__code__.co_argcount == 1 else two
