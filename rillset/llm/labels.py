"""Labelled rows for fitting: a bounded, fixed choice of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fitting_rows(labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, y) of at most `most` labelled documents outside the held-out fold, the first by a hash of the id.

    A label is 0 or 1; other values and nulls are left out, and of a document's several labels the larger counts.
    """
    sound = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    chosen = sound.where(remainder(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    return chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
