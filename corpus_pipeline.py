"""The corpus pipeline: toxic documents go, copies and near copies go, personal data is masked, the rest is packed.

Each stage gets all rows that its predecessor kept, with the columns of documents, and is written as Parquet in the shared
folder before the next one reads it: a lost executor costs the stage at hand, nothing before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillset.llm.common import materialize
from rillset.llm.exact_dedup import distinct_texts
from rillset.llm.ngram_join import similar_groups
from rillset.llm.packing import pack_documents
from rillset.llm.pii import with_masked, with_spans
from rillset.llm.queries import table, tokenizer_path
from rillset.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the corpus at sf_dir.

    Each row is judged by its text alone, however its id repeats; a null or empty text stays. Without labels or in an empty
    table nothing goes. All columns stay.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id stays, of several such rows the smallest by all columns.

    Null and empty texts are equal; a null id stays only where its text has no other. An empty table stays empty.
    """
    return distinct_texts(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one of the smallest doc_id stays; those without words stay.

    Rows that repeat an id are documents of their own and come last in that order, as do rows without an id. What goes is a
    small table of row numbers, so that documents move only where it outgrows Spark's bound for a broadcast.
    """
    rows = docs.withColumn("__row", F.col("doc_id"))
    several = materialize(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("__id")), "repeated-ids")
    if several.limit(1).count():
        # texts are distinct, so these numbers are one a row
        own = F.shiftrightunsigned(F.xxhash64("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)), 2) + F.lit(1 << 62)
        rows = docs.join(several, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
        named = F.col("doc_id").isNotNull() & F.col("__id").isNull()
        rows = rows.withColumn("__row", F.when(named, F.col("doc_id")).otherwise(own)).drop("__id")
    gone = materialize(similar_groups(rows, id_col="__row").where("doc_id <> component_id").select(F.col("doc_id").alias("__row")), "near-copies")
    return rows.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is masked by its kind; n_chars follows. No row goes; null texts stay null."""
    masked = with_masked(with_spans(docs, "text", "__spans"), "text", "__spans", "__masked")
    hit = F.size("__spans") > 0
    new = {"text": F.col("__masked"), "n_chars": F.when(hit, F.length("__masked").cast("long")).otherwise(F.col("n_chars"))}
    return masked.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of every document; a null or empty text is its end id alone, rows that repeat an id are packed each."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("pii", pii),
    ("packing", packing),
]
#: A classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents at sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
