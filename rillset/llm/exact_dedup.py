"""Exact de-duplication: counting quotient filters find repeated fingerprints, bytes decide.

1. Each input partition builds a counting quotient filter of its 64-bit text fingerprints: the high bits (the
   quotient) pick a run, the low bits (the remainder) are stored sorted within the run, beside a count.
2. The filters are cut by quotient range; the slices of one range merge, losslessly, by their sorted remainders.
   A fingerprint that a third of all rows share is one entry of each partition's filter.
3. The repeated fingerprints go back to all tasks as a Bloom filter of bounded size, so that a unique text leaves the scan
   only in the filter's few false alarms. The others are grouped by their bytes, copies combined before the shuffle.
4. Rows meet their group by fingerprint and SHA-256. Of n rows fewer than HOT groups can have more than n / HOT; those are
   broadcast, and no key of the shuffled join has more rows than that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillset.llm.blocks import mix64
from rillset.llm.common import materialize, n_parts, select_text

QUOTIENTS_PER_SLICE_BITS = 10
HOT = 1000
BLOOM_HASHES, BLOOM_BITS_PER_KEY, BLOOM_LEAST_BITS, BLOOM_MOST_BITS = 4, 16, 1 << 16, 1 << 28
BLOOM_SLICE = 1 << 16


class CountingQuotientFilter:
    """An exact multiset of 64-bit fingerprints. runs[i]: how many distinct remainders quotient i holds."""

    def __init__(self, first: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray, q_bits: int):
        self.first, self.runs, self.remainders, self.counts, self.q_bits = first, runs, remainders, counts, q_bits

    @classmethod
    def build(cls, fingerprints: np.ndarray, q_bits: int) -> CountingQuotientFilter:
        values, counts = np.unique(fingerprints.astype(np.uint64, copy=False), return_counts=True)
        return cls._of(values, counts.astype(np.uint64), 0, 1 << q_bits, q_bits)

    @classmethod
    def _of(cls, values: np.ndarray, counts: np.ndarray, first: int, n: int, q_bits: int) -> CountingQuotientFilter:
        r_bits = np.uint64(64 - q_bits)
        quotients = (values >> r_bits).astype(np.int64) - first
        return cls(first, np.bincount(quotients, minlength=n).astype(np.uint32), values & np.uint64((1 << int(r_bits)) - 1), counts, q_bits)

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(self.first, self.first + len(self.runs), dtype=np.uint64), self.runs)
        return (quotients << np.uint64(64 - self.q_bits)) | self.remainders

    def slices(self, width_bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The filter cut at multiples of 2**width_bits quotients; only parts that hold something."""
        width, ends = 1 << width_bits, np.concatenate([[0], np.cumsum(self.runs, dtype=np.int64)])
        for k in range(0, len(self.runs), width):
            a, b = ends[k], ends[k + width]
            if b > a:
                yield k >> width_bits, CountingQuotientFilter(self.first + k, self.runs[k : k + width], self.remainders[a:b], self.counts[a:b], self.q_bits)

    @staticmethod
    def merge(parts: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """All parts cover the same quotients; equal remainders of a quotient add their counts."""
        values, counts = np.concatenate([p.fingerprints() for p in parts]), np.concatenate([p.counts for p in parts])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        return CountingQuotientFilter._of(values[starts], np.add.reduceat(counts, starts), parts[0].first, len(parts[0].runs), parts[0].q_bits)

    def to_bytes(self) -> bytes:
        head = np.array([self.first, len(self.runs), len(self.remainders), self.q_bits], "<i8").tobytes()
        return head + self.runs.astype("<u4").tobytes() + self.remainders.astype("<u8").tobytes() + self.counts.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> CountingQuotientFilter:
        first, n, m, q_bits = (int(x) for x in np.frombuffer(b, "<i8", 4))
        at = 32 + 4 * n
        return cls(first, np.frombuffer(b, "<u4", n, 32), np.frombuffer(b, "<u8", m, at), np.frombuffer(b, "<u8", m, at + 8 * m), q_bits)


def repeated_fingerprints(fps: DataFrame, column: str = "fp") -> DataFrame:
    """(fp, n) of every value of a long column that more than one row has; n counts the rows. Nulls are left out."""
    spark = fps.sparkSession
    slice_bits = max(2, (n_parts(spark) - 1).bit_length())
    q_bits = slice_bits + QUOTIENTS_PER_SLICE_BITS

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if held and len(values := np.concatenate(held)):
            cut = [(k, part.to_bytes()) for k, part in CountingQuotientFilter.build(values.view(np.uint64), q_bits).slices(QUOTIENTS_PER_SLICE_BITS)]
            for i in range(0, len(cut), 64):
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut[i : i + 64]], pa.int32()), pa.array([b for _, b in cut[i : i + 64]], pa.binary())], ["slice", "cqf"])

    def merge(table: pa.Table) -> pa.Table:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("cqf")])
        many = whole.counts > 1
        return pa.table({"fp": whole.fingerprints()[many].view(np.int64), "n": whole.counts[many].astype(np.int64)})

    narrow = fps.select(F.col(column).cast("long").alias("fp")).where("fp is not null")
    return narrow.mapInArrow(build, "slice int, cqf binary").groupBy("slice").applyInArrow(merge, "fp long, n long")


def _places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a Bloom filter of a power of two of bits that stand for each value."""
    values = values.view(np.uint64)
    return [(mix64(values ^ np.uint64(0x9E37_79B9 * (k + 1))) & np.uint64(bits - 1)).astype(np.int64) for k in range(BLOOM_HASHES)]


def bloom_filter(values: DataFrame, n: int) -> np.ndarray:
    """The bytes of a Bloom filter over a column of n longs: BLOOM_BITS_PER_KEY bits for each, BLOOM_MOST_BITS at most.

    A task fills a filter of its own and sends the slices that hold something; slices are united before the driver gets them.
    """
    bits = min(BLOOM_MOST_BITS, max(BLOOM_LEAST_BITS, 1 << (BLOOM_BITS_PER_KEY * max(1, n) - 1).bit_length()))

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for at in _places(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits):
                np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for k in range(0, len(own), BLOOM_SLICE):
            part = own[k : k + BLOOM_SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOOM_SLICE], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "bits"])

    def unite(table: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([whole.tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for row in values.mapInArrow(fill, "slice int, bits binary").groupBy("slice").applyInArrow(unite, "slice int, bits binary").toLocalIterator():
        out[row.slice * BLOOM_SLICE :][: len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def _may_repeat(docs: DataFrame, repeated: DataFrame) -> Callable[[Column], Column]:
    """Whether a fingerprint may be one of the repeated ones: always true for those, and for few others."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(repeated, repeated.count()).tobytes())

    @F.arrow_udf("boolean")
    def might(fp: pa.Array) -> pa.Array:
        held = np.frombuffer(shared.value, np.uint8)
        found = np.ones(len(fp), bool)
        for at in _places(fp.to_numpy(zero_copy_only=False).astype(np.int64), 8 * len(held)):
            found &= (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pa.array(found)

    return might


class _Copies:
    """Rows beside __id, __text and __fp: those alone by their fingerprint, the others, and the groups of equal texts."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        plain = [F.col(f"`{id_col}`").cast("long").alias("__id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text")]
        rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *plain).withColumn("__fp", F.xxhash64("__text"))
        repeated = materialize(repeated_fingerprints(rows.select("__fp"), "__fp").select("fp"), "repeated")
        might = _may_repeat(docs, repeated)
        self.alone = rows.where(~might(F.col("__fp")))
        self.suspects = rows.where(might(F.col("__fp")))
        groups = self.suspects.groupBy("__fp", "__text").agg(F.max("__id").alias("__keep_id"), F.count(F.lit(1)).alias("__group_size")).where("__group_size > 1")
        self.groups = materialize(groups.select("__fp", F.sha2("__text", 256).alias("__sha"), "__keep_id", "__group_size"), "copies")

    def met(self, columns: list[str], kept: bool) -> DataFrame:
        """The suspects' columns, __id and __sha, and __keep and __size of their group (null without one); with kept only rows that stay."""
        total = self.groups.agg(F.sum("__group_size")).first()[0] or 0
        hot = F.col("__group_size") > -(-total // HOT)
        few = self.groups.where(hot).select("__fp", "__sha", F.col("__keep_id").alias("__hot_id"), F.col("__group_size").alias("__hot_size"))
        rows = self.suspects.withColumn("__sha", F.sha2("__text", 256)).select(*columns, "__id", "__fp", "__sha")
        # fewer than HOT rows, whatever the size of the input
        one = rows.join(F.broadcast(few), ["__fp", "__sha"], "left")
        stays = F.col("__id").eqNullSafe(F.col("__hot_id"))
        one = one.where(F.col("__hot_size").isNull() | stays) if kept else one
        # rows that have met their group are dealt by their id, where nothing can match
        met = F.col("__hot_size").isNotNull()
        one = one.withColumn("__key", F.when(met, F.xxhash64("__id")).otherwise(F.col("__fp"))).withColumn("__want", F.when(met, F.lit("")).otherwise(F.col("__sha")))
        rest = self.groups.where(~hot).select(F.col("__fp").alias("__key"), F.col("__sha").alias("__want"), "__keep_id", "__group_size")
        both = one.join(rest, ["__key", "__want"], "left")
        size = F.coalesce("__hot_size", "__group_size")
        out = both.select(*columns, "__id", "__sha", F.when(met, F.col("__hot_id")).otherwise(F.col("__keep_id")).alias("__keep"), size.alias("__size"))
        return out.where(F.col("__size").isNull() | F.col("__id").eqNullSafe(F.col("__keep"))) if kept else out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id (largest doc_id of the rows with an identical text), group_size, kept, text_sha256.

    A null text counts as empty, so null and empty texts form one group. A null doc_id never wins over a number; in a
    group of null ids only, keep_id is null and every row is kept. Rows that repeat a doc_id count one by one, and all
    rows that carry the keep_id are kept. An empty table gives no rows.
    """
    copies = _Copies(select_text(docs, id_col, text_col), "doc_id", "text")
    met = copies.met([], False).select("__id", "__sha", "__keep", "__size")
    alone = copies.alone.select("__id", F.sha2("__text", 256).alias("__sha"), F.lit(None).cast("long").alias("__keep"), F.lit(None).cast("long").alias("__size"))
    single = F.col("__size").isNull()
    return met.union(alone).select(
        F.col("__id").alias("doc_id"),
        F.when(single, F.col("__id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("__id").eqNullSafe(F.col("__keep"))).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, one for each text: that of the largest id, of several such rows the smallest by all columns.

    Null and empty texts count as equal. A null id stays only where a text has no other. An empty table gives no rows.
    """
    columns = [f"`{c}`" for c in docs.columns]
    copies = _Copies(docs, id_col, text_col)
    met = copies.met(columns, True)
    single = met.where(F.col("__size").isNull()).select(*columns)
    whole = F.min(F.struct(*columns)).alias("__row")
    several = met.where(F.col("__size").isNotNull()).groupBy("__sha").agg(whole).select("__row.*")
    return copies.alone.select(*columns).union(single).union(several)
