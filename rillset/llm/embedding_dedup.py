"""Near-duplicate embeddings: cross-polytope hashing behind fast Hadamard rotations, multiprobe buckets, verified pairs.

1. Equal vectors become one class, with its number of members.
2. A class's vector is rotated (three rounds of random signs and a fast Hadamard transform) and hashed to the nearest
   signed axis; `hashes` of those make a table's bucket. It enters its own bucket of each table and, as probes, those
   where one hash takes the second nearest axis. Two classes meet in a bucket that both have entered. More hashes make a
   meeting in one table rarer, so the number of tables follows: pairs at the threshold are missed at a rate of MISSED.
3. Buckets are dealt to cells. A large bucket is cut into blocks and each pair of blocks is a cell, so no task holds a
   bucket whole and the work spreads. A cell multiplies matrices and counts, in double precision, each pair of cosine
   at least the threshold in exactly one bucket, the first where the two meet. What leaves a cell is a sum for each
   class and a spanning star of its links, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillset.llm.blocks import mix64
from rillset.llm.common import materialize, n_parts
from rillset.llm.graph import connected_components

#: The least number of tables, and the share of pairs at the threshold that may meet in none.
TABLES, MISSED = 6, 1e-4
BLOCK = 512
#: Pairs that a task holds at a time.
PAIRS = 500_000
SALTS = 16
SEED = 20240607


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def bucket_codes(x: np.ndarray, tables: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tables) own buckets and (rows, tables, hashes) probes of unit rows."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    wide = np.zeros((n, width))
    wide[:, :d] = x
    rng = np.random.default_rng([SEED, d])
    own, probes = np.zeros((n, tables), np.int64), np.zeros((n, tables, hashes), np.int64)
    for t in range(tables):
        first, second = [], []
        for _ in range(hashes):
            y = wide
            for signs in rng.choice([-1.0, 1.0], size=(3, width)):
                y = hadamard(y * signs)
            axes = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            size = np.take_along_axis(np.abs(y), axes, 1)
            axes = np.where((size[:, :1] >= size[:, 1:]), axes, axes[:, ::-1])
            code = 2 * axes + (np.take_along_axis(y, axes, 1) > 0)
            first.append(code[:, 0].astype(np.uint64))
            second.append(code[:, 1].astype(np.uint64))

        def code_of(parts: list[np.ndarray], t: int = t) -> np.ndarray:
            h = np.full(n, d * 1_000 + t, np.uint64)
            for p in parts:
                with np.errstate(over="ignore"):
                    h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + p + np.uint64(1))
            return h.view(np.int64)

        own[:, t] = code_of(first)
        for k in range(hashes):
            probes[:, t, k] = code_of([*first[:k], second[k], *first[k + 1 :]])
    return own, probes


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(raw: pa.Array, dtype: str) -> np.ndarray:
    """Rows of bytes of one length as rows of numbers."""
    n, width = len(raw), len(raw[0].as_buffer()) // np.dtype(dtype).itemsize
    first = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]
    return np.frombuffer(raw.buffers()[2], dtype, n * width, int(first)).reshape(n, width)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _first_meeting(a: np.ndarray, b: np.ndarray, own: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The bucket, of the first table that has one, where rows a and b meet (the smallest of several)."""
    most = np.iinfo(np.int64).max
    found, none = np.full(len(a), most), np.ones(len(a), bool)
    entered = np.concatenate([own[:, :, None], probes], axis=2)
    for t in range(own.shape[1]):
        x, y = entered[a, t], entered[b, t]
        both = (x[:, :, None] == y[:, None, :]).any(2)
        use = none & both.any(1)
        found[use] = np.where(both, x, most).min(1)[use]
        none &= ~use
    return found


def meeting_rate(width: int, threshold: float, hashes: int, tables: int = 16) -> float:
    """The share of (pair, table) in which random pairs of cosine threshold meet; always the same for equal arguments."""
    rng = np.random.default_rng(SEED)
    n = int(np.clip(1_000_000 // width, 100, 2_000))
    a, b = rng.normal(size=(2, n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b *= math.sqrt(max(0.0, 1 - threshold**2)) / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    x, y = (np.concatenate([own[:, :, None], probes], axis=2) for own, probes in (bucket_codes(a, tables, hashes), bucket_codes(threshold * a + b, tables, hashes)))
    return float((x[:, :, :, None] == y[:, :, None, :]).any((2, 3)).mean())


def tables_for(width: int, threshold: float, hashes: int) -> int:
    """So many tables that of pairs at the threshold a share of MISSED at most is expected to meet in none."""
    rate = min(max(meeting_rate(width, threshold, hashes), 0.01), 1 - 1e-9)
    return max(TABLES, math.ceil(math.log(MISSED) / math.log1p(-rate)))


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.95, tables: int | None = None, hashes: int | None = None, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per row: vec_id, n_links (other vectors found with cosine >= threshold), component_id, kept.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; vectors of different
    widths don't link. component_id is the smallest vec_id reachable by links, itself included; kept says that it is the
    row's own. Equal vectors all link. Ids are taken as unique; a null id forms no link. An empty table gives no rows.
    hashes (a table's hashes) follows from the number of distinct vectors unless given; more make smaller buckets. tables
    follows from width, threshold and hashes unless given (tables_for), so recall does not fall with size.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType
    dtype = "<f4" if isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType) else "<f8"
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    sound = base.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    classes = materialize(sound.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("members")), "vector-classes")
    n = classes.count()
    width = classes.select(F.max(F.size("v"))).first()[0] or 1 if hashes is None or tables is None else 1
    if hashes is None:
        # buckets of a few vectors, were they spread evenly: (2 d) ** hashes of them
        hashes = max(1, round(math.log(max(2.0, n / 2)) / math.log(2 * max(2, width))))
    if tables is None:
        tables = tables_for(width, threshold, hashes)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, wide = b.column(0), b.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for w in np.unique(wide):
                at = np.flatnonzero(wide == w)
                for k in range(0, len(at), 2048):
                    part = pa.array(at[k : k + 2048])
                    x = lists.take(part).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(w)).astype(dtype)
                    raw = [r.tobytes() for r in x]
                    own, probes = bucket_codes(_unit(x), tables, hashes)
                    codes = np.concatenate([own[:, :, None], probes], axis=2).reshape(len(x), -1)
                    times = codes.shape[1]
                    row = np.repeat(np.arange(len(x)), times)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(codes.ravel()), b.column(1).take(part).take(pa.array(row)), b.column(2).take(part).take(pa.array(row)), pa.array(raw, pa.binary()).take(pa.array(row))], ["bucket", "rep", "members", "raw"]
                    )

    placed = classes.select("v", "rep", "members").mapInArrow(place, "bucket long, rep long, members long, raw binary")
    # sizes come from the codes alone, and only large buckets are named
    large = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block).select("bucket", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    large = materialize(large, "large-buckets")
    if large.limit(1).count():
        placed = _cut_large(placed, large)
    else:
        placed = placed.withColumn("cell", F.lit(0)).withColumn("side", F.lit(0))
    groups = max(4 * n_parts(spark), -(-n * tables * (1 + hashes) // 50_000))

    def compare(table: pa.Table) -> pa.Table:
        sums = []
        lengths = pc.binary_length(table.column("raw")).to_numpy()
        for size in np.unique(lengths):
            part = table.filter(pa.array(lengths == size)).combine_chunks().sort_by([("bucket", "ascending"), ("cell", "ascending"), ("side", "ascending"), ("rep", "ascending")])
            bucket, cell, side, reps, members = (part.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("bucket", "cell", "side", "rep", "members"))
            sums.append(_Links(_matrix(pa.concat_arrays(part.column("raw").chunks), dtype), reps, members, threshold, tables, hashes).of(bucket, cell, side))
        rep, links, root = (np.concatenate(c) if sums else np.zeros(0, np.int64) for c in (zip(*sums) if sums else ((), (), ())))
        return pa.table({"rep": rep.astype(np.int64), "links": links.astype(np.int64), "root": root.astype(np.int64)})

    dealt = placed.withColumn("g", F.pmod(F.xxhash64("bucket", "cell"), F.lit(groups)).cast("int"))
    linked = materialize(dealt.groupBy("g").applyInArrow(compare, "rep long, links long, root long"), "vector-links")
    sums = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(linked, "rep", "root").select(F.col("node").alias("rep"), "component")
    known = classes.join(sums, "rep", "left").join(components, "rep", "left")
    known = known.where("members > 1 or links is not null").select("v", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = base.withColumn("salt", salt).join(spread, ["v", "salt"], "left")
    # a null id takes no part, whatever its vector
    named = F.col("vec_id").isNotNull()
    component = F.when(named, F.coalesce("c", "vec_id"))
    return rows.select("vec_id", F.when(named, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


class _Links:
    """The links between rows of some buckets: sums of members for each class, and a spanning star of each component."""

    def __init__(self, x: np.ndarray, reps: np.ndarray, members: np.ndarray, threshold: float, tables: int, hashes: int):
        self.unit, self.threshold, self.tables, self.hashes = _unit(x), threshold, tables, hashes
        self.named, first, self.row = np.unique(reps, return_index=True, return_inverse=True)
        self.first, self.members = first, members[first]
        self.links, self.root = np.zeros(len(first), np.int64), np.arange(len(first))
        self.coded = np.zeros(len(first), bool)
        self.own, self.probes = np.zeros((len(first), tables), np.int64), np.zeros((len(first), tables, hashes), np.int64)
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def of(self, bucket: np.ndarray, cell: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, links, root) of the classes that link; rows come sorted by bucket, cell and side."""
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(bucket) != 0) | (np.diff(cell) != 0)]))
        ends = np.append(starts[1:], len(bucket))
        several = ends - starts > 1
        for a, z in zip(starts[several].tolist(), ends[several].tolist()):
            # a cell between two blocks compares one with the other, any other its rows with each other
            middle = a + int(np.searchsorted(side[a:z], 1))
            if middle < z:
                i, j = np.nonzero(self.unit[a:middle] @ self.unit[middle:z].T >= self.threshold)
                i, j = self.row[a + i], self.row[middle + j]
                keep = i != j
            else:
                i, j = np.nonzero(self.unit[a:z] @ self.unit[a:z].T >= self.threshold)
                keep = i < j
                i, j = self.row[a + i], self.row[a + j]
            if keep.any():
                self.pairs.append((i[keep], j[keep], np.full(int(keep.sum()), bucket[a])))
                self.held += int(keep.sum())
                if self.held >= PAIRS:
                    self._count()
        self._count()
        some = self.links > 0
        return self.named[some], self.links[some], self.named[self.root[some]]

    def _count(self) -> None:
        """Count the pairs at hand, each in the first bucket where its classes meet; a class is hashed once."""
        if not self.pairs:
            return
        a, b, bucket = (np.concatenate(c) for c in zip(*self.pairs))
        self.pairs, self.held = [], 0
        fresh = np.zeros(len(self.first), bool)
        fresh[a] = fresh[b] = True
        fresh = np.flatnonzero(fresh & ~self.coded)
        for k in range(0, len(fresh), 2048):
            part = fresh[k : k + 2048]
            self.own[part], self.probes[part] = bucket_codes(self.unit[self.first[part]], self.tables, self.hashes)
        self.coded[fresh] = True
        here = np.concatenate([_first_meeting(a[k : k + 100_000], b[k : k + 100_000], self.own, self.probes) for k in range(0, len(a), 100_000)]) == bucket
        a, b = a[here], b[here]
        self.links += np.bincount(a, weights=self.members[b], minlength=len(self.first)).astype(np.int64)
        self.links += np.bincount(b, weights=self.members[a], minlength=len(self.first)).astype(np.int64)
        # classes are numbered by their ids, so the least number is the least id
        self.root = _roots(len(self.first), np.concatenate([a, np.arange(len(self.root))]), np.concatenate([b, self.root]))


def _cut_large(placed: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of a large bucket go to the cells (i, j), i <= j, of their block; side tells i's rows from j's (0 where i = j)."""
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    known = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = salted.join(known, ["bucket", "salt"], "left").drop("salt").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.hash("rep"), F.col("blocks"))
    out = both.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return out.select("bucket", "rep", "members", "raw", (low * F.col("blocks") + high).cast("int").alias("cell"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"))
