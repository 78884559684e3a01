"""Versioned state: append-only logs of weighted segments, written as Parquet.

A step appends what changed. A log's content is the sum of its segments, and reading is one scan over their files. Segments
are merged by size: TIER segments of about one size become one of the next, so a row is rewritten once for each power of
TIER that its log grows by, and a large base is left alone by small changes. Merged segments cancel what they can; without
retractions files are only joined, and beyond MERGE_ROWS not even that.

A segment knows the ranges of its columns that views join or group by (whole numbers and dates). A step that looks for keys
within some range opens only the segments whose range meets it, and pushes the range to their scans, so where keys come with
time (orders, days) a change of today's leaves the files of the years before alone.

Segments count only when a step commits, so a failed step leaves no trace. Files that nothing names any longer are deleted
GRACE commits later, when results handed out by the last steps have been read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillset.zset import WEIGHT, ZSet

TIER = 8
MERGE_ROWS = 50_000_000
FILE_ROWS = 4_000_000
GRACE = 2
#: Rows that a shuffle partition is to hold, and its compressed bytes up to which small ones are joined.
PARTITION_ROWS = 500_000
PARTITION_BYTES = 4 << 20
EPOCH = date(1970, 1, 1).toordinal()


#: Lowest and highest value, as whole numbers.
Range = tuple[int, int]


class Segment:
    """ranges: for columns by name the least and greatest value, None where all are null, and whether there are nulls."""

    def __init__(self, path: str, rows: int, least: int, ranges: dict[str, list] | None = None):
        self.path, self.rows, self.least, self.ranges = path, rows, least, ranges or {}

    def saved(self) -> list:
        return [self.path, self.rows, self.least, self.ranges]

    def meets(self, within: dict[str, Range]) -> bool:
        known = [(self.ranges[c], span) for c, span in within.items() if c in self.ranges]
        return all(low is not None and low <= span[1] and high >= span[0] for (low, high, _), span in known)


def has_range(kind: T.DataType) -> bool:
    return isinstance(kind, (T.IntegralType, T.DateType))


def _number(column: str, kind: T.DataType) -> Column:
    return F.unix_date(F.col(f"`{column}`")) if isinstance(kind, T.DateType) else F.col(f"`{column}`")


def spanned(segments: list[Segment], column: str, with_null: bool) -> Range | None:
    """The range of a column over segments, None where it is not known, or where nulls matter and there are some."""
    known = [s.ranges.get(column) for s in segments if s.rows]
    if not known or any(r is None or (with_null and r[2]) for r in known):
        return None
    sure = [r for r in known if r[0] is not None]
    return (min(r[0] for r in sure), max(r[1] for r in sure)) if sure else None


def partitions(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for so many rows, the session's at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))


@contextmanager
def sized(sessions: Iterable[SparkSession], rows: int) -> Iterator[None]:
    """Shuffles that follow the rows at hand, so that what a task sorts and holds doesn't grow with the tables."""
    held = []
    try:
        for spark in sessions:
            names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
            few, size = (spark.conf.get(n) for n in names)
            if (n := partitions(spark, rows)) > int(few):
                held.append((spark, dict(zip(names, (few, size)))))
                spark.conf.set(names[0], str(n))
                spark.conf.set(names[1], str(min(PARTITION_BYTES, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size))))
        yield
    finally:
        for spark, was in held:
            for name, value in was.items():
                spark.conf.set(name, value)


class Store:
    """Writes segments and small texts below one root folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.pinned: set[str] = set()
        self.parts: list[str] = []

    def write(self, df: DataFrame, name: str, tracked: Iterable[str] = ()) -> Segment:
        """Write a segment; the ranges of the tracked columns are seen on the way."""
        path, seen = f"{self.root}/{name}-{uuid.uuid4().hex[:12]}", Observation()
        tracked = [(c, _number(c, df.schema[c].dataType)) for c in tracked if has_range(df.schema[c].dataType)]
        more = [m for i, (c, x) in enumerate(tracked) for m in (F.min(x).alias(f"low{i}"), F.max(x).alias(f"high{i}"), F.max(F.col(f"`{c}`").isNull()).alias(f"null{i}"))]
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.min(WEIGHT).alias("least"), *more).write.parquet(path)
        found = seen.get
        ranges = {c: [found[f"low{i}"], found[f"high{i}"], bool(found[f"null{i}"])] for i, (c, _) in enumerate(tracked)}
        return Segment(path, found["n"], 1 if found["least"] is None else found["least"], ranges)

    def read(self, schema: T.StructType, segments: list[Segment]) -> DataFrame:
        some = [s.path for s in segments if s.rows]
        if not some:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*some)

    def part(self, df: DataFrame, name: str, tracked: Iterable[str] = ()) -> tuple[DataFrame, Segment]:
        """A small result that several branches read, written once and deleted when the step ends."""
        segment = self.write(df, f"{name}-part", tracked)
        self.parts.append(segment.path)
        return self.read(df.schema, [segment]), segment

    def end_step(self) -> None:
        self.delete(self.parts)
        self.parts = []

    # -- files --------------------------------------------------------------------------------------------------------
    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def delete(self, paths: Iterable[str]) -> None:
        for path in paths:
            if path not in self.pinned:
                fs, where = self._at(path)
                fs.delete(where, True)

    def names(self, folder: str) -> list[str]:
        fs, where = self._at(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def put(self, name: str, text: str) -> None:
        """A text below the root, whole or not at all."""
        fs, where = self._at(f"{self.root}/{name}")
        _, fresh = self._at(f"{self.root}/{name}.tmp")
        out = fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(fresh, where)

    def get(self, name: str) -> str:
        fs, where = self._at(f"{self.root}/{name}")
        source = fs.open(where)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()


class Log:
    """Segments of one table, view or operator."""

    def __init__(self, store: Store, name: str, schema: T.StructType):
        self.store, self.name = store, name
        relaxed = [T.StructField(f.name, f.dataType, True) for f in schema.fields if f.name != WEIGHT]
        self.data = T.StructType(relaxed)
        self.schema = T.StructType([*relaxed, T.StructField(WEIGHT, T.LongType(), True)])
        self.segments: list[Segment] = []
        self.staged: list[Segment] = []
        self.dead: list[tuple[int, str]] = []
        self.commits = 0
        self.tracked: set[str] = set()

    def stage(self, df: DataFrame) -> Segment:
        segment = self.store.write(df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]), self.name, sorted(self.tracked))
        self.staged.append(segment)
        return segment

    def commit(self) -> None:
        self.segments += [s for s in self.staged if s.rows]
        self._bury([s for s in self.staged if not s.rows])
        self.staged = []
        self.commits += 1

    def abort(self) -> None:
        self.store.delete(s.path for s in self.staged)
        self.staged = []

    def tidy(self) -> None:
        """Merge tiers that are full, and delete files that nothing has named for GRACE commits."""
        self.merge()
        self.store.delete(path for at, path in self.dead if at + GRACE <= self.commits)
        self.dead = [(at, path) for at, path in self.dead if at + GRACE > self.commits]

    def _bury(self, segments: list[Segment]) -> None:
        self.dead += [(self.commits, s.path) for s in segments]

    def merge(self) -> None:
        tiers: dict[int, list[Segment]] = {}
        for s in self.segments:
            if s.rows < MERGE_ROWS or s.least < 0:
                tiers.setdefault((s.rows.bit_length() + 2) // 3, []).append(s)
        for tier in sorted(tiers):
            if len(some := tiers[tier]) >= TIER:
                rest = [s for s in self.segments if s not in some]
                made = self.store.write(self._merged(some, not rest), self.name, sorted(self.tracked))
                self._bury(some)
                self.segments = rest + ([made] if made.rows else [])
                self._bury([] if made.rows else [made])

    def _merged(self, some: list[Segment], whole: bool) -> DataFrame:
        df = self.store.read(self.schema, some)
        if any(s.least < 0 for s in some):
            return ZSet(df).compact().df
        return df.coalesce(max(1, sum(s.rows for s in some) // FILE_ROWS))

    def clear(self) -> None:
        self._bury([*self.segments, *self.staged])
        self.segments, self.staged = [], []

    def saved(self) -> dict:
        """What a manifest says of the log once the staged segments count."""
        return {"schema": self.data.simpleString(), "segments": [s.saved() for s in [*self.segments, *self.staged] if s.rows]}

    def restore(self, saved: dict) -> None:
        if saved["schema"] != self.data.simpleString():
            raise ValueError(f"{self.name} was {saved['schema']}, not {self.data.simpleString()}")
        self.segments = [Segment(*s) for s in saved["segments"]]

    @property
    def only_inserts(self) -> bool:
        return all(s.least > 0 for s in [*self.segments, *self.staged])

    @property
    def count(self) -> int:
        """Rows as they are stored, those of a step at hand included."""
        return sum(s.rows for s in [*self.segments, *self.staged])

    def at(self, version: str, within: dict[str, Range] | None = None) -> DataFrame:
        """The rows before or after the step; with ranges of columns at least those within them, without nulls there."""
        segments = self.segments if version == "old" else [*self.segments, *self.staged]
        if not within:
            return self.store.read(self.schema, segments)
        df = self.store.read(self.schema, [s for s in segments if s.meets(within)])
        for c, span in within.items():
            if isinstance(self.schema[c].dataType, T.DateType):
                if not 1 <= span[0] + EPOCH <= span[1] + EPOCH <= date.max.toordinal():
                    continue  # not a date that Python has
                span = [date.fromordinal(x + EPOCH) for x in span]
            df = df.where(F.col(f"`{c}`").between(*map(F.lit, span)))
        return df

    def old(self, within: dict[str, Range] | None = None) -> DataFrame:
        return self.at("old", within)

    def new(self) -> DataFrame:
        return self.at("new")

    def delta(self) -> DataFrame | None:
        some = [s for s in self.staged if s.rows]
        return self.store.read(self.schema, some) if some else None

    def rows(self, version: str = "new") -> DataFrame:
        """The content as plain rows, each as often as its weight says."""
        df = self.at(version)
        if not self.only_inserts and (n := partitions(self.store.spark, self.count)) > partitions(self.store.spark, 0):
            df = df.repartition(n, *[F.col(f"`{c}`") for c in self.data.fieldNames()])
        return expand(df, self.only_inserts)


class GroupLog(Log):
    """Rows of which the latest of each key counts: columns of the key, `state` (a struct; null: the group is gone), `was`, `seq`."""

    def __init__(self, store: Store, name: str, schema: T.StructType, keys: list[str]):
        super().__init__(store, name, schema)
        self.keys, self.tracked = keys, {k for k in keys if has_range(self.schema[k].dataType)}

    def _merged(self, some: list[Segment], whole: bool) -> DataFrame:
        rows = self.store.read(self.schema, some).groupBy(*self.keys).agg(F.max_by(F.struct("state", "was", "seq", WEIGHT), "seq").alias("r")).select(*self.keys, "r.*")
        # a group that is gone must still hide its older rows in other segments
        rows = rows.where("state IS NOT NULL") if whole else rows
        return rows.select(*self.schema.fieldNames())

    @property
    def fields(self) -> list[str]:
        return self.schema["state"].dataType.fieldNames()

    def last(self) -> list[Column]:
        """The latest state of a group's rows, field by field: numbers are then hashed, not sorted."""
        return [F.max_by(F.col(f"state.{f}"), "seq").alias(f"was_{f}") for f in self.fields]

    def packed(self) -> Column:
        """The fields of last() as a state again; the first field of every state is a number."""
        whole = F.struct(*[F.col(f"was_{f}").alias(f) for f in self.fields])
        return F.when(F.col(f"was_{self.fields[0]}").isNotNull(), whole).cast(self.schema["state"].dataType)

    def current(self, rows: DataFrame) -> DataFrame:
        """(keys, state) of the groups that rows of this log say are there."""
        return rows.groupBy(*self.keys).agg(*self.last()).select(*self.keys, self.packed().alias("state")).where("state IS NOT NULL")


def expand(df: DataFrame, only_inserts: bool = False) -> DataFrame:
    """Weighted rows as rows. Without retractions nothing has to cancel, and no shuffle is needed."""
    data = [F.col(f"`{c}`") for c in df.columns if c != WEIGHT]
    if not only_inserts:
        return ZSet(df).expand()
    return df.where(F.col(WEIGHT) > 0).select(*data, F.explode(F.sequence(F.lit(1).cast("long"), F.col(WEIGHT))).alias(WEIGHT)).drop(WEIGHT)
