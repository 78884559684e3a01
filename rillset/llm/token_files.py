"""Token files: Arrow stream files of fixed-size-list batches, so the k-th sequence is an offset away, without parsing.

A shard is two stream files. `<shard>.tokens.arrow` has batches of fixed_size_list<id>[seq_len] and, beside them, how many
ids of each sequence are documents' (the others are padding behind the shard's last id); ids are unsigned 16-bit integers
where the vocabulary allows it, else 32-bit. Nothing is compressed and every batch but the last has BATCH_SEQUENCES
sequences, so all of these have one size in bytes: a memory-mapped reader finds a sequence by a multiplication and gets its
ids as a view of the file. A mask is ones and then zeros, so it is a view too, of one array that serves all sequences: bytes
of masks in the files would be half as many again as those of the ids. `<shard>.docs.arrow` has doc_id, start (ids of the
shard before the document) and n_tokens. Shards hold the documents in ascending doc_id order and end at a document once they
are ROLL_BYTES long; the manifest has each shard's place and ids, from which global starts follow.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from rillset.llm.common import n_parts, select_text, tidied
from rillset.llm.tokens import WordEncoder, chunks

SEQ_LEN = 2048
BATCH_SEQUENCES = 256
ROLL_BYTES = 512 << 20
MANIFEST = "shard string, part int, roll int, n_docs long, n_tokens long, first_doc long, last_doc long"
MANIFEST_ROWS = pa.schema([("shard", pa.string()), ("part", pa.int32()), ("roll", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64())])
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI as Spark writes it."""
    for spark_name, name in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "/dbfs/")):
        if uri.startswith(spark_name):
            uri = name + uri.removeprefix(spark_name).lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _schema(dtype: np.dtype, seq_len: int) -> pa.Schema:
    kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    return pa.schema([pa.field("ids", pa.list_(kind, seq_len)), pa.field("length", pa.int32())])


def _sequences(ids: np.ndarray, seq_len: int, schema: pa.Schema) -> pa.RecordBatch:
    """Whole sequences from ids, the last one padded with zeros."""
    n = -(-len(ids) // seq_len)
    flat = np.zeros(n * seq_len, ids.dtype)
    flat[: len(ids)] = ids
    length = np.minimum(len(ids) - np.arange(n) * seq_len, seq_len).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), seq_len), pa.array(length)], schema=schema)


class _Shard:
    """The two files of a shard as they are written."""

    def __init__(self, folder: str, part: int, roll: int, schema: pa.Schema, seq_len: int):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        self.name, self.part, self.roll, self.schema, self.seq_len = f"part-{part:06d}-{roll:04d}-{uuid.uuid4().hex[:12]}", part, roll, schema, seq_len
        self.files = [fs.open_output_stream(f"{base}/{self.name}.{kind}.arrow") for kind in ("tokens", "docs")]
        self.tokens, self.index = (pa.ipc.new_stream(f, s) for f, s in zip(self.files, (schema, DOCS)))
        self.rest: list[np.ndarray] = []
        self.held = self.n_tokens = self.n_docs = 0
        self.first = self.last = None

    def add(self, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.index.write(pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(ends[:-1] + self.n_tokens), pa.array(np.diff(ends))], schema=DOCS))
        known = [x for x in doc_ids.to_pylist() if x is not None]
        if known:
            self.first, self.last = self.first if self.first is not None else known[0], known[-1]
        self.n_tokens, self.n_docs, self.held = self.n_tokens + len(ids), self.n_docs + len(doc_ids), self.held + len(ids)
        self.rest.append(ids)
        whole = BATCH_SEQUENCES * self.seq_len
        if self.held >= whole:
            flat = np.concatenate(self.rest)
            for k in range(0, len(flat) - whole + 1, whole):
                self.tokens.write(_sequences(flat[k : k + whole], self.seq_len, self.schema))
            self.rest = [flat[len(flat) // whole * whole :].copy()]
            self.held = len(self.rest[0])

    def close(self) -> pa.RecordBatch:
        if self.held:
            self.tokens.write(_sequences(np.concatenate(self.rest), self.seq_len, self.schema))
        for x in (self.tokens, self.index, *self.files):
            x.close()
        row = [self.name, self.part, self.roll, self.n_docs, self.n_tokens, self.first, self.last]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, MANIFEST_ROWS)], schema=MANIFEST_ROWS)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, seq_len: int = SEQ_LEN, shards: int | None = None, roll_bytes: int = ROLL_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all documents below `folder` (a URI that executors share) and return the manifest, itself kept there as Parquet.

    Rows are dealt by ranges of doc_id and sorted within a range; a range is cut at a doc_id, so rows that repeat an id
    share a range, in any order among themselves. A task starts a new shard at the first document behind roll_bytes of ids. A null or empty text is its end id alone. A null doc_id sorts first. An empty table gives an empty manifest.
    A task writes to names of its own attempt, which the manifest then lists, so a task that runs twice after a lost
    executor leaves at worst files that no manifest row names.
    """
    spark = docs.sparkSession
    n = shards or n_parts(spark)

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        schema, part = _schema(encoder.dtype, seq_len), TaskContext.get().partitionId()
        most, shard, roll = roll_bytes // encoder.dtype.itemsize, None, 0
        for b in chunks(batches):
            if not b.num_rows:
                continue
            ids, ends = encoder.encode(b.column(1))
            ids = np.insert(ids, ends[1:], end_id).astype(encoder.dtype, copy=False)
            ends, a = ends + np.arange(len(ends)), 0
            while a < b.num_rows:
                shard = shard or _Shard(folder, part, roll, schema, seq_len)
                z = max(a + 1, int(np.searchsorted(ends, ends[a] + most - shard.n_tokens, side="left")))
                z = min(z, b.num_rows)
                shard.add(b.column(0).slice(a, z - a), ids[ends[a] : ends[z]], ends[a : z + 1] - ends[a])
                a = z
                if shard.n_tokens >= most:
                    yield shard.close()
                    shard, roll = None, roll + 1
        if shard:
            yield shard.close()

    rows = select_text(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files that the manifest of `folder` names.

    start counts the ids of all documents in shards and places before it. A task opens a shard's files by their path and
    holds one batch at a time, beside the shard's index.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row for each file of ROLL_BYTES
    shards = sorted((r.part, r.roll, r.shard, r.n_tokens) for r in manifest.select("part", "roll", "shard", "n_tokens").toLocalIterator())
    rows, at = [], 0
    for *_, shard, n in shards:
        rows.append((shard, at))
        at += n
    names = spark.createDataFrame(rows, "shard string, base long")

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            for shard, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(f"{base}/{shard}.docs.arrow") as f:
                    index = pa.ipc.open_stream(f).read_all().combine_chunks()
                starts, counts = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                with fs.open_input_stream(f"{base}/{shard}.tokens.arrow") as f:
                    crc = _checksums(pa.ipc.open_stream(f), starts, counts)
                doc_ids = index.column("doc_id").combine_chunks()
                for k in range(0, len(starts), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(k, 1 << 16), pa.array(starts[part] + before), pa.array(counts[part]), pa.array(crc[part], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = names.repartition(max(1, min(len(rows), n_parts(spark))), "shard") if rows else names
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _checksums(batches: Iterable[pa.RecordBatch], starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The crc32 of each document's ids, which follow each other in the batches."""
    crc, ends, at, d = np.zeros(len(starts), np.int64), starts + counts, 0, 0
    for batch in batches:
        ids = batch.column("ids").flatten().to_numpy(zero_copy_only=True)[: pc.sum(batch.column("length")).as_py()].astype("<u4")
        z = at + len(ids)
        while d < len(starts) and starts[d] < z:
            crc[d] = zlib.crc32(ids[max(0, starts[d] - at) : ends[d] - at], int(crc[d]))
            if ends[d] > z:
                break
            d += 1
        at = z
    if d < len(starts) or at != int(counts.sum()):
        raise ValueError(f"the sequences have {at} ids, the documents have {int(counts.sum())}")
    return crc


class TokenFile:
    """Random access to the sequences of a tokens file, mapped into memory: ids and masks are views, nothing is copied."""

    def __init__(self, source: os.PathLike | str | pa.Buffer):
        self.file = pa.BufferReader(source) if isinstance(source, pa.Buffer) else pa.memory_map(str(source))
        self.schema = pa.ipc.read_schema(self.file)
        self.head, self.seq_len = self.file.tell(), self.schema.field("ids").type.list_size
        self.masks = np.repeat(np.array([True, False]), self.seq_len)
        self.batch_bytes = 0
        if first := self._read(0):
            self.batch_bytes, self.per_batch = self.file.tell() - self.head, first.num_rows

    def _read(self, k: int) -> pa.RecordBatch | None:
        at = self.head + k * self.batch_bytes
        if at + 8 >= self.file.size():
            return None  # the end of the stream
        self.file.seek(at)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)

    def __len__(self) -> int:
        if not self.batch_bytes:
            return 0
        whole, rest = divmod(self.file.size() - 8 - self.head, self.batch_bytes)
        return whole * self.per_batch + (self._read(whole).num_rows if rest else 0)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of the k-th sequence."""
        batch = self._read(k // self.per_batch) if self.batch_bytes and k >= 0 else None
        place = k % self.per_batch if batch is not None else 0
        if batch is None or place >= batch.num_rows:
            raise IndexError(k)
        ids = batch.column("ids").flatten()[place * self.seq_len : (place + 1) * self.seq_len].to_numpy(zero_copy_only=True)
        pad = self.seq_len - batch.column("length")[place].as_py()
        return ids, self.masks[pad : pad + self.seq_len]
