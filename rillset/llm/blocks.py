"""Documents in blocks: rows move once, as compressed Arrow batches, and every later step works on a whole block.

A block is all documents with one hash of their id. Steps that have to look something up for every word or shingle
(a dictionary entry, a document frequency) ask for each distinct key of a block once instead of once per occurrence.

The number of blocks follows from the bytes of the input: a block is what one task holds. Blocks grow with the root of the
input, so that the message of a block to a slice of the keys, of which there are blocks times slices, stays at
MESSAGE_BYTES or more: 100 TB are 300,000 blocks of 300 MB.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillset.llm.common import n_parts, tidied, tidied_group

FLUSH_BYTES = 24 << 20
BLOCK_BYTES = 64 << 20
MESSAGE_BYTES = 1 << 10
#: Bytes of text that a byte of a compressed file is taken to hold.
UNPACKED = 3
#: Spark's size of what it doesn't know the size of is larger.
UNKNOWN = 1 << 60
#: Up to so many blocks each gets a shuffle partition of its own.
MOST_EVEN = 10_000


def block_count(docs: DataFrame) -> int:
    """How many blocks (doc_id, text) rows make, by the bytes of the files below them, or of the texts where these aren't known.

    There is one for each shuffle partition at least.
    """
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    if max(sizes) < UNKNOWN:
        total = UNPACKED * sum(sizes)
    else:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(n_parts(docs.sparkSession), -(-total // max(BLOCK_BYTES, math.isqrt(total * MESSAGE_BYTES))))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (multiply and xor-shift)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(batch: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write(batch)
    return sink.getvalue().to_pybytes()


def unpack(blobs: Iterable[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])


def even_labels(n: int) -> list[int]:
    """n integers that Spark's hash partitioning deals to n partitions, one each (Murmur3 of an int, seed 42, modulo n).

    Beyond MOST_EVEN chance deals them evenly enough.
    """
    if n > MOST_EVEN:
        return list(range(n))

    def murmur(x: int) -> int:
        mask = 0xFFFFFFFF
        k = x * 0xCC9E2D51 & mask
        k = ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask
        h = 42 ^ k
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
        h ^= 4
        h = (h ^ h >> 16) * 0x85EBCA6B & mask
        h = (h ^ h >> 13) * 0xC2B2AE35 & mask
        h ^= h >> 16
        return h - (1 << 32) if h >> 31 else h

    found: dict[int, int] = {}
    x = 0
    while len(found) < n:
        found.setdefault(murmur(x) % n, x)
        x += 1
    return [found[k] for k in range(n)]


def to_blocks(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text) rows as (block, blob), dealt by block; every block that has documents has at least one blob."""

    labels = np.array(even_labels(n))

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            ids = table.column(0).fill_null(0).to_numpy().astype(np.int64)
            block = (mix64(ids.view(np.uint64)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0]))
            for a, b in zip(starts, [*starts[1:], len(order)]):
                part = table.take(pa.array(order[a:b])).combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([int(labels[block[order[a]]])], pa.int32()), pa.array([pack(part)], pa.binary())], ["block", "blob"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= FLUSH_BYTES:
                yield from flush()
                held, size = [], 0
        if held and sum(b.num_rows for b in held):
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, "block int, blob binary")


def ask_and_answer(blocks: DataFrame, n: int, ask: Callable, answer: Callable, finish: Callable, schema: str) -> DataFrame:
    """A keyed look-up for whole blocks, with two small shuffles of keys instead of one of all occurrences.

    n is the number of blocks and of slices. ask(table of documents) gives (slice, bytes) pairs: a block's distinct keys, cut by a hash of the key.
    answer(list of bytes) gets what all blocks ask of one slice and returns a reply for each, in order.
    finish(table of documents, {slice: reply}) gives the block's result as an Arrow table of the schema.
    """

    labels = even_labels(n)
    slice_of = {label: k for k, label in enumerate(labels)}

    def ask_block(table: pa.Table) -> pa.Table:
        block, asked = table.column("block")[0].as_py(), list(ask(unpack(table.column("blob").to_pylist())))
        return pa.table({"slice": pa.array([labels[k] for k, _ in asked], pa.int32()), "block": pa.array([block] * len(asked), pa.int32()), "keys": pa.array([b for _, b in asked], pa.binary())})

    def answer_slice(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        return pa.table({"block": table.column("block"), "slice": table.column("slice"), "reply": pa.array(answer(table.column("keys").to_pylist()), pa.binary())})

    def finish_block(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = {slice_of[k]: reply for k, reply in zip(right.column("slice").to_pylist(), right.column("reply").to_pylist())}
        return finish(unpack(left.column("blob").to_pylist()), replies)

    asked = blocks.groupBy("block").applyInArrow(tidied_group(ask_block), "slice int, block int, keys binary")
    replies = asked.groupBy("slice").applyInArrow(tidied_group(answer_slice), "block int, slice int, reply binary")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(tidied_group(finish_block), schema)
