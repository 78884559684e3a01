"""Packing by power-of-two decomposition: binary-length pieces, equal lengths in one bucket, no sequence across documents.

A document of n ids is cut into floor(n / max_len) pieces of max_len and one piece for each set bit of the rest, longest
first. Every piece is a sequence of its own, of a power-of-two length, so nothing is padded; sequences of one length form
a bucket and train together. The cut needs the document alone: no shuffle, no state between documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rillset.llm.common import select_text, tidied
from rillset.llm.tokens import WordEncoder, chunks

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(n: int, max_len: int = 2048) -> list[int]:
    """The piece lengths of a document of n ids: whole max_len pieces, then the binary digits of the rest."""
    whole, rest = divmod(n, max_len)
    return [max_len] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_documents(
    docs: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if with_ids).

    sequence_id holds the bucket (log2 of the length) in its high bits, then the partition and a counter, so ordering by
    it lays out bucket after bucket. A null or empty text is its end id alone: one piece of length 1. Repeated rows are
    packed each. An empty table gives no rows. max_len is a power of two up to 2**15.
    """
    if max_len < 1 or max_len & (max_len - 1) or max_len > 1 << 15:
        raise ValueError("max_len must be a power of two up to 32768")

    @tidied
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, counter = WordEncoder.of(tokenizer), TaskContext.get().partitionId(), 0
        for b in chunks(batches):
            ids, ends = encoder.encode(b.column(1))
            doc, start, length, crc, total, held = [], [], [], [], [], []
            for d, (a, z) in zip(b.column(0).to_pylist(), zip(ends[:-1].tolist(), ends[1:].tolist())):
                own = np.append(ids[a:z], end_id).astype("<u4")
                raw, at = memoryview(own).cast("B"), 0
                for n in cut(len(own), max_len):
                    doc.append(d)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    total.append(len(own))
                    if with_ids:
                        held.append(own[at : at + n])
                    at += n
            lengths = np.array(length, np.int64)
            buckets = np.log2(np.maximum(lengths, 1)).astype(np.int64)
            sequence = (buckets << 59) | (np.int64(part) << 37) | np.arange(counter, counter + len(lengths), dtype=np.int64)
            counter += len(lengths)
            columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(sequence), pa.array(np.zeros(len(lengths), np.int64))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([x.tolist() for x in held], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return select_text(docs, id_col, text_col).mapInArrow(run, SCHEMA + (", ids array<bigint>" if with_ids else ""))
