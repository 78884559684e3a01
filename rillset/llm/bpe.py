"""BPE by a distinct-word table: each distinct word is encoded once, ids come back by position, pieces by id.

Documents move once, as compressed blocks. A block sends its distinct words, cut by a hash of the word, to the slices of
the word table; a slice merges the words of all blocks, encodes each once and replies to each block with the ids of the
words it sent. The block puts the ids back by position and decodes by an id-to-piece look-up. So what moves for words
grows with distinct words per block, not with occurrences, and a word that fills a third of a corpus is one entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rillset.llm.blocks import ask_and_answer, block_count, mix64, to_blocks
from rillset.llm.common import select_text
from rillset.llm.tokens import WordEncoder, split_words, spread

#: Words decoded at a time.
PART_WORDS = 1 << 19


def _hash_words(words: pa.Array) -> np.ndarray:
    """A hash of each word's first and last bytes and length, to deal words to slices; equal words agree."""
    words = words.cast(pa.large_binary())
    lengths = pc.binary_length(words).fill_null(0).to_numpy().astype(np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    h = lengths.astype(np.uint64)
    for k in range(8):
        if not len(data):
            break
        for at in (offsets[:-1] + k, offsets[1:] - 1 - k):
            ok = lengths > k
            byte = np.where(ok, data[np.where(ok, at, 0)], 0).astype(np.uint64)
            with np.errstate(over="ignore"):
                h = h * np.uint64(1_099_511_628_211) + byte
    return mix64(h)


def _sliced(words: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(slice, positions) of distinct words, in an order that the words alone decide.

    A block's documents come in another order when it is read again, and its words with them: asked and answered positions
    agree as they are sorted by hash, words of one hash by their bytes.
    """
    h = _hash_words(words)
    k = (h % np.uint64(n)).astype(np.int64)
    order = np.lexsort((h, k))
    again = np.concatenate([[False], h[order][1:] == h[order][:-1], [False]])
    for a, z in zip(np.flatnonzero(~again[:-1] & again[1:]).tolist(), (np.flatnonzero(again[:-1] & ~again[1:]) + 1).tolist()):
        some = order[a:z]
        texts = words.take(pa.array(some)).to_pylist()
        order[a:z] = some[sorted(range(z - a), key=texts.__getitem__)]
    bounds = np.searchsorted(k[order], np.arange(n + 1))
    for i in range(n):
        if bounds[i + 1] > bounds[i]:
            yield i, order[bounds[i] : bounds[i + 1]]


def _zip(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def _unzip(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, n: int | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256 (and ids, decoded).

    A null text counts as empty: no ids, an empty decoded text. Rows that repeat an id are encoded each. An empty table
    gives no rows. The decoded text is the tokenizer's decode with special tokens kept: pieces joined by single spaces, or
    what the file's decoder makes of them. A tokenizer that joins text across white space has no table of words: ValueError.
    """
    if not WordEncoder.of(tokenizer).apart:
        raise ValueError(f"{tokenizer} joins text across white space, so its texts cannot be encoded word by word")
    rows = select_text(docs, id_col, text_col)
    n = n or block_count(rows)

    def ask(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        words = split_words(table.column("text").combine_chunks())[0].dictionary_encode().dictionary
        for k, at in _sliced(words, n):
            yield k, _zip("\n".join(words.take(pa.array(at)).to_pylist()).encode())

    def answer(asked: list[bytes]) -> list[bytes]:
        encoder = WordEncoder.of(tokenizer)
        lists = [_unzip(x).decode().split("\n") for x in asked]
        coded = pa.array([w for x in lists for w in x], pa.large_string()).dictionary_encode()
        ids, lengths = encoder.encode_words(coded.dictionary)
        starts = np.cumsum(lengths) - lengths
        index, at, out = coded.indices.to_numpy(), 0, []
        for x in lists:
            got, ends = spread(ids, starts, lengths, index[at : at + len(x)], np.arange(len(x) + 1))
            out.append(_zip(np.diff(ends).astype("<u4").tobytes() + got.tobytes()))
            at += len(x)
        return out

    def finish(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        encoder = WordEncoder.of(tokenizer)
        words, ends = split_words(table.column("text").combine_chunks())
        coded = words.dictionary_encode()
        m = len(coded.dictionary)
        starts, lengths, held, at_id = np.zeros(m, np.int64), np.zeros(m, np.int64), [], 0
        for k, at in _sliced(coded.dictionary, n):
            raw = _unzip(replies[k])
            counts = np.frombuffer(raw, "<u4", len(at)).astype(np.int64)
            lengths[at], starts[at] = counts, at_id + np.cumsum(counts) - counts
            held.append(np.frombuffer(raw, encoder.dtype, offset=4 * len(at)))
            at_id += len(held[-1])
        ids = np.concatenate(held) if held else np.zeros(0, encoder.dtype)
        pieces = _pieces(encoder)
        index = coded.indices.to_numpy()
        columns = {"doc_id": table.column("doc_id").combine_chunks()}
        n_tokens, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
        a = 0
        while a < len(ends) - 1:
            # some documents at a time, a very long one alone
            z = max(a + 1, min(a + 512, int(np.searchsorted(ends, ends[a] + PART_WORDS))))
            part, a = ends[a : z + 1], z
            got, cut = spread(ids, starts, lengths, index[part[0] : part[-1]], part - part[0])
            wide = got.astype("<u4")
            if encoder.joins_pieces:
                decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pieces.take(pa.array(got.astype(np.int64)))), " ")
            else:
                decoded = pa.array([encoder.tokenizer.decode(wide[x:y].tolist(), skip_special_tokens=False) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.string())
            n_tokens += np.diff(cut).tolist()
            ids_sha += [hashlib.sha256(wide[x:y]).hexdigest() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
            text_sha += [hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded]
            if with_ids:
                all_ids += [wide[x:y].tolist() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
                texts += decoded.to_pylist()
        columns |= {"n_tokens": pa.array(n_tokens, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
        if with_ids:
            columns |= {"ids": pa.array(all_ids, pa.list_(pa.int64())), "decoded": pa.array(texts, pa.string())}
        return pa.table(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>, decoded string" if with_ids else "")
    return ask_and_answer(to_blocks(rows, n), n, ask, answer, finish, schema)


def _pieces(encoder: WordEncoder) -> pa.Array:
    """The piece of each id."""
    if not hasattr(encoder, "pieces"):
        size = max(encoder.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        encoder.pieces = pa.array([encoder.tokenizer.id_to_token(i) or "" for i in range(size)], pa.string())
    return encoder.pieces
