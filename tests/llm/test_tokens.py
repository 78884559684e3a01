"""Encoding, decoding, packing and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD_TEXTS, TOKENIZER, docs, empty, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillset.llm import bpe, packing, token_files
from rillset.llm.blocks import even_labels
from rillset.llm.common import scratch_path
from rillset.llm.tokens import WordEncoder

LIB = Tokenizer.from_file(TOKENIZER)
TEXTS = [*ODD_TEXTS, *(prose(random.Random(k), 40 + 300 * (k % 5)) for k in range(12))]


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0x17F), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_fast_path_is_the_library(texts):
    ids, ends = WordEncoder.of(TOKENIZER).encode(pa.array(texts, pa.string()))
    assert [ids[a:z].tolist() for a, z in zip(ends[:-1], ends[1:])] == [ids_of(t) for t in texts]


def test_encode_and_decode(spark):
    out = {r.doc_id: r for r in bpe.encode_documents(docs(spark, TEXTS), TOKENIZER, with_ids=True).collect()}
    for i, text in enumerate(TEXTS):
        ids = ids_of(text)
        decoded = LIB.decode(ids, skip_special_tokens=False)
        assert list(out[i].ids) == ids and out[i].decoded == decoded and out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(raw(ids)).hexdigest() and out[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_documents(empty(spark), TOKENIZER).count() == 0


def test_labels_are_dealt_evenly(spark):
    got = spark.createDataFrame([(x,) for x in even_labels(37)], "x int").select(F.pmod(F.hash("x"), F.lit(37))).collect()
    assert [r[0] for r in got] == list(range(37))


def test_packing(spark):
    assert packing.cut(2048 * 2 + 5) == [2048, 2048, 4, 1]
    rows = packing.pack_documents(docs(spark, TEXTS), TOKENIZER, with_ids=True).collect()
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.start):
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(TEXTS):
        ids = [*ids_of(text), 1]
        assert [x for r in by_doc[i] for x in r.ids] == ids
        assert all(r.doc_tokens == len(ids) and r.offset == 0 and r.length in {1 << k for k in range(12)} and r.ids_crc32 == zlib.crc32(raw(r.ids)) for r in by_doc[i])
    assert len({r.sequence_id for r in rows}) == len(rows)
    in_order = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert in_order == sorted(in_order)  # equal lengths stand together
    assert packing.pack_documents(empty(spark), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(empty(spark), TOKENIZER, max_len=100)


def test_token_files(spark):
    folder = scratch_path(spark, "test-tokens")
    manifest = token_files.write_token_files(docs(spark, [*TEXTS, None], 5), folder, TOKENIZER, seq_len=64)
    out = {r.doc_id: r for r in token_files.read_token_files(spark, folder).collect()}
    at = 0
    for i, text in enumerate([*TEXTS, None]):
        ids = [*ids_of(text), 2]
        assert (out[5 + i].start, out[5 + i].n_tokens, out[5 + i].ids_crc32) == (at, len(ids), zlib.crc32(raw(ids)))
        at += len(ids)
    shard = manifest.orderBy(F.desc("n_tokens")).first()
    file = token_files.TokenFile(f"{folder.removeprefix('file://')}/{shard.shard}.tokens.arrow")
    sequences = [file.sequence(k) for k in range(len(file))]
    assert len(file) == -(-shard.n_tokens // 64) and all(x.dtype == np.uint16 and not x.flags.owndata and not m.flags.owndata and len(x) == len(m) == 64 for x, m in sequences)
    assert sum(int(m.sum()) for _, m in sequences) == shard.n_tokens
    for k in (-1, len(file), 10**6):
        with pytest.raises(IndexError):
            file.sequence(k)
    nothing = scratch_path(spark, "test-tokens")
    assert token_files.write_token_files(empty(spark), nothing, TOKENIZER).count() == 0
    assert token_files.read_token_files(spark, nothing).count() == 0


def test_batches_of_several_chunks_are_taken_whole(spark, monkeypatch):
    from rillset.llm import tokens

    rng, folder = random.Random(5), scratch_path(spark, "test-tokens")
    texts = [prose(rng, 40) for _ in range(200)]
    whole = tokens.chunks
    for module in (token_files, packing):
        monkeypatch.setattr(module, "chunks", lambda batches: whole(batches, 2_000))
    token_files.write_token_files(docs(spark, texts).coalesce(1), folder, TOKENIZER, shards=1)
    out = {r.doc_id: r.ids_crc32 for r in token_files.read_token_files(spark, folder).collect()}
    assert out == {i: zlib.crc32(raw([*ids_of(t), 2])) for i, t in enumerate(texts)}
    pieces = packing.pack_documents(docs(spark, texts).coalesce(1), TOKENIZER).collect()
    assert {r.doc_id for r in pieces} == set(range(200)) and sum(r.length for r in pieces) == sum(len(ids_of(t)) + 1 for t in texts)


def test_token_files_roll_and_are_read_at_an_offset(spark, monkeypatch):
    """Shards end at a document once they are long enough; ids that repeat or are null keep their rows; very long texts."""
    rng, folder = random.Random(4), scratch_path(spark, "test-tokens")
    texts = [prose(rng, 20_000), *(prose(rng, rng.randint(0, 80)) for _ in range(300)), "", None]
    rows = [(i // 2 if i < 20 else i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, "no id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = token_files.write_token_files(df, folder, TOKENIZER, seq_len=16, shards=2, roll_bytes=6000)
    shards = manifest.orderBy("part", "roll").collect()
    assert len(shards) > 8 and max(r.roll for r in shards) > 2 and sum(r.n_docs for r in shards) == len(rows)
    out = token_files.read_token_files(spark, folder).collect()
    want = sorted((-1 if i is None else i, zlib.crc32(raw([*ids_of(t or ""), 2])), len(ids_of(t or "")) + 1) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.n_tokens) for r in out) == want
    ends = sorted((r.start, r.start + r.n_tokens) for r in out)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    big = next(r for r in shards if r.n_tokens > 20_000)
    file = token_files.TokenFile(f"{folder.removeprefix('file://')}/{big.shard}.tokens.arrow")
    monkeypatch.setattr(file, "_read", lambda k, whole=file._read: whole(k) if k == 3 else 1 / 0)
    own = sorted((r.start, r.doc_id) for r in out)
    ids, mask = file.sequence(3 * 256 + 5)  # one batch is opened, at its offset
    assert mask.all() and len(ids) == 16 and own
    at = sum(r.n_tokens for r in shards if (r.part, r.roll) < (big.part, big.roll))
    long = next(r for r in out if r.n_tokens > 20_000)
    place = (3 * 256 + 5) * 16 - (long.start - at)
    assert ids.tolist() == [*ids_of(texts[0]), 2][place : place + 16]


def test_tokenizers_that_join_words_are_taken_whole_or_refused(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, texts = Tokenizer.from_file(path), ["a  b c", " two words\n\nand lines", "", None, "x " * 50]
    assert not WordEncoder.of(path).apart and WordEncoder.of(TOKENIZER).apart
    ids, ends = WordEncoder.of(path).encode(pa.array([t or "" for t in texts]))
    assert [ids[a:z].tolist() for a, z in zip(ends[:-1], ends[1:])] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    folder = scratch_path(spark, "test-tokens")
    token_files.write_token_files(docs(spark, texts), folder, path)
    out = {r.doc_id: r.ids_crc32 for r in token_files.read_token_files(spark, folder).collect()}
    assert out == {i: zlib.crc32(raw([*lib.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        bpe.encode_documents(docs(spark, texts), path)


def test_blocks_follow_the_bytes(spark, monkeypatch):
    """More blocks than partitions give the same ids; the number grows with the files below the documents."""
    from rillset.llm import blocks, ngram_join

    rng = random.Random(12)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(60)] + [prose(rng, 20_000), "", None]
    df = docs(spark, texts).union(docs(spark, texts[:3])).select("doc_id", "text")
    folder = scratch_path(spark, "test-blocks")
    df.write.parquet(folder)
    df = spark.read.parquet(folder)
    assert blocks.block_count(df) == 4
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1)
    monkeypatch.setattr(blocks, "MESSAGE_BYTES", 16)
    n = blocks.block_count(df)
    assert n > 60
    out = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.encode_documents(df, TOKENIZER).collect())
    assert out == sorted((i, len(ids_of(t or "")), hashlib.sha256(raw(ids_of(t or ""))).hexdigest()) for i, t in [*enumerate(texts), *enumerate(texts[:3])])
    few, many = (sorted((r.doc_id, r.n_shingles, r.tokens) for r in ngram_join.shared_shingles(df, n=k).collect()) for k in (4, n))
    assert few == many


def test_blocks_that_are_read_again_in_another_order_give_the_same_ids(spark, monkeypatch):
    """Parts of a block come as the shuffle brings them, for the question and for the answer; words of one hash as well."""
    from rillset.llm import blocks

    rng = random.Random(21)
    alike = ["beginning" + "".join(rng.choice("abc") for _ in range(4)) + "theending" for _ in range(200)]
    texts = [prose(rng, 40) + " " + " ".join(rng.sample(alike, 20)) for _ in range(200)]
    whole = blocks.unpack

    def mixed(blobs):
        return whole(random.sample(list(blobs), len(blobs)))

    monkeypatch.setattr(blocks, "unpack", mixed)
    out = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.encode_documents(docs(spark, texts).repartition(20), TOKENIZER).collect()}
    assert out == {i: (len(ids_of(t)), hashlib.sha256(raw(ids_of(t))).hexdigest()) for i, t in enumerate(texts)}
