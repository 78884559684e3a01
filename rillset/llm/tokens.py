"""Encoding whole texts with a tokenizer file, by distinct word where the file allows it.

A tokenizer that never joins text across white space (white space is dropped before the model, the normalizer looks at no
neighbours, no added token holds white space; see words_apart) gives a text the ids of its white-space separated words, one
after the other. So a batch's distinct words are encoded, each once, and the ids come back by position. Splitting at ASCII
white space alone is enough: other white space stays inside a "word". Texts of any other tokenizer go through the
tokenizers library whole.

Words of plain characters (ASCII but for the apostrophe, and the letters of Latin-1) take a fast path: they are cut into
runs of letters, single digits and runs of other signs, and the merges of the tokenizer's file are applied to all of a
batch's runs at once, with NumPy. Every other word goes through the tokenizers library. The fast path is taken only for
a tokenizer file of exactly the parts it stands for (see _plain_parts), and tests hold both against the library.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text that is encoded at a time.
CHUNK_BYTES = 4 << 20
#: Runs of more bytes go through the library.
LONGEST_RUN = 32
NO_MERGE = np.int32(1 << 30)

#: Fixed value: the pre-tokenizer's pattern that the fast path stands for.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_B = np.arange(256)
_LETTER = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122))
_DIGIT = (_B >= 48) & (_B <= 57)
_SIGN = (_B > 32) & (_B < 127) & ~_LETTER & ~_DIGIT & (_B != ord("'"))
_KIND = np.select([_LETTER, _DIGIT, _SIGN], [1, 2, 3], 0).astype(np.uint8)
_LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)


def _byte_letters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in kept)}
    return [chr(b) if b not in rest else rest[b] for b in range(256)]


def _plain_parts(spec: dict) -> bool:
    """Whether the file has the parts that the fast path stands for."""
    norm, pre, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    kinds = [(x.get("type"), x.get("pattern"), x.get("content")) for x in norm.get("normalizers", [])]
    cuts = pre.get("pretokenizers", [])
    return (
        kinds == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
        and [x.get("type") for x in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": PATTERN}
        and cuts[0]["behavior"] == "Removed"
        and cuts[0]["invert"]
        and not cuts[1]["add_prefix_space"]
        and not cuts[1]["use_regex"]
        and (model["type"], model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix")) == ("BPE", None, None, None)
        and model.get("end_of_word_suffix") == "</w>"
        and not model.get("ignore_merges")
        and len(model["vocab"]) <= 1 << 16
        and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))
    )


#: Normalizers that change each word alone, and pre-tokenizers that drop white space before the model.
LOCAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer"}
DROPPING = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}


def words_apart(spec: dict) -> bool:
    """Whether a text's ids are those of its white-space separated words; False also where that is not known of a file's parts."""
    if _plain_parts(spec):
        return True
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", []) if norm.get("type") == "Sequence" else [norm] if norm else []
    first = (pre.get("pretokenizers") or [{}])[0] if pre.get("type") == "Sequence" else pre
    apart = not any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"])
    return apart and all(x.get("type") in LOCAL for x in steps) and first.get("type") in DROPPING


class Merger:
    """The merges of a BPE vocabulary of at most 2**16 pieces, applied to many runs of bytes at once."""

    def __init__(self, model: dict):
        vocab, letters = model["vocab"], _byte_letters()
        self.first = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.last = np.array([vocab.get(c + "</w>", -1) for c in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        a, b = (np.array([vocab[p[k]] for p in pairs], np.uint32) for k in (0, 1))
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32)
        keys, at = np.unique((a << np.uint32(16)) | b, return_index=True)
        # open addressing, laid out once; a pair's rank is its first place in the list
        self.bits = max(4, int(len(keys) * 6).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, np.uint32(0xFFFFFFFF)), np.full(1 << self.bits, NO_MERGE, np.int32)
        self.probes, left, where, step = 0, keys, at.astype(np.int32), 0
        slot = self._slot(left)
        while len(left):
            free = self.ranks[slot] == NO_MERGE
            won = np.zeros(len(left), bool)
            won[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            won &= free
            self.keys[slot[won]], self.ranks[slot[won]] = left[won], where[won]
            left, where, slot, step = left[~won], where[~won], (slot[~won] + 1) & ((1 << self.bits) - 1), step + 1
        self.probes = step

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_MERGE where it has none."""
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], NO_MERGE)
        rest = np.flatnonzero((out == NO_MERGE) & (self.keys[slot] != np.uint32(0xFFFFFFFF)))
        for _ in range(1, self.probes):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.ranks[slot[rest[hit]]]
            rest = rest[~hit & (found != np.uint32(0xFFFFFFFF))]
        return out

    def merge(self, data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids as (runs, length), ids of each run) for runs of `length` bytes of data each."""
        n = len(starts)
        ids = np.empty((length, n), np.int32)
        for j in range(length):
            ids[j] = (self.last if j == length - 1 else self.first)[data[starts + j]]
        out, size, rows = ids.copy(), np.full(n, length), np.arange(n)
        # a pair's key is rank * 64 + place, so that a minimum finds the lowest rank and of equal ones the leftmost
        key = np.full((max(1, length - 1), n), NO_MERGE, np.int32)
        for j in range(length - 1):
            r = self.rank(ids[j], ids[j + 1])
            key[j] = np.where(r < NO_MERGE, (r << 6) | j, NO_MERGE)
        for left in range(length - 1, 0, -1):
            best = key[:left].min(0)
            on = best < NO_MERGE
            if not on.all():
                done = rows[~on]
                out[: left + 1, done], size[done] = ids[: left + 1, ~on], left + 1
                if not on.any():
                    break
                ids, key, best, rows = ids[: left + 1, on], key[:left, on], best[on], rows[on]
            place, every = best & 63, np.arange(len(rows))
            ids[place, every] = self.made[best >> 6]
            for j in range(1, left):
                after = place < j
                ids[j] = np.where(after, ids[j + 1], ids[j])
            for j in range(1, left - 1):
                # pairs behind the merged one move down a place
                key[j] = np.where((place < j) & (key[j + 1] < NO_MERGE), key[j + 1] - 1, np.where(place < j, NO_MERGE, key[j]))
            if left == 1:
                out[0, rows], size[rows] = ids[0], 1
                break
            key[left - 1] = NO_MERGE
            before = place > 0
            p = place[before]
            r = self.rank(ids[p - 1, every[before]], ids[p, every[before]])
            key[p - 1, every[before]] = np.where(r < NO_MERGE, (r << 6) | (p - 1), NO_MERGE)
            behind = place < left - 1
            p = place[behind]
            r = self.rank(ids[p, every[behind]], ids[p + 1, every[behind]])
            key[p, every[behind]] = np.where(r < NO_MERGE, (r << 6) | p, NO_MERGE)
            key[place[~behind], every[~behind]] = NO_MERGE
        if length == 1:
            size[:] = 1
        return out, size


class WordEncoder:
    """The ids of words and texts, by distinct word."""

    _loaded: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = Merger(spec["model"]) if _plain_parts(spec) else None
        self.apart, self.joins_pieces = words_apart(spec), spec.get("decoder") is None

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and how many each has."""
        words = words.cast(pa.large_string())
        if self.merger is None or not len(words):
            plain, coded = np.zeros(len(words), bool), None
        else:
            plain, coded = self._plain(words)
        other = np.flatnonzero(~plain)
        counts = np.zeros(len(words), np.int64)
        slow = [np.array(e.ids, self.dtype) for k in range(0, len(other), 4096) for e in self.tokenizer.encode_batch_fast(words.take(pa.array(other[k : k + 4096])).to_pylist(), add_special_tokens=False)]
        counts[other] = [len(x) for x in slow]
        if coded is None:
            return np.concatenate([*slow, np.zeros(0, self.dtype)]).astype(self.dtype), counts
        owner, size, ids = coded
        np.add.at(counts, owner, size)
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), self.dtype)
        mask = np.repeat(plain, counts)
        out[mask] = ids
        if len(slow):
            out[~mask] = np.concatenate(slow)
        return out, counts

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, tuple]:
        """Which words the fast path takes; the word of each of their runs, the ids of each run, and all ids in a row."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n = len(data)
        kind = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if n > 1 else np.zeros(0, np.int64)
        low = data[lead + 1]
        lead = lead[(low >= 0x80) & (low <= 0xBF) & (low != 0x97) & (low != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        small = _LOWER[data]
        capital = lead[(data[lead + 1] <= 0x9E)]
        small[capital + 1] += 0x20
        angle = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if n > 1 else []
        kind[angle] = 0  # may begin an added token
        fresh = np.empty(n, bool)
        fresh[:1] = True
        fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begins = offsets[:-1][np.diff(offsets) > 0]
        fresh[begins] = True
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, n))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        bad = np.zeros(len(words), bool)
        sums = np.concatenate([[0], np.cumsum(kind == 0)])
        bad |= sums[offsets[1:]] > sums[offsets[:-1]]
        bad[owner[sizes > LONGEST_RUN]] = True
        take = ~bad[owner]
        starts, sizes, owner = starts[take], sizes[take], owner[take]
        counts = np.zeros(len(starts), np.int64)
        parts = []
        for length in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == length)
            for k in range(0, len(at), 1 << 15):
                part = at[k : k + (1 << 15)]
                ids, size = self.merger.merge(small, starts[part], length)
                counts[part] = size
                parts.append((part, ids, size))
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, self.dtype)
        for part, ids, size in parts:
            first = ends[part] - size
            for j in range(int(size.max())):
                some = size > j
                flat[first[some] + j] = ids[j, some]
        return ~bad, (owner, counts, flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the offsets of each text in it."""
        if not self.apart:
            whole = [e.ids for k in range(0, len(texts), 256) for e in self.tokenizer.encode_batch_fast(texts.slice(k, 256).to_pylist(), add_special_tokens=False)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in whole], dtype=np.int64)]).astype(np.int64)
            return np.concatenate([*(np.array(x, self.dtype) for x in whole), np.zeros(0, self.dtype)]), ends
        words, ends = split_words(texts)
        coded = words.dictionary_encode()
        ids, counts = self.encode_words(coded.dictionary)
        return spread(ids, np.cumsum(counts) - counts, counts, coded.indices.to_numpy(), ends)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and the offsets of each text in it. Words may be empty (at white space at an end)."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), offsets - offsets[0]


def spread(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, index: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put the ids of words back by position: index has a word number for each position, ends the positions of texts."""
    n = lengths[index]
    before = np.concatenate([[0], np.cumsum(n)])
    take = np.arange(before[-1]) + np.repeat(starts[index] - before[:-1], n)
    return ids[take], before[ends]


def chunks(batches, most: int = CHUNK_BYTES):
    """The batches in pieces of about `most` bytes, so that one step's arrays stay small whatever the batch size is."""
    for b in batches:
        per = max(1, b.nbytes // max(1, b.num_rows))
        step = max(1, most // per)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
