"""Word shingles of whole texts as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from rillset.llm.blocks import mix64

WORDS = 5
CHUNK_BYTES = 4 << 20
_RNG = np.random.default_rng(5_0_8_0)
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(0, 1 << 63)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words by their bytes, wherever they stand: polynomials over random byte values."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
        h = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
        return mix64(h + (ends - starts).astype(np.uint64))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(all distinct shingles in a row, ascending within a text; the offsets of each text).

    Only A-Z are lower-cased; words are runs of bytes other than space, tab, newline, vertical tab, form feed and carriage
    return. A text of fewer words than a shingle has its whole sequence as one; a text without words has none.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    found, sizes, a = [], [], 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, side="right")) - 1)
        tokens, counts = _sets_of(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], words)
        found.append(tokens)
        sizes.append(counts)
        a = z
    counts = np.concatenate([np.zeros(1, np.int64), *sizes])
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.cumsum(counts)


def _sets_of(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    n_docs = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    data, space = _LOWER[raw], _SPACE[raw]
    first = np.zeros(len(data) + 1, bool)  # a text's first byte starts a word, whatever stands before it
    first[offsets[:-1]] = True
    first = first[:-1]
    begins = np.flatnonzero(~space & (first | np.concatenate([[True], space[:-1]])))
    last = np.concatenate([first[1:], [True]])
    ends = np.flatnonzero(~space & (last | np.concatenate([space[1:], [True]]))) + 1
    h = _word_hashes(data, begins, ends)
    doc = np.searchsorted(offsets, begins, side="right") - 1
    count = np.bincount(doc, minlength=n_docs)
    at = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        m = len(h) - words + 1
        if m > 0:
            s = sum(h[k : k + m] * _PLACES[k] for k in range(words))
            whole = doc[:m] == doc[words - 1 :]
            tokens, owner = mix64(s[whole]), doc[:m][whole]
        else:
            tokens, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):
            one = np.array([(h[at[d] : at[d + 1]] * _PLACES[: count[d]]).sum(dtype=np.uint64) for d in short])
            tokens = np.concatenate([tokens, mix64(one + _PLACES[words + count[short]])])
            owner = np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            tokens, owner = tokens[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n_docs + 1))
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        tokens[a:z].sort()
    keep = np.ones(len(tokens), bool)
    keep[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[keep], np.bincount(owner[keep], minlength=n_docs)
