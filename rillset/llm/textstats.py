"""Whole-batch statistics of texts, with Arrow and NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rillset.llm.tokens import split_words

_BYTES = np.arange(256)
_UPPER, _LOWER = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT, _SPACE = (_BYTES >= 48) & (_BYTES <= 57), (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_STOP = np.isin(_BYTES, [ord(c) for c in ".,"])
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~_STOP
CLASSES = {"upper": _UPPER, "lower": _LOWER, "digit": _DIGIT, "space": _SPACE, "stop": _STOP, "symbol": _SYMBOL, "line": _BYTES == 10, "wide": _BYTES >= 192}


def byte_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Bytes of each class in each text, and all bytes as 'all'."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at, out = offsets - offsets[0], {"all": np.diff(offsets)}
    for name, members in CLASSES.items():
        sums = np.concatenate([[0], np.cumsum(members[data], dtype=np.int64)])
        out[name] = sums[at[1:]] - sums[at[:-1]]
    return out


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(document of each word, number of each word, distinct words); empty words are left out."""
    words, ends = split_words(texts)
    document = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    coded = words.filter(pa.array(full)).dictionary_encode()
    return document[full], coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def distinct_share(document: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and all codes of each document."""
    pair = document * (int(code.max()) + 1 if len(code) else 1) + code
    own = np.unique(pair)
    width = int(code.max()) + 1 if len(code) else 1
    return np.bincount(own // width, minlength=n), np.bincount(document, minlength=n)
