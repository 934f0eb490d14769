"""Vectorised text kernels: whole Arrow batches are handled as flat byte arrays.

No kernel loops over rows or characters in Python.  A chunk of texts is one
``uint8`` array with document offsets; words are found with a byte-class
table, and their 64-bit hashes come from one prefix sum of
``table[byte] * P**position`` (mod 2**64), so that the hash of any slice is two
lookups and a multiplication.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass handles; a longer document is its own chunk.
CHUNK_BYTES = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Byte classes: 0 separates, 1 belongs to words (ASCII letters and digits, bytes of non-ASCII characters unless :func:`classes` says else), 2 other visible characters.
BYTE_CLASS = np.full(256, 2, np.uint8)
BYTE_CLASS[[0x20, *range(0x00, 0x20), 0x7F]] = 0
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    BYTE_CLASS[_a:_b] = 1
#: First bytes of characters that need a look at the character: spaces, punctuation, scripts written without spaces.
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE0, 0xE1, 0xE2, 0xE3, *range(0xE4, 0xEA), 0xEF, 0xF0]] = True
#: (first, last code point, class); class 3 is a word of one character: Thai to Myanmar, Khmer, kana, ideographs.
_RANGES = (
    (0x80, 0xA0, 0), (0xA1, 0xA9, 2), (0xAB, 0xB4, 2), (0xB6, 0xB9, 2), (0xBB, 0xBF, 2), (0x0E00, 0x0EFF, 3), (0x1000, 0x109F, 3), (0x1680, 0x1680, 0), (0x1780, 0x17FF, 3),
    (0x2000, 0x200B, 0), (0x200E, 0x2027, 2), (0x2028, 0x2029, 0), (0x202A, 0x202E, 2), (0x202F, 0x202F, 0), (0x2030, 0x205E, 2), (0x205F, 0x2064, 0), (0x2190, 0x2BFF, 2),
    (0x3000, 0x3000, 0), (0x3001, 0x3004, 2), (0x3005, 0x3007, 3), (0x3008, 0x3020, 2), (0x3030, 0x3030, 2), (0x303D, 0x303F, 2), (0x3040, 0x9FFF, 3), (0xF900, 0xFAFF, 3),
    (0xFE30, 0xFE4F, 2), (0xFEFF, 0xFEFF, 0), (0xFF01, 0xFF0F, 2), (0xFF1A, 0xFF20, 2), (0xFF3B, 0xFF40, 2), (0xFF5B, 0xFF65, 2), (0xFF66, 0xFF9D, 3), (0x1F000, 0x1FAFF, 2), (0x20000, 0x3FFFF, 3),
)
_LOW, _HIGH, _KIND = (np.array(x, np.int64) for x in zip(*_RANGES))

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept between calls up to 4 Mi entries."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        p, q = np.full(size, BASE, np.uint64), np.full(size, BASE_INV, np.uint64)
        p[0] = q[0] = 1
        np.multiply.accumulate(p, out=p)
        np.multiply.accumulate(q, out=q)
        if size > 1 << 22:
            return p, q
        _powers["p"], _powers["q"] = p, q
    return _powers["p"], _powers["q"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function on batches, after whose last one the worker gives back what it freed: idle workers live on and count as the executor's memory."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def text_chunks(texts: pa.Array, target: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``target`` bytes; at least one row each."""
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    a = 0
    while a < n:
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + target, "right")))
        yield a, min(b, n)
        a = b


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end and n+1 offsets.  A null counts as an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64, n + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(C, inverse powers): the hash of data[a:b] is (C[b] - C[a]) * inverse[a]."""
    p, q = powers(len(data) + 1)
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum(BYTE_TABLE[data] * p[: len(data)], out=c[1:])
    return c, q


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte (0 separates, 1 word, 2 other visible characters) and where words of one character begin and end."""
    cls, none = BYTE_CLASS[data], np.zeros(0, np.int64)
    at = np.flatnonzero(_LEAD[data])
    if not len(at):
        return cls, none
    lead, last = data[at].astype(np.int64), len(data) - 1
    size = np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))
    at, lead, size = (x[at + size <= len(data)] for x in (at, lead, size))
    code = lead & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
    for k in range(1, 4):
        code = np.where(k < size, code << 6 | (data[np.minimum(at + k, last)] & 0x3F), code)
    row = np.searchsorted(_LOW, code, "right") - 1
    known = (row >= 0) & (code <= _HIGH[row])
    at, size, kind = at[known], size[known], _KIND[row[known]]
    for k in range(4):
        mine = k < size
        cls[at[mine] + k] = np.where(kind[mine] == 3, 1, kind[mine])
    own = kind == 3
    return cls, np.concatenate([at[own], at[own] + size[own]]) if own.any() else none


def word_spans(data: np.ndarray, offs: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and n+1 offsets of the documents in the list of words.

    A word is a longest run of word bytes, or one character of a script written without spaces; with ``punctuation``, runs of
    other visible bytes are words too.  Unicode's spaces separate, its punctuation is no part of a word.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    cls, own = classes(data)
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(cls[1:], cls[:-1], out=change[1:-1])
    change[offs] = change[own] = True
    at = np.flatnonzero(change)
    kind = cls[at[:-1]]
    want = kind > 0 if punctuation else kind == 1
    starts, ends = at[:-1][want], at[1:][want]
    return starts, ends, np.searchsorted(starts, offs, "left")


def word_hashes(texts: pa.Array, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and n+1 offsets of the documents among them."""
    data, offs = text_bytes(texts)
    starts, ends, docs = word_spans(data, offs, punctuation)
    if not len(starts):
        return np.zeros(0, np.uint64), docs
    c, inv = prefix_hash(data)
    return mix64((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64)), docs


def ngrams(words: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each document and the documents' offsets among them.

    A document of fewer than n words, but at least one, has one gram: all of it.
    """
    count = np.diff(docs)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.concatenate([[0], np.cumsum(grams)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    first = np.arange(out[-1]) + np.repeat(docs[:-1] - out[:-1], grams)
    acc = words[first] * GRAM[0]
    short = count < n
    if not short.any():
        for j in range(1, n):
            acc += words[first + j] * GRAM[j]
    else:
        end = np.repeat(docs[1:], grams)
        padded = np.concatenate([words, np.zeros(n, np.uint64)])
        for j in range(1, n):
            acc += np.where(first + j < end, padded[first + j], np.uint64(0)) * GRAM[j]
    return mix64(acc), out


def unique_per_doc(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, with new offsets."""
    owner = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[keep], o[keep]
    return v, np.searchsorted(o, np.arange(len(docs)))
