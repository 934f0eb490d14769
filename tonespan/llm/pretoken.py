"""Pre-tokens of byte-level BPE, cut out of whole chunks of text at once.

The pattern (contractions, letters, digits, other characters, each with one
leading space; white space without the last of its run) needs only the class
of each character and of its neighbours, so the boundaries are found with
array operations.  The tests hold the result against the tokenizer's own.
"""

from __future__ import annotations

import base64
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from . import kernels as K

#: A public byte-level vocabulary; any file of ranks of that format may be given instead.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_state: dict = {}


def load_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def encoder(ranks: dict[bytes, int]):  # noqa: ANN201
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def share_ranks(spark: SparkSession, path: str):  # noqa: ANN201
    """The vocabulary as a broadcast (its size is the vocabulary's), so that executors need no file."""
    return spark.sparkContext.broadcast(load_ranks(path))


def _classes() -> tuple[np.ndarray, np.ndarray]:
    if "cls" not in _state:
        cls = np.full(0x110000, 3, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k in "LN":
                cls[c] = 1 if k == "L" else 2
        cls[SPACES] = 0
        _state["cls"], _state["code"] = cls, K.mix64(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _state["cls"], _state["code"]


def pretokens(texts: pa.Array) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined, starts and ends of pre-tokens in it, their hashes, and the documents' offsets among them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = "".join(texts.to_pylist())
    offs = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(texts), dtype=np.int64))])
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(code)
    if not n:
        none = np.zeros(0, np.int64)
        return joined, none, none, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    classes, table = _classes()
    cls = classes[code]
    edge = np.zeros(n + 3, bool)  # where documents begin; also beyond the end
    edge[offs], edge[n:] = True, True
    start = edge[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    last = np.flatnonzero((cls[:-1] == 0) & (cls[1:] != 0) & ~edge[1:n])
    start[last] = True
    start[last[code[last] == 32] + 1] = False
    apostrophe = np.flatnonzero(code == 39)
    if len(apostrophe):
        at = apostrophe[apostrophe + 1 < n]
        at = at[~edge[at + 1] & (cls[np.minimum(at + 1, n - 1)] == 1)]
        before = np.maximum(at - 1, 0)
        at = at[edge[at] | ((cls[before] != 3) & (code[before] != 32))]
        c1, c2 = code[at + 1], np.where(edge[at + 2], 0, code[np.minimum(at + 2, n - 1)])
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for which, size in ((one, 2), (two, 3)):
            start[at[which] + 1] = False
            rest = at[which] + size
            rest = rest[rest < n]
            start[rest[~edge[rest] & (cls[rest] == 1)]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    p, inv = K.powers(n + 1)
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum(table[code] * p[:n], out=c[1:])
    hashes = K.mix64((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    return joined, starts, ends, hashes, np.searchsorted(starts, offs)


class PieceCache:
    """A worker's bounded memory of encoded pre-tokens, of their ids or (``ids=False``) only of their number: one slot for each of 2**bits residues, later pieces replace earlier ones."""

    def __init__(self, ranks: dict[bytes, int], ids: bool = True, bits: int = 21, pool: int = 1 << 23) -> None:
        self.encode = encoder(ranks)._encode_single_piece
        self.mask = np.uint64((1 << bits) - 1)
        self.limit, self.keep = pool, ids
        self.wide = np.uint16 if len(ranks) <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.place = np.zeros(int(self.mask) + 1, np.int32)
        self.size = np.zeros(int(self.mask) + 1, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.wide), 0

    def lengths(self, joined: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Number of ids of each pre-token; ``first`` is the table (keys, lengths) that is asked before the cache."""
        out = np.zeros(len(hashes), np.int64)
        todo = np.arange(len(hashes))
        if first is not None:
            slot = (hashes & np.uint64(len(first[0]) - 1)).astype(np.int64)
            hit = first[0][slot] == hashes
            out[hit] = first[1][slot[hit]]
            todo = np.flatnonzero(~hit)
        if len(todo):
            out[todo] = self._find(joined, starts, ends, hashes[todo], todo)[1]
        return out

    def ids(self, joined: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each pre-token."""
        place, size, pool = self._find(joined, starts, ends, hashes, np.arange(len(hashes)))
        total = np.concatenate([[0], np.cumsum(size)])
        return pool[np.repeat(place - total[:-1], size) + np.arange(total[-1])], size

    def _find(self, joined: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, which: np.ndarray):  # noqa: ANN202
        slot = (hashes & self.mask).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != hashes)
        place, size = self.place[slot].astype(np.int64), self.size[slot].astype(np.int64)
        if not len(miss):
            return place, size, self.pool
        new, at, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
        at = which[miss[at]]
        encode = self.encode
        codes = [encode(joined[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        n = np.fromiter(map(len, codes), np.int64, len(codes))
        into = (new & self.mask).astype(np.int64)
        if self.keep:
            flat = np.fromiter((x for c in codes for x in c), self.wide, int(n.sum()))
            if self.used + len(flat) > self.limit:
                self.clear()
                return self._alone(joined, starts, ends, hashes, which)
            while self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), self.wide)])
            where = self.used + np.concatenate([[0], np.cumsum(n)[:-1]])
            self.pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.place[into] = where
            place[miss] = where[inverse]
        self.keys[into], self.size[into] = new, n
        size[miss] = n[inverse]
        return place, size, self.pool

    def _alone(self, joined: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, which: np.ndarray):  # noqa: ANN202
        """The same without the cache."""
        _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = which[at]
        codes = [self.encode(joined[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        n = np.fromiter(map(len, codes), np.int64, len(codes))
        pool = np.fromiter((x for c in codes for x in c), self.wide, int(n.sum()))
        where = np.concatenate([[0], np.cumsum(n)[:-1]])
        return where[inverse], n[inverse], pool


def worker_cache(ranks: dict[bytes, int], tokenizer: str, ids: bool) -> PieceCache:
    """The worker process's cache for this vocabulary; a reused worker keeps it from task to task."""
    if _state.get("key") != (tokenizer, ids):
        _state["key"], _state["cache"] = (tokenizer, ids), PieceCache(ranks, ids)
    return _state["cache"]
