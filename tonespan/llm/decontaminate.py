"""Benchmark decontamination by q-gram counting in diagonal bands and banded alignment.

Texts and items are compared as bytes of their lower-cased words joined by
single spaces.  Items are cut into overlapping segments; a segment of L bytes
that occurs with at most e edits shares at least L - q + 1 - e*q of its q-grams
on diagonals that span at most e, hence all of them lie in one of the bands of
2(e+1) diagonals that begin at every multiple of e+1.  The benchmark's q-grams
are one sorted array of places; hits are first counted in the bands of its
whole text, and only those whose band has enough are given to segments.
Items that are too short for an edit are looked up whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship
from . import kernels as K

#: q, edits a byte, bytes of a segment and of the step from one to the next.
Q, EDIT_RATE, SEGMENT, STEP = 8, 0.095, 64, 16
#: Bytes of benchmark text in one broadcast index (which has 17 times as many), and indexes that one pass searches; a larger benchmark takes several passes.
BLOCK_BYTES, BLOCKS = 2 << 20, 4
#: Leading bits of a hash that the index is entered by; bits of a band by which hits are counted at first.
_BITS, _COUNT_BITS = 20, 18


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lower-cased words with one space after each run of words' bytes, and document offsets."""
    data, offs = K.text_bytes(K.lower(texts))
    if not len(data):
        return data, offs
    word = K.classes(data)[0] == 1
    keep = word.copy()
    keep[1:] |= word[:-1]
    first = offs[:-1][offs[:-1] < len(data)]
    keep[first] = word[first]
    out = np.where(word, data, np.uint8(0x20))[keep]
    return out, np.concatenate([[0], np.cumsum(keep)])[offs]


def qgrams(data: np.ndarray, q: int) -> np.ndarray:
    """Hashes of data[i:i+q] for every i."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    c, inv = K.prefix_hash(data)
    return K.mix64((c[q:] - c[:-q]) * inv[: len(data) - q + 1])


@dataclass
class Index:
    """Segments of a block of benchmark items, the q-grams of the items' text in order of their hashes, and the short items."""

    text: np.ndarray  # the normalised items end to end
    item: np.ndarray  # of each segment
    start: np.ndarray  # of each segment in the text; neither starts nor ends decrease
    length: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    hashes: np.ndarray
    place: np.ndarray  # of each q-gram in the text
    least: np.ndarray  # of each q-gram: what the most modest of its segments needs
    first: np.ndarray  # where the hashes of each leading part begin
    short: dict  # length: (hashes in order, segments)


def budget(length: np.ndarray, q: int = Q, rate: float = EDIT_RATE) -> np.ndarray:
    """Edits that a segment may have: its length times the rate, and no more than the q-gram lemma can find."""
    return np.maximum(np.minimum((length * rate).astype(np.int64), length // q - 1), 0)


def build(items: list[tuple], q: int = Q, rate: float = EDIT_RATE, size: int = SEGMENT, step: int = STEP) -> Index:
    """Segments of all items with a word; those of fewer than 2q bytes have no edits and are kept apart."""
    data, offs = normalised(pa.array([t for _, t in items], pa.string()))
    item, start, length = [], [], []
    for k, (i, _) in enumerate(items):
        n = len(data[offs[k] : offs[k + 1]].tobytes().rstrip())
        for s in ([0] if n <= size else [*range(0, n - size, step), n - size]) if n else []:
            item.append(i)
            start.append(int(offs[k]) + s)
            length.append(min(n, size))
    start, length = np.array(start, np.int64), np.array(length, np.int64)
    edits = budget(length, q, rate)
    need = length - q + 1 - edits * q
    grams = qgrams(data, q)
    low, high = _owners(np.arange(len(grams)), start, length, q)
    long = np.concatenate([[0], np.cumsum(length >= 2 * q)])
    place = np.flatnonzero(long[high] > long[low]) if len(start) else np.zeros(0, np.int64)
    least = np.full(len(place), 255, np.int64)
    for j in range(int((high - low)[place].max()) if len(place) else 0):
        inside = low[place] + j < high[place]
        least = np.where(inside, np.minimum(least, need[np.minimum(low[place] + j, len(need) - 1)]), least)
    order = np.argsort(grams[place], kind="stable")
    hashes = grams[place][order]
    first = np.searchsorted(hashes >> np.uint64(64 - _BITS), np.arange((1 << _BITS) + 1, dtype=np.uint64)).astype(np.int32)
    short = {}
    for n in np.unique(length[length < 2 * q]).tolist():
        mine = np.flatnonzero(length == n)
        own = qgrams(data, n)[start[mine]]
        short[n] = (np.sort(own), mine[np.argsort(own, kind="stable")])
    return Index(data, np.array(item), start, length, edits, need, hashes, place[order].astype(np.int32), least[order].astype(np.uint8), first, short)


def _owners(place: np.ndarray, start: np.ndarray, length: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of the segments that hold the q-gram at each place."""
    return np.searchsorted(start + length, place + q, "left"), np.searchsorted(start, place, "right")


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [low, high), and the range that each is of."""
    n = np.maximum(high - low, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of], of


def _align(ix: Index, seg: np.ndarray, low: np.ndarray, begin: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Least edits between each segment and a stretch of text[begin:end] whose diagonals lie within the band from ``low`` on."""
    most = int(ix.edits[seg].max())
    width = 2 * (most + 1) + 2 * most
    steps = np.arange(width)
    slope = steps.astype(np.int16)
    cost = np.zeros((len(seg), width), np.int16)
    best = np.full(len(seg), 1 << 20, np.int32)
    first, last = low - most, len(ix.text) - 1
    for r in range(int(ix.length[seg].max())):
        at = first[:, None] + r + steps
        inside = (at >= begin[:, None]) & (at < end[:, None])
        char = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 1)
        now = cost + (char != ix.text[np.minimum(ix.start[seg] + r, last)][:, None])
        now[:, :-1] = np.minimum(now[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(now - slope, axis=1) + slope
        done = ix.length[seg] == r + 1
        best[done] = cost[done].min(axis=1)
    return best


def _verbatim(ix: Index, seg: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which segments stand at their places in the text without an edit."""
    same = (at >= begin) & (at + ix.length[seg] <= end)
    for s in range(0, SEGMENT, 16):
        some = np.flatnonzero(same & (ix.length[seg] > s))
        step = s + np.arange(16)
        of = np.minimum(step, ix.length[seg[some], None] - 1)
        same[some] = (data[at[some, None] + of] == ix.text[ix.start[seg[some], None] + of]).all(axis=1)
    return same


def _crowded(band: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Hits that may lie in a band, or in two bands that follow each other, of as many hits as they need: counts are by the last bits of bands, so none is too low."""
    mask = (1 << _COUNT_BITS) - 1
    cell = band & mask
    count = np.bincount(cell, minlength=mask + 1)
    return count[cell] + np.maximum(count[(cell - 1) & mask], count[(cell + 1) & mask]) >= least


def _whole(ix: Index, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, segment) of short items, found as whole words."""
    for n, (hashes, segs) in ix.short.items():
        grams = qgrams(data, n)
        bound = np.zeros(len(data) + 1, bool)  # between words: before and behind a space, and where documents meet
        bound[offs] = True
        blank = np.flatnonzero(data == 0x20)
        bound[blank] = bound[blank + 1] = True
        at = np.flatnonzero(bound[: len(grams)] & bound[n : n + len(grams)])
        which, of = _spread(np.searchsorted(hashes, grams[at], "left"), np.searchsorted(hashes, grams[at], "right"))
        at, seg = at[of], segs[which]
        doc = np.searchsorted(offs, at, "right") - 1
        ok = at + n <= offs[np.minimum(doc + 1, len(offs) - 1)]
        at, seg, doc = at[ok], seg[ok], doc[ok]
        same = np.ones(len(at), bool)
        for k in range(n):
            same &= data[at + k] == ix.text[ix.start[seg] + k]
        yield doc[same], seg[same]


def search(ix: Index, texts: pa.Array, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, segment, edits) of verified occurrences, the edits those of the best occurrence in a band."""
    data, offs = normalised(texts)
    out = [(np.zeros(0, np.int64),) * 3] + [(d, s, np.zeros(len(d), np.int64)) for d, s in _whole(ix, data, offs)]
    grams = qgrams(data, q)
    part = (grams >> np.uint64(64 - _BITS)).astype(np.int64)
    at = np.flatnonzero(ix.first[part] < ix.first[part + 1]) if len(ix.hashes) else np.zeros(0, np.int64)
    if len(at):
        which, of = _spread(ix.first[part[at]].astype(np.int64), ix.first[part[at] + 1])
        at = at[of]
        same = ix.hashes[which] == grams[at]
        at, which = at[same], which[same]
        place = ix.place[which].astype(np.int64)
        crowd = _crowded((at - place + len(ix.text)) // (int(ix.edits.max()) + 1), ix.least[which])
        at, place = at[crowd], place[crowd]
        doc = np.searchsorted(offs, at, "right") - 1
        inside = at + q <= offs[doc + 1]
        at, place, doc = at[inside], place[inside], doc[inside]
        seg, of = _spread(*_owners(place, ix.start, ix.length, q))
        at, doc, place = at[of], doc[of], place[of]
        long = ix.length[seg] >= 2 * q
        at, doc, place, seg = at[long], doc[long], place[long], seg[long]
        begin = at - (place - ix.start[seg])
        band = (begin + SEGMENT) // (ix.edits[seg] + 1)
        bands = len(data) + 2 * SEGMENT
        key = (doc * len(ix.item) + seg) * bands + band
        found, one, count = np.unique(np.concatenate([key, key - (band > 0)]), return_index=True, return_counts=True)
        pair, band, begin = found // bands, found % bands, begin[one % max(len(begin), 1)]
        doc, seg = pair // len(ix.item), pair % len(ix.item)
        keep = count >= ix.need[seg]
        doc, seg, band, begin = doc[keep], seg[keep], band[keep], begin[keep]
        same = _verbatim(ix, seg, begin, offs[doc], offs[doc + 1], data)
        out.append((doc[same], seg[same], np.zeros(int(same.sum()), np.int64)))
        doc, seg, band = doc[~same], seg[~same], band[~same]
        for s in range(0, len(doc), 4096):
            d, g, b = (x[s : s + 4096] for x in (doc, seg, band))
            edits = _align(ix, g, b * (ix.edits[g] + 1) - SEGMENT, offs[d], offs[d + 1], data)
            ok = edits <= ix.edits[g]
            out.append((d[ok], g[ok], edits[ok]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _passes(benchmark: DataFrame, item_col: str, text_col: str) -> list[list]:
    """Broadcast indexes by pass, each of about BLOCK_BYTES of benchmark text."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    spark = benchmark.sparkSession
    ship(spark)
    part = F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))
    made = [spark.sparkContext.broadcast(build(sorted((r.item, r.text) for r in items.where(part == k).collect()))) for k in range(blocks)]
    return [made[k : k + BLOCKS] for k in range(0, blocks, BLOCKS)]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits): documents with a segment of an item, with the fewest edits of any segment.

    Texts and items are compared as lower-cased words with single spaces.  A segment is 64 bytes, one begins every 16 bytes and
    one ends each item; a shorter item is one segment.  A segment of L bytes may have 0.095 L edits (6 at 64 bytes), but at most
    L/8 - 1, both rounded down: none below 16 bytes, where the item must occur as whole words.  An item without words is nowhere.
    Null ids and texts are skipped; empty tables give no rows; a repeated document is searched
    once for each row and reported once; further columns are not read.
    """
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int"

    def scan(shared: list) -> Callable:
        @K.tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for (a, b), ix in product(K.text_chunks(batch.column(1)), [x.value for x in shared]):
                    row, seg, edits = search(ix, batch.column(1).slice(a, b - a))
                    if len(row):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(ix.item[seg].tolist(), type=item_type), pa.array(edits, pa.int32())], ["doc_id", "item_id", "edits"])

        return run

    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _passes(benchmark, item_col, item_text):
        out = out.unionAll(rows.mapInArrow(scan(shared), schema))
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without those that hold a segment of an item, as :func:`leaks` finds them.  One pass over the rows, no shuffle.

    Null and empty texts and null ids stay; repeated rows are judged alike; without items, or documents, nothing changes;
    columns of any name pass through.
    """
    at = docs.columns.index(text_col)

    def clean(shared: list) -> Callable:
        @K.tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for (a, b), ix in product(K.text_chunks(batch.column(at)), [x.value for x in shared]):
                    keep[search(ix, batch.column(at).slice(a, b - a))[0] + a] = False
                yield batch.filter(pa.array(keep))

        return run

    for shared in _passes(benchmark, item_col, item_text):
        docs = docs.mapInArrow(clean(shared), docs.schema)
    return docs
