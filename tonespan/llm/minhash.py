"""Near-duplicate documents by circulant MinHash.

One permutation scatters the shingles over a universe of 2**44 circles of 2**20
places; the second is a fixed table of values around the circle, flipped by a
mask of each circle's own, and coordinate k reads it shifted by k places.  A
shingle's contribution to all coordinates is then one contiguous slice of the
table under one mask, and a signature is the element-wise minimum of such
slices.  The universe doesn't fill up, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import kernels as K
from .common import forget, join_ids, stored, unused
from .graph import across, bucketed, components

#: Word n-gram length of shingles, signature length, rows of a band, least Jaccard similarity.
NGRAM, COORDS, ROWS, THRESHOLD = 3, 160, 4, 0.5
CIRCLE_BITS = 20

_tables: dict[int, np.ndarray] = {}


def _windows(coords: int) -> np.ndarray:
    """Row x holds the second permutation at x, x+1, ..., x+coords-1 (circular): a view, not a copy."""
    if coords not in _tables:
        size = 1 << CIRCLE_BITS
        rng = np.random.Generator(np.random.PCG64(77))
        pi = rng.permutation(np.arange(size, dtype=np.uint64) << np.uint64(32 - CIRCLE_BITS) | rng.integers(0, 1 << (32 - CIRCLE_BITS), size, dtype=np.uint64)).astype(np.uint32)
        _tables[coords] = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: coords - 1]]), coords)
    return _tables[coords]


def places(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation: each shingle's place on its circle, and the circle's mask."""
    x = K.mix64(shingles * np.uint64(0xD6E8FEB86659FD93))
    return (x >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64), (K.mix64(x << np.uint64(CIRCLE_BITS)) >> np.uint64(32)).astype(np.uint32)


def signatures(shingles: np.ndarray, docs: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """One row of coordinates for each document; documents without shingles get the largest value throughout."""
    at, mask = places(shingles)
    out = np.full((len(docs) - 1, coords), np.uint32(0xFFFFFFFF), np.uint32)
    win, some = _windows(coords), np.flatnonzero(np.diff(docs))
    step = 1 << 12  # shingles gathered at once: 2.5 MB of slices, which stay in the cache
    for i, (a, b) in zip(some, zip(docs[some], docs[some + 1])):
        for s in range(a, b, step):
            e = min(b, s + step)
            values = win[at[s:e]]
            values ^= mask[s:e, None]
            np.minimum(out[i], values.min(axis=0), out=out[i])
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """64-bit keys of the bands; the band's number is part of the key."""
    n, coords = sig.shape
    bands = coords // rows
    s = sig[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
    acc = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        acc = K.mix64(acc + s[:, :, r] * K.GRAM[r] + np.uint64(1))
    return acc


@K.tidy
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in K.text_chunks(batch.column(1)):
            part = batch.slice(a, b - a)
            words, docs = K.word_hashes(K.lower(part.column(1)))
            count = np.diff(docs)
            whole = np.zeros(len(count), np.uint64)
            if len(words):
                place = np.arange(len(words)) - np.repeat(docs[:-1], count)
                mixed = K.mix64(words + K.mix64(place.astype(np.uint64) + np.uint64(1)))
                total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
                whole = K.mix64(total[docs[1:]] - total[docs[:-1]] + count.astype(np.uint64))
            keys = band_keys(signatures(*K.ngrams(words, docs, NGRAM)))
            some = count > 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(some.sum() + 1) * keys.shape[1], pa.int32()), pa.array(keys[some].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(some)), pa.array(whole[some].view(np.int64)), lists], ["id", "content", "bands"])


@K.tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in K.text_chunks(batch.column(1)):
            part = batch.slice(a, b - a)
            values, docs = K.unique_per_doc(*K.ngrams(*K.word_hashes(K.lower(part.column(1))), NGRAM))
            lists = pa.ListArray.from_arrays(pa.array(docs, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "shingles"])


def _verified(edges: DataFrame, texts: DataFrame, kind: str, threshold: float) -> DataFrame:
    """The edges (a, b) whose exact Jaccard similarity of shingle sets reaches the threshold."""
    edges = stored(edges, "candidates")
    ids = stored(edges.select(F.col("a").alias("id")).unionAll(edges.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = stored(join_ids(texts, ids, "id", "left_semi").mapInArrow(_sets, f"id {kind}, shingles array<bigint>"), "sets")
    both = edges.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    out = stored(both.where(shared >= F.lit(threshold) * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "verified")
    forget(sets, ids, edges)
    return out


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, comp) for every document that has a near copy; comp is the least id of its group.

    Two documents are near copies if the Jaccard similarity of their sets of
    word 3-grams (lower case, punctuation ignored) is at least ``threshold``;
    groups are the connected components.  Copies with the same words are
    joined by a content hash first.  In each band bucket all members are
    compared with the least one; members that end in different components
    are then all compared with each other, so no partner is capped.

    Null ids and texts, and texts without words, have no near copies.  Texts of
    fewer than three words are one shingle.  Rows that repeat an id with
    different texts count as one document with any of its texts.
    An empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    kind = dict(texts.dtypes)["id"]
    sketch = stored(texts.mapInArrow(_sketch, f"id {kind}, content bigint, bands array<bigint>"), "sketch")
    first = stored(sketch.groupBy("content").agg(F.min("id").alias("id"), F.min("bands").alias("bands"), F.count("*").alias("n")), "contents")
    copies = sketch.select("id", "content").join(first.where("n > 1").select("content", F.col("id").alias("a")), "content").select("a", F.col("id").alias("b")).where("a <> b")
    buckets = bucketed(first.select("id", F.explode("bands").alias("key")))
    stars = _verified(buckets.where("a <> id").select("a", F.col("id").alias("b")).distinct(), texts, kind, threshold)
    comps = stored(components(stars), "comps")
    more = _verified(across(buckets, comps), texts, kind, threshold)
    groups = stored(components(copies.unionAll(stars).unionAll(more)), "groups")
    forget(sketch, first, buckets, stars, comps, more)
    return groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each group of near copies: group_id (its least id, the one to keep), sorted doc_ids, n_docs."""
    groups = duplicate_groups(docs, id_col, text_col, threshold)
    return groups.groupBy(F.col("comp").alias("group_id")).agg(F.sort_array(F.collect_list("id")).alias("doc_ids"), F.count("*").alias("n_docs"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of near copies, that of the least id; all columns stay.

    If an id repeats, only one of its rows stays: the least by a hash of the text.
    Rows with a null id or text, and texts without words, stay; columns of any name pass through; an empty table stays empty.
    """
    groups = duplicate_groups(docs, id_col, text_col, threshold)
    gone = stored(groups.where("id <> comp").select(F.col("id").alias("__gone")), "gone")
    kept = join_ids(docs, gone, docs[id_col] == gone["__gone"], "left_anti")  # type: ignore[arg-type]
    again = stored(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).count().where("count > 1").select("__again"), "again")
    if again.isEmpty():
        return kept
    same = kept[id_col] == again["__again"]
    once = join_ids(kept, again, same, "left_anti")  # type: ignore[arg-type]
    more = join_ids(kept, again, same, "left_semi")  # type: ignore[arg-type]
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col), text_col)
    rank = unused(docs, "rank")
    return once.unionByName(more.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank))
