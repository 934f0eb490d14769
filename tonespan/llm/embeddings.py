"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

A vector is scaled to length 1 and rotated by a random orthogonal matrix; its
code holds the signs.  With x the code as a unit vector and c = <x, o> stored
as correction factor, <x, q> / c estimates <o, q> without bias, and its error
is at most about EPSILON * sqrt(1/c**2 - 1) * sqrt(1 - s**2) / sqrt(D - 1) at a true
value s.  The other side q is rotated likewise and rounded at random to 4
bits, which keeps the estimate unbiased.  Pairs whose bound stays below the
threshold are dropped without their vectors being read; the others are
computed exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import kernels as K
from .common import join_ids, stored
from .graph import across, bucketed, components

#: Least cosine, standard errors that an estimate may be off, wanted recall of the candidate search at the threshold.
THRESHOLD, EPSILON, RECALL = 0.95, 4.0, 0.97


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def band_plan(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band, so that a bucket holds about one unrelated vector, and bands for the recall at the threshold."""
    bits = min(48, max(8, math.ceil(math.log2(max(rows, 2)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def by_dimension(batch: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, vectors scaled to length 1, rows) of the rows of a batch, of those with a direction: finite numbers that aren't all 0."""
    lists = batch.cast(pa.list_(pa.float64()))
    valid = np.asarray(lists.is_valid())
    offs = lists.offsets.to_numpy()
    values, size = lists.values, np.where(valid, np.diff(offs), 0)
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # a null is read as NaN
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        x = flat[offs[at][:, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore"):
            x = x / np.abs(x).max(axis=1)[:, None]  # so that no square leaves the range of numbers
            norm = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        if good.any():
            yield dim, x[good] / norm[good, None], at[good]


def encode(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs and correction factors, and 4-bit values with their low ends and steps, of unit vectors."""
    y = x @ rotation(x.shape[1], seed)
    factor = np.abs(y).sum(axis=1) / math.sqrt(x.shape[1])
    low = y.min(axis=1)
    step = np.maximum((y.max(axis=1) - low) / 15, 1e-12)
    # each vector is rounded by draws of its own, made from its numbers: a task that is run again rounds alike
    own = K.mix64(np.ascontiguousarray(x).view(np.uint64).sum(axis=1, dtype=np.uint64) + np.uint64(seed))
    draws = K.mix64(own[:, None] + K.mix64(np.arange(1, x.shape[1] + 1, dtype=np.uint64))[None, :])
    dither = (draws >> np.uint64(11)) * 2.0**-53
    q = np.clip(np.floor((y - low[:, None]) / step[:, None] + dither), 0, 15).astype(np.uint8)
    return np.packbits(y > 0, axis=1), factor, q, low, step


def estimate(bits: np.ndarray, factor: np.ndarray, q: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Unbiased inner products of coded vectors with rounded ones, row by row."""
    dim = q.shape[1]
    sign = np.unpackbits(bits, axis=1)[:, :dim].astype(np.float32) * 2 - 1
    dot = (sign * q).sum(axis=1) * step + sign.sum(axis=1) * low
    return dot / math.sqrt(dim) / factor


def margin(factor: np.ndarray, step: np.ndarray, dim: int, s: float, epsilon: float = EPSILON) -> np.ndarray:
    """What an estimate of a true inner product s may be off: the code's error and the rounding's."""
    code = np.sqrt(np.maximum(1 / factor**2 - 1, 0)) * math.sqrt(1 - s * s) / math.sqrt(max(dim - 1, 1))
    rounding = step / 2 / factor  # the dither's error deviates by at most half a step in each place
    return epsilon * np.sqrt(code**2 + rounding**2)


def _settled(rows: DataFrame) -> DataFrame:
    """rows with one vector for each id: of those with a direction the least.  Only ids are shuffled, and the rows of ids that repeat."""
    again = stored(rows.groupBy("id").count().where("count > 1").select("id"), "again")
    if again.isEmpty():
        return rows
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    directed = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & (most > 0) & (most < float("inf"))
    some = join_ids(rows, again, "id", "left_semi").where(directed).groupBy("id").agg(F.min("v").alias("v"))
    return join_ids(rows, again, "id", "left_anti").unionByName(some)


def _fixed(column: pa.Array, at: np.ndarray | None = None) -> np.ndarray:
    """Rows of a binary column whose values are equally long, as a matrix of bytes."""
    data = b"".join((column if at is None else column.take(pa.array(at))).to_pylist())
    return np.frombuffer(data, np.uint8).reshape(len(column) if at is None else len(at), -1)


def _binary(matrix: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix of bytes."""
    n, width = matrix.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each group of near vectors: group_id (its least id), sorted vec_ids, n_vecs.

    Vectors are near if they have the same dimension and their cosine is at least ``threshold``; groups are connected
    components.  Vectors of each dimension of the table are compared among themselves.  Null ids and vectors, vectors with
    nulls or without a direction (empty, all 0, not finite) have no near ones.  Of rows that repeat an id the least vector with a
    direction counts.  Other columns aren't read.  An empty table gives no rows.
    Vectors that are alike in all numbers are one in the search.  In each bucket all members are compared with the least one,
    and members that end in different groups with each other.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null and size(v) > 0")
    kind = dict(rows.dtypes)["id"]
    sizes = {r.dim: r.n for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}  # a row for each dimension
    plans = {dim: band_plan(n, threshold) for dim, n in sizes.items()}
    whole = _settled(rows)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, x, at in by_dimension(batch.column(1)):
                bits, bands = plans[dim]
                packed, factor, q, low, step = encode(x)
                signs = [np.unpackbits(packed, axis=1)[:, :dim].astype(bool)]
                while sum(s.shape[1] for s in signs) < bits * bands:  # further rotations give further signs
                    signs.append(x @ rotation(dim, len(signs)) > 0)
                flat = np.concatenate(signs, axis=1)[:, : bits * bands].reshape(len(at), bands, bits)
                keys = K.mix64((flat @ (np.int64(1) << np.arange(bits, dtype=np.int64))).view(np.uint64) + K.mix64(np.uint64(dim) * np.uint64(1 << 32) + np.arange(bands, dtype=np.uint64)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * bands, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                numbers = np.ascontiguousarray(x).view(np.uint64)
                content = K.mix64((numbers * K.mix64(np.arange(1, dim + 1, dtype=np.uint64))).sum(axis=1, dtype=np.uint64) + np.uint64(dim)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(content), lists, _binary(packed), pa.array(factor), _binary(q), pa.array(low), pa.array(step)],
                    ["id", "content", "bands", "bits", "factor", "q", "low", "step"],
                )

    codes = stored(whole.mapInArrow(code, f"id {kind}, content bigint, bands array<bigint>, bits binary, factor double, q binary, low double, step double"), "codes")
    first = stored(codes.groupBy("content").agg(F.min("id").alias("a"), F.count("*").alias("n")), "contents")
    copies = codes.select("id", "content").join(first.where("n > 1"), "content").select("a", F.col("id").alias("b")).where("a <> b")
    single = codes.join(first.select("content", F.col("a").alias("id")), ["content", "id"], "left_semi")

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pc.binary_length(batch.column(4)))
            size = np.where(np.asarray(pc.binary_length(batch.column(2))) == (size + 7) // 8, size, 0)
            keep = np.zeros(batch.num_rows, bool)
            for dim in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == dim)
                factor, low, step = (batch.column(c).to_numpy()[at] for c in (3, 5, 6))
                keep[at] = estimate(_fixed(batch.column(2), at), factor, _fixed(batch.column(4), at), low, step) >= threshold - margin(factor, step, dim, threshold)
            yield batch.filter(pa.array(keep)).select([0, 1])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            other = {dim: (y, at) for dim, y, at in by_dimension(batch.column(3))}
            for dim, x, at in by_dimension(batch.column(2)):
                if dim in other:
                    both, i, j = np.intersect1d(at, other[dim][1], return_indices=True)
                    keep[both] = (x[i] * other[dim][0][j]).sum(axis=1) >= threshold
            yield batch.filter(pa.array(keep)).select([0, 1])

    def verified(edges: DataFrame) -> DataFrame:
        both = edges.join(codes.selectExpr("id as a", "bits", "factor"), "a").join(codes.selectExpr("id as b", "q", "low", "step"), "b")
        left = stored(both.select("a", "b", "bits", "factor", "q", "low", "step").mapInArrow(promising, f"a {kind}, b {kind}"), "uncertain")
        ids = stored(left.select(F.col("a").alias("id")).unionAll(left.select(F.col("b").alias("id"))).distinct(), "ids")
        vecs = stored(join_ids(whole, ids, "id", "left_semi"), "vectors")  # only these are moved
        full = left.join(vecs.selectExpr("id as a", "v as va"), "a").join(vecs.selectExpr("id as b", "v as vb"), "b")
        return stored(full.select("a", "b", "va", "vb").mapInArrow(exact, f"a {kind}, b {kind}"), "near")

    buckets = bucketed(single.select("id", F.explode("bands").alias("key")).distinct())
    stars = verified(stored(buckets.where("a <> id").select("a", F.col("id").alias("b")).distinct(), "candidates"))
    comps = stored(components(stars), "comps")
    more = verified(stored(across(buckets, comps), "candidates"))
    groups = components(copies.unionAll(stars).unionAll(more))
    return groups.groupBy(F.col("comp").alias("group_id")).agg(F.sort_array(F.collect_list("id")).alias("vec_ids"), F.count("*").alias("n_vecs"))
