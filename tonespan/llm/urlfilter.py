"""URL filter: gradient-boosted trees on lexical features.

Features are computed for whole batches from byte counts: lengths, depth,
digit ratio, entropy, parameters, and statistics of the host's suffix.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import kernels as K
from .common import stored

#: Labelled URLs of each class to train on (those of the least hashes), trees, their depth, learning rate, bins of a feature, L2 penalty.
SAMPLE, TREES, DEPTH, RATE, BINS, PENALTY = 10_000, 60, 3, 0.3, 32, 1.0
#: Share of the features that a tree may use: where several tell the known hosts apart, none may hide the others.
COLUMNS = 0.3
#: Parts of the hosts; in training, a suffix's share of bad URLs is taken from the other parts.
FOLDS = 5
#: Host names that a seed blocklist marks as bad; the query's labels come from it.
SEEDS = ("cheap-pills", "spam-farm", "casino-win", "adult-x", "ads-track", "free-bets")
NAMES = ["length", "host_length", "path_length", "query_length", "depth", "host_dots", "host_hyphens", "digit_ratio", "host_digits", "entropy", "host_entropy", "parameters", "percents", "underscores", "host_vowels", "suffix_share", "suffix_bad"]


@dataclass
class Trees:
    """Complete trees of DEPTH levels: feature and threshold of inner nodes, values of leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    suffix_bad: dict = field(default_factory=dict)
    rate: float = 0.0  # share of bad URLs in training, for suffixes not met there


def parts(df: DataFrame, url_col: str) -> DataFrame:
    """df with __url, __host, __path, __query and __suffix, cut by patterns in the JVM; a null URL counts as empty."""
    df = df.withColumn("__url", F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit(""))))
    df = df.withColumn("__host", F.regexp_extract("__url", r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#]*)", 1))
    df = df.withColumn("__path", F.regexp_extract("__url", r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?[^/?#]*([^?#]*)", 1))
    return df.withColumn("__query", F.regexp_extract("__url", r"\?([^#]*)", 1)).withColumn("__suffix", F.regexp_extract("__host", r"([^.:]*)(?::\d+)?$", 1))


def _counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A histogram of bytes for each text, and lengths."""
    data, offs = K.text_bytes(texts)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    return np.bincount(owner * 256 + data, minlength=256 * (len(offs) - 1)).reshape(-1, 256), np.diff(offs)


def _entropy(hist: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = hist / np.maximum(n, 1)[:, None]
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)


def lexical(url: pa.Array, host: pa.Array, path: pa.Array, query: pa.Array, share: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The features of NAMES, a row for each URL."""
    u, un = _counts(url)
    h, hn = _counts(host)
    p, pn = _counts(path)
    q, qn = _counts(query)
    digits, vowels = slice(48, 58), [ord(c) for c in "aeiou"]
    cols = [un, hn, pn, qn, p[:, 47], h[:, 46], h[:, 45], u[:, digits].sum(1) / np.maximum(un, 1), h[:, digits].sum(1), _entropy(u, un), _entropy(h, hn),
            q[:, 38] + (qn > 0), u[:, 37], u[:, 95], h[:, vowels].sum(1) / np.maximum(hn, 1), share, bad]
    return np.stack([np.asarray(c, np.float64) for c in cols], axis=1)


def columns(tree: int, d: int) -> list[int]:
    """The features that a tree may use, in the order in which they are tried."""
    return np.random.Generator(np.random.PCG64([5, tree])).permutation(d)[: max(1, math.ceil(COLUMNS * d))].tolist()


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of complete trees for the logistic loss; ties go to the feature that is tried first and the lowest cut."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p0 / (1 - p0)))
    margin, trees = np.full(n, base), []
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            size = 2**level
            best = np.full(size, 1e-9)
            split = np.full((size, 2), -1)
            for j in columns(t, d):
                key = node * (BINS + 1) + binned[:, j]
                gs = np.bincount(key, g, size * (BINS + 1)).reshape(size, -1)
                hs = np.bincount(key, h, size * (BINS + 1)).reshape(size, -1)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt**2 / (ht + PENALTY)
                gain = gain[:, : len(cuts[j])]
                if gain.shape[1]:
                    at = gain.argmax(1)
                    top = gain[np.arange(size), at]
                    better = top > best + 1e-12
                    best[better], split[better, 0], split[better, 1] = top[better], j, at[better]
            first = size - 1
            right = np.zeros(n, np.int64)
            for k in range(size):
                if split[k, 0] >= 0:
                    feature[first + k], threshold[first + k] = split[k, 0], cuts[split[k, 0]][split[k, 1]]
                    mine = node == k
                    right[mine] = binned[mine, split[k, 0]] > split[k, 1]
            node = node * 2 + right
        gs, hs = np.bincount(node, g, 2**DEPTH), np.bincount(node, h, 2**DEPTH)
        value = -RATE * gs / (hs + PENALTY)
        margin += value[node]
        trees.append((feature, threshold, value))
    return Trees(base, *(np.stack(t) for t in zip(*trees)))


def predict(trees: Trees, x: np.ndarray) -> np.ndarray:
    margin = np.full(len(x), trees.base)
    rows = np.arange(len(x))
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
        node = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            at = 2**level - 1 + node
            node = node * 2 + (x[rows, feature[at]] > threshold[at])
        margin += value[node]
    return 1 / (1 + np.exp(-margin))


def seed_labels(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, bad) for every URL, bad if a label of its host is in SEEDS."""
    hosts = parts(pages.select(F.col(url_col).alias("url")).where("url is not null"), "url")
    return hosts.select("url", F.arrays_overlap(F.split("__host", r"[.:]"), F.array(*map(F.lit, SEEDS))).cast("int").alias("bad"))


def suffix_shares(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(__suffix, __share): each suffix's share of all URLs of the table."""
    n = stored(parts(pages.select(url_col), url_col).groupBy("__suffix").agg(F.count("*").alias("n")), "suffixes")
    total = n.agg(F.sum("n")).first()[0] or 1
    return n.select("__suffix", (F.col("n") / total).alias("__share"))


def fit(labels: DataFrame, shares: DataFrame, url_col: str = "url", label_col: str = "bad", sample: int = SAMPLE) -> Trees:
    """Trains in one task on at most ``sample`` labelled URLs of each class; null URLs and labels are ignored, repeated URLs count once, as bad if any of them is."""
    ship(labels.sparkSession)
    rows = labels.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(url_col).alias("__u")).agg(F.max(label_col).cast("double").alias("__y"))
    order = [F.xxhash64("__u"), F.col("__u")]
    chosen = rows.where("__y > 0").orderBy(*order).limit(sample).unionAll(rows.where("__y <= 0").orderBy(*order).limit(sample))
    ready = parts(chosen, "__u").join(shares, "__suffix", "left").select("__url", "__host", "__path", "__query", "__suffix", F.coalesce("__share", F.lit(0.0)).alias("__share"), "__y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got).combine_chunks()
        y = t.column("__y").to_numpy()
        suffix = t.column("__suffix").to_pylist()
        fold = [zlib.crc32(h.encode()) % FOLDS for h in t.column("__host").to_pylist()]
        mean = float(y.mean())
        seen: dict[tuple, np.ndarray] = {}
        for s, k, v in zip(suffix, fold, y):
            for key in ((s, k), (s, None)):
                seen[key] = seen.get(key, np.zeros(2)) + (v, 1)
        rate = lambda c: float((c[0] + 20 * mean) / (c[1] + 20))
        bad = {s: rate(c) for (s, k), c in seen.items() if k is None}
        others = np.array([rate(seen[s, None] - seen[s, k]) for s, k in zip(suffix, fold)])  # a URL's own host has no part in its rate
        cols = [t.column(c).combine_chunks() for c in ("__url", "__host", "__path", "__query")]
        trees = boost(lexical(*cols, t.column("__share").to_numpy(), others), y)
        trees.suffix_bad, trees.rate = bad, mean
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], ["model"])

    got = ready.repartition(1).sortWithinPartitions(F.xxhash64("__url"), "__url").mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else Trees(-8.0, np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8)))


def filtered(pages: DataFrame, model: Trees, shares: DataFrame, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(page_id, url, score, keep) for every row; keep if the score, the probability of a bad URL, is below the threshold.

    A null URL is scored as an empty one.  Repeated rows and null ids get a row each; without labelled URLs all are kept.
    ``shares`` has a row for each suffix; Spark broadcasts it only if its size allows.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            bad = np.array([m.suffix_bad.get(s, m.rate) for s in batch.column(6).to_pylist()], np.float64)
            score = predict(m, lexical(*(batch.column(k) for k in range(2, 6)), batch.column(7).to_numpy(), bad))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(score, 6)), pa.array(score < threshold)], ["page_id", "url", "score", "keep"])

    rows = parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url").join(shares, "__suffix", "left")
    rows = rows.select("page_id", "url", "__url", "__host", "__path", "__query", "__suffix", F.coalesce("__share", F.lit(0.0)).alias("__share"))
    return rows.mapInArrow(run, f"page_id {dict(pages.dtypes)[id_col]}, url string, score double, keep boolean")


def url_filter(pages: DataFrame, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Trains on labels (url, bad), by default those of the seed blocklist, and scores all pages.

    A row for each page, whatever its columns; see :func:`fit` for nulls and repeated rows in labels and :func:`filtered` for those
    in pages; an empty table gives no rows.
    """
    ship(pages.sparkSession)
    shares = suffix_shares(pages, url_col)
    return filtered(pages, fit(labels if labels is not None else seed_labels(pages, url_col), shares), shares, id_col, url_col)
