"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations with map-side combination and two joins, so a
node with millions of neighbours is never gathered in one row or task.  The
edges of each round are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_ids, stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for each node of the edges (a, b): comp is the least id of its component.

    Self-loops and repeated edges are harmless; null ends are ignored; no edges give no rows.
    """
    e = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        last, e = e, stored(_small_star(_large_star(e)), "edges")
        forget(last)
        now = _digest(e)
        if now == before or not now[0]:
            break
        before = now
    pairs = e.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return pairs.unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("comp"))).distinct()


def bucketed(keyed: DataFrame) -> DataFrame:
    """(key, id, a) of the buckets (key, id) with two ids or more, a the least one; stored.

    The least and greatest ids are combined map-side; the join's hot keys can be split between tasks.
    """
    ends = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("key", "a")
    return stored(keyed.join(ends, "key").select("key", "id", "a"), "buckets")


def across(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) that share a bucket (key, id, its least id a) but no component, beside those tried already."""
    named = stored(join_ids(buckets, comps, "id", "left").select("key", "id", "a", F.coalesce("comp", "id").alias("comp")), "named")
    split = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min_by("comp", "id").alias("lead")).where("low <> high").select("key", "lead")
    named = stored(named.join(split, "key"), "split")
    odd = named.where("comp <> lead").select("key", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("a").alias("least"))
    rest = named.select("key", F.col("id").alias("y"), F.col("comp").alias("cy"))
    return odd.join(rest, "key").where("cx <> cy and y <> least").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
