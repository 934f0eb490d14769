"""Mixing sources along a curriculum: weight schedules, cumulative demand, training positions.

At training time t in [0, 1] source s gets the share w_s(t), linear between
knots.  Its demand up to t is T times the integral of w_s; a document whose
tokens have their middle at m in the order of its source is read at the t
where that demand reaches m.  T is the largest budget that no source's supply
falls short of, so shares hold at every time and no document repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_ids, stored, unused

#: Knots, and the powers of a source's supply that its share follows there: natural at first, then flatter.
KNOTS, POWERS = (0.0, 0.5, 1.0), (1.0, 0.7, 0.5)
#: Parts of a source's order; partial sums of parts make the running totals of a hot source a parallel job.
PARTS = 4096
_MOD = 1 << 31


def default_schedule(supply: DataFrame, knots: tuple[float, ...] = KNOTS, powers: tuple[float, ...] = POWERS) -> DataFrame:
    """(src, w0, w1, ...) from (src, supply): shares proportional to supply**power at each knot."""
    return supply.select("src", *(F.when(F.col("supply") > 0, F.pow(F.col("supply").cast("double"), F.lit(p))).otherwise(0.0).alias(f"w{k}") for k, p in enumerate(powers)))


def whole_schedule(supply: DataFrame, knots: tuple[float, ...] = KNOTS) -> DataFrame:
    """(src, w0, w1, ...) from (src, supply): shares that use up every source at t = 1, for knots from 0 to 1.

    A source's share is natural on average and moves linearly: large sources go from more to less, small ones from
    less to more.  The shift is bounded by the source's own share, so no source changes the room of another.
    """
    everyone = Window.partitionBy()
    p = supply.where("supply > 0").select("src", F.col("supply").cast("double").alias("supply"), (F.col("supply") / F.sum("supply").over(everyone)).alias("p"))
    p = p.withColumn("flat", F.sqrt("p") / F.sum(F.sqrt("p")).over(everyone))
    late = p.withColumn("late", F.col("flat") / (F.col("flat") + F.col("p")))
    late = late.withColumn("shift", F.sum(F.col("p") * F.col("late")).over(everyone) - F.col("late"))
    return late.select("src", *((F.col("supply") * (1 + F.col("shift") * (1 - 2 * t))).alias(f"w{k}") for k, t in enumerate(knots)))


def positions(docs: DataFrame, schedule: DataFrame | Callable[..., DataFrame] | None = None, knots: tuple[float, ...] = KNOTS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens, position) of the documents that are read, position in [0, 1].

    ``schedule`` has src and a weight w0, w1, ... for each knot (not negative; they are normalised at each knot);
    a source without one has weight 0.  It may be a function of (src, supply) and the knots, too: ``default_schedule``
    drops what is beyond a source's demand, ``whole_schedule`` places every document of each source with tokens.  Tokens are runs of visible characters.
    A null source counts as ''; null and empty texts have no tokens and take no room; rows with a null id go;
    repeated rows are placed one after the other.  Empty tables give no rows.  Integer ids are ordered within a source by a
    congruence of their own (that of ``SQL``), ids of other types by their hash.  A source that the schedule names twice
    has the sum of its weights.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("n"),
    )
    whole = dict(rows.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    number = F.col("doc_id").cast("bigint") if whole else F.xxhash64("doc_id")
    rows = stored(rows.withColumn("h", F.pmod(F.pmod(number, F.lit(_MOD)) * 1103515245 + 12345, F.lit(_MOD))).withColumn("part", F.expr(f"cast(h div {_MOD // PARTS} as int)")), "tokens")
    sums = stored(rows.groupBy("src", "part").agg(F.sum("n").alias("total")), "sums")
    supply = sums.groupBy("src").agg(F.sum("total").alias("supply"))
    weights = schedule if isinstance(schedule, DataFrame) else (schedule or default_schedule)(supply, knots=knots)
    m = len(knots)
    weights = weights.groupBy("src").agg(*(F.sum(F.col(f"w{k}").cast("double")).alias(f"w{k}") for k in range(m)))
    joined = supply.join(weights, "src").select("src", "supply", *(f"w{k}" for k in range(m)))
    everyone = Window.partitionBy()
    shares = joined.select("src", "supply", *(F.coalesce(F.try_divide(F.col(f"w{k}"), F.sum(f"w{k}").over(everyone)), F.lit(0.0)).alias(f"s{k}") for k in range(m)))
    area = sum((F.lit((knots[k + 1] - knots[k]) / 2) * (F.col(f"s{k}") + F.col(f"s{k + 1}")) for k in range(m - 1)), F.lit(0.0))
    plan = shares.withColumn("area", area).withColumn("budget", F.min(F.try_divide(F.col("supply").cast("double"), F.col("area"))).over(everyone))
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).select("src", "part", "base")
    within = Window.partitionBy("src", "part").orderBy("h", "doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(base, ["src", "part"]).join(plan, "src")
    rest = (F.col("base") + F.col("inner") + F.col("n") / 2.0) / F.col("budget")
    placed = placed.withColumn("rest", rest).where("budget > 0 and area > 0 and rest <= area * (1 + 1e-9)")
    done, at = F.lit(0.0), F.lit(None).cast("double")
    for k in range(m - 1):
        width, a, b = knots[k + 1] - knots[k], F.col(f"s{k}"), F.col(f"s{k + 1}")
        here = F.greatest(F.col("rest") - done, F.lit(0.0))
        u = F.coalesce(F.try_divide(2 * here, a + F.sqrt(F.greatest(a * a + 2 * (b - a) / width * here, F.lit(0.0)))), F.lit(0.0))
        mine = F.lit(knots[k]) + F.least(u, F.lit(width))
        inside = F.col("rest") <= done + (a + b) / 2 * width
        at = F.coalesce(at, mine if k == m - 2 else F.when(inside, mine))
        done = done + (a + b) / 2 * width
    return placed.select("doc_id", F.col("src").alias("source"), F.col("n").alias("n_tokens"), F.round(at, 6).alias("position"))


def placed(docs: DataFrame, schedule: DataFrame | Callable[..., DataFrame] | None = None, name: str = "position", **columns: str) -> DataFrame:
    """docs with their positions in a further column ``name``, without those that have none; in no order.

    Rows that repeat an id all take the place of the first of them; rows with a null id go; columns of any other name pass through.
    """
    id_col = columns.get("id_col", "doc_id")
    place = stored(positions(docs, schedule, **columns).groupBy(F.col("doc_id").alias("__id")).agg(F.min("position").alias("__position")), "positions")
    both = join_ids(docs, place, docs[id_col] == place["__id"], "inner", 96)  # type: ignore[arg-type]
    return both.select(*(docs[c] for c in docs.columns), place["__position"].alias(name))


def mixed(docs: DataFrame, schedule: DataFrame | Callable[..., DataFrame] | None = None, **columns: str) -> DataFrame:
    """docs in the order in which training reads them, without those beyond their source's demand; all columns stay.

    Rows are treated as by :func:`placed`; rows at the same position go by id.  Files keep the order among themselves by their
    numbers only; who reads them in another order gets the positions from :func:`placed` again, which depend on the rows alone.
    """
    name = unused(docs, "position")
    return placed(docs, schedule, name, **columns).orderBy(name, columns.get("id_col", "doc_id")).drop(name)


#: The same in DuckDB's SQL, over `documents`.
SQL = r"""
with t as (select doc_id, coalesce(source, '') src, coalesce(len(regexp_extract_all(text, '\S+')), 0)::bigint n,
    ((((doc_id % 2147483648) + 2147483648) % 2147483648) * 1103515245 + 12345) % 2147483648 h from documents where doc_id is not null),
c as (select *, coalesce(sum(n) over (partition by src order by h, doc_id, n rows between unbounded preceding and 1 preceding), 0)::double before from t),
p as (select src, sum(n)::double supply from t group by src),
w as (select src, supply, supply w0, pow(supply, 0.7) w1, pow(supply, 0.5) w2 from p where supply > 0),
s as (select src, supply, w0 / sum(w0) over () s0, w1 / sum(w1) over () s1, w2 / sum(w2) over () s2 from w),
a as (select *, 0.25 * (s0 + s1) a1, 0.25 * (s0 + s1) + 0.25 * (s1 + s2) area from s),
b as (select *, min(supply / area) over () budget from a),
r as (select *, (before + n / 2.0) / budget rest from c join b using (src)),
q as (select *, greatest(rest - a1, 0) r2 from r where rest <= area * (1 + 1e-9))
select doc_id, src as source, n as n_tokens, round(case when rest <= a1
    then least(coalesce(2 * rest / (s0 + sqrt(greatest(s0 * s0 + 4 * (s1 - s0) * rest, 0))), 0), 0.5)
    else 0.5 + least(coalesce(2 * r2 / (s1 + sqrt(greatest(s1 * s1 + 4 * (s2 - s1) * r2, 0))), 0), 0.5) end, 6) as position
from q
"""
