"""What documents, lags, lexicons, features and time schemes contribute to a model's predictions.

Documents meet reference dates through a table of (reference date, period, lag): a range join turned into an equi-join of
bounded size.  Coefficients and time weights are small and broadcast; documents are reduced to one row for each time scheme first.
An iterative scheme's models are one table of coefficients by reference date, so its plan doesn't grow with their number.

A group's series is the mean of its members', so its coefficient is spread over them: documents keep the weights that the texts
were aggregated with, and all dimensions add up to the same, whatever groups were made.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .aggregation import _STEP, SERIES
from .model import IterativeModel, Model
from .panel import Measures


@dataclass(frozen=True)
class Attributions:
    """Long frames: documents (ref_date, id, date, attrib), the others (ref_date, component, attrib)."""

    documents: DataFrame
    lags: DataFrame | None
    lexicons: DataFrame
    features: DataFrame
    time: DataFrame


def coefficient_frame(spark: SparkSession, coef: Mapping[str, float] | Sequence[tuple], m: Measures | None = None) -> DataFrame:
    """(lexicon, feature, time, coef) of the terms that are series; with pairs (date, coefficients) also ref_date.

    With measures, groups of lexicons and features are spread over the members that documents have scores of.
    """
    many = not isinstance(coef, Mapping)
    spread = m.members if m else lambda _, name: {name: 1.0}
    rows: dict[tuple, float] = {}
    for day, terms in coef if many else [(None, coef)]:
        for term, v in terms.items():
            if term.count("--") == 2:
                lexicon, feature, time = term.split("--")
                for (a, x), (b, y) in product(spread("lexicon", lexicon).items(), spread("feature", feature).items()):
                    key = (str(day), a, b, time) if many else (a, b, time)
                    rows[key] = rows.get(key, 0.0) + float(v) * x * y
    frame = spark.createDataFrame([(*k, v) for k, v in rows.items()], "ref_date string, " * many + "lexicon string, feature string, time string, coef double")
    return frame.withColumn("ref_date", F.col("ref_date").cast("date")) if many else frame


def lag_windows(grid: DataFrame, refs: DataFrame, n_lags: int) -> DataFrame:
    """(ref_date, date, lag, place): the ``n_lags`` grid dates that end at each reference date; lag 0 is the date itself, place 0 the most lagged."""
    numbered = grid.select("date", F.row_number().over(Window.orderBy("date")).alias("__k"))
    ends = refs.select("ref_date").join(numbered.withColumnRenamed("date", "ref_date").withColumnRenamed("__k", "__r"), "ref_date")
    spread = ends.select("ref_date", "__r", F.explode(F.sequence(F.lit(0), F.lit(n_lags - 1))).alias("lag")).withColumn("__k", F.col("__r") - F.col("lag"))
    return spread.join(numbered, "__k").select("ref_date", "date", "lag", (F.lit(n_lags - 1) - F.col("lag")).alias("place"))


def date_grid(weighted: DataFrame, by: str, fill: str) -> DataFrame:
    """All periods from the first to the last with documents; only those with documents if nothing is filled."""
    if fill == "none":
        return weighted.select("date").distinct()
    return weighted.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi", F.expr(_STEP[by]))).alias("date"))


def _weights_frame(spark: SparkSession, weights: Mapping[str, Sequence[float]]) -> DataFrame:
    return spark.createDataFrame([(k, i, float(w)) for k, ws in weights.items() for i, w in enumerate(ws)], "time string, place int, b double")


def by_document(weighted: DataFrame, coef: DataFrame, windows: DataFrame, weights: DataFrame) -> DataFrame:
    """(ref_date, id, date, attrib) from document weights (id, date, lexicon, feature, score, w)."""
    reduced = weighted.join(F.broadcast(coef), ["lexicon", "feature"]).groupBy("id", "date", "time").agg(F.sum(F.col("coef") * F.col("score") * F.col("w")).alias("v"))
    placed = windows.join(F.broadcast(weights), "place")
    return reduced.join(placed, ["date", "time"]).groupBy("ref_date", "id", "date").agg(F.coalesce(F.sum(F.col("v") * F.col("b")), F.lit(0.0)).alias("attrib"))


def by_document_each(weighted: DataFrame, coef: DataFrame, windows: DataFrame, weights: DataFrame) -> DataFrame:
    """The same with coefficients of each reference date's own."""
    per = windows.join(F.broadcast(weights), "place").join(coef, ["ref_date", "time"]).groupBy("ref_date", "date", "lexicon", "feature").agg(F.sum(F.col("coef") * F.col("b")).alias("g"))
    return weighted.join(per, ["date", "lexicon", "feature"]).groupBy("ref_date", "id", "date").agg(F.coalesce(F.sum(F.col("score") * F.col("w") * F.col("g")), F.lit(0.0)).alias("attrib"))


def by_lag(weighted: DataFrame, coef: DataFrame, windows: DataFrame, weights: DataFrame, grid: DataFrame, fill: str) -> DataFrame:
    """(ref_date, component, attrib): the same by lag; periods without documents count 0, or like the last before with fill 'latest'."""
    used = coef.select("lexicon", "feature").distinct()
    totals = weighted.join(F.broadcast(used), ["lexicon", "feature"]).groupBy("date", "lexicon", "feature").agg(F.sum(F.col("score") * F.col("w")).alias("v"), F.lit(True).alias("__there"))
    full = totals
    if fill == "latest":
        full = grid.crossJoin(F.broadcast(used)).join(totals, ["date", "lexicon", "feature"], "left").withColumn("v", F.when(F.col("__there"), F.coalesce("v", F.lit(0.0))))
        full = full.withColumn("v", F.last("v", ignorenulls=True).over(Window.partitionBy("lexicon", "feature").orderBy("date")))
    on = ["ref_date", "time"] if "ref_date" in coef.columns else ["time"]
    rows = windows.join(F.broadcast(weights), "place").join(F.broadcast(coef), on).join(full.select("date", "lexicon", "feature", "v"), ["date", "lexicon", "feature"], "left")
    return rows.groupBy("ref_date", F.concat(F.lit("lag_"), F.col("lag").cast("string")).alias("component")).agg(F.coalesce(F.sum(F.col("coef") * F.col("v") * F.col("b")), F.lit(0.0)).alias("attrib"))


def by_dimension(panel: DataFrame, coef: DataFrame, refs: DataFrame, dim: str) -> DataFrame:
    """(ref_date, component, attrib): coefficient times measure by component; those without a series in the model get 0."""
    days = panel.withColumnRenamed("date", "ref_date").join(refs, "ref_date", "left_semi")
    rows = days.join(F.broadcast(coef), ["ref_date", *SERIES] if "ref_date" in coef.columns else list(SERIES), "left")
    return rows.groupBy("ref_date", F.col(dim).alias("component")).agg(F.coalesce(F.sum(F.col("coef") * F.col("value")), F.lit(0.0)).alias("attrib"))


def normalized(frame: DataFrame) -> DataFrame:
    """Each reference date's attributions over their root of squares; 0 where that is 0."""
    norm = F.sqrt(F.sum(F.col("attrib") * F.col("attrib")).over(Window.partitionBy("ref_date")))
    return frame.withColumn("attrib", F.coalesce(F.try_divide("attrib", norm), F.lit(0.0)))


def attributions(model: Model | IterativeModel, m: Measures, lags: bool = True, normalize: bool = False, ref_dates: Sequence | None = None, factor: str | None = None) -> Attributions:
    """Of a model at its sample's dates (or the given ones), or of each model of an iterative scheme at its own date.

    ``factor`` names the class of a multinomial model.  Document attributions aren't normalised.
    """
    spark = m.panel.sparkSession
    of = lambda f: f.coef[factor] if factor is not None else next(iter(f.coef.values()))
    if isinstance(model, IterativeModel):
        models = list(model.models.items())
        days = list(ref_dates) if ref_dates is not None else [d for d, _ in models]
        first, terms = min(f.dates[0] for _, f in models), [(d, of(f)) for d, (_, f) in zip(days, models)]
        days = days[: len(terms)]
    else:
        (first, last), days, terms = model.dates, ref_dates, of(model)
    if days is None:
        refs = m.panel.select(F.col("date").alias("ref_date")).distinct().where(F.col("ref_date").between(F.lit(first), F.lit(last)))
    else:
        if min(map(str, days)) < str(first):
            raise ValueError("a reference date lies before the first date of the sample")
        refs = spark.createDataFrame([(str(d),) for d in days], "d string").select(F.col("d").cast("date").alias("ref_date")).distinct()
        if not refs.join(m.panel.select(F.col("date").alias("ref_date")), "ref_date", "left_anti").isEmpty():
            raise ValueError("a reference date isn't in the panel")
    coef, base = coefficient_frame(spark, terms), coefficient_frame(spark, terms, m)
    weighted = m.base_weights
    grid = date_grid(weighted, m.control.by, m.control.fill)
    weights = _weights_frame(spark, m.time_weights)
    windows = lag_windows(grid, refs, m.control.lag)
    wrap = normalized if normalize else lambda f: f
    return Attributions(
        (by_document_each if isinstance(model, IterativeModel) else by_document)(weighted, base, windows, weights),
        wrap(by_lag(weighted, base, windows, weights, grid, m.control.fill)) if lags else None,
        *(wrap(by_dimension(m.panel, coef, refs, d)) for d in SERIES),
    )
