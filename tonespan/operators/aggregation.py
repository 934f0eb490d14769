"""From sentiment of sentences or documents to a panel of rolling series.

All frames are long: one row for each lexicon and feature.  Weighted means of groups are single aggregates that are
combined map-side; document weights themselves are only made where attribution asks for them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import weights as W
from .corpus import check_names, period
from .scoring import checked_cores

FILLS = ("zero", "latest", "none")


@dataclass(frozen=True)
class Aggregation:
    """How to aggregate, checked as a whole: all that is wrong is told at once.

    A lag of 1 leaves nothing to weigh over time (scheme ``dummyTime``); own weights decide the lag and join the schemes.
    """

    within: str = "proportional"
    docs: str = "equal_weight"
    time: tuple[str, ...] = ("equal_weight",)
    sentence: bool = False
    ignore_zeros: bool = True
    by: str = "day"
    lag: int = 1
    fill: str = "zero"
    alpha_docs: float = 0.1
    alphas: tuple[float, ...] = tuple(k / 10 for k in range(1, 6))
    inverse_exp: bool = False
    orders: tuple[int, ...] = (1, 2, 3)
    inverse_almon: bool = True
    a: tuple[float, ...] = (1, 2, 3, 4)
    b: tuple[float, ...] = (1, 2, 3, 4)
    own: Mapping[str, Sequence[float]] | None = field(default=None)
    tokens: str | None = None
    cores: int | None = None

    def __post_init__(self) -> None:
        set_ = lambda k, v: object.__setattr__(self, k, v)
        if isinstance(self.time, str):
            set_("time", (self.time,))
        wrong = []
        set_("cores", checked_cores(self.cores))
        if self.lag == 1:
            set_("time", ("own",))
            set_("own", {"dummyTime": [1.0]})
        elif self.own:
            sizes = {len(v) for v in self.own.values()}
            if len(sizes) != 1:
                wrong.append("own weights differ in length")
            else:
                set_("lag", sizes.pop())
            set_("time", tuple(dict.fromkeys((*self.time, "own"))))
        elif "own" in self.time:
            wrong.append("the scheme 'own' needs weights")
        for what, chosen, of in (("within", (self.within,), W.WITHIN), ("docs", (self.docs,), W.DOCS), ("time", self.time, W.TIME), ("by", (self.by,), ("year", "month", "week", "day")), ("fill", (self.fill,), FILLS)):
            wrong += [f"{what}: {c!r} is none of {', '.join(of)}" for c in chosen if c not in of]
        if self.lag <= 0:
            wrong.append("lag must be positive")
        if min(self.alphas) <= 0 or max(self.alphas) > 1:
            wrong.append("alphas must lie in (0, 1]")
        if not 0 < self.alpha_docs <= 1:
            wrong.append("alpha_docs must lie in (0, 1]")
        if min(self.orders) <= 0 or min(*self.a, *self.b) <= 0:
            wrong.append("orders and beta parameters must be positive")
        if wrong:
            raise ValueError("; ".join(wrong))

    def time_weights(self) -> dict[str, list[float]]:
        return W.time_weights(self.time, self.lag, self.alphas, self.inverse_exp, self.orders, self.inverse_almon, self.a, self.b, self.own)


def no_nan(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def sentences_to_docs(sent: DataFrame, how: str = "equal_weight", ignore_zeros: bool = True) -> DataFrame:
    """Document sentiment: weighted sums over a document's sentences; words are added up.  A document without a weighted sentence scores 0."""
    keys = ["id", *(["date"] if "date" in sent.columns else []), "lexicon", "feature"]
    score = no_nan(F.col("score"))
    value = F.when(score != 0, score) if ignore_zeros else score
    rows = sent.select(*keys, "word_count", value.alias("__v"))
    total = F.coalesce(W.weighted_sum(how, F.col("__v"), F.col("word_count"), ignore_zeros), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.sum("word_count").alias("word_count"), total.alias("score"))


def dated(sent: DataFrame, by: str, ignore_zeros: bool) -> DataFrame:
    """Document sentiment at the first days of periods, zeros as nulls if they are ignored."""
    score = no_nan(F.col("score"))
    return sent.select("id", period(F.col("date"), by).alias("date"), "word_count", "lexicon", "feature", (F.when(score != 0, score) if ignore_zeros else score).alias("score"))


def docs_to_dates(sent: DataFrame, how: str = "equal_weight", by: str = "day", ignore_zeros: bool = True) -> DataFrame:
    """(date, lexicon, feature, value): weighted sums over the documents of each period, 0 where none has a weight."""
    rows = dated(sent, by, ignore_zeros)
    total = F.coalesce(W.weighted_sum(how, F.col("score"), F.col("word_count"), ignore_zeros), F.lit(0.0))
    return rows.groupBy("date", "lexicon", "feature").agg(total.alias("value"))


def document_weights(sent: DataFrame, how: str, by: str, ignore_zeros: bool) -> DataFrame:
    """(id, date, lexicon, feature, score, w): the weight of each document in its period.

    Totals are a small aggregate (one row for each period and series) that is joined back; no window sorts the documents.
    """
    rows = dated(sent, by, ignore_zeros)
    score, words = F.col("score"), F.col("word_count")
    totals = rows.groupBy("date", "lexicon", "feature").agg(*W.group_totals(how, score, words, ignore_zeros))
    return rows.join(totals, ["date", "lexicon", "feature"]).select("id", "date", "lexicon", "feature", "score", W.document_weight(how, score, words, ignore_zeros).alias("w"))


SERIES = ("lexicon", "feature", "time")


def series_of(panel: DataFrame) -> list[str]:
    return [c for c in SERIES if c in panel.columns]


_STEP = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "year": "interval 1 year"}


def filled(panel: DataFrame, by: str, fill: str = "zero", before: str | None = None, after: str | None = None) -> DataFrame:
    """A row for each period from the first (or ``before``) to the last (or ``after``) and each series.

    ``zero`` sets 0 where there is nothing, ``latest`` the last value before; with ``before`` the first row takes the first known ones.
    """
    if fill not in ("zero", "latest"):
        raise ValueError("fill must be 'zero' or 'latest'")
    keys = series_of(panel)
    # one reading of the panel, which may be made from texts: a row for each series, with its values by date
    there = F.when(F.col("date").isNotNull(), F.struct("date", "value"))
    series = panel.groupBy(*keys).agg(F.min("date").alias("__lo"), F.max("date").alias("__hi"), F.map_from_entries(F.collect_list(there)).alias("__v"))
    everyone = Window.partitionBy()
    low, high = F.min("__lo").over(everyone), F.max("__hi").over(everyone)
    if before is not None:
        low = F.least(low, period(F.lit(before).cast("date"), by))
    if after is not None:
        high = F.greatest(high, period(F.lit(after).cast("date"), by))
    series = series.select(*keys, "__v", low.alias("__lo"), high.alias("__hi")).where("__lo is not null")
    full = series.select(F.explode(F.sequence("__lo", "__hi", F.expr(_STEP[by]))).alias("date"), *keys, "__v").select("date", *keys, F.col("__v")[F.col("date")].alias("value"))
    if fill == "zero":
        return full.withColumn("value", F.coalesce("value", F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy("date")
    value = F.last("value", ignorenulls=True).over(w)
    if before is not None:
        value = F.coalesce(value, F.first("value", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return full.select("date", *keys, value.alias("value"))


def rolled(panel: DataFrame, weights: Mapping[str, Sequence[float]]) -> DataFrame:
    """(date, lexicon, feature, time, value): right-aligned weighted sums of the last rows of each series, the first weight for the most lagged.

    Missing values are skipped; rows without a whole window are left out.  The query fails if a series is shorter than the
    window, or if a name is one of two dimensions: checks that run along with the rows, without a job of their own.
    """
    lag = len(next(iter(weights.values())))
    keys = series_of(panel)
    series = Window.partitionBy(*keys)
    frame = series.orderBy("date").rowsBetween(1 - lag, 0)
    short = F.count("*").over(series) < lag
    rows = panel.select(*panel.columns, F.collect_list(F.struct(no_nan(F.col("value")).alias("v"))).over(frame).alias("__v"), short.alias("__short"))
    whole = F.when(F.col("__short"), F.raise_error(F.lit(f"the window of {lag} rows is longer than a series")).cast("boolean"))
    if {"lexicon", "feature"} <= set(keys):
        named = (F.col("lexicon") == F.col("feature")) | F.col("lexicon").isin(list(weights)) | F.col("feature").isin(list(weights))
        whole = whole.when(named, F.raise_error(F.concat_ws(" ", F.lit("a name occurs in more than one dimension:"), "lexicon", "feature")).cast("boolean"))
    rows = rows.where(whole.otherwise(F.size("__v") == lag))

    def total(ws: Sequence[float]) -> Column:
        products = F.zip_with("__v", F.array(*map(F.lit, map(float, ws))), lambda s, w: F.coalesce(s["v"] * w, F.lit(0.0)))
        return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)

    schemes = F.array(*(F.struct(F.lit(k).alias("time"), total(ws).alias("value")) for k, ws in weights.items()))
    return rows.select("date", *keys, F.inline(schemes))


def check_component_names(lexicons: Sequence[str], features: Sequence[str], times: Sequence[str]) -> None:
    """The same check where the names are known beforehand."""
    names = [*features, *lexicons, *times]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"names occur in more than one dimension: {', '.join(twice)}")


def merged(*tables: DataFrame) -> DataFrame:
    """Long sentiment tables put together; rows that are alike in all keys and the score count once, and what a table lacks counts as 0.

    In the long form a missing series is a missing row; :func:`completed` adds the zeros.
    """
    if len(tables) < 2:
        raise ValueError("give at least two sentiment tables")
    sentence = any("sentence_id" in t.columns for t in tables)
    out = None
    for t in tables:
        if sentence and "sentence_id" not in t.columns:
            t = t.withColumn("sentence_id", F.lit(1))
        out = t if out is None else out.unionByName(t)
    return completed(out.distinct())


def completed(sent: DataFrame) -> DataFrame:
    """A row for each document (or sentence) and each lexicon and feature of the table, 0 where there was none."""
    keys = [c for c in sent.columns if c not in ("lexicon", "feature", "score")]
    series = sent.select("lexicon", "feature").distinct().agg(F.collect_set(F.struct("lexicon", "feature")).alias("__series"))
    have = sent.groupBy(*keys).agg(F.collect_list(F.struct("lexicon", "feature", "score")).alias("__have"))
    both = have.crossJoin(F.broadcast(series))
    lacking = F.transform(F.array_except("__series", F.transform("__have", lambda h: F.struct(h["lexicon"], h["feature"]))), lambda s: F.struct(s["lexicon"].alias("lexicon"), s["feature"].alias("feature"), F.lit(0.0).alias("score")))
    return both.select(*keys, F.inline(F.concat("__have", lacking))).withColumn("score", F.coalesce("score", F.lit(0.0)))


def as_sentiment(df: DataFrame) -> DataFrame:
    """Long sentiment from a wide table with id, date, word_count and score columns ``lexicon`` or ``lexicon--feature`` (what follows a second '--' is cut off)."""
    for c, kinds in (("id", ("string",)), ("date", ("date",)), ("word_count", ("double", "int", "bigint", "float"))):
        if dict(df.dtypes).get(c) not in kinds:
            raise ValueError(f"column {c} must exist, as {kinds[0]}")
    keys = [c for c in ("id", "sentence_id", "date", "word_count") if c in df.columns]
    scores = [c for c in df.columns if c not in keys]
    if not scores or set(scores) - {c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")}:
        raise ValueError("there must be at least one score column, and all must be numeric")
    names = [(*c.split("--"), "dummyFeature")[:2] for c in scores]
    if len(set(names)) < len(names):
        raise ValueError("names of score columns must be unique")
    check_names([*dict.fromkeys(n for n, _ in names)])
    rows = F.array(*(F.struct(F.lit(a).alias("lexicon"), F.lit(b).alias("feature"), F.col(f"`{c}`").cast("double").alias("score")) for c, (a, b) in zip(scores, names)))
    return df.select(*keys, F.inline(rows)).withColumn("word_count", F.col("word_count").cast("double"))


def peaks(df: DataFrame, key: str, value: str, n: float = 10, kind: str = "both", average: bool = False) -> DataFrame:
    """The keys of the n largest (or smallest, or largest absolute) values, each once; ``n`` below 1 is a share of all keys, rounded down.

    ``average`` takes the mean of a key's values first.  Ties go by the key.  A partial aggregate and a bounded top-n: no full sort.
    """
    if kind not in ("both", "neg", "pos"):
        raise ValueError("kind must be both, neg or pos")
    x = no_nan(F.col(value))
    if average:
        df, x = df.groupBy(key).agg(F.avg(x).alias(value)), F.col(value)
    x = F.abs(x) if kind == "both" else -x if kind == "neg" else x
    top = df.groupBy(key).agg(F.max(x).alias("__x"))
    if n < 1:
        n = int(top.count() * n)
    return top.orderBy(F.desc_nulls_last("__x"), key).limit(int(n)).select(key)
