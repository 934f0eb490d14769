"""Regressions of a variable on the panel: alignment, cleaning, calibration, iterative evaluation.

A panel is as many rows as there are periods and as many columns as series - hundreds by hundreds, however large the
corpus - so it is collected once (its size is checked), broadcast, and fitted in parallel: a task for each alpha,
for each resample of the cross-validation, or for each window of the iterative scheme.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from . import elasticnet as E
from .aggregation import SERIES
from .panel import series_name
from .scoring import checked_cores

FAMILIES, CRITERIA = ("gaussian", "binomial", "multinomial"), ("BIC", "AIC", "Cp", "cv")
#: Cells of a panel that may be collected for fitting.
MOST_CELLS = 50_000_000


@dataclass(frozen=True)
class ModelControl:
    """How to fit, checked as a whole.  ``start`` counts iterations from 1; ``oos`` periods are skipped before a forecast."""

    model: str = "gaussian"
    kind: str = "BIC"
    intercept: bool = True
    iterative: bool = False
    h: int = 0
    oos: int = 0
    difference: bool = False
    alphas: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
    lambdas: tuple[float, ...] | None = None
    n_sample: int | None = None
    train_window: int | None = None
    test_window: int | None = None
    start: int = 1
    shrink_x: tuple[bool, ...] | bool = False
    cores: int | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "cores", checked_cores(self.cores))
        wrong = []
        if self.model not in FAMILIES:
            wrong.append(f"model must be one of {', '.join(FAMILIES)}")
        if self.kind not in CRITERIA:
            wrong.append(f"kind must be one of {', '.join(CRITERIA)}")
        if self.kind != "cv" and self.model != "gaussian":
            wrong.append("classification is calibrated by cross-validation only")
        if self.kind == "cv" and (not self.train_window or not self.test_window):
            wrong.append("cross-validation needs train_window and test_window")
        if any(not 0 <= a <= 1 for a in self.alphas):
            wrong.append("alphas must lie in [0, 1]")
        if self.lambdas is not None and min(self.lambdas) < 0:
            wrong.append("lambdas must not be negative")
        if self.oos < 0 or self.start < 1:
            wrong.append("oos must not be negative and start must be at least 1")
        if self.iterative and (self.n_sample is None or self.n_sample < 1):
            wrong.append("iterations need n_sample")
        if self.kind == "cv" and self.iterative and self.n_sample and self.train_window and self.test_window and self.n_sample < self.train_window + self.test_window + self.oos:
            wrong.append("n_sample must hold the training and test windows")
        if self.difference and self.model != "gaussian":
            wrong.append("only a numeric response can be differenced")
        if wrong:
            raise ValueError("; ".join(wrong))


@dataclass(frozen=True)
class Model:
    """A fit: coefficients by term for each class (one class named '' unless multinomial)."""

    family: str
    alpha: float
    lam: float
    dates: tuple
    coef: Mapping[str, Mapping[str, float]]
    intercept: Mapping[str, float]
    discarded: Mapping[str, bool]
    n_vars: tuple[int, int]
    levels: tuple[str, ...] = ()
    criterion: Mapping | None = field(default=None)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(class, term, coef), the intercept as '(Intercept)'."""
        rows = [(k, t, float(v)) for k, c in self.coef.items() for t, v in (("(Intercept)", self.intercept[k]), *c.items())]
        return spark.createDataFrame(rows, "class string, term string, coef double")

    def summary(self) -> str:
        """How the model was specified and calibrated, and its coefficients that aren't 0 (their number by class, if multinomial)."""
        how = (self.criterion or {}).get("criterion", "cv")
        lines = [f"model type: {self.family}", f"calibration: {'cross-validation' if how == 'cv' else how + ' information criterion'}", f"sample: {self.dates[0]} to {self.dates[1]}", f"alpha: {self.alpha:.2f}", f"lambda: {self.lam:.2f}"]
        if self.family == "multinomial":
            return "\n".join([*lines, *(f"{k}: {len(c)} coefficients" for k, c in self.nonzero().items())])
        kept = {"(Intercept)": next(iter(self.intercept.values())), **next(iter(self.nonzero().values()))}
        return "\n".join([*lines, *(f"{t}: {v:.6g}" for t, v in kept.items())])

    def nonzero(self) -> dict[str, dict[str, float]]:
        return {k: {t: v for t, v in c.items() if v != 0} for k, c in self.coef.items()}

    def predict(self, new: DataFrame, kind: str = "link") -> DataFrame:
        """(date, class, value) from a long frame (date, term, value): link, response (probabilities) or class."""
        coefs = self.coefficients(new.sparkSession).where("term <> '(Intercept)'")
        base = new.sparkSession.createDataFrame([(k, float(v)) for k, v in self.intercept.items()], "class string, __b double")
        total = new.select("date").distinct().crossJoin(F.broadcast(base)).join(new.join(F.broadcast(coefs), "term").groupBy("date", "class").agg(F.sum(F.col("value") * F.col("coef")).alias("__v")), ["date", "class"], "left")
        total = total.select("date", "class", (F.coalesce("__v", F.lit(0.0)) + F.col("__b")).alias("value"))
        if kind == "link" or self.family == "gaussian":
            return total
        if self.family == "binomial":
            p = 1 / (1 + F.exp(-F.col("value")))
            if kind == "response":
                return total.select("date", F.lit(self.levels[1]).alias("class"), p.alias("value"))
            return total.select("date", F.when(p > 0.5, self.levels[1]).otherwise(self.levels[0]).alias("class"))
        w = Window.partitionBy("date")
        p = total.withColumn("value", F.exp(F.col("value") - F.max("value").over(w)))
        p = p.withColumn("value", F.col("value") / F.sum("value").over(w))
        return p if kind == "response" else p.groupBy("date").agg(F.max_by("class", "value").alias("class"))


def panel_matrix(panel: DataFrame) -> tuple[list, list[str], np.ndarray]:
    """Dates, series names and the matrix of a panel, missing values as 0; refuses panels that are no panels."""
    n = panel.agg(F.countDistinct("date").alias("t"), F.countDistinct(*SERIES).alias("p")).first()
    if n.t * n.p > MOST_CELLS:
        raise ValueError(f"a panel of {n.t} dates and {n.p} series is too large to be fitted in one task")
    df = panel.select("date", series_name().alias("s"), F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).alias("v")).toPandas()
    table = df.pivot(index="date", columns="s", values="v").fillna(0.0).sort_index().sort_index(axis=1)
    return list(table.index), list(table.columns), table.to_numpy(float)


def align(x: np.ndarray, y: np.ndarray, dates: Sequence, h: int = 0, difference: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """x, y and dates so that row k of x meets y at k + h; with ``difference``, y's change over |h| rows."""
    n = len(y)
    if h > 0:
        y = y[h:] - y[:-h] if difference else y[h:]
        return x[: len(y)], y, list(dates[: len(y)])
    if h < 0:
        k = -h
        x, dates = x[k:n], list(dates[k:n])
        return x, (y[k:] - y[:-k]) if difference else y[: len(x)], dates
    return x, y, list(dates)


def discard(x: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """Which columns repeat an earlier one, or are 0 in more than ``threshold`` of the rows."""
    seen: set[bytes] = set()
    out = (x == 0).mean(axis=0) > threshold
    for j in range(x.shape[1]):
        key = (x[:, j] + 0.0).tobytes()
        out[j] |= key in seen
        seen.add(key)
    return out


def cv_slices(n: int, train: int, test: int = 1, skip: int = 0, reverse: bool = False) -> list[tuple[range, range]]:
    """Training and test rows (from 1) of each rolling origin."""
    if train + skip + test >= n:
        raise ValueError("the windows leave no room in the sample")
    if reverse:
        return [(range(s - train + 1, s + 1), range(s - skip - train, s - skip - train - test, -1)) for s in range(n, train + skip + test - 1, -1)]
    return [(range(s - train + 1, s + 1), range(s + skip + 1, s + skip + test + 1)) for s in range(train, n - skip - test + 1)]


def _fit(family: str, x: np.ndarray, y: np.ndarray, alpha: float, lambdas: Sequence[float] | None, penalty: np.ndarray, intercept: bool, classes: int) -> E.Path:
    return E.gaussian(x, y, alpha, lambdas, penalty, intercept) if family == "gaussian" else E.logistic(x, y, alpha, lambdas, penalty, intercept, classes)


def _classes(path: E.Path, k: int, x: np.ndarray) -> np.ndarray:
    z = x @ path.coef[k].T + path.intercept[k]
    return (z[:, 0] > 0).astype(int) if z.shape[1] == 1 else z.argmax(axis=1)


def _ic_path(x: np.ndarray, y: np.ndarray, alpha: float, c: ModelControl, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    path = E.gaussian(x, y, alpha, c.lambdas, penalty, c.intercept)
    fitted = x @ path.coef[:, 0, :].T + path.intercept[:, 0]
    df = np.array([E.degrees_of_freedom(x, b[0], alpha, lam) for b, lam in zip(path.coef, path.lambdas)])
    return path.lambdas, df, ((y[:, None] - fitted) ** 2).sum(axis=0)


def choose_ic(kind: str, n: int, alphas: Sequence[float], paths: Sequence[tuple]) -> tuple[float, float, list]:
    """(alpha, lambda, criterion by alpha): sigma squared comes from the fit of the most degrees of freedom."""
    best = max(((d, -k, -a) for a, (_, df, _) in enumerate(paths) for k, d in enumerate(df)), default=None)
    d, k, a = best[0], -best[1], -best[2]
    rest = n - min(n, d)
    sigma2 = paths[a][2][k] / rest if rest > 0 else math.inf
    table = [E.criterion(kind, n, df, rss, sigma2) for _, df, rss in paths]
    value, k, a = min((v, k, a) for a, row in enumerate(table) for k, v in enumerate(row))
    return alphas[a], float(paths[a][0][k]), [t.tolist() for t in table]


def _cv_lambdas(c: ModelControl) -> np.ndarray:
    return np.sort(np.asarray(c.lambdas if c.lambdas is not None else 10 ** np.linspace(2, -2, 100), float))[::-1]


def _cv_scores(x: np.ndarray, y: np.ndarray, alpha: float, train: range, test: range, c: ModelControl, penalty: np.ndarray, classes: int) -> np.ndarray:
    """Loss by lambda of one resample: squared error's root, or the share of wrong classes."""
    a, b = np.array(train) - 1, np.array(test) - 1
    path = _fit(c.model, x[a], y[a], alpha, _cv_lambdas(c), penalty, c.intercept, classes)
    if c.model == "gaussian":
        err = x[b] @ path.coef[:, 0, :].T + path.intercept[:, 0] - y[b][:, None]
        return np.sqrt((err**2).mean(axis=0))
    return np.array([(_classes(path, k, x[b]) != y[b]).mean() for k in range(len(path.lambdas))])


def _choose(x: np.ndarray, y: np.ndarray, c: ModelControl, penalty: np.ndarray, classes: int, spark: SparkSession | None) -> tuple[float, float, dict | None]:
    """Alpha and lambda; in parallel if a session is given, else in this process."""
    if c.kind == "cv":
        slices = cv_slices(len(y), c.train_window, c.test_window, c.oos)
        lams = _cv_lambdas(c)
        if len(c.alphas) * len(lams) == 1:
            return c.alphas[0], float(lams[0]), None
        jobs = list(product(range(len(c.alphas)), range(len(slices))))
        work = lambda a, s: _cv_scores(x, y, c.alphas[a], *slices[s], c, penalty, classes).tolist()
        got = _parallel(spark, jobs, work)
        mean = np.array([np.mean([got[(a, s)] for s in range(len(slices))], axis=0) for a in range(len(c.alphas))])
        at = np.unravel_index(mean.argmin(), mean.shape)
        return c.alphas[at[0]], float(lams[at[1]]), {"criterion": "cv", "alphas": list(c.alphas), "lambdas": lams.tolist(), "matrix": mean.tolist()}
    work = lambda a, _: [v.tolist() for v in _ic_path(x, y, c.alphas[a], c, penalty)]
    got = _parallel(spark, [(a, 0) for a in range(len(c.alphas))], work)
    paths = [tuple(np.array(v) for v in got[(a, 0)]) for a in range(len(c.alphas))]
    alpha, lam, table = choose_ic(c.kind, len(y), c.alphas, paths)
    return alpha, lam, {"criterion": c.kind, "alphas": list(c.alphas), "lambdas": [p[0].tolist() for p in paths], "matrix": table}


def _parallel(spark: SparkSession | None, jobs: list[tuple[int, int]], work) -> dict:  # noqa: ANN001
    if spark is None:
        return {j: work(*j) for j in jobs}
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"a": pdf.a, "s": pdf.s, "r": [json.dumps(work(a, s)) for a, s in zip(pdf.a, pdf.s)]})

    tasks = spark.createDataFrame(jobs, "a int, s int").repartition(min(len(jobs), 1000), "a", "s")
    return {(r.a, r.s): json.loads(r.r) for r in tasks.mapInPandas(run, "a int, s int, r string").collect()}


def _one(x: np.ndarray, names: list[str], nx: int, y: np.ndarray, dates: Sequence, c: ModelControl, levels: tuple[str, ...], spark: SparkSession | None) -> Model:
    p = x.shape[1] - nx
    gone = discard(x[:, :p])
    if gone.all():
        raise ValueError("no series is left after cleaning: too many repeated or zero ones")
    keep = np.concatenate([~gone, np.ones(nx, bool)])
    kept, xx = [n for n, k in zip(names, keep) if k], x[:, keep]
    shrink = c.shrink_x if isinstance(c.shrink_x, tuple) else (c.shrink_x,) * nx
    penalty = np.array([1.0] * int((~gone).sum()) + [float(s) for s in shrink][:nx])
    alpha, lam, table = _choose(xx, y, c, penalty, max(len(levels), 2), spark)
    path = _fit(c.model, xx, y, alpha, [lam], penalty, c.intercept, max(len(levels), 2))
    classes = levels if c.model == "multinomial" else ("",)
    return Model(c.model, alpha, lam, (dates[0], dates[len(y) - 1]), {k: dict(zip(kept, map(float, path.coef[0][i]))) for i, k in enumerate(classes)},
                 {k: float(path.intercept[0][i]) for i, k in enumerate(classes)}, dict(zip(names[:p], map(bool, gone))), (p, nx), levels, table)


@dataclass(frozen=True)
class Inputs:
    dates: list
    names: list[str]
    nx: int
    x: np.ndarray
    y: np.ndarray
    levels: tuple[str, ...]


def inputs(panel: DataFrame, y: Sequence, x: Mapping[str, Sequence[float]] | None, c: ModelControl) -> Inputs:
    """The panel as a matrix with the other regressors behind, y as numbers or class numbers."""
    dates, names, m = panel_matrix(panel)
    if len(y) != len(dates) or any(len(v) != len(dates) for v in (x or {}).values()):
        raise ValueError("y and x need a value for each date of the panel")
    levels: tuple[str, ...] = ()
    if c.model == "gaussian":
        yy = np.asarray(y, float)
    else:
        levels = tuple(sorted({str(v) for v in y}))
        if (c.model == "binomial") != (len(levels) <= 2) or len(levels) < 2:
            raise ValueError("binomial models need two classes, multinomial ones at least three")
        yy = np.array([levels.index(str(v)) for v in y])
    if x:
        m = np.column_stack([m, *(np.nan_to_num(np.asarray(v, float)) for v in x.values())])
    return Inputs(dates, names + list(x or {}), len(x or {}), m, yy, levels)


def fit(panel: DataFrame, y: Sequence, c: ModelControl, x: Mapping[str, Sequence[float]] | None = None) -> Model | IterativeModel:
    """Fits y (in order of the panel's dates) on the panel and further regressors, once or in rolling windows."""
    d = inputs(panel, y, x, c)
    if c.iterative:
        return _iterative(panel.sparkSession, d, c)
    xx, yy, dates = align(d.x, d.y, d.dates, c.h, c.difference)
    return _one(xx, d.names, d.nx, yy, dates, c, d.levels, panel.sparkSession)


@dataclass(frozen=True)
class IterativeModel:
    """Models by the dates of their forecasts, and how the forecasts did."""

    models: Mapping
    performance: pd.DataFrame
    figures: Mapping[str, float]

    def alphas(self) -> list[float]:
        return [m.alpha for m in self.models.values()]

    def lambdas(self) -> list[float]:
        return [m.lam for m in self.models.values()]

    def summary(self) -> str:
        """How the models were specified, and how their forecasts did."""
        first = next(iter(self.models.values()))
        rows = [f"{k}: {v:.2f}" for k, v in self.figures.items()]
        return "\n".join([f"model type: {first.family}", f"forecasts: {len(self.models)}", f"mean alpha: {np.mean(self.alphas()):.2f}", f"mean lambda: {np.mean(self.lambdas()):.2f}", *rows])

    def plot_frame(self) -> pd.DataFrame:
        """(date, variable, value) for drawing realized and predicted values."""
        return self.performance.rename(columns={"response": "realized", "predicted": "prediction"}).melt("date", ["realized", "prediction"])


def _iterative(spark: SparkSession, d: Inputs, c: ModelControl) -> IterativeModel:
    """A row for each window; each is fitted where its row is."""
    n_iter = len(d.y) - c.n_sample - abs(c.h) - c.oos
    if n_iter <= 0 or c.start > n_iter:
        raise ValueError("too few rows for one iteration with this sample, horizon, skip and start")
    xx, yy, dates = align(d.x, d.y, d.dates, c.h, c.difference)
    ship(spark)
    shared = spark.sparkContext.broadcast((xx, yy, [str(t) for t in dates], d.names, d.nx, d.levels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, days, names, nx, levels = shared.value
        for pdf in batches:
            out = []
            for i in pdf.id:
                rows = slice(i - 1, i - 1 + c.n_sample)
                m = _one(x[rows], names, nx, y[rows], days[rows], c, levels, None)
                out.append(json.dumps([m.alpha, m.lam, m.dates, m.coef, m.intercept, m.discarded]))
            yield pd.DataFrame({"id": pdf.id, "model": out})

    tasks = spark.range(c.start, n_iter + 1).repartition(min(1000, n_iter - c.start + 1), "id")
    got = {r.id: json.loads(r.model) for r in tasks.mapInPandas(run, "id bigint, model string").collect()}
    by_text = {str(t): t for t in dates}
    models, rows = {}, []
    for i in range(c.start, n_iter + 1):
        alpha, lam, span, coef, icept, gone = got[i]
        m = Model(c.model, alpha, lam, tuple(by_text[s] for s in span), coef, icept, gone, (len(d.names) - d.nx, d.nx), d.levels)
        at = i - 1 + c.n_sample + c.oos
        models[dates[at]] = m
        z = {k: icept[k] + sum(v * xx[at, d.names.index(t)] for t, v in cc.items()) for k, cc in coef.items()}
        if c.model == "gaussian":
            rows.append((dates[at], float(yy[at]), z[""]))
        else:
            guess = d.levels[int(z[""] > 0)] if c.model == "binomial" else max(z, key=z.get)
            rows.append((dates[at], d.levels[int(yy[at])], guess))
    raw = pd.DataFrame(rows, columns=["date", "response", "predicted"])
    raw, figures = performance(raw) if c.model == "gaussian" else accuracy(raw)
    return IterativeModel(models, raw, figures)


def performance(raw: pd.DataFrame) -> tuple[pd.DataFrame, dict[str, float]]:
    """Adds DA (equal signs of changes), error, errorSq and AD; MDA in per cent, RMSFE and MAD."""
    e = raw.predicted - raw.response
    da = (np.sign(raw.response.diff()) == np.sign(raw.predicted.diff())).astype(float)
    da.iloc[:1] = np.nan
    raw = raw.assign(DA=da, error=e, errorSq=e**2, AD=e.abs())
    return raw, {"MDA": float(da.mean() * 100), "RMSFE": float(np.sqrt((e**2).mean())), "MAD": float(e.abs().mean())}


def accuracy(raw: pd.DataFrame) -> tuple[pd.DataFrame, dict[str, float]]:
    raw = raw.assign(accuracy=(raw.response == raw.predicted).astype(float))
    return raw, {"accuracy": float(raw.accuracy.mean() * 100)}


def loss_table(models: Mapping[str, IterativeModel], loss: str = "errorSq") -> pd.DataFrame:
    """Losses by date (rows) and model; DA and accuracy turn into 1 - value, and DA loses the first row."""
    if loss not in ("DA", "errorSq", "AD", "accuracy"):
        raise ValueError("loss must be DA, errorSq, AD or accuracy")
    out = pd.DataFrame({k: m.performance.set_index("date")[loss] for k, m in models.items()})
    if loss in ("DA", "accuracy"):
        out = 1 - out
    return out.iloc[1:] if loss == "DA" else out
