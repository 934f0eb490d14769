"""Elastic nets against optimality conditions, closed forms and another implementation; models; attribution sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonespan.operators import aggregation as A
from tonespan.operators import attribution as H
from tonespan.operators import elasticnet as E
from tonespan.operators import model as M
from tonespan.operators import panel as P
from tonespan.plans import base as B

SF = "/root/testdata/sf0.001"


def data(n=60, p=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * rng.uniform(0.5, 3, p)
    return x, x @ rng.normal(size=p) + rng.normal(size=n) + 2


@pytest.mark.parametrize("alpha", [0.0, 0.3, 1.0])
@pytest.mark.parametrize("penalty", [None, np.array([0.0, 1, 1, 1, 2, 1, 1, 1])])
def test_optimality(alpha, penalty):
    x, y = data()
    path = E.gaussian(x, y, alpha, [1.0, 0.3, 0.05], penalty)
    xs, f = (x - x.mean(0)) / x.std(0), E._factors(penalty, x.shape[1])
    for lam, b, b0 in zip(path.lambdas, path.coef[:, 0], path.intercept[:, 0]):
        s, ys = b * x.std(0) / y.std(), (y - y.mean()) / y.std()
        slope = xs.T @ (ys - xs @ s) / len(y) - lam / y.std() * (1 - alpha) * f * s
        on = s != 0
        assert np.allclose(slope[on], (lam / y.std() * alpha * f * np.sign(s))[on], atol=1e-6)
        assert (np.abs(slope[~on]) <= (lam / y.std() * alpha * f)[~on] + 1e-6).all()
        assert b0 == pytest.approx(y.mean() - x.mean(0) @ b)


def test_ridge_closed_form():
    x, y = data(seed=1)
    b = E.gaussian(x, y, 0.0, [0.5]).coef[0, 0]
    xs, ys = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    want = np.linalg.solve(xs.T @ xs / len(y) + 0.5 / y.std() * np.eye(x.shape[1]), xs.T @ ys / len(y))
    assert np.allclose(b, want * y.std() / x.std(0))


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_like_another_implementation(spark, alpha):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    x, y = data(seed=2)
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"x{k}" for k in range(8)]).assign(label=y))
    df = VectorAssembler(inputCols=[f"x{k}" for k in range(8)], outputCol="features").transform(df)
    fit = LinearRegression(elasticNetParam=alpha, regParam=0.3, tol=1e-12, maxIter=1000, solver="l-bfgs").fit(df)
    assert np.allclose(E.gaussian(x, y, alpha, [0.3], ddof=1).coef[0, 0], fit.coefficients.toArray(), atol=1e-5)


def test_path_and_degrees_of_freedom():
    x, y = data(seed=3)
    path = E.gaussian(x, y, 1.0)
    assert (path.coef[0] == 0).all() and (path.coef[-1] != 0).any() and (np.diff(path.lambdas) < 0).all()
    assert E.degrees_of_freedom(x, np.zeros(8), 0.5, 1.0) == 1 and E.degrees_of_freedom(x, path.coef[-1, 0], 1.0, 1.0) == (path.coef[-1] != 0).sum()
    xs = (x - x.mean(0)) / x.std(0, ddof=1)
    b = np.array([1.0, 0, 2, 3, 0, 0, 0, 1])
    a = xs[:, b != 0]
    assert E.degrees_of_freedom(x, b, 0.4, 2.0) == pytest.approx(np.trace(a @ np.linalg.inv(a.T @ a + 0.6 * 2.0 * np.eye(4)) @ a.T))


def test_logistic_optimality():
    x, y = data(200, 5, 4)
    c = (y > 2).astype(int)
    path = E.logistic(x, c, 0.5, [0.05])
    xs = (x - x.mean(0)) / x.std(0)
    p = 1 / (1 + np.exp(-(x @ path.coef[0, 0] + path.intercept[0, 0])))
    s = path.coef[0, 0] * x.std(0)
    slope = xs.T @ (c - p) / len(c) - 0.05 * 0.5 * s
    assert np.allclose(slope[s != 0], 0.025 * np.sign(s[s != 0]), atol=1e-4) and (np.abs(slope[s == 0]) <= 0.025 + 1e-4).all()
    assert (c - p).mean() == pytest.approx(0, abs=1e-5)
    three = np.digitize(y, [0, 4])
    many = E.logistic(x, three, 0.5, [0.02], classes=3)
    assert ((x @ many.coef[0].T + many.intercept[0]).argmax(1) == three).mean() > 0.8


def test_alignment_and_slices():
    x, y, d = np.arange(10.0)[:, None], np.arange(10.0) ** 2, list(range(10))
    assert [v.tolist() if hasattr(v, "tolist") else v for v in M.align(x, y, d, 2)][1:] == [(np.arange(2.0, 10) ** 2).tolist(), list(range(8))]
    xx, yy, dd = M.align(x, y, d, -1)
    assert xx[0, 0] == 1 and yy[0] == 0 and len(xx) == len(yy) == 9 and dd[0] == 1
    assert M.align(x, y, d, 3, True)[1].tolist() == (y[3:] - y[:-3]).tolist()
    s = M.cv_slices(10, 4, 2, 1)
    assert [(list(a), list(b)) for a, b in s][0] == ([1, 2, 3, 4], [6, 7]) and len(s) == 4 and list(s[-1][1]) == [9, 10]
    with pytest.raises(ValueError):
        M.cv_slices(7, 4, 2, 1)
    assert M.discard(np.array([[1.0, 1, 0, 2], [2, 2, 0, 3], [3, 3, 5, 0], [0, 0, 0, 4]])).tolist() == [False, True, True, False]


def test_controls():
    with pytest.raises(ValueError, match="model.*alphas"):
        M.ModelControl(model="x", alphas=(2.0,))
    with pytest.raises(ValueError):
        M.ModelControl(kind="cv")
    with pytest.raises(ValueError):
        M.ModelControl(iterative=True)


def test_criteria():
    df, rss = np.array([1.0, 3.0]), np.array([50.0, 20.0])
    assert E.criterion("BIC", 100, df, rss, 0.3) == pytest.approx(rss / 30 + np.log(100) / 100 * df)
    assert E.criterion("AIC", 100, df, rss, 0.3) == pytest.approx(rss / 30 + 0.02 * df)
    assert E.criterion("Cp", 100, df, rss, 0.3) == pytest.approx(rss / 100 + 0.02 * df * 0.3)


@pytest.fixture(scope="module")
def measured(spark):
    m = P.aggregate(A.as_sentiment(B.events(spark, SF)), B.CONTROL)
    return P.Measures(m.panel.persist(), m.sentiment.persist(), m.control)


@pytest.fixture(scope="module")
def response(measured):
    dates, names, x = M.panel_matrix(measured.panel)
    return list(x @ np.linspace(-1, 1, len(names)) + np.sin(np.arange(len(dates))))


@pytest.mark.parametrize("kind", ["BIC", "AIC", "Cp"])
def test_information_criteria(measured, response, kind):
    fit = M.fit(measured.panel, response, M.ModelControl(kind=kind, alphas=(0.2, 1.0)), {"x1": np.arange(len(response)) / 10})
    table = fit.criterion
    a = table["alphas"].index(fit.alpha)
    assert table["matrix"][a][table["lambdas"][a].index(fit.lam)] == min(v for row in table["matrix"] for v in row)
    assert fit.n_vars == (8, 1) and "x1" in fit.coef[""]


def test_cross_validation_and_classes(measured, response):
    c = M.ModelControl(kind="cv", alphas=(0.5,), lambdas=(0.5, 0.1, 0.02), train_window=20, test_window=4)
    fit = M.fit(measured.panel, response, c)
    scores = fit.criterion["matrix"][0]
    assert fit.lam == fit.criterion["lambdas"][int(np.argmin(scores))]
    labels = ["up" if v > np.median(response) else "down" for v in response]
    two = M.fit(measured.panel, labels, M.ModelControl(model="binomial", kind="cv", alphas=(0.5,), lambdas=(0.1, 0.02), train_window=25, test_window=5))
    assert two.levels == ("down", "up")
    new = measured.panel.select("date", P.series_name().alias("term"), "value")
    p = {r.date: r.value for r in two.predict(new, "response").collect()}
    c = {r.date: r["class"] for r in two.predict(new, "class").collect()}
    assert all((p[d] > 0.5) == (c[d] == "up") for d in p)
    with pytest.raises(ValueError):
        M.fit(measured.panel, labels, M.ModelControl(model="multinomial", kind="cv", train_window=20, test_window=4))


def test_attributions_add_up(measured, response):
    fit = M.fit(measured.panel, response, M.ModelControl(kind="AIC", alphas=(0.3,)))
    new = measured.panel.select("date", P.series_name().alias("term"), "value")
    predicted = {r.date: r.value - fit.intercept[""] for r in fit.predict(new).collect()}
    a = H.attributions(fit, measured)
    for frame in (a.lexicons, a.features, a.time, a.lags, a.documents):
        got = {r.ref_date: r.s for r in frame.groupBy("ref_date").agg(F.sum("attrib").alias("s")).collect()}
        assert {d: got.get(d, 0.0) for d in predicted} == pytest.approx(predicted, abs=1e-6)  # a window without documents has none
    norm = H.attributions(fit, measured, lags=False, normalize=True)
    assert norm.lags is None and all(r.s == pytest.approx(1) or r.s == 0 for r in norm.features.groupBy("ref_date").agg(F.sum(F.col("attrib") ** 2).alias("s")).collect())
    with pytest.raises(ValueError):
        H.attributions(fit, measured, ref_dates=["1990-01-01"])


def test_attributions_of_grouped_panels_add_up(measured, response):
    g = measured.aggregate(lexicons={"LEX": ["lexA", "lexB"]}, features={"ANY": ["up", "down"]}, time={"T": ["equal_weight", "linear"]})
    days = [r.date for r in g.dates().orderBy("date").collect()]
    model = M.Model("gaussian", 1.0, 0.1, (days[0], days[-1]), {"": {"LEX--ANY--T": 0.7}}, {"": 0.1}, {}, (1, 0))
    at = H.attributions(model, g)
    total = lambda f: {r.ref_date: r.t for r in f.groupBy("ref_date").agg(F.sum("attrib").alias("t")).collect()}
    want = total(at.lexicons)
    assert max(map(abs, want.values())) > 0.1
    for f in (at.documents, at.lags, at.features, at.time):
        got = total(f)  # a date without documents in its window has none to attribute to
        assert got.keys() <= want.keys() and all(got.get(k, 0.0) == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_iterative_attributions_are_those_of_each_model(measured):
    days = [r.date for r in measured.dates().orderBy("date").collect()]
    names = ["--".join(r) for r in measured.panel.select("lexicon", "feature", "time").distinct().orderBy("lexicon", "feature", "time").collect()]
    one = lambda k: M.Model("gaussian", 1.0, 0.1, (days[0], days[-1]), {"": {n: 0.1 * (i + 1) * k for i, n in enumerate(names[:5])}}, {"": 0.0}, {}, (8, 0))
    models = {days[6]: one(1), days[9]: one(-2), days[12]: one(3)}
    many = H.attributions(M.IterativeModel(models, pd.DataFrame(), {}), measured)
    for part in ("documents", "lags", "lexicons", "features", "time"):
        keys = [c for c in getattr(many, part).columns if c != "attrib"]
        got = {tuple(r[c] for c in keys): r.attrib for r in getattr(many, part).collect()}
        want = {tuple(r[c] for c in keys): r.attrib for d, m in models.items() for r in getattr(H.attributions(m, measured, ref_dates=[d]), part).collect()}
        got, want = ({k: v for k, v in x.items() if abs(v) > 1e-12} for x in (got, want))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items()), part
    few, more = (H.attributions(M.IterativeModel(dict(list(models.items())[:n]), pd.DataFrame(), {}), measured).lags._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (1, 3))
    assert few == more


def test_summaries_of_models(measured, response):
    fitted = M.fit(measured.panel, response, M.ModelControl(kind="AIC", alphas=(0.5,)))
    text = fitted.summary()
    assert "AIC information criterion" in text and "(Intercept)" in text and all(t in text for t in next(iter(fitted.nonzero().values())))
    raw = pd.DataFrame({"date": [1, 2], "response": [1.0, 2.0], "predicted": [1.5, 2.5]})
    it = M.IterativeModel({1: fitted, 2: fitted}, *M.performance(raw))
    assert "forecasts: 2" in it.summary() and "RMSFE: 0.50" in it.summary()
    frame = it.plot_frame()
    assert list(frame.columns) == ["date", "variable", "value"] and set(frame.variable) == {"realized", "prediction"} and len(frame) == 4


def test_lags_with_latest_fill_add_up(spark, response):
    m = P.aggregate(A.as_sentiment(B.events(spark, SF)), A.Aggregation(docs="proportional", time=("linear",), by="day", lag=3, fill="latest"))
    series = sorted({r.s for r in m.panel.select(P.series_name().alias("s")).distinct().collect()})
    ends = m.panel.agg(F.min("date"), F.max("date")).first()
    fit = M.Model("gaussian", 1.0, 0.1, tuple(ends), {"": {s: 1.0 + k for k, s in enumerate(series)}}, {"": 0.0}, {}, (len(series), 0))
    a = H.attributions(fit, m)
    sums = lambda f: {r.ref_date: r.s for r in f.groupBy("ref_date").agg(F.sum("attrib").alias("s")).collect()}
    assert sums(a.lags) == pytest.approx(sums(a.features), abs=1e-6)


def test_iterations(measured, response):
    c = M.ModelControl(kind="BIC", alphas=(0.5, 1.0), iterative=True, n_sample=30, h=1)
    it = M.fit(measured.panel, response, c)
    assert len(it.models) == len(response) - 30 - 1
    first = next(iter(it.models.values()))
    dates, names, x = M.panel_matrix(measured.panel)
    xx, yy, dd = M.align(x, np.array(response), dates, 1)
    alone = M._one(xx[:30], names, 0, yy[:30], dd[:30], c, (), None)
    assert alone.coef[""] == pytest.approx(first.coef[""]) and alone.dates == first.dates
    assert it.figures["RMSFE"] == pytest.approx(np.sqrt(it.performance.errorSq.mean()))
    loss = M.loss_table({"a": it, "b": it}, "DA")
    assert len(loss) == len(it.models) - 1 and (loss.a + it.performance.set_index("date").DA.iloc[1:] == 1).all()
    a = H.attributions(it, measured, lags=False)
    assert a.features.select("ref_date").distinct().count() == len(it.models)
