"""Corpora, aggregation, panel algebra: goldens, rules, invariants."""

from __future__ import annotations

import datetime as dt
import random
import warnings

import pytest
from pyspark.sql import functions as F

from tonespan import sources
from tonespan.operators import aggregation as A
from tonespan.operators import corpus as C
from tonespan.operators import panel as P
from tonespan.operators.lexicons import Lexicons
from tonespan.plans import base as B

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def sent(spark, rows):
    return spark.createDataFrame([(i, day(k), float(wc), "l", "f", s) for i, k, wc, s in rows], "id string, date date, word_count double, lexicon string, feature string, score double")


def panel(spark, values, by="f"):
    return spark.createDataFrame([(day(k), "l", "f", v) for k, v in values], "date date, lexicon string, feature string, value double")


# --- corpora


def test_build(spark):
    raw = spark.createDataFrame([("1", "2020-01-02", "a <b>bold</b> \"x\"!", 5.0, "z"), ("2", "2020-01-01", None, 15.0, "z")], "id string, date string, texts string, `my f` double, other string")
    with pytest.warns(UserWarning, match="other"):
        c = C.build(raw, clean=True)
    assert {(r.id, r.my_f, r.texts) for r in c.collect()} == {("1", 0.0, "a bold x"), ("2", 1.0, None)}
    assert C.build(raw.select("id", "date", "texts")).first().dummyFeature == 1.0
    with pytest.raises(ValueError):
        C.build(raw.drop("date"))
    with pytest.raises(Exception, match="not a date"):
        C.build(raw.withColumn("date", F.lit("02.01.2020")).select("id", "date", "texts")).collect()
    assert C.build(raw.where("false").select("id", "date", "texts", "my f")).count() == 0


def test_features(spark):
    c = C.build(spark.createDataFrame([("1", "2020-01-01", "good good cut"), ("2", "2020-01-01", "rates"), ("3", "2020-02-01", "none")], "id string, date string, texts string"))
    with pytest.warns(UserWarning, match="absent"):
        out = C.add_features(c, keywords={"good": ["good"], "cut": "cut|rates", "absent": ["zzz"], "n n": ["good"]}, binary={"good": True, "cut": True, "absent": True, "n n": False}, regex={"good": False, "cut": True, "absent": False, "n n": False}).withColumnRenamed("n_n", "n")
    assert [(r.good, r.cut, r.n) for r in out.orderBy("id").collect()] == [(1, 1, 1), (0, 1, 0), (0, 0, 0)] and "absent" not in out.columns
    everywhere = C.add_features(c, keywords={"e": "e|u"}, regex=True)
    assert [r.e for r in everywhere.where("texts <> 'good good cut'").collect()] == [1.0, 1.0] or [r.e for r in everywhere.collect()] == [None] * 3
    wide = spark.createDataFrame([("1", 0.5, 7.0, "x"), ("2", 1.0, 0.0, "y"), ("9", None, 0.5, "z")], "id string, fine double, wide double, word string")
    with pytest.warns(UserWarning, match="word, wide|wide, word"):
        more = C.add_features(c, wide)
    assert "wide" not in more.columns and [r.fine for r in more.orderBy("id").collect()] == [0.5, 1.0, None]
    with pytest.warns(UserWarning):
        assert "big" not in C.add_features(c, {"big": 3.0, "ok": 0.5}).columns
    assert C.feature_names(C.remove_features(out, ["good", "cut", "n"])) == ["dummyFeature"]
    with pytest.raises(ValueError):
        C.remove_features(c, ["date"])
    s = {r.date: r for r in C.summarize(out, "month").collect()}
    assert s[dt.date(2020, 1, 1)].documents == 2 and s[dt.date(2020, 1, 1)].totalTokens == 4 and s[dt.date(2020, 1, 1)].cut == 2
    assert C.sample(c, 2).count() == 2 and C.trim(c, 2).count() == 1 and "corpus" in C.describe(c)


def test_sources(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"content": ["a b", "c"], "meta": {"id": 1, "datetimestamp": "2020-01-05T10:00:00", "f": 0.5}}\n')
    r = sources.as_corpus(str(tmp_path / "d.json"), spark).first()
    assert (r.id, r.date, r.texts, r.f) == ("1", dt.date(2020, 1, 5), "a b c", 0.5)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x1.txt").write_text("one\ntwo")
    dates = spark.createDataFrame([("x1", "2021-02-03")], "id string, date string")
    r = sources.as_corpus(str(tmp_path / "t"), spark, dates=dates).first()
    assert (r.id, r.texts, r.date) == ("x1", "one\ntwo", dt.date(2021, 2, 3))
    p = panel(spark, [(0, 1.0), (1, 2.0)]).withColumn("time", F.lit("exponential0.2"))
    for form in ("long", "wide"):
        sources.write_panel(p, str(tmp_path / form), form=form)
        assert sorted(map(tuple, sources.read_panel(spark, str(tmp_path / form)).select(p.columns).collect())) == sorted(map(tuple, p.collect()))


# --- aggregation


@pytest.mark.parametrize(("how", "want"), [("equal_weight", 0.5), ("proportional", 0.25), ("inverseProportional", 0.75), ("exponential", 0.75), ("inverseExponential", 0.75)])
def test_document_weights(spark, how, want):
    s = sent(spark, [("a", 0, 100, 1.0), ("b", 0, 300, 2.0), ("c", 1, 50, 3.0)])
    got = {r.id: r.w for r in A.document_weights(s, how, "day", True).collect()}
    assert got["a"] == pytest.approx(want) and got["b"] == pytest.approx(1 - want)
    alone = got["c"]
    assert alone is None if "xponential" in how else alone == 1
    values = {r.date: r.value for r in A.docs_to_dates(s, how).collect()}
    assert values[day(0)] == pytest.approx(want + 2 * (1 - want)) and values[day(1)] == (0 if "xponential" in how else 3)


@pytest.mark.parametrize("how", ["equal_weight", "proportional", "inverseProportional", "exponential", "inverseExponential"])
@pytest.mark.parametrize("ignore", [True, False])
def test_sums_are_weights_times_scores(spark, how, ignore):
    s = sent(spark, [(str(i), i % 3, 10 + 7 * i, (i % 4 - 1) / 2) for i in range(20)])
    direct = {r.date: r.value for r in A.docs_to_dates(s, how, ignore_zeros=ignore).collect()}
    w = A.document_weights(s, how, "day", ignore)
    long_way = {r.date: r.v for r in w.groupBy("date").agg(F.sum(F.col("w") * F.col("score")).alias("v"), F.sum("w").alias("w")).collect()}
    assert direct == pytest.approx(long_way)
    assert all(r.w == pytest.approx(1) for r in w.groupBy("date").agg(F.sum("w").alias("w")).collect())


def test_sentences(spark):
    s = spark.createDataFrame([("a", k, DAY, float(n), "l", "f", v) for k, n, v in ((1, 2, 1.0), (2, 6, 0.0), (3, 4, -0.5))], "id string, sentence_id int, date date, word_count double, lexicon string, feature string, score double")
    one = A.sentences_to_docs(s, "equal_weight").first()
    assert one.score == pytest.approx(0.25) and one.word_count == 12
    assert A.sentences_to_docs(s, "equal_weight", False).first().score == pytest.approx(0.5 / 3)
    assert A.sentences_to_docs(s, "proportional").first().score == pytest.approx((2 - 2) / 6)


def test_rolling_skips_missing_values(spark):
    p = panel(spark, [(0, 1.0), (1, 2.0), (2, None), (3, 4.0), (4, 5.0), (5, 6.0)])
    got = [r.value for r in A.rolled(p, {"w": [0.1, 0.3, 0.6]}).orderBy("date").collect()]
    assert got == pytest.approx([0.7, 2.6, 4.2, 5.5])
    with pytest.raises(Exception, match="longer than a series"):
        A.rolled(p, {"w": [1.0] * 7}).count()


def test_filling(spark):
    p = panel(spark, [(1, 5.0), (4, 7.0)])
    zero = [(r.date, r.value) for r in A.filled(p, "day", "zero", after=str(day(5))).orderBy("date").collect()]
    assert zero == [(day(1), 5), (day(2), 0), (day(3), 0), (day(4), 7), (day(5), 0)]
    latest = [r.value for r in A.filled(p, "day", "latest", before=str(day(0))).orderBy("date").collect()]
    assert latest == [5, 5, 5, 5, 7]
    assert A.filled(p.where("false"), "day").count() == 0


def test_controls():
    assert A.Aggregation(lag=1, time=("linear",)).time_weights() == {"dummyTime": [1.0]}
    own = A.Aggregation(time=("linear",), lag=9, own={"q1": [0.25, 0.75]})
    assert own.lag == 2 and list(own.time_weights()) == ["linear", "q1"]
    with pytest.raises(ValueError, match="docs.*by") as e:
        A.Aggregation(docs="no", by="hour", lag=-1, fill="x")
    assert "lag" in str(e.value) and "fill" in str(e.value)
    with pytest.raises(ValueError):
        A.check_component_names(["a"], ["b"], ["a"])
    with pytest.warns(UserWarning, match="cores"):
        assert A.Aggregation(cores=0).cores == 1


def test_windows_and_names_that_cannot_be(spark):
    rows = [(f"{i}", DAY + dt.timedelta(days=i), 3.0, "l", "f", 1.0) for i in range(3)]
    sent = spark.createDataFrame(rows, "id string, date date, word_count double, lexicon string, feature string, score double")
    assert P.aggregate(sent, A.Aggregation(lag=3, time=("linear",))).panel.count() == 1
    with pytest.raises(Exception, match="longer than a series"):
        P.aggregate(sent, A.Aggregation(lag=4, time=("linear",))).panel.count()
    for column, name in (("lexicon", "f"), ("feature", "linear"), ("lexicon", "linear")):
        with pytest.raises(Exception, match="more than one dimension"):
            P.aggregate(sent.withColumn(column, F.lit(name)), A.Aggregation(lag=3, time=("linear",))).panel.count()
    with pytest.raises(ValueError, match="more than one dimension"):
        P.measures(B.corpus(spark, SF).drop("language"), Lexicons({"odd": {"the": 1.0}}), A.Aggregation(lag=3, time=("linear",)))
    assert P.aggregate(sent.where("false"), A.Aggregation(lag=4, time=("linear",))).panel.count() == 0


def test_as_sentiment(spark):
    w = spark.createDataFrame([("1", DAY, 3.0, 1.0, 2.0)], "id string, date date, word_count double, `a--b--c` double, d double")
    assert {(r.lexicon, r.feature, r.score) for r in A.as_sentiment(w).collect()} == {("a", "b", 1.0), ("d", "dummyFeature", 2.0)}
    with pytest.raises(ValueError):
        A.as_sentiment(w.drop("id"))


def test_merging(spark):
    a, b = sent(spark, [("1", 0, 5, 1.0)]), sent(spark, [("2", 1, 5, 2.0)]).withColumn("lexicon", F.lit("m"))
    got = {(r.id, r.lexicon): r.score for r in A.merged(a, b, a).collect()}
    assert got == {("1", "l"): 1.0, ("1", "m"): 0.0, ("2", "m"): 2.0, ("2", "l"): 0.0}
    with pytest.raises(ValueError):
        A.merged(a)


def test_peaks(spark):
    s = sent(spark, [("a", 0, 1, 1.0), ("b", 0, 1, -3.0), ("c", 0, 1, 2.0), ("d", 0, 1, None), ("a", 0, 1, -2.5)])
    ids = lambda *x: [r.id for r in A.peaks(s, "id", "score", *x).collect()]
    assert ids(2) == ["b", "a"] and ids(2, "pos") == ["c", "a"] and ids(1, "neg") == ["b"] and ids(0.5) == ["b", "a"] and ids(9) == ["b", "a", "c", "d"]
    assert ids(2, "pos", True) == ["c", "a"]


def test_periods(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 3),)], "d date")
    assert [df.select(C.period(F.col("d"), k)).first()[0] for k in ("year", "month", "week", "day")] == [dt.date(2021, 1, 1), dt.date(2021, 1, 1), dt.date(2020, 12, 28), dt.date(2021, 1, 3)]


# --- panels


@pytest.fixture(scope="module")
def made(spark):
    return P.aggregate(A.as_sentiment(B.events(spark, SF)), B.CONTROL).keep()


def test_shape(made):
    dims = made.dimensions()
    assert made.n_measures() == 8 == len(dims["lexicons"]) * len(dims["features"]) * len(dims["time"])
    grid = A.filled(A.docs_to_dates(made.sentiment, "proportional"), "day")
    assert made.n_obs() == grid.select("date").distinct().count() - B.CONTROL.lag + 1
    assert "8 series" in made.summary()


def test_subset_rules(made):
    assert made.subset(select=["lexA"]).n_measures() == 4 and made.subset(select=[["lexA", "linear"], ["lexB", "up", "linear"]]).n_measures() == 3
    assert made.subset(delete=[["lexA", "linear"]]).n_measures() == 6
    with pytest.raises(ValueError):
        made.subset(select=["nothing"])
    with pytest.warns(UserWarning):
        assert made.subset("date < date'1990-01-01'").n_obs() == made.n_obs()
    with pytest.warns(UserWarning):
        assert made.subset(delete=["lexA", "lexB"]).n_measures() == 8


def test_groups(made):
    g = made.aggregate(lexicons={"both": ["lexA", "lexB"]}, keep=True)
    assert g.n_measures() == 12
    some = made.with_panel(P.delete(made.panel, [["lexB", "up"]])).aggregate(lexicons={"both": ["lexA", "lexB"]})
    assert {(r.lexicon, r.feature) for r in some.panel.select("lexicon", "feature").distinct().collect()} == {("both", "down"), ("lexA", "up")}
    with pytest.raises(ValueError):
        made.aggregate(features={"x": ["up", "missing"]})
    with pytest.raises(ValueError):
        made.aggregate(features={"x": ["up", "up"]})


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_plans_do_not_grow(spark):
    """Neither with groups, nor with languages, nor with models."""
    panel = P.aggregate(A.as_sentiment(B.events(spark, SF)), B.CONTROL).panel
    once = scans(P.grouped(panel, lexicons={"x": ["lexA", "lexB"]}))
    assert once == scans(panel)
    assert scans(P.grouped(panel, {"x": ["lexA", "lexB"]}, {"y": ["up", "down"]}, {"z": ["equal_weight", "linear"]})) == once
    lex = lambda k: Lexicons({f"lex{k}": {"the": 1.0}})
    by = lambda n: P.sentiment(B.corpus(spark, SF), {k: lex(k) for k in ("en", "de", "fr", "es")[:n]}, "counts", features=[])
    assert scans(by(1)) == scans(by(4)) == 1


def test_groups_against_plain_means(spark):
    rng = random.Random(4)
    rows = [(DAY + dt.timedelta(days=t), a, b, c, None if rng.random() < 0.2 else rng.random()) for a in "abcd" for b in "xy" for c in "mno" for t in range(5) if (a, b) != ("d", "y")]
    panel = spark.createDataFrame(rows, "date date, lexicon string, feature string, time string, value double")
    groups = {"lexicon": {"ab": ["a", "b"], "bc": ["b", "c"], "cd": ["c", "d"]}, "feature": {"xy": ["x", "y"]}, "time": {"mn": ["m", "n"]}}
    have = {tuple(r[:4]): r[4] for r in rows}
    for k, dim in enumerate(("lexicon", "feature", "time"), 1):
        for name, members in groups[dim].items():
            keys = {q[1:k] + q[k + 1 :] for q in have}
            whole = [o for o in keys if all(any(q[1:k] + q[k + 1 :] == o and q[k] == m for q in have) for m in members)]
            new = {}
            for o in whole:
                for day in {q[0] for q in have}:
                    vs = [have.pop((day, *o[: k - 1], m, *o[k - 1 :])) for m in members]
                    known = [v for v in vs if v is not None]
                    new[(day, *o[: k - 1], name, *o[k - 1 :])] = sum(known) / len(known) if known and (len(whole) >= 2 or len(known) == len(vs)) else None
            have |= new
    got = {tuple(r)[:4]: r.value for r in P.grouped(panel, groups["lexicon"], groups["feature"], groups["time"]).select("date", "lexicon", "feature", "time", "value").collect()}
    assert got.keys() == have.keys() and all(got[k] == pytest.approx(v) if v is not None else got[k] is None for k, v in have.items())


def test_weights_of_groups(made):
    g = made.aggregate(lexicons={"LEX": ["lexA", "lexB"]}, features={"ANY": ["up", "down"]}, time={"T": ["equal_weight", "linear"]})
    assert list(g.time_weights) == ["T"] and g.time_weights["T"] == pytest.approx([(1 / 3 + w) / 2 for w in (1 / 6, 2 / 6, 3 / 6)])
    w = g.document_weights
    assert {tuple(r) for r in w.select("lexicon", "feature").distinct().collect()} == {("LEX", "ANY")}
    assert w.select("id").distinct().count() == made.sentiment.select("id").distinct().count()
    assert all(r.t == pytest.approx(1) for r in w.groupBy("date").agg(F.sum("w").alias("t")).collect())
    some = made.subset(select=[["lexA", "up", "linear"]])
    assert {tuple(r) for r in some.document_weights.select("lexicon", "feature").distinct().collect()} >= {("lexA", "up")}
    assert g.members("lexicon", "LEX") == {"lexA": 0.5, "lexB": 0.5} and made.members("lexicon", "lexA") == {"lexA": 1.0}


def test_summary_has_averages(made):
    text, st = made.summary(), P.stats(made.panel).agg(F.avg("mean").alias("m")).first()
    assert f"mean {st.m:.5f}" in text and "meanCorr" in text and "by day" in text


def test_diff_and_scale(made):
    assert made.diff(2, 2).n_obs() == made.n_obs() - 4
    st = P.stats(made.scale().panel).collect()
    assert all(abs(r.mean) < 1e-9 and r.sd == pytest.approx(1) for r in st)
    added = made.panel.select("date").distinct().withColumn("value", F.lit(2.0))
    back = P.scaled(P.scaled(made.panel, added, False), {f"{a}--{b}--{c}": 2.0 for a in ("lexA", "lexB") for b in ("up", "down") for c in ("equal_weight", "linear")}, False)
    same = back.alias("x").join(made.panel.alias("y"), ["date", "lexicon", "feature", "time"]).where("abs(x.value - y.value) > 1e-9")
    assert same.count() == 0


def test_long_and_wide_are_inverse(made):
    assert P.long(P.wide(made.panel)).exceptAll(made.panel.select("date", "lexicon", "feature", "time", "value")).count() == 0


def test_update_equals_doing_all_at_once(spark):
    c = B.corpus(spark, SF).drop("language")
    lex, control = B.lexicons(), A.Aggregation(docs="proportional", time=("linear", "equal_weight"), by="month", lag=2)
    whole = P.measures(c, lex, control).panel
    part = P.measures(c.where("odd = 1"), lex, control).update(c, lex).panel
    joined = whole.alias("a").join(part.alias("b"), ["date", "lexicon", "feature", "time"], "full")
    assert joined.where("not (abs(a.value - b.value) < 1e-9) or a.value is null or b.value is null").count() == 0
    with pytest.raises(ValueError):
        P.measures(c, lex, control).update(c, Lexicons({"other": {"x": 1.0}}))


def test_stream_adds_each_document_once(spark, tmp_path):
    from tonespan.streaming import scored_stream, store_new, sums_by_period

    c = B.corpus(spark, SF).select("id", "date", "texts", "odd")
    lex = Lexicons({"l": {"the": 1.0, "of": -1.0}})
    c.where("odd = 1").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        src = spark.readStream.schema(c.schema).parquet(str(tmp_path / "in"))
        store_new(src, lex, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        c.write.mode("append").parquet(str(tmp_path / "in"))
    got, want = spark.read.parquet(str(tmp_path / "out")), P.sentiment(c, lex)
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0
    live = sums_by_period(scored_stream(spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in")), lex, watermark="3000 days"), "30 days")
    out = live.writeStream.format("parquet").option("path", str(tmp_path / "live")).option("checkpointLocation", str(tmp_path / "ck2")).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.read.schema(live.schema).parquet(str(tmp_path / "live")).count() == 0  # no window is over yet
    live = sums_by_period(scored_stream(spark.readStream.schema(c.schema).parquet(str(tmp_path / "in")), lex, watermark="0 days"), "30 days")
    out = live.writeStream.format("parquet").option("path", str(tmp_path / "over")).option("checkpointLocation", str(tmp_path / "ck3")).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    closed = {(r.date, r.feature): (r.value, r.documents) for r in spark.read.schema(live.schema).parquet(str(tmp_path / "over")).collect()}
    batch = sums_by_period(want.withColumn("date", F.col("date").cast("timestamp")), "30 days")
    assert len(closed) > 5
    whole = {(r.date, r.feature): (r.value, r.documents) for r in batch.collect()}
    assert all(whole[k] == pytest.approx(v) for k, v in closed.items())


def test_warnings_are_off_by_default(made):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        made.subset("date >= date'2000-01-01'")


def test_an_update_scores_each_text_once(spark):
    from tonespan.plans import base, catalog

    got = catalog.QUERIES["f3_update_texts"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2  # the documents of before, and the new ones
    whole = base.corpus(spark, "/root/testdata/sf0.001").select("id", "date", "texts")
    part = P.measures(whole.where("id % 2 = 0"), base.lexicons(), A.Aggregation(by="month"))
    again = part.update(whole, base.lexicons()).update(whole, base.lexicons())
    assert again.sentiment.count() == 2 * whole.count()
    with pytest.raises(ValueError, match="lexicons"):
        part.subset(delete=["lexB"]).update(whole, base.lexicons())
