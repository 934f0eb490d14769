"""The panel of sentiment series (date, lexicon, feature, time, value) and what can be done with it.

Wide names ``lexicon--feature--time`` exist at the edges only; selections are predicates on the three columns.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from . import aggregation as A
from .aggregation import SERIES, Aggregation
from .corpus import feature_names
from .lexicons import Lexicons
from .scoring import sentiment

DIMS = {"lexicons": "lexicon", "features": "feature", "time": "time"}


def series_name() -> Column:
    return F.concat_ws("--", *SERIES)


def wide(panel: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """A column for each series; with ``names`` no job runs to find them."""
    return panel.select("date", series_name().alias("__s"), "value").groupBy("date").pivot("__s", list(names) if names else None).agg(F.first("value"))


def long(table: DataFrame) -> DataFrame:
    """The panel of a wide table with the columns date and ``lexicon--feature--time``."""
    cols = [c for c in table.columns if c != "date"]
    rows = F.array(*(F.struct(*(F.lit(p).alias(k) for p, k in zip(c.split("--"), SERIES)), F.col(f"`{c}`").cast("double").alias("value")) for c in cols))
    return table.select("date", F.inline(rows))


def grouped(panel: DataFrame, lexicons: Mapping[str, Sequence[str]] | None = None, features: Mapping[str, Sequence[str]] | None = None, time: Mapping[str, Sequence[str]] | None = None, keep: bool = False) -> DataFrame:
    """Series of named groups of components: their mean, where all members have the series; lexicons first, then features, then time.

    Missing values are left out of a mean if the group makes two series or more, else they make it missing.
    """
    before = panel
    for dim, groups in zip(SERIES, (lexicons, features, time)):
        for name, members in (groups or {}).items():
            if len(members) < 2 or len(set(members)) < len(members):
                raise ValueError(f"group {name} needs at least two components, none twice")
        for layer in _layers(groups or {}):
            panel = _merged(panel, dim, layer)
    if keep:
        panel = panel.unionByName(before.join(panel.select(*SERIES).distinct(), list(SERIES), "left_anti").select(panel.columns))
    return panel


def _layers(groups: Mapping[str, Sequence[str]]) -> list[dict[str, Sequence[str]]]:
    """Groups in their order, in as few layers of groups without common members as this order allows."""
    layers: list[dict] = []
    for name, members in groups.items():
        if not layers or {m for g in layers[-1].values() for m in g} & set(members):
            layers.append({})
        layers[-1][name] = members
    return layers


def _merged(panel: DataFrame, dim: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One reading of the panel for all groups: which series a group can merge is told by windows over the panel itself."""
    others = [d for d in SERIES if d != dim]
    of = F.create_map(*(F.lit(v) for name, members in groups.items() for m in members for v in (m, name)))
    size = F.create_map(*(F.lit(v) for name, members in groups.items() for v in (name, len(members))))
    rows = panel.withColumn("__g", of[F.col(dim)])
    rows = rows.withColumn("__k", F.size(F.collect_set(dim).over(Window.partitionBy("__g", *others))))
    rows = rows.withColumn("__in", F.coalesce(F.col("__k") == size[F.col("__g")], F.lit(False)))
    target = F.when(F.col("__in"), F.struct(*others))
    rows = rows.withColumn("__n", F.size(F.collect_set(target).over(Window.partitionBy("__g"))))
    name = F.when(F.col("__in"), F.col("__g")).otherwise(F.col(dim)).alias("__name")
    mean = F.when((F.max("__n") >= 2) | (F.count("value") == F.count("*")), F.avg("value"))
    return rows.groupBy("date", *others, name, "__in").agg(mean.alias("value")).withColumnRenamed("__name", dim).select(panel.columns)


def check_groups(panel: DataFrame, **groups: Mapping[str, Sequence[str]] | None) -> None:
    """Fails if a named member is no component of its dimension (one small job for all)."""
    for kind, given in groups.items():
        dim = DIMS[kind]
        have = {r[0] for r in panel.select(dim).distinct().collect()}
        lacking = sorted({m for members in (given or {}).values() for m in members} - have)
        if lacking:
            raise ValueError(f"no components of {kind}: {', '.join(lacking)}")


def global_indices(panel: DataFrame, lexicons: Mapping[str, float] | None = None, features: Mapping[str, float] | None = None, time: Mapping[str, float] | None = None) -> DataFrame:
    """(date, globLex, globFeat, globTime, global): means of the values weighted by components; by default each weighs 1/number of them."""
    df = panel
    for dim, given in zip(SERIES, (lexicons, features, time)):
        if given is None:
            w = panel.select(dim).distinct().select(dim, (F.lit(1.0) / F.count("*").over(Window.partitionBy())).alias(f"__{dim}"))
        else:
            w = panel.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{dim} string, __{dim} double")
        df = df.join(broadcast(w) if given is not None else w, dim, "left")
    out = df.groupBy("date").agg(*(F.avg(F.col("value") * F.col(f"__{dim}")).alias(n) for dim, n in zip(SERIES, ("globLex", "globFeat", "globTime"))))
    return out.withColumn("global", (F.col("globLex") + F.col("globFeat") + F.col("globTime")) / 3)


def subset(panel: DataFrame, condition: str | None = None, rows: Sequence[int] | None = None) -> DataFrame:
    """Dates that meet a condition (on date and series in back-ticks), or by their number from 1.  If none does, the panel stays as it is, with a warning."""
    if rows is not None:
        days = panel.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("__k"))
        if max(rows) > days.count():
            warnings.warn("a row number is beyond the panel, which stays as it is", stacklevel=2)
            return panel
        return panel.join(days.where(F.col("__k").isin(list(rows))).select("date"), "date", "left_semi")
    try:
        out = panel.select("date").where(condition)
        out.schema  # noqa: B018
        out = panel.where(condition)
    except Exception as e:
        if "UNRESOLVED" not in str(e):
            raise
        out = panel.join(wide(panel).where(condition).select("date"), "date", "left_semi")
    if out.isEmpty():
        warnings.warn("no date meets the condition; the panel stays as it is", stacklevel=2)
        return panel
    return out


def _matches(parts: Sequence[str] | Sequence[Sequence[str]]) -> Column:
    """Any of the components, or any of the combinations of components."""
    has = lambda c: (F.col("lexicon") == c) | (F.col("feature") == c) | (F.col("time") == c)
    out = F.lit(False)
    for p in parts:
        if isinstance(p, str):
            out = out | has(p)
        else:
            every = F.lit(True)
            for c in p:
                every = every & has(c)
            out = out | every
    return out


def select(panel: DataFrame, parts: Sequence[str] | Sequence[Sequence[str]]) -> DataFrame:
    return panel.where(_matches(parts))


def delete(panel: DataFrame, parts: Sequence[str] | Sequence[Sequence[str]]) -> DataFrame:
    return panel.where(~_matches(parts))


def differenced(panel: DataFrame, lag: int = 1, times: int = 1) -> DataFrame:
    """Differences over ``lag`` rows, taken ``times`` times; the first lag * times rows of each series go."""
    w = Window.partitionBy(*SERIES).orderBy("date")
    out = panel.withColumn("__k", F.row_number().over(w))
    for _ in range(times):
        out = out.withColumn("value", F.col("value") - F.lag("value", lag).over(w))
    return out.where(F.col("__k") > lag * times).drop("__k")


def scaled(panel: DataFrame, center: bool | Mapping[str, float] | DataFrame = True, scale: bool | Mapping[str, float] | DataFrame = True) -> DataFrame:
    """Each series less its mean (or given numbers by wide name), over its deviation (or given numbers).

    A frame (date, value) or (date, lexicon, feature, time, value) is added as ``center`` - added, not subtracted - and divides
    as ``scale``.  Without centring, the deviation is about 0, with n - 1.
    """
    df, x = panel, F.col("value")
    for what, k in ((center, "__c"), (scale, "__s")):
        if isinstance(what, DataFrame):
            on = [c for c in ("date", *SERIES) if c in what.columns]
            df = df.join(what.select(*on, F.col("value").alias(k)), on, "left")
            x = x + F.col(k) if k == "__c" else F.try_divide(x, F.col(k))
    df = df.withColumn("value", x).select(panel.columns)
    own = Window.partitionBy(*SERIES)
    named = lambda m: F.create_map(*(F.lit(v) for kv in m.items() for v in (kv[0], float(kv[1]))))[series_name()]
    centred = center is True or isinstance(center, Mapping)
    if center is True:
        df = df.withColumn("value", F.col("value") - F.avg("value").over(own))
    elif isinstance(center, Mapping):
        df = df.withColumn("value", F.col("value") - named(center))
    if scale is True:
        spread = F.sqrt(F.try_divide(F.sum(F.col("value") * F.col("value")).over(own), F.greatest(F.count("value").over(own) - 1, F.lit(1))))
        df = df.withColumn("value", F.try_divide("value", F.stddev_samp("value").over(own) if centred and center is True else spread))
    elif isinstance(scale, Mapping):
        df = df.withColumn("value", F.try_divide("value", named(scale)))
    return df


def stats(panel: DataFrame) -> DataFrame:
    """By series: mean, sd, max, min, and meanCorr, the mean of its correlations with the others but for those that are 1."""
    base = panel.groupBy(*SERIES).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.max("value").alias("max"), F.min("value").alias("min"))
    a = panel.select("date", series_name().alias("__a"), F.col("value").alias("__x"))
    b = panel.select("date", series_name().alias("__b"), F.col("value").alias("__y"))
    pairs = a.join(b, "date").where("__a <> __b").groupBy("__a", "__b").agg(F.corr("__x", "__y").alias("__r"))
    mean = pairs.where("not isnan(__r) and __r <> 1").groupBy("__a").agg(F.avg("__r").alias("meanCorr"))
    return base.withColumn("__a", series_name()).join(mean, "__a", "left").drop("__a")


def by_dimension(panel: DataFrame, dim: str | None = None) -> DataFrame:
    """(date, variable, value) for drawing: all series, or means by lexicon, feature or time."""
    if dim is None:
        return panel.select("date", series_name().alias("variable"), "value")
    return panel.groupBy("date", F.col(dim).alias("variable")).agg(F.avg("value").alias("value"))


@dataclass(frozen=True)
class Measures:
    """A panel with what it was made from.  All frames are lazy; changes give new objects."""

    panel: DataFrame
    sentiment: DataFrame
    control: Aggregation
    #: (dimension, name, members) of the groups that were made, in their order.
    groups: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    #: Ids of the documents and names of the lexicons, where they are known without scoring a text.
    ids: DataFrame | None = None
    lexicons: tuple[str, ...] | None = None

    @cached_property
    def time_weights(self) -> dict[str, list[float]]:
        """Weights by scheme, the first of the most lagged place; a group's are the means of its members', and the panel's schemes stay."""
        out = self.control.time_weights()
        for dim, name, members in self.groups:
            if dim == "time":
                out[name] = [sum(ws) / len(members) for ws in zip(*(out[m] for m in members))]
        have = set(self.dimensions()["time"]) if self.groups else set(out)
        return {k: w for k, w in out.items() if k in have}

    @property
    def base_weights(self) -> DataFrame:
        """Document weights of the series that texts were scored for."""
        return A.document_weights(self.sentiment, self.control.docs, self.control.by, self.control.ignore_zeros)

    @property
    def document_weights(self) -> DataFrame:
        """(id, date, lexicon, feature, w) of the panel's lexicons and features: a group's weights are the means of its members' (missing ones 0), scaled to a sum of 1 by period."""
        w = self.base_weights.select("id", "date", "lexicon", "feature", "w")
        for dim, name, members in self.groups:
            if dim == "time":
                continue
            other = "lexicon" if dim == "feature" else "feature"
            mine = w.where(F.col(dim).isin(list(members))).groupBy("id", "date", other).agg((F.sum(F.coalesce("w", F.lit(0.0))) / len(members)).alias("w"))
            total = mine.groupBy("date", other).agg(F.sum("w").alias("__t"))
            mine = mine.join(total, ["date", other]).select("id", "date", other, F.lit(name).alias(dim), F.try_divide("w", "__t").alias("w"))
            w = w.unionByName(mine)
        return w.join(self.panel.select("lexicon", "feature").distinct(), ["lexicon", "feature"], "left_semi") if self.groups else w

    def members(self, dim: str, name: str) -> dict[str, float]:
        """The components that a component of the panel is the mean of, with their shares: itself, unless it is a group."""
        made = {(d, n): m for d, n, m in self.groups}
        if (dim, name) not in made:
            return {name: 1.0}
        out: dict[str, float] = {}
        for m in made[dim, name]:
            for base, share in self.members(dim, m).items():
                out[base] = out.get(base, 0.0) + share / len(made[dim, name])
        return out

    def with_panel(self, panel: DataFrame) -> Measures:
        return replace(self, panel=panel, lexicons=None)

    def keep(self) -> Measures:
        """Caches the panel when it is first made: it is small, and steps that read it several times then don't score the texts again."""
        return self.with_panel(self.panel.persist())

    def dates(self) -> DataFrame:
        return self.panel.select("date").distinct()

    def dimensions(self) -> dict[str, list[str]]:
        rows = self.panel.select(*SERIES).distinct().collect()
        return {k: sorted({r[d] for r in rows}) for k, d in DIMS.items()}

    def n_measures(self) -> int:
        return self.panel.select(*SERIES).distinct().count()

    def n_obs(self) -> int:
        return self.dates().count()

    def subset(self, condition: str | None = None, rows: Sequence[int] | None = None, select: Sequence | None = None, delete: Sequence | None = None) -> Measures:
        panel = self.panel
        if condition is not None or rows is not None:
            panel = subset(panel, condition, rows)
        for parts, keep in ((select, True), (delete, False)):
            if parts is None:
                continue
            have = {c for v in self.dimensions().values() for c in v}
            asked = {c for p in parts for c in ([p] if isinstance(p, str) else p)}
            if asked - have:
                raise ValueError(f"components of no series: {', '.join(sorted(asked - have))}")
            hit = panel.select(*SERIES).distinct().withColumn("__m", _matches(parts))
            n, m = hit.count(), hit.where("__m").count()
            if m == 0 or (not keep and m == n):
                warnings.warn("none or all of the series; the panel stays as it is", stacklevel=2)
            else:
                panel = panel.where(_matches(parts) if keep else ~_matches(parts))
        return self.with_panel(panel)

    def aggregate(self, lexicons: Mapping | None = None, features: Mapping | None = None, time: Mapping | None = None, keep: bool = False) -> Measures:
        check_groups(self.panel, lexicons=lexicons, features=features, time=time)
        made = tuple((dim, name, tuple(m)) for dim, given in (("feature", features), ("lexicon", lexicons), ("time", time)) for name, m in (given or {}).items())
        return replace(self, panel=grouped(self.panel, lexicons, features, time, keep), groups=self.groups + made, lexicons=None)

    def fill(self, fill: str = "zero", before: str | None = None, after: str | None = None) -> Measures:
        return self.with_panel(A.filled(self.panel, self.control.by, fill, before, after))

    def diff(self, lag: int = 1, times: int = 1) -> Measures:
        return self.with_panel(differenced(self.panel, lag, times))

    def scale(self, center: bool | Mapping | DataFrame = True, scale: bool | Mapping | DataFrame = True) -> Measures:
        return self.with_panel(scaled(self.panel, center, scale))

    def peak_dates(self, n: float = 10, kind: str = "both", average: bool = False) -> DataFrame:
        return A.peaks(self.panel, "date", "value", n, kind, average)

    def update(self, corpus: DataFrame, lexicons: Lexicons) -> Measures:
        """Scores the documents whose ids are new and aggregates again; the lexicons must be the same.

        Which ids and lexicons there are is asked of the scores only where the corpus doesn't tell: no text is scored for it.
        """
        if set(self.dimensions()["lexicons"] if self.lexicons is None else self.lexicons) != set(lexicons):
            raise ValueError("the lexicons are not those of the panel")
        known = self.sentiment.select("id").distinct() if self.ids is None else self.ids
        scored = sentiment(corpus.join(known, "id", "left_anti"), lexicons, self.control.within, self.control.sentence, self.control.tokens, feature_names(corpus) or None)
        out = aggregate(self.sentiment.unionByName(to_documents(scored, self.control)), self.control)
        return out if self.ids is None else replace(out, ids=self.ids.unionAll(corpus.select("id")), lexicons=tuple(lexicons))

    def updated(self, scored: DataFrame) -> Measures:
        """The same from sentiment of documents; those whose ids are known already are left out."""
        new = scored.join(self.sentiment.select("id").distinct(), "id", "left_anti").select(self.sentiment.columns)
        return aggregate(self.sentiment.unionByName(new), self.control)

    def summary(self) -> str:
        """What the panel is made of and how, and the averages of its series' statistics."""
        dims = self.dimensions()
        s = stats(self.panel).agg(*(F.avg(c).alias(c) for c in ("mean", "sd", "max", "min", "meanCorr"))).first()
        return "\n".join([
            f"{self.n_measures()} series of {self.n_obs()} dates by {self.control.by}", *(f"{k}: {', '.join(v)}" for k, v in dims.items()),
            f"{self.control.within} within documents, {self.control.docs} over documents, {', '.join(self.control.time)} over time, lag {self.control.lag}, fill {self.control.fill}",
            "averages: " + ", ".join(f"{k} {'-' if v is None else f'{v:.5f}'}" for k, v in s.asDict().items()),
        ])


def to_documents(sent: DataFrame, control: Aggregation) -> DataFrame:
    return A.sentences_to_docs(sent, control.docs, control.ignore_zeros) if "sentence_id" in sent.columns else sent


def aggregate(sent: DataFrame, control: Aggregation) -> Measures:
    """A panel from long sentiment: sentences to documents to periods to rolling sums, in one lazy plan."""
    docs = to_documents(sent, control)
    panel = A.docs_to_dates(docs, control.docs, control.by, control.ignore_zeros)
    if control.fill != "none":
        panel = A.filled(panel, control.by, control.fill)
    return Measures(A.rolled(panel, control.time_weights()), docs, control)


def measures(corpus: DataFrame, lexicons: Lexicons | Mapping[str, Lexicons], control: Aggregation) -> Measures:
    """From texts to the panel; component names are checked before anything runs."""
    names = [n for lex in lexicons.values() for n in lex] if not isinstance(lexicons, Lexicons) else list(lexicons)
    A.check_component_names(names, [c for c in feature_names(corpus) if c != control.tokens] or ["dummyFeature"], list(control.time_weights()))
    made = aggregate(sentiment(corpus, lexicons, control.within, control.sentence, control.tokens), control)
    # a document without a sentence has no scores by sentence
    return made if control.sentence else replace(made, ids=corpus.select("id"), lexicons=tuple(names))
