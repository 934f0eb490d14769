"""The tables of the queries in the engine's shape, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregation as A
from ..operators.lexicons import Lexicons

#: Scores and shifters are sums of powers of two, so that sums don't depend on their order.
LEX = {
    "lexA": {"the": 1.0, "of": -0.5, "and": 0.75, "is": -1.25, "der": 0.5, "und": -0.75, "de": 0.25, "la": -1.0, "que": 1.5, "on": 0.0},
    "lexB": {"to": 1.0, "in": -1.0, "that": 0.625, "was": -0.375, "die": 1.125, "zu": -0.25, "le": 0.75, "les": -0.875, "el": 0.375, "the": -0.25},
}
VALENCE_Y = [{"x": "of", "y": -1.0}, {"x": "and", "y": 1.75}, {"x": "it", "y": 0.25}, {"x": "der", "y": 1.75}, {"x": "qui", "y": -1.0}, {"x": "y", "y": 0.25}]
VALENCE_T = [{"x": "not", "t": 1}, {"x": "for", "t": 2}, {"x": "it", "t": 3}, {"x": "with", "t": 4}, {"x": "nicht", "t": 1}, {"x": "von", "t": 2}, {"x": "pas", "t": 1}, {"x": "en", "t": 2}, {"x": "no", "t": 1}]
OWN = {"first": [0.5, 0.3, 0.2], "last": [0.1, 0.2, 0.7]}
LANGUAGES = {"en": {"english": {"the": 1.0, "of": -1.0}}, "de": {"german": {"der": 1.0, "die": -0.5}}, "fr": {"french": {"la": 1.0, "le": -0.5}}, "es": {"spanish": {"el": 1.0, "en": -0.5}}}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def lexicons(kind: str | None = None) -> Lexicons:
    return Lexicons(LEX, {"y": VALENCE_Y, "t": VALENCE_T}.get(kind))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 730).cast("int"))
    odd = (F.col("doc_id") % 2).cast("double")
    return docs.select(F.col("doc_id").cast("string").alias("id"), day.alias("date"), F.col("text").alias("texts"), F.col("lang").alias("language"), odd.alias("odd"), (1 - odd).alias("even"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with the features quality and toxic, 0 where there is no label."""
    marks = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return corpus(spark, d).drop("odd", "even").join(marks, "id", "left").fillna(0.0, ["quality", "toxic"])


CORPUS = """corpus as (select cast(doc_id as varchar) id, date '2020-01-01' + cast(doc_id % 730 as integer) as date, text texts, lang as language,
  cast(doc_id % 2 as double) odd, 1 - cast(doc_id % 2 as double) even from documents)"""
_W = r"(?:\p{N}+(?:[.,;''’]\p{N}+)*|_|\p{L}[\p{L}\p{M}]*(?:[''’.:·]\p{L}[\p{L}\p{M}]*)*)+"


def tokens_sql(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '{_W}'), lambda w: not regexp_matches(w, '\p{{N}}$'))"


def values(rows: list[tuple]) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else f"cast({v!r} as double)"
    return "(values " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ")"


def lexicon_sql(lex: Mapping[str, Mapping[str, float]] = LEX) -> str:
    return f"lex as (select * from {values([(k, x, float(y)) for k, v in lex.items() for x, y in v.items()])} t(lexicon, word, y))"


def scored_sql(how: str, kind: str | None = None, lex: Mapping[str, Mapping[str, float]] = LEX, source: str = "corpus", keys: str = "id") -> str:
    """CTEs up to scored(id, n, lexicon, score), for documents without valence words or with those of kind y."""
    p = {
        "UShaped": "pow(x - (n + 1) / 2.0, 2)", "inverseUShaped": "0.25 - pow(x - (n + 1) / 2.0, 2) / (n * n)",
        "exponential": "exp(5 * (x / n - 1))", "inverseExponential": "exp(5 * (1 - x / n))", "TFIDF": "f",
    }.get(how, "1")
    idf = "1" if how != "TFIDF" else "log10((select count(*) from toks) / cast(1 + d.df as double))"
    shift = "coalesce(v.y, 1)" if kind == "y" else "1"
    vjoin = f"left join {values([(r['x'], r['y']) for r in VALENCE_Y])} v(w, y) on v.w = coalesce(e.prev, e.w)" if kind == "y" else ""
    norm = f"select {keys}, sum({p}) norm from {'hits' if kind else 'e'} group by {keys}" if p not in ("1", "f") else f"select {keys}, 1 norm from toks"
    final = {"counts": "s", "TFIDF": "s", "proportional": "coalesce(s / nullif(n, 0), 0)", "proportionalSquareRoot": "coalesce(s / nullif(sqrt(n), 0), 0)", "proportionalPol": "coalesce(s / nullif(c, 0), 0)"}.get(how, "case when c = 0 then 0 else s / nullif(norm, 0) end")
    first = f"{source}, " if source.startswith("corpus as") else ""
    return f"""{first}{lexicon_sql(lex)},
toks as (select {keys}, {tokens_sql('texts')} t from corpus),
e as (select *, lag(w) over (partition by {keys} order by x) prev from (select {keys}, cast(len(t) as double) n, unnest(t) w, cast(generate_subscripts(t, 1) as double) x from toks)),
names as (select distinct lexicon from lex), words as (select distinct word from lex),
d as (select w, count(distinct ({keys})) df from e where w in (select word from words) group by w),
hits as (select e.*, {shift} shift, {idf} f from e left join d using (w) {vjoin} where w in (select word from words)),
norms as ({norm}),
sums as (select {', '.join('h.' + k.strip() for k in keys.split(','))}, l.lexicon, sum(shift * y * ({p})) s, count(*) filter (y <> 0) c from hits h join lex l on l.word = h.w group by all),
scored as (select {', '.join('toks.' + k.strip() for k in keys.split(','))}, cast(len(t) as double) n, names.lexicon, coalesce(s, 0) s, coalesce(c, 0) c, norm from toks cross join names
  left join sums on {' and '.join(f'sums.{k.strip()} = toks.{k.strip()}' for k in keys.split(','))} and sums.lexicon = names.lexicon left join norms on {' and '.join(f'norms.{k.strip()} = toks.{k.strip()}' for k in keys.split(','))}),
result as (select *, {final} score from scored)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """events as scored documents: two lexicons, two features, many zeros; dates are spread so that three days without events follow every five."""
    ev = table(spark, d, "events")
    k = F.dayofmonth("ts") - 1
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k + 3 * F.floor(k / 5)).cast("int"))
    v = F.floor((F.col("value") - 50.0) * 8) / 8.0
    up, first = F.col("event_type").isin("click", "view", "purchase"), (F.col("event_id") % 3) == 0
    zero = F.lit(0.0)
    return ev.select(
        F.col("event_id").cast("string").alias("id"), day.alias("date"), (1 + F.col("event_id") % 50).cast("double").alias("word_count"),
        F.when(up, v).otherwise(zero).alias("lexA--up"), F.when(up, zero).otherwise(v).alias("lexA--down"),
        F.when(first, v / 2).otherwise(zero).alias("lexB--up"), F.when(first, zero).otherwise(v / 4).alias("lexB--down"),
    )


EVENTS = """ev as (select cast(event_id as varchar) id, date '2024-01-01' + cast((day(ts) - 1) + 3 * ((day(ts) - 1) // 5) as integer) date, cast(1 + event_id % 50 as double) wc, floor((value - 50.0) * 8) / 8.0 v,
  event_type in ('click', 'view', 'purchase') up, event_id % 3 = 0 f from events),
sent as (select id, date, wc, 'lexA' lexicon, 'up' feature, case when up then v else 0 end score from ev union all select id, date, wc, 'lexA', 'down', case when up then 0 else v end from ev
  union all select id, date, wc, 'lexB', 'up', case when f then v / 2 else 0 end from ev union all select id, date, wc, 'lexB', 'down', case when f then 0 else v / 4 end from ev)"""

CONTROL = A.Aggregation(docs="proportional", time=("equal_weight", "linear"), by="day", lag=3, fill="zero")
#: The panel of EVENTS under CONTROL.
DAILY = "daily as (select date, lexicon, feature, sum(score * wc) / sum(wc) as value from sent where score <> 0 group by all)"
GRID = """grid as (select unnest(generate_series((select min(date) from sent), (select max(date) from sent), interval 1 day))::date as date),
full_ as (select g.date, s.lexicon, s.feature, coalesce(value, 0) as value from grid g cross join (select distinct lexicon, feature from sent) s left join daily d on d.date = g.date and d.lexicon = s.lexicon and d.feature = s.feature)"""


def roll_sql(weights: Mapping[str, list[float]], source: str = "full_") -> str:
    """rolled(date, lexicon, feature, time, value) from rows of ``source``."""
    lag = len(next(iter(weights.values())))
    lagged = lambda k: "value" if k == 0 else f"lag(value, {k}) over w"
    one = lambda name, ws: f"select date, lexicon, feature, '{name}' as time, row_number() over w k, " + " + ".join(f"coalesce({lagged(lag - 1 - i)}, 0) * {float(x)!r}::double" for i, x in enumerate(ws)) + f" as value from {source} window w as (partition by lexicon, feature order by date)"
    return f"rolled as (select date, lexicon, feature, time, value from ({' union all '.join(one(k, v) for k, v in weights.items())}) where k >= {lag})"


PANEL = f"{EVENTS}, {DAILY}, {GRID}, {roll_sql(CONTROL.time_weights())}, panel as (select * from rolled)"
