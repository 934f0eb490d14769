"""The queries of the engine and, where SQL can say the same, their SQL.  Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import weights as W
from ..operators import aggregation as A
from ..operators import attribution as H
from ..operators import corpus as C
from ..operators import model as M
from ..operators import panel as P
from ..operators.lexicons import Lexicons
from ..operators.scoring import scored, sentiment
from ..session import spread
from . import base as B
from .base import r6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- corpus and texts


@query("a1_corpus_rescale", f"with {B.CORPUS}, m as (select min(n_chars)::double lo, max(n_chars)::double hi from documents) select c.id, c.date, round(case when lo < 0 or hi > 1 then (n_chars - lo) / (hi - lo) else n_chars end, 6) + 0.0 as n_chars from documents d join corpus c on c.id = cast(d.doc_id as varchar) cross join m")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = B.table(s, d, "documents")
    made = C.build(docs.select(F.col("doc_id").alias("id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 730).cast("int")).cast("string").alias("date"), F.col("text").alias("texts"), F.col("n_chars").alias("n chars")))
    return made.select("id", "date", r6("n_chars").alias("n_chars"))


@query("a2_clean_texts", """select cast(doc_id as varchar) id, regexp_replace(regexp_replace(regexp_replace(text, '<.*?>', '', 'g'), '["]', '', 'g'), '[^-a-zA-Z0-9,&. ]', '', 'g') as texts from documents""")
def _(s: SparkSession, d: str) -> DataFrame:
    return B.corpus(s, d).select("id", T.clean(F.col("texts")).alias("texts"))


_LAB = f"with {B.CORPUS}, lab as (select c.id, c.date, c.texts, c.odd, coalesce(l.quality, 0)::double quality, coalesce(l.toxic, 0)::double toxic from corpus c left join labels l on cast(l.doc_id as varchar) = c.id)"


@query("a3_add_features", f"{_LAB} select id, odd, quality, toxic, 0.5::double as share from lab")
def _(s: SparkSession, d: str) -> DataFrame:
    marks = B.table(s, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    both = C.add_features(C.add_features(B.corpus(s, d), marks).fillna(0.0, ["quality", "toxic"]), {"share": 0.5})
    return both.select("id", "odd", "quality", "toxic", "share")


@query("a4_keyword_features", rf"""with {B.CORPUS}, k as (select id, regexp_matches(texts, '\bthe\b|\band\b')::int::double word, len(regexp_extract_all(texts, '[Ll]icen[cs]e|[0-9]+'))::double many from corpus), m as (select min(many) lo, max(many) hi from k)
select id, word, round((many - lo) / nullif(hi - lo, 0), 6) + 0.0 as many from k cross join m""")
def _(s: SparkSession, d: str) -> DataFrame:
    more = C.add_features(B.corpus(s, d), keywords={"word": ["the", "and"], "many": "[Ll]icen[cs]e|[0-9]+"}, binary={"word": True, "many": False}, regex={"word": False, "many": True})
    return more.select("id", "word", r6("many").alias("many"))


@query("a5_remove_features", f"with {B.CORPUS} select id, date, texts, language, 1.0::double as \"dummyFeature\" from corpus")
def _(s: SparkSession, d: str) -> DataFrame:
    return C.remove_features(B.corpus(s, d), ["odd", "even"])


@query("a6_corpus_summary", f"""with {B.CORPUS}, n as (select date_trunc('month', date)::date as date, len({B.tokens_sql('texts')}) n, odd, even from corpus)
select date, count(*) as documents, sum(n)::bigint as "totalTokens", round(avg(n), 6) as "meanTokens", min(n)::bigint as "minTokens", max(n)::bigint as "maxTokens", sum((odd > 0)::int)::bigint as odd, sum((even > 0)::int)::bigint as even from n group by 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    return C.summarize(B.corpus(s, d), "month").withColumn("meanTokens", F.round("meanTokens", 6))


@query("a13_trim", f"with {B.CORPUS} select id from corpus where len({B.tokens_sql('texts')}) between 100 and 1000")
def _(s: SparkSession, d: str) -> DataFrame:
    return C.trim(B.corpus(s, d), 100, 1000).select("id")


@query("a13_segments", f"with {B.CORPUS}, p as (select id, unnest(string_split(texts, chr(10))) s, generate_subscripts(string_split(texts, chr(10)), 1) k from corpus) select id || '.' || k as id, trim(s) as texts from p where trim(s) <> ''")
def _(s: SparkSession, d: str) -> DataFrame:
    return C.segments(B.corpus(s, d), "\n").select("id", "texts")


@query("a13_sentences")
def _(s: SparkSession, d: str) -> DataFrame:
    return C.to_sentences(B.corpus(s, d)).select("id", "texts")


@query("b1_tokens", f"with {B.CORPUS}, t as (select id, {B.tokens_sql('texts')} t from corpus) select id, len(t)::int as n, array_to_string(t, ' ') as tokens from t")
def _(s: SparkSession, d: str) -> DataFrame:
    t = spread(B.corpus(s, d).select("id", "texts")).select("id", T.tokens(F.col("texts")).alias("t"))
    return t.select("id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("b2_sentences")
def _(s: SparkSession, d: str) -> DataFrame:
    cut = spread(B.corpus(s, d).select("id", "texts")).select("id", F.posexplode_outer(T.sentence_tokens(F.col("texts"))).alias("sentence", "tokens"))
    return cut.where("sentence is not null")


# --- lexicons


def _lexicon_rows(s: SparkSession, lex: Lexicons) -> DataFrame:
    return s.createDataFrame([(k, x, y) for k in lex for x, y in lex[k].items()], "lexicon string, x string, y double")


@query("b4_lexicon_dedup", """with w as (select lower(n_name) x, n_nationkey::double y from nation union all select lower(n_name), 99 from nation where n_nationkey % 3 = 0 union all select r_name, r_regionkey + 0.5 from region union all select lower(r_name), 7 from region where r_regionkey = 2)
select lower(x) as x, max_by(y, case when x = lower(x) then 1 else 0 end) as y from w where lower(x) not in (select x from w group by x having count(*) > 1) and not regexp_matches(x, '\\s') group by lower(x)""")
def _(s: SparkSession, d: str) -> DataFrame:
    nation, region = B.table(s, d, "nation").orderBy("n_nationkey").collect(), B.table(s, d, "region").orderBy("r_regionkey").collect()
    pairs = [(r.n_name.lower(), float(r.n_nationkey)) for r in nation] + [(r.n_name.lower(), 99.0) for r in nation if r.n_nationkey % 3 == 0]
    pairs += [(r.r_name, r.r_regionkey + 0.5) for r in region] + [(r.r_name.lower(), 7.0) for r in region if r.r_regionkey == 2]
    return s.createDataFrame([*Lexicons({"places": pairs})["places"].items()], "x string, y double")


@query("b5_lexicon_split", f"with {B.lexicon_sql()} select lexicon || case when y > 0 then '_POS' else '_NEG' end as lexicon, word as x, y from lex where y <> 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return _lexicon_rows(s, Lexicons(B.LEX, split=True))


@query("b6_valence", f"select x, min_by(y, k) as y from (values {', '.join(f'({i}, $${r['x']}$$, {r['y']}::double)' for i, r in enumerate(B.VALENCE_Y + [{'x': 'OF', 'y': 5.0}]))}) t(k, x0, y), lateral (select lower(x0) x) group by x")
def _(s: SparkSession, d: str) -> DataFrame:
    made = Lexicons(B.LEX, [*B.VALENCE_Y, {"x": "OF", "y": 5.0}])
    return s.createDataFrame(list(made.valence.values), "x string, y double")


@query("b10_lexicon_map", f"with {B.lexicon_sql()} select word as x, coalesce(max(y) filter (lexicon = 'lexA'), 0) as \"lexA\", coalesce(max(y) filter (lexicon = 'lexB'), 0) as \"lexB\" from lex group by word")
def _(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(w, *v) for w, v in B.lexicons().word_map().items()], "x string, lexA double, lexB double")


@query("b12_frequencies", f"with {B.CORPUS}, t as (select id, unnest({B.tokens_sql('texts')}) token from corpus), tf as (select id, token, count(*) n from t group by all) select token, sum(n)::bigint as tf, count(*) as df from tf group by token")
def _(s: SparkSession, d: str) -> DataFrame:
    tf, _ = C.document_frequencies(B.corpus(s, d).select("id", T.tokens(F.col("texts")).alias("tokens")))
    return tf.groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


# --- scores


def _unigram(how: str, kind: str | None) -> Query:
    return lambda s, d: sentiment(B.corpus(s, d), B.lexicons(kind), how, features=[]).select("id", "word_count", "lexicon", r6("score").alias("score"))


_FINAL = "select id, n as word_count, lexicon, round(score, 6) + 0.0 as score from result"
for _how, _name in zip(W.WITHIN, ("counts", "proportional", "proportional_pol", "sqrt", "ushaped", "inv_ushaped", "exp", "inv_exp", "tfidf")):
    query("c12_tfidf" if _name == "tfidf" else f"c3_unigram_{_name}", f"with {B.scored_sql(_how, source=B.CORPUS)} {_FINAL}")(_unigram(_how, None))
    if _name in ("counts", "proportional_pol", "exp", "tfidf"):
        query(f"c4_bigram_{_name}", f"with {B.scored_sql(_how, 'y', source=B.CORPUS)} {_FINAL}")(_unigram(_how, "y"))

_SHIFT = f"val as (select * from {B.values([(r['x'], float(r['t'])) for r in B.VALENCE_T])} t(w, t))"
#: Cluster scores: the chain of hits that are centres (the search goes on behind the window and the token after it), and their windows.
_CLUSTERS = f"""with recursive {B.CORPUS}, {B.lexicon_sql()}, {_SHIFT}, toks as (select id, {B.tokens_sql('texts')} t from corpus),
e as (select id, len(t) n, unnest(t) w, generate_subscripts(t, 1) - 1 k from toks), words as (select distinct word from lex),
ent as materialized (select e.*, word is not null hit, case when word is null then val.t end v from e left join words on word = e.w left join val on val.w = e.w where word is not null or val.w is not null),
nxt as materialized (select h.id, h.n, h.k, g.k nk from (select * from ent where hit) h asof left join (select * from ent where hit) g on h.id = g.id and h.k + 4 <= g.k),
chain as (select nxt.id, nxt.n, nxt.k, 0::bigint lb, nk from nxt join (select id, min(k) k from nxt group by id) f on f.id = nxt.id and f.k = nxt.k
  union all select x.id, x.n, x.k, least(c.n, c.k + 3) + 1, x.nk from chain c join nxt x on x.id = c.id and x.k = c.nk),
win as (select c.id, c.k j, ent.k, ent.w, ent.hit, ent.v from (select *, unnest([-4, -3, -2, -1, 0, 1, 2]) o from chain) c join ent on ent.id = c.id and ent.k = c.k + c.o and ent.k >= c.lb and ent.k < c.n),
imp as (select id, j, count(*) filter (v = 1) % 2 neg, count(*) filter (v = 2) amp, count(*) filter (v = 3) deamp from win group by all),
hit as (select win.*, case when k = j then (1 - 2 * neg) * (1 + greatest(0.8 * ((1 - neg) * amp - (neg * amp + deamp)), -1)) else 1 end f from win join imp using (id, j) where hit),
s as (select id, lexicon, sum(f * y) s, count(*) filter (y <> 0) c from hit join lex on word = w group by all)
select toks.id, len(t)::double as word_count, l.lexicon, round(coalesce(__S__, 0) + 1e-9, 6) + 0.0 as score from toks cross join (select distinct lexicon from lex) l left join s on s.id = toks.id and s.lexicon = l.lexicon"""
for _how, _name, _x in (("counts", "counts", "s"), ("proportionalPol", "proportional_pol", "s / nullif(c, 0)")):  # moved off ties, which the two sides round apart
    query(f"c5_cluster_{_name}", _CLUSTERS.replace("__S__", _x))(lambda s, d, h=_how: sentiment(B.corpus(s, d), B.lexicons("t"), h, features=[]).select("id", "word_count", "lexicon", r6(F.col("score") + 1e-9).alias("score")))


#: Sentences are given as tokens here: the lines of a text, as SQL has no sentence breaks.
_LINES = f"""with {B.CORPUS}, {B.lexicon_sql()}, {_SHIFT}, p as (select id, unnest(string_split(texts, chr(10))) l, generate_subscripts(string_split(texts, chr(10)), 1) p from corpus),
toks as (select id, row_number() over (partition by id order by p) sid, t from (select id, p, {B.tokens_sql("replace(l, ', ', ' c_c ')")} t from p) where len(t) > 0),
e as (select id, sid, len(t) n, unnest(t) w, generate_subscripts(t, 1) - 1 k from toks), words as (select distinct word from lex),
ent as (select e.*, word is not null hit, case when word is null then val.t end v from e left join words on word = e.w left join val on val.w = e.w where word is not null or val.w is not null),
h as (select h.*, coalesce(c.k, least(h.n, h.k + 3)) en from (select * from ent where hit) h asof left join (select * from e where w = 'c_c') c on c.id = h.id and c.sid = h.sid and least(h.n, h.k + 3) <= c.k),
imp as (select h.id, h.sid, h.k, h.w, count(*) filter (x.v = 1) % 2 neg, count(*) filter (x.v = 2) amp, count(*) filter (x.v = 3) deamp, count(*) filter (x.v = 4 and x.k < h.k) - count(*) filter (x.v = 4 and x.k > h.k) adv
  from h left join ent x on x.id = h.id and x.sid = h.sid and not x.hit and x.k >= h.k - 5 and x.k < h.en group by all),
s as (select id, sid, lexicon, sum(y * (1 - 2 * neg) * (1 + 0.8 * (1 - neg) * amp + greatest(0.8 * (-neg * amp - deamp), -1)) * (1 + 0.25 * adv)) s from imp join lex on word = w group by all)
select toks.id, toks.sid::int as sentence_id, len(t)::double as word_count, l.lexicon, round(coalesce(s, 0), 6) + 0.0 as score from toks cross join (select distinct lexicon from lex) l left join s on s.id = toks.id and s.sid = toks.sid and s.lexicon = l.lexicon"""


@query("c6_line_clusters", _LINES)
def _(s: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("texts", "\n"), lambda x: T.tokens(F.replace(x, F.lit(", "), F.lit(f" {T.COMMA} ")))), lambda t: F.size(t) > 0)
    given = spread(B.corpus(s, d).select("id", "texts")).select("id", lines.alias("lines"))
    return sentiment(given, B.lexicons("t"), "counts", sentence=True, tokens="lines", features=[]).select("id", "sentence_id", "word_count", "lexicon", r6("score").alias("score"))


@query("c6_sentence_clusters")
def _(s: SparkSession, d: str) -> DataFrame:
    return sentiment(B.corpus(s, d), B.lexicons("t"), "counts", sentence=True, features=[]).select("id", "sentence_id", "word_count", "lexicon", r6("score").alias("score"))


@query("c16_feature_spread", f"with {B.scored_sql('proportional', source=B.CORPUS)} select id, lexicon, f.feature as feature, round(score * case f.feature when 'odd' then odd else even end, 6) + 0.0 as score from result join corpus using (id) cross join (values ('odd'), ('even')) f(feature)")
def _(s: SparkSession, d: str) -> DataFrame:
    return sentiment(B.corpus(s, d), B.lexicons(), "proportional").select("id", "lexicon", "feature", r6("score").alias("score"))


_LANG = [(lang, k, x, y) for lang, lex in B.LANGUAGES.items() for k, v in lex.items() for x, y in v.items()]


@query("c18_multilang", f"""with {B.CORPUS}, lex as (select * from {B.values(_LANG)} t(lang, lexicon, x, y)), t as (select id, language, unnest({B.tokens_sql('texts')}) w from corpus),
s as (select id, lexicon, sum(y) s from t join lex on lex.lang = t.language and lex.x = t.w group by all)
select c.id, n.lexicon, round(coalesce(s.s, 0), 6) + 0.0 as score from corpus c cross join (select distinct lexicon from lex) n left join s on s.id = c.id and s.lexicon = n.lexicon""")
def _(s: SparkSession, d: str) -> DataFrame:
    return sentiment(B.corpus(s, d), {k: Lexicons(v) for k, v in B.LANGUAGES.items()}, "counts", features=[]).select("id", "lexicon", r6("score").alias("score"))


# --- sentiment tables: events are documents with scores, turns of conversations are sentences


@query("d1_merge_sentiment", f"with {B.EVENTS} select id, lexicon, feature, round(score, 6) + 0.0 as score from sent")
def _(s: SparkSession, d: str) -> DataFrame:
    wide = B.events(s, d)
    a, b = wide.drop("lexB--up", "lexB--down"), wide.drop("lexA--up", "lexA--down")
    return A.merged(A.as_sentiment(a), A.as_sentiment(b)).select("id", "lexicon", "feature", r6("score").alias("score"))


@query("d2_as_sentiment", f"with {B.EVENTS} select id, date, wc as word_count, lexicon, feature, round(score, 6) + 0.0 as score from sent")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.as_sentiment(B.events(s, d)).select("id", "date", "word_count", "lexicon", "feature", r6("score").alias("score"))


for _kind, _x in (("both", "abs(score)"), ("neg", "-score"), ("pos", "score")):
    query(f"d3_peakdocs_{_kind}", f"with {B.EVENTS} select id from (select id, max({_x}) x from sent group by id) order by x desc, id limit 25")(
        lambda s, d, k=_kind: A.peaks(A.as_sentiment(B.events(s, d)), "id", "score", 25, k))


@query("d4_periods", f"with {B.CORPUS} select id, date_trunc('year', date)::date as year, date_trunc('month', date)::date as month, date_trunc('week', date)::date as week from corpus")
def _(s: SparkSession, d: str) -> DataFrame:
    return B.corpus(s, d).select("id", *(C.period(F.col("date"), k).alias(k) for k in ("year", "month", "week")))


_TURNS = f"""lines as (select cast(conv_id as varchar) as id, cast(turn as varchar) as turn, row_number() over (partition by conv_id order by turn, role, text) k, text texts from conversations),
{B.scored_sql('proportional', keys='id, k').replace('from corpus)', 'from lines)')}"""


def _turns(s: SparkSession, d: str) -> DataFrame:
    t = B.table(s, d, "conversations")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = t.select(F.col("conv_id").cast("string").alias("id"), k.alias("sentence_id"), T.tokens(F.col("text")).alias("t"))
    lex = B.lexicons()
    named = F.arrays_zip(F.array(*map(F.lit, lex)).alias("lexicon"), F.col("scores").alias("score"))
    return scored(rows, "t", lex, "proportional").select("id", "sentence_id", "word_count", F.lit("dummyFeature").alias("feature"), F.inline(named))


@query("e3_sentence_to_doc", f"with {_TURNS} select id, lexicon, sum(n)::double as word_count, round(coalesce(sum(score * n) filter (score <> 0) / nullif(sum(n) filter (score <> 0), 0), 0), 6) + 0.0 as score from result group by id, lexicon")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.sentences_to_docs(_turns(s, d), "proportional").select("id", "lexicon", "word_count", r6("score").alias("score"))


_DOCS = {
    "equal": ("equal_weight", "avg(score) filter (score <> 0)"),
    "prop": ("proportional", "sum(score * wc) filter (score <> 0) / nullif(sum(wc) filter (score <> 0), 0)"),
    "inv_prop": ("inverseProportional", "sum(score / wc) filter (score <> 0) / nullif(sum(1 / wc) filter (score <> 0), 0)"),
    "exp": ("exponential", "sum(score * (1 - wc / total)) filter (score <> 0) / nullif(sum(1 - wc / total) filter (score <> 0), 0)"),
    "inv_exp": ("inverseExponential", "sum(score * (1 - wc / total)) filter (score <> 0) / nullif(sum(1 - wc / total) filter (score <> 0), 0)"),
}
for _name, (_how, _x) in _DOCS.items():
    _sql = f"with {B.EVENTS}, g as (select *, sum(wc) over (partition by date, lexicon, feature) total from sent) select date, lexicon, feature, round(coalesce({_x}, 0), 6) + 0.0 as value from g group by all"
    query(f"e4_docs_{_name}", _sql)(lambda s, d, h=_how: A.docs_to_dates(A.as_sentiment(B.events(s, d)), h).withColumn("value", r6("value")))
    query(f"e4_docs_{_name}_zeros", _sql.replace(" filter (score <> 0)", ""))(lambda s, d, h=_how: A.docs_to_dates(A.as_sentiment(B.events(s, d)), h, ignore_zeros=False).withColumn("value", r6("value")))


@query("e4_document_weights", f"with {B.EVENTS} select id, date, lexicon, feature, round(case when score <> 0 then wc / sum(case when score <> 0 then wc end) over (partition by date, lexicon, feature) end, 9) as w from sent")
def _(s: SparkSession, d: str) -> DataFrame:
    return A.document_weights(A.as_sentiment(B.events(s, d)), "proportional", "day", True).select("id", "date", "lexicon", "feature", F.round("w", 9).alias("w"))


_DAILY = f"{B.EVENTS}, {B.DAILY}"


def _daily(s: SparkSession, d: str) -> DataFrame:
    return A.docs_to_dates(A.as_sentiment(B.events(s, d)), "proportional")


_ROLL = {
    "equal": W.time_weights(["equal_weight"], 3), "linear": W.time_weights(["linear"], 3), "exponential": W.time_weights(["exponential"], 5, alphas=(0.1, 0.6), inverse_exp=True),
    "almon": W.time_weights(["almon"], 4), "beta": W.time_weights(["beta"], 4, a=(1, 2), b=(1, 3)), "own": W.time_weights(["own"], 3, own=B.OWN),
}
_OUT = "select date, lexicon, feature, time, round(value, 6) + 0.0 as value from"
for _name, _ws in _ROLL.items():
    query(f"e6_roll_{_name}", f"with {_DAILY}, {B.GRID}, {B.roll_sql(_ws)} {_OUT} rolled")(lambda s, d, w=_ws: A.rolled(A.filled(_daily(s, d), "day"), w).select("date", "lexicon", "feature", "time", r6("value").alias("value")))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Monthly panel of the documents: proportional unigram scores, equal weights over documents, linear ones over three months."""
    control = A.Aggregation(docs="equal_weight", time=("linear",), by="month", lag=3)
    return P.measures(B.corpus(s, d), B.lexicons(), control).panel.select("date", "lexicon", "feature", "time", r6("value").alias("value"))


_MONTHLY = f"""{B.scored_sql('proportional', source=B.CORPUS)}, m as (select date_trunc('month', date)::date as date, lexicon, feature, coalesce(avg(v) filter (v <> 0), 0) as value from
  (select date, lexicon, f.feature as feature, score * case f.feature when 'odd' then odd else even end v from result join corpus using (id) cross join (values ('odd'), ('even')) f(feature)) group by all)"""
query("e7_measures", f"with {_MONTHLY}, {B.roll_sql(W.time_weights(['linear'], 3), 'm')} {_OUT} rolled")(flagship)


# --- the panel


def _measures(s: SparkSession, d: str) -> P.Measures:
    return P.aggregate(A.as_sentiment(B.events(s, d)), B.CONTROL)


def _panel(s: SparkSession, d: str) -> DataFrame:
    return _measures(s, d).panel


def _out(df: DataFrame) -> DataFrame:
    return df.select("date", "lexicon", "feature", "time", r6("value").alias("value"))


_P = f"with {B.PANEL}"

query("f1_fill_zero", f"with {_DAILY}, {B.GRID} select date, lexicon, feature, round(value, 6) + 0.0 as value from full_")(lambda s, d: A.filled(_daily(s, d), "day").withColumn("value", r6("value")))


@query("f1_fill_latest", f"""with {_DAILY}, g as (select unnest(generate_series(date '2023-12-28', (select max(date) from sent) + 3, interval 1 day))::date as date), s as (select distinct lexicon, feature from sent),
j as (select g.date, s.lexicon, s.feature, value from g cross join s left join daily d on d.date = g.date and d.lexicon = s.lexicon and d.feature = s.feature)
select date, lexicon, feature, round(coalesce(last_value(value ignore nulls) over (partition by lexicon, feature order by date), first_value(value ignore nulls) over (partition by lexicon, feature order by date rows between current row and unbounded following)), 6) + 0.0 as value from j""")
def _(s: SparkSession, d: str) -> DataFrame:
    # the last day after the end is three days on, wherever the data end
    p = _daily(s, d)
    end = p.agg(F.date_add(F.max("date"), 3).cast("string")).first()[0]
    return A.filled(p, "day", "latest", before="2023-12-28", after=end).withColumn("value", r6("value"))


@query("f3_update", f"{_P} {_OUT} panel")
def _(s: SparkSession, d: str) -> DataFrame:
    # half of the documents are scored already; the other half comes as new, along with repeated ones
    whole = A.as_sentiment(B.events(s, d))
    return _out(P.aggregate(whole.where("pmod(hash(id), 2) = 0"), B.CONTROL).updated(whole).panel)


@query("f3_update_texts", SQL["e7_measures"])
def _(s: SparkSession, d: str) -> DataFrame:
    control = A.Aggregation(time=("linear",), by="month", lag=3)
    whole = B.corpus(s, d)
    first = P.measures(whole.where("odd = 0"), B.lexicons(), control)
    return _out(first.update(whole, B.lexicons()).panel)


@query("f5_group", f"{_P}, a as (select date, 'lexAB' lexicon, feature, time, avg(value) as value from panel group by all) select date, lexicon, 'any' as feature, time, round(avg(value), 6) + 0.0 as value from a group by all")
def _(s: SparkSession, d: str) -> DataFrame:
    return _out(P.grouped(_panel(s, d), lexicons={"lexAB": ["lexA", "lexB"]}, features={"any": ["up", "down"]}))


@query("f6_global", f"{_P}, g as (select date, avg(value * 0.5) l, avg(value * case feature when 'up' then 0.7 else 0.3 end) f, avg(value * 0.5) t from panel group by date) select date, round(l, 6) + 0.0 as \"globLex\", round(f, 6) + 0.0 as \"globFeat\", round(t, 6) + 0.0 as \"globTime\", round((l + f + t) / 3, 6) + 0.0 as \"global\" from g")
def _(s: SparkSession, d: str) -> DataFrame:
    g = P.global_indices(_panel(s, d), features={"up": 0.7, "down": 0.3})
    return g.select("date", *(r6(c).alias(c) for c in g.columns[1:]))


query("f7_subset", f"{_P} {_OUT} panel where date >= date '2024-01-10'")(lambda s, d: _out(P.subset(_panel(s, d), "date >= date'2024-01-10'")))
query("f7_subset_measure", f"{_P} {_OUT} panel where date in (select date from panel where lexicon = 'lexA' and feature = 'up' and time = 'linear' and value > 0)")(lambda s, d: _out(P.subset(_panel(s, d), "`lexA--up--linear` > 0")))
query("f7_subset_rows", f"{_P} {_OUT} panel where date in (select date from (select date, row_number() over (order by date) k from (select distinct date from panel)) where k in (1, 3, 8))")(lambda s, d: _out(P.subset(_panel(s, d), rows=[1, 3, 8])))
query("f8_select", f"{_P} {_OUT} panel where (lexicon = 'lexA' and time = 'linear') or feature = 'down'")(lambda s, d: _out(P.select(_panel(s, d), [["lexA", "linear"], ["down"]])))
query("f9_delete", f"{_P} {_OUT} panel where not (lexicon = 'lexA' and feature = 'up')")(lambda s, d: _out(P.delete(_panel(s, d), [["lexA", "up"]])))
query("f10_diff", f"{_P}, w as (select *, value - 2 * lag(value, 2) over w + lag(value, 4) over w dd, row_number() over w k from panel window w as (partition by lexicon, feature, time order by date)) select date, lexicon, feature, time, round(dd, 6) + 0.0 as value from w where k > 4")(lambda s, d: _out(P.differenced(_panel(s, d), 2, 2)))
query("f11_scale", f"{_P} select date, lexicon, feature, time, round((value - avg(value) over w) / stddev_samp(value) over w, 6) + 0.0 as value from panel window w as (partition by lexicon, feature, time)")(lambda s, d: _out(P.scaled(_panel(s, d))))
query("f11_scale_uncentred", f"{_P} select date, lexicon, feature, time, round(value / sqrt(sum(value * value) over w / (count(*) over w - 1)), 6) + 0.0 as value from panel window w as (partition by lexicon, feature, time)")(lambda s, d: _out(P.scaled(_panel(s, d), center=False)))


@query("f12_stats", f"""{_P}, n as (select date, lexicon || '--' || feature || '--' || time s, value from panel), c as (select a.s, corr(a.value, b.value) r from n a join n b on a.date = b.date and a.s <> b.s group by a.s, b.s), m as (select s, avg(r) r from c group by s)
select lexicon, feature, time, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(max(value), 6) as max, round(min(value), 6) as min, round(any_value(m.r), 6) as "meanCorr" from panel join m on m.s = lexicon || '--' || feature || '--' || time group by lexicon, feature, time""")
def _(s: SparkSession, d: str) -> DataFrame:
    st = P.stats(_panel(s, d))
    return st.select("lexicon", "feature", "time", *(F.round(c, 6).alias(c) for c in st.columns[3:]))


query("f13_long", f"{_P} {_OUT} panel")(lambda s, d: _out(P.long(P.wide(_panel(s, d)))))


@query("f14_wide", f"""{_P} select date, round(max(value) filter (lexicon = 'lexA' and feature = 'up' and time = 'linear'), 6) + 0.0 as "lexA_up_linear", round(max(value) filter (lexicon = 'lexB' and feature = 'down' and time = 'equal_weight'), 6) + 0.0 as "lexB_down_equal" from panel group by date""")
def _(s: SparkSession, d: str) -> DataFrame:
    return P.wide(_panel(s, d), ["lexA--up--linear", "lexB--down--equal_weight"]).select("date", r6(F.col("`lexA--up--linear`")).alias("lexA_up_linear"), r6(F.col("`lexB--down--equal_weight`")).alias("lexB_down_equal"))


@query("f15_dimensions", f"{_P} select count(distinct (lexicon, feature, time)) as measures, count(distinct date) as obs, string_agg(distinct lexicon, ',' order by lexicon) as lexicons, string_agg(distinct feature, ',' order by feature) as features, string_agg(distinct time, ',' order by time) as times from panel")
def _(s: SparkSession, d: str) -> DataFrame:
    m = _measures(s, d).keep()
    dims = m.dimensions()
    return s.createDataFrame([(m.n_measures(), m.n_obs(), *(",".join(dims[k]) for k in ("lexicons", "features", "time")))], "measures bigint, obs bigint, lexicons string, features string, times string")


@query("f17_grouped_weights", f"""{_P}, w as (select id, date, lexicon, feature, wc / sum(wc) over (partition by date, lexicon, feature) w from sent where score <> 0),
a as (select id, date, lexicon, sum(w) / 2 w from w group by all), b as (select id, date, lexicon, w / sum(w) over (partition by date, lexicon) w from a),
c as (select id, date, sum(w) / 2 w from b group by all) select i.id, i.date, 'lexAB' as lexicon, 'any' as feature, round(coalesce(c.w, 0) / sum(c.w) over (partition by i.date), 9) as w from (select distinct id, date from sent) i left join c on c.id = i.id and c.date = i.date""")
def _(s: SparkSession, d: str) -> DataFrame:
    return _grouped(s, d).document_weights.select("id", "date", "lexicon", "feature", F.round("w", 9).alias("w"))


def _grouped(s: SparkSession, d: str) -> P.Measures:
    return _measures(s, d).aggregate(lexicons={"lexAB": ["lexA", "lexB"]}, features={"any": ["up", "down"]})


query("f16_peakdates", f"{_P} select date from (select date, max(abs(value)) x from panel group by date) order by x desc, date limit 5")(lambda s, d: P.A.peaks(_panel(s, d), "date", "value", 5))
query("f16_peakdates_average", f"{_P} select date from (select date, -avg(value) x from panel group by date) order by x desc, date limit 5")(lambda s, d: P.A.peaks(_panel(s, d), "date", "value", 5, "neg", True))
query("f19_plot", f"{_P} select date, lexicon as variable, round(avg(value), 6) + 0.0 as value from panel group by all")(lambda s, d: P.by_dimension(_panel(s, d), "lexicon").withColumn("value", r6("value")))


# --- models: what fits use, over the panel's matrix; the response is a formula of the date


_Y = "y as (select date, cast(day(date) * day(date) % 17 + 0.25 * month(date) as double) y from (select distinct date from panel))"


def _rows(s: SparkSession, dates: list, names: list[str], x: np.ndarray, y: np.ndarray) -> DataFrame:
    table = [(d, float(v), *n.split("--"), float(x[i, j])) for i, (d, v) in enumerate(zip(dates, y)) for j, n in enumerate(names)]
    return s.createDataFrame(table, "date date, response double, lexicon string, feature string, time string, value double")


@query("g3_align", f"{_P}, {_Y}, m as (select date, lead(y, 2) over (order by date) - y as response from y) select date, round(response, 6) + 0.0 as response, lexicon, feature, time, round(value, 6) + 0.0 as value from panel join m using (date) where response is not null")
def _(s: SparkSession, d: str) -> DataFrame:
    dates, names, x = M.panel_matrix(_panel(s, d))
    x, y, dates = M.align(x, np.array([t.day * t.day % 17 + 0.25 * t.month for t in dates]), dates, 2, True)
    return _rows(s, dates, names, x, y).withColumn("response", r6("response")).withColumn("value", r6("value"))


@query("g4_clean_panel", f"{_P}, q as (select date, lexicon, feature, time, case when value > 0 then value else 0 end as value from panel), a as (select lexicon, feature, time, avg((value = 0)::int) z, list((date, value) order by date) l from q group by all) select lexicon, feature, time, (z > 0.5 or row_number() over (partition by l order by lexicon, feature, time) > 1) as discarded from a")
def _(s: SparkSession, d: str) -> DataFrame:
    _, names, x = M.panel_matrix(_panel(s, d))
    return s.createDataFrame([(*n.split("--"), bool(g)) for n, g in zip(names, M.discard(np.maximum(x, 0.0)))], "lexicon string, feature string, time string, discarded boolean")


@query("g8_cv_slices", f"{_P}, n as (select count(distinct date) n from panel) select i as slice, i as train_from, i + 11 as train_to, i + 14 as test_from, i + 16 as test_to from (select unnest(generate_series(1, n - 2 - 3 - 12 + 1)) i from n)")
def _(s: SparkSession, d: str) -> DataFrame:
    slices = M.cv_slices(_measures(s, d).n_obs(), 12, 3, 2)
    return s.createDataFrame([(k + 1, a[0], a[-1], b[0], b[-1]) for k, (a, b) in enumerate(slices)], "slice bigint, train_from bigint, train_to bigint, test_from bigint, test_to bigint")


def _fit(s: SparkSession, d: str, control: M.ModelControl, classes: int = 0):  # noqa: ANN202
    m = _measures(s, d)
    dates, names, x = M.panel_matrix(m.panel)
    y = x @ np.linspace(-1, 1, len(names)) + np.cos(np.arange(len(dates)))
    if classes:
        cuts = np.quantile(y, np.linspace(0, 1, classes + 1)[1:-1])
        y = [f"class{k}" for k in np.searchsorted(cuts, y)]
    return m, M.fit(m.panel, list(y), control, {"x1": np.sin(np.arange(len(dates)) / 3)})


def _coefs(s: SparkSession, fitted) -> DataFrame:  # noqa: ANN001
    return fitted.coefficients(s).withColumn("coef", r6("coef"))


for _kind in ("BIC", "AIC", "Cp"):
    query(f"g5_enet_ic_{_kind.lower()}")(lambda s, d, k=_kind: _coefs(s, _fit(s, d, M.ModelControl(kind=k, alphas=(0.0, 0.5, 1.0)))[1]))
query("g9_enet_cv")(lambda s, d: _coefs(s, _fit(s, d, M.ModelControl(kind="cv", alphas=(0.2, 0.8), lambdas=tuple(10 ** np.linspace(1, -2, 20)), train_window=20, test_window=4))[1]))
query("g9_multinomial_cv")(lambda s, d: _coefs(s, _fit(s, d, M.ModelControl(model="multinomial", kind="cv", alphas=(0.5,), lambdas=(0.5, 0.1, 0.02), train_window=25, test_window=5), 3)[1]))


@query("g11_iterative")
def _(s: SparkSession, d: str) -> DataFrame:
    it = _fit(s, d, M.ModelControl(kind="BIC", alphas=(0.3, 1.0), iterative=True, n_sample=25, h=1))[1]
    return s.createDataFrame(it.performance[["date", "response", "predicted"]]).select("date", r6("response").alias("response"), r6("predicted").alias("predicted"))


_F = "f as (select date, avg(value) filter (lexicon = 'lexA') as response, avg(value) filter (lexicon = 'lexB') as predicted from panel group by date)"


@query("g12_performance", f"{_P}, {_F} select date, round(response, 6) + 0.0 as response, round(predicted, 6) + 0.0 as predicted, (sign(response - lag(response) over w) = sign(predicted - lag(predicted) over w))::int::double as \"DA\", round(predicted - response, 6) + 0.0 as error, round((predicted - response) ** 2, 6) as \"errorSq\", round(abs(predicted - response), 6) as \"AD\" from f window w as (order by date)")
def _(s: SparkSession, d: str) -> DataFrame:
    f = _panel(s, d).groupBy("date").agg(F.avg(F.when(F.col("lexicon") == "lexA", F.col("value"))).alias("response"), F.avg(F.when(F.col("lexicon") == "lexB", F.col("value"))).alias("predicted"))
    p = s.createDataFrame(M.performance(f.orderBy("date").toPandas())[0].astype(object).where(lambda x: x.notna(), None), "date date, response double, predicted double, DA double, error double, errorSq double, AD double")
    return p.select("date", "DA", *(r6(c).alias(c) for c in ("response", "predicted", "error", "errorSq", "AD")))


_COEF = {f"{a}--{b}--{c}": round(0.1 * (1 + i) + 0.0137 / (3 + i), 7) * (-1) ** i for i, (a, b, c) in enumerate((a, b, c) for a in ("lexA", "lexB") for b in ("up", "down") for c in ("equal_weight", "linear"))}
_COEFS = f"coef as (select * from {B.values([(*k.split('--'), v) for k, v in _COEF.items()])} t(lexicon, feature, time, coef))"


def _model(m: P.Measures) -> M.Model:
    """A model with given coefficients, for the queries whose SQL can't fit one."""
    ends = m.panel.agg(F.min("date"), F.max("date")).first()
    return M.Model("gaussian", 1.0, 0.1, tuple(ends), {"": _COEF}, {"": 0.5}, {}, (8, 0))


@query("g13_predict", f"{_P}, {_COEFS} select date, round(0.5 + sum(coef * value), 6) + 0.0 as value from panel join coef using (lexicon, feature, time) group by date")
def _(s: SparkSession, d: str) -> DataFrame:
    m = _measures(s, d)
    new = m.panel.select("date", P.series_name().alias("term"), "value")
    return _model(m).predict(new).select("date", r6("value").alias("value"))


# --- attribution


def _attributed(part: str, **options) -> Query:  # noqa: ANN003
    def run(s: SparkSession, d: str) -> DataFrame:
        m = _measures(s, d)
        return getattr(H.attributions(_model(m), m, **options), part).withColumn("attrib", r6("attrib"))

    return run


_B = B.CONTROL.time_weights()
_HSQL = f"""{_P}, {_COEFS}, b as (select * from {B.values([(k, 2 - i, w) for k, ws in _B.items() for i, w in enumerate(ws)])} t(time, lag, b)),
w as (select id, date, lexicon, feature, score * wc / sum(wc) over (partition by date, lexicon, feature) sw from sent where score <> 0),
refs as (select distinct date ref_date from panel),
pairs as (select ref_date, ref_date - cast(lag as integer) as date, lag, time, b from refs cross join b)"""
query("h1_docs", f"{_HSQL}, ids as (select distinct id, date from sent), t as (select p.ref_date, i.id, i.date, sum(coef * sw * b) attrib from pairs p join ids i on i.date = p.date left join w on w.id = i.id left join coef c on c.lexicon = w.lexicon and c.feature = w.feature and c.time = p.time where w.id is null or c.coef is not null group by all) select ref_date, id, date, round(coalesce(attrib, 0), 6) + 0.0 as attrib from t")(_attributed("documents"))
query("h2_lags", f"{_HSQL}, v as (select p.ref_date, p.lag, sum(coef * sw * b) attrib from pairs p left join w on w.date = p.date left join coef c on c.lexicon = w.lexicon and c.feature = w.feature and c.time = p.time group by all) select ref_date, 'lag_' || cast(lag as integer) as component, round(coalesce(attrib, 0), 6) + 0.0 as attrib from v")(_attributed("lags"))
for _dim, _plural in (("lexicon", "lexicons"), ("feature", "features"), ("time", "time")):
    query(f"h3_{_plural}", f"{_P}, {_COEFS} select date as ref_date, {_dim} as component, round(sum(coef * value), 6) + 0.0 as attrib from panel join coef using (lexicon, feature, time) group by date, {_dim}")(_attributed(_plural))
query("h4_normalized", f"{_P}, {_COEFS}, a as (select date as ref_date, lexicon as component, sum(coef * value) attrib from panel join coef using (lexicon, feature, time) group by date, lexicon) select ref_date, component, round(coalesce(attrib / nullif(sqrt(sum(attrib * attrib) over (partition by ref_date)), 0), 0), 6) + 0.0 as attrib from a")(_attributed("lexicons", normalize=True))


@query("h6_iterative")
def _(s: SparkSession, d: str) -> DataFrame:
    m, it = _fit(s, d, M.ModelControl(kind="AIC", alphas=(0.5,), iterative=True, n_sample=35, h=1))
    return H.attributions(it, m).features.withColumn("attrib", r6("attrib"))


_TWO = {"equal_weight": 0.3, "linear": -0.7}
_GROUPED = f"""{_HSQL}, two as (select * from {B.values(list(_TWO.items()))} t(time, c)), ids as (select distinct id, date from sent), v as (select id, date, sum(sw) / 4 v from w group by id, date)"""


def _attributed_groups(part: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        m = _grouped(s, d)
        model = replace(_model(m), coef={"": {f"lexAB--any--{k}": c for k, c in _TWO.items()}})
        return getattr(H.attributions(model, m), part).withColumn("attrib", r6("attrib"))

    return run


query("h1_docs_grouped", f"{_GROUPED}, t as (select p.ref_date, i.id, i.date, sum(c * v * b) attrib from pairs p join ids i on i.date = p.date join two using (time) left join v on v.id = i.id and v.date = i.date group by all) select ref_date, id, date, round(coalesce(attrib, 0), 6) + 0.0 as attrib from t")(_attributed_groups("documents"))
query("h2_lags_grouped", f"{_GROUPED}, t as (select date, sum(v) v from v group by date), u as (select p.ref_date, p.lag, sum(c * v * b) attrib from pairs p join two using (time) left join t on t.date = p.date group by all) select ref_date, 'lag_' || cast(lag as integer) as component, round(coalesce(attrib, 0), 6) + 0.0 as attrib from u")(_attributed_groups("lags"))


@query("h6_given", f"{_P}, {_COEFS}, r as (select date, (k - 2) // 4 f from (select date, row_number() over (order by date) k from (select distinct date from panel)) where k in (6, 10, 14)) select date as ref_date, feature as component, round(sum(coef * f * value), 6) + 0.0 as attrib from panel join r using (date) join coef using (lexicon, feature, time) group by date, feature")
def _(s: SparkSession, d: str) -> DataFrame:
    m = _measures(s, d).keep()
    days = [r.date for r in m.dates().orderBy("date").collect()]
    models = {days[4 * f + 1]: replace(_model(m), coef={"": {k: c * f for k, c in _COEF.items()}}) for f in (1, 2, 3)}
    return H.attributions(M.IterativeModel(models, pd.DataFrame(), {}), m).features.withColumn("attrib", r6("attrib"))
