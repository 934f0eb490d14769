"""Corpora: a row for each document with id, date, texts, optional language, and features in [0, 1].

Everything stays lazy: ranges that a feature needs are a one-row aggregate that is joined to the rows, not collected.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import spread

RESERVED = ("id", "sentence_id", "date", "word_count", "texts")
DUMMY = "dummyFeature"
_NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def numeric(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in _NUMBERS or t.startswith("decimal")]


def feature_names(corpus: DataFrame) -> list[str]:
    return [c for c in numeric(corpus) if c not in (*RESERVED, "language")]


def check_names(names: Sequence[str]) -> None:
    """Names of components hold no '-' (it separates dimensions), aren't reserved and occur once."""
    bad = [n for n in names if "-" in n or n in RESERVED]
    if bad or len(set(names)) < len(names):
        raise ValueError(f"names must be unique, not reserved and without '-': {bad or list(names)}")


def _rescaled(df: DataFrame, features: Sequence[str], always: bool = False) -> DataFrame:
    """Features that leave [0, 1] (or all, with ``always``) moved to it by their least and greatest values; constant ones become null."""
    if not features:
        return df
    ends = df.agg(*(F.min(c).cast("double").alias(f"__lo_{c}") for c in features), *(F.max(c).cast("double").alias(f"__hi_{c}") for c in features))

    def scaled(c: str) -> Column:
        x, lo, hi = F.col(c).cast("double"), F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        moved = F.try_divide(x - lo, hi - lo)
        return (moved if always else F.when((lo < 0) | (hi > 1), moved).otherwise(x)).alias(c)

    return df.crossJoin(F.broadcast(ends)).select(*(scaled(c) if c in features else F.col(f"`{c}`") for c in df.columns))


def parsed_date(col: Column) -> Column:
    """A date from yyyy-MM-dd; the query fails at a date that isn't one."""
    day = F.try_to_timestamp(F.substring(col.cast("string"), 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(day.isNull(), F.raise_error(F.concat(F.lit("not a date as yyyy-MM-dd: "), F.coalesce(col.cast("string"), F.lit("null")))).cast("date")).otherwise(day)


def build(df: DataFrame, clean: bool = False) -> DataFrame:
    """A corpus from any frame with id, date and texts.

    Blanks in column names become '_'.  Other columns that aren't numeric are dropped with a warning (but for language);
    without a feature there is one, dummyFeature, of 1.  Features beyond [0, 1] are rescaled.
    """
    df = df.toDF(*(c.replace(" ", "_") for c in df.columns))
    lacking = [c for c in ("id", "date", "texts") if c not in df.columns]
    if lacking:
        raise ValueError(f"a corpus needs the columns id, date and texts; there is no {', '.join(lacking)}")
    features = feature_names(df)
    dropped = [c for c in df.columns if c not in (*RESERVED, "language", *features)]
    if dropped:
        warnings.warn(f"not numeric, hence no features: {', '.join(dropped)}", stacklevel=2)
    check_names(features)
    keys = [F.col("id").cast("string").alias("id"), parsed_date(F.col("date")).alias("date"), (T.clean(F.col("texts")) if clean else F.col("texts")).cast("string").alias("texts")]
    out = df.select(*keys, *(["language"] if "language" in df.columns else []), *(F.col(c).cast("double").alias(c) for c in features))
    return _rescaled(out, features) if features else out.withColumn(DUMMY, F.lit(1.0))


def add_features(corpus: DataFrame, features: DataFrame | Mapping[str, float] | None = None, keywords: Mapping[str, Sequence[str] | str] | None = None, binary: bool | Mapping[str, bool] = True, regex: bool | Mapping[str, bool] = False) -> DataFrame:
    """The corpus with more features; one of the same name replaces the old one.

    ``features`` is a frame with id (joined by it) or constants for all documents; what isn't numeric or leaves [0, 1] is
    skipped with a warning (an aggregate over the frame tells).  ``keywords`` names words, or a pattern with ``regex``; texts
    with any of them get 1, or their count without ``binary``, moved to [0, 1]; a feature that all texts have alike becomes null.
    A keyword that no text has is skipped with a warning (one scan of the texts tells, for all keywords).
    """
    if isinstance(features, DataFrame):
        good = [c for c in numeric(features) if c != "id"]
        ends = features.agg(*(e(c).alias(f"{k}{i}") for i, c in enumerate(good) for k, e in (("lo", F.min), ("hi", F.max)))).first() if good else {}
        inside = [c for i, c in enumerate(good) if (ends[f"lo{i}"] is None or ends[f"lo{i}"] >= 0) and (ends[f"hi{i}"] is None or ends[f"hi{i}"] <= 1)]
        skipped = [c for c in features.columns if c not in inside and c != "id"]
        if skipped:
            warnings.warn(f"skipped, as not numeric or beyond [0, 1]: {', '.join(skipped)}", stacklevel=2)
        check_names(inside)
        if inside:
            corpus = corpus.drop(*inside).join(features.select(F.col("id").cast("string").alias("id"), *(F.col(c).cast("double").alias(c) for c in inside)), "id", "left")
    elif features:
        for c, x in features.items():
            if not 0 <= x <= 1:
                warnings.warn(f"skipped, as beyond [0, 1]: {c}", stacklevel=2)
            else:
                check_names([c])
                corpus = corpus.withColumn(c, F.lit(float(x)))
    if keywords:
        named = {k.replace(" ", "_"): k for k in keywords}
        check_names(list(named))
        of = lambda flag, k: flag[k] if isinstance(flag, Mapping) else flag
        hits: dict[str, Column] = {}
        for c, k in named.items():
            words = keywords[k]
            pattern = T.keyword_pattern(words if isinstance(words, str) else list(words), of(regex, k))
            hits[c] = F.col("texts").rlike(pattern).cast("double") if of(binary, k) else F.regexp_count("texts", F.lit(pattern)).cast("double")
        top = spread(corpus.select("id", "texts")).agg(*(F.max(h).alias(c) for c, h in hits.items())).first()
        absent = [c for c in hits if not top[c]]
        if absent:
            warnings.warn(f"occur in no document, not added: {', '.join(absent)}", stacklevel=2)
        found = [c for c in hits if top[c]]
        corpus = _rescaled(corpus.withColumns({c: hits[c] for c in found}), found, always=True)
    return corpus


def remove_features(corpus: DataFrame, names: Sequence[str]) -> DataFrame:
    if "date" in names or set(names) - set(feature_names(corpus)):
        raise ValueError("only features can be removed")
    out = corpus.drop(*names)
    return out if feature_names(out) else out.withColumn(DUMMY, F.lit(1.0))


def period(date: Column, by: str) -> Column:
    """First day of the year, month, ISO week (its Monday), or the day itself."""
    if by not in ("year", "month", "week", "day"):
        raise ValueError("by must be year, month, week or day")
    return date.cast("date") if by == "day" else F.date_trunc(by, date).cast("date")


def summarize(corpus: DataFrame, by: str = "day", features: Sequence[str] | None = None) -> DataFrame:
    """By period: documents, total, mean, least and most tokens, and documents of each feature."""
    feats = list(features) if features is not None else feature_names(corpus)
    rows = spread(corpus.select("id", "date", "texts", *feats)).select(period(F.col("date"), by).alias("date"), F.size(T.tokens(F.coalesce("texts", F.lit("")))).alias("__n"), *feats)
    return rows.groupBy("date").agg(
        F.count("*").alias("documents"), F.sum("__n").alias("totalTokens"), F.avg("__n").alias("meanTokens"), F.min("__n").cast("bigint").alias("minTokens"),
        F.max("__n").cast("bigint").alias("maxTokens"), *(F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(c) for c in feats),
    )


def to_sentences(corpus: DataFrame) -> DataFrame:
    """A row for each sentence, ids as id.1, id.2, ..."""
    cut = corpus.select("*", F.posexplode_outer(T.sentences(F.col("texts"))).alias("__p", "__s"))
    return cut.withColumn("id", F.concat_ws(".", "id", (F.col("__p") + 1).cast("string"))).withColumn("texts", F.trim("__s")).drop("__p", "__s").where("texts <> ''")


def segments(corpus: DataFrame, pattern: str) -> DataFrame:
    """A row for each part of a text between matches of the pattern."""
    cut = corpus.select("*", F.posexplode_outer(F.split("texts", pattern)).alias("__p", "__s"))
    return cut.withColumn("id", F.concat_ws(".", "id", (F.col("__p") + 1).cast("string"))).withColumn("texts", F.trim("__s")).drop("__p", "__s").where("texts <> ''")


def sample(corpus: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n documents by the least seeded hashes of their ids: the same ones however the table is partitioned."""
    return corpus.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def trim(corpus: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """Documents of at least ``least`` and at most ``most`` tokens."""
    n = F.size(T.tokens(F.coalesce("texts", F.lit(""))))
    return corpus.where((n >= least) & (n <= most if most is not None else F.lit(True)))


def describe(corpus: DataFrame) -> str:
    """A line about the frame's shape, without running anything."""
    kind = "multi-language corpus" if "language" in corpus.columns else "corpus"
    return f"A {kind} with the features {', '.join(feature_names(corpus)) or 'none'}"


def document_frequencies(tokens: DataFrame, id_col: str = "id", tokens_col: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(id, token, tf) and (token, df) of a column of token arrays."""
    tf = tokens.select(F.col(id_col).alias("id"), F.explode_outer(tokens_col).alias("token")).where("token is not null").groupBy("id", "token").agg(F.count("*").alias("tf"))
    return tf, tf.groupBy("token").agg(F.count("*").alias("df"))
