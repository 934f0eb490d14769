"""Lexicon scores of documents and sentences.

A document's tokens become an array of dictionary entries by look-ups in a
constant of hash buckets (a constant map alone would be searched from its
start for each token); all schemes are folds over that array.  Nothing is
exploded and nothing is shuffled: a document is scored where it is read.
"""

from __future__ import annotations

import json
import math
import warnings
import zlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.weights import WITHIN
from ..session import spread
from .lexicons import Lexicons

#: Hit, shifter, scores, inverse frequency, comma; and ones for counting shifters: types 1 and 2 in u, 3 and 4 in w, each in 31 bits.
_ENTRY = "h: boolean, v: double, s: array<double>, f: double, p: boolean, u: bigint, w: bigint"
_LOW = (1 << 31) - 1


#: Between a language and a word in the look-up of corpora of several languages.
_MARK = "\u0001"


def _by_language(lexicons: Lexicons | Mapping[str, Lexicons]) -> dict[str, Lexicons]:
    """Lexicons by what is put before their words: nothing, or the language and a mark."""
    return {"": lexicons} if isinstance(lexicons, Lexicons) else {f"{lang}{_MARK}": lex for lang, lex in lexicons.items()}


def _entries(lexicons: Lexicons | Mapping[str, Lexicons], idf: Mapping[str, float] | None) -> dict[str, dict]:
    """What is known of each word; the scores of a language's words are 0 in the others' lexicons."""
    parts, out, before = _by_language(lexicons), {}, 0
    total = sum(map(len, parts.values()))
    for prefix, lex in parts.items():
        scores, shifters = lex.word_map(), dict(lex.valence.values) if lex.valence else {}
        for w, s in scores.items():
            out[prefix + w] = {"h": True, "v": shifters.get(w), "s": [0.0] * before + s + [0.0] * (total - before - len(s)), "f": (idf or {}).get(prefix + w), "p": w == T.COMMA, "u": 0, "w": 0}
        for w in {*shifters, T.COMMA} - set(scores):
            kind = int(shifters.get(w, 0)) if lex.kind == "t" else 0
            out[prefix + w] = {"h": False, "v": shifters.get(w), "s": [], "f": None, "p": w == T.COMMA, "u": {1: 1, 2: 1 << 31}.get(kind, 0), "w": {3: 1, 4: 1 << 31}.get(kind, 0)}
        before += len(lex)
    return out


def looked_up(tokens: Column, entries: Mapping[str, dict]) -> Column:
    """The dictionary entry of each token, null for other tokens."""
    size = 1 << max(4, len(entries).bit_length())
    buckets: list[dict] = [{} for _ in range(size)]
    for word, entry in entries.items():
        buckets[zlib.crc32(word.encode()) % size][word] = entry
    table = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), f"array<map<string, struct<{_ENTRY}>>>")
    return F.transform(tokens, lambda t: F.get(table, F.pmod(F.crc32(t.cast("binary")), F.lit(size)).cast("int"))[t])


def _weight(how: str, k: str, centre: str) -> str:
    x, n = f"({k} + 1D)", "cast(__n as double)"
    return {
        "UShaped": f"pow({x} - ({n} + 1D) / 2D, 2D)",
        "inverseUShaped": f"(0.25D - try_divide(pow({x} - ({n} + 1D) / 2D, 2D), {n} * {n}))",
        "exponential": f"exp(5D * (try_divide({x}, {n}) - 1D))",
        "inverseExponential": f"exp(5D * (1D - try_divide({x}, {n})))",
        "TFIDF": f"get(__x, {centre}).f",
    }.get(how, "1D")


def _all_weights(how: str) -> str:
    """Sum of the position weights of all n places, in closed form."""
    n, r = "cast(__n as double)", "exp(5D / __n)"
    return {
        "UShaped": f"({n} * ({n} * {n} - 1D) / 12D)",
        "inverseUShaped": f"({n} / 4D - try_divide({n} * {n} - 1D, 12D * {n}))",
        "exponential": f"(exp(-5D) * {r} * (1D - exp(5D)) / (1D - {r}))",
        "inverseExponential": "(exp(5D) * exp(-5D / __n) * (1D - exp(-5D)) / (1D - exp(-5D / __n)))",
    }[how]


def _count(window: str, kind: int, extra: str = "true") -> str:
    return f"size(filter({window}, k -> k <> j and not coalesce(get(__x, k).h, false) and get(__x, k).v = {kind}D and {extra}))"


def _ones(field: str, start: str, end: str) -> str:
    """Sum of the entries' ones over the places [start, end)."""
    return f"aggregate(slice(__x, {start} + 1, greatest({end} - {start}, 0)), 0L, (x, e) -> x + coalesce(e.{field}, 0L))"


def _cluster_impact(start: str, end: str) -> str:
    return (
        f"transform(array(named_struct('u', {_ones('u', start, end)}, 'w', {_ones('w', start, end)})), o -> transform(array(named_struct('n', (o.u & {_LOW}L) % 2, 'a', shiftright(o.u, 31), 'd', o.w & {_LOW}L)), "
        "c -> (1 - 2 * c.n) * (1D + greatest(0.8D * ((1 - c.n) * c.a - (c.n * c.a + c.d)), -1D)))[0])[0]"
    )


def _sentence_impact(window: str) -> str:
    neg, amp, deamp = (_count(window, k) for k in (1, 2, 3))
    adv = f"({_count(window, 4, 'k < j')} - {_count(window, 4, 'k > j')})"
    return (
        f"transform(array(named_struct('n', {neg} % 2, 'a', {amp}, 'd', {deamp}, 'b', {adv})), "
        "c -> (1 - 2 * c.n) * (1D + 0.8D * (1 - c.n) * c.a + greatest(0.8D * (-c.n * c.a - c.d), -1D)) * (1D + 0.25D * c.b))[0]"
    )


def _swept(how: str, size: int) -> str:
    """Sentence clusters in one sweep from the end: what lies between a hit's own neighbourhood and the next comma is a difference of running counts.

    So a window that reaches to a far comma costs no more than a short one.  At each place running counts are updated first (o = 1),
    and remembered if there is a comma; then the hits whose neighbourhood ends there are scored (o = 0).
    """
    pol, weighed = how == "proportionalPol", how in ("UShaped", "inverseUShaped", "exponential", "inverseExponential")
    here = "filter(transform(__x, (e, k) -> if({0}, named_struct('p', k, 'o', 1, 't', {1}, 'j', k), null)), v -> v is not null)"
    asked = "transform(__h, j -> named_struct('p', least(__n, j + 3), 'o', 0, 't', 0, 'j', j))"
    parts = [here.format("e.u > 0 or e.w > 0", "1"), here.format("e.p", "0"), asked, *([here.format("e.h", "5")] if pol or weighed else [])]
    events = f"sort_array(concat({', '.join(parts)}), false)"
    zero = f"array_repeat(0D, {size})"
    first, last = "greatest(0, q.j - 5)", "least(__n, q.j + 3)"
    near = f"sequence({first}, {last} - 1)"
    # ones before and behind the hit: its neighbourhood's, and what lies between that and the next comma
    ones = ", ".join(f"'{f}b', {_ones(f, first, 'q.j')}, '{f}a', {_ones(f, '(q.j + 1)', last)} + if(z.c, z.{f} - z.c{f}, 0L)" for f in "uw")
    found = f"'n', ((o.ub + o.ua) & {_LOW}L) % 2, 'a', shiftright(o.ub + o.ua, 31), 'd', (o.wb + o.wa) & {_LOW}L, 'b', shiftright(o.wb, 31) - shiftright(o.wa, 31)"
    impact = (
        f"transform(array(named_struct({ones})), o -> transform(array(named_struct({found})), "
        "c -> (1 - 2 * c.n) * (1D + 0.8D * (1 - c.n) * c.a + greatest(0.8D * (-c.n * c.a - c.d), -1D)) * (1D + 0.25D * c.b))[0])[0]"
    )
    init = {"u": "0L", "w": "0L", "cu": "0L", "cw": "0L", "c": "false", "s": zero}
    update = {f: f"z.{f} + if(q.t = 1, get(__x, q.j).{f}, 0L)" for f in "uw"} | {f"c{f}": f"if(q.t = 0, z.{f}, z.c{f})" for f in "uw"} | {"c": "z.c or q.t = 0", "s": "z.s"}
    score = {f: f"z.{f}" for f in init} | {"s": f"transform(array({impact}), i -> transform(z.s, (v, l) -> v + i * get(get(__x, q.j).s, l) * {_weight(how, 'q.j', 'q.j')}))[0]"}
    if weighed:  # weights of the hits from here on, those at the comma, and the sum over windows
        init |= {"m": "0D", "cm": "0D", "norm": "0D"}
        update |= {"m": f"z.m + if(q.t = 5, {_weight(how, 'q.j', 'q.j')}, 0D)", "cm": "if(q.t = 0, z.m, z.cm)", "norm": "z.norm"}
        own = f"aggregate(filter({near}, k -> coalesce(get(__x, k).h, false)), 0D, (x, k) -> x + {_weight(how, 'k', 'k')})"
        score |= {"m": "z.m", "cm": "z.cm", "norm": f"z.norm + {own} + if(z.c, z.m - z.cm, 0D)"}
    if pol or weighed:  # the same of hits with a score, by lexicon
        init |= {"h": zero, "ch": zero, "t": zero}
        update |= {"h": "if(q.t = 5, transform(z.h, (v, l) -> v + if(get(get(__x, q.j).s, l) <> 0D, 1D, 0D)), z.h)", "ch": "if(q.t = 0, z.h, z.ch)", "t": "z.t"}
        own = f"size(filter({near}, k -> get(get(__x, k).s, l) <> 0D))"
        score |= {"h": "z.h", "ch": "z.ch", "t": f"transform(z.t, (v, l) -> v + {own} + if(z.c, get(z.h, l) - get(z.ch, l), 0D))"}
    struct = lambda fields: "named_struct(" + ", ".join(f"'{f}', {fields[f]}" for f in init) + ")"
    swept = f"aggregate({events}, {struct(init)}, (z, q) -> if(q.o = 1, {struct(update)}, {struct(score)}))"
    return f"transform(array({swept}), z -> named_struct('norm', {'z.norm' if weighed else '0D'}, 's', z.s, 'c', {'z.t' if pol or weighed else zero}))[0]"


def _folded(how: str, size: int, kind: str | None, sentence: bool) -> str:
    """A struct of norm, s (sums by lexicon) and c (tokens with a score, by lexicon, each time they are touched)."""
    zero = f"array_repeat(0D, {size})"
    if kind == "t" and not sentence:
        start, end = "greatest(a.next, j - 4)", "least(__n, j + 3)"
        window = f"sequence({start}, {end} - 1)"
        touched = f"filter({window}, k -> k = j or coalesce(get(__x, k).h, false))"
        w = _weight(how, "k", "j")
        update = (
            f"transform(array(named_struct('t', {touched}, 'i', {_cluster_impact(start, end)})), q -> named_struct('next', least(__n, j + 3) + 1, "
            f"'norm', a.norm + aggregate(q.t, 0D, (b, k) -> b + {w}), "
            f"'s', transform(a.s, (v, l) -> v + aggregate(q.t, 0D, (b, k) -> b + if(k = j, q.i, 1D) * get(get(__x, k).s, l) * {w})), "
            "'c', transform(a.c, (v, l) -> v + size(filter(q.t, k -> get(get(__x, k).s, l) <> 0D)))))[0]"
        )
        return f"aggregate(__h, named_struct('next', 0, 'norm', 0D, 's', {zero}, 'c', {zero}), (a, j) -> if(j < a.next, a, {update}))"
    if kind == "t" and how != "TFIDF":
        return _swept(how, size)
    if kind == "t":
        end = "if(locate('1', __p, least(__n, j + 3) + 1) > 0, locate('1', __p, least(__n, j + 3) + 1) - 1, least(__n, j + 3))"  # a search no longer than the window
        windows = f"transform(__h, j -> transform(array({end}), e -> named_struct('j', j, 'st', greatest(0, j - 5), 'en', e))[0])"
        span = "sequence(w.st, w.en - 1)"
        per = (
            f"transform({windows}, w -> transform(array(w.j), j -> named_struct('j', j, 'st', w.st, 'en', w.en, 'i', {_sentence_impact(span)}, "
            f"'t', filter({span}, k -> coalesce(get(__x, k).h, false))))[0])"
        )
        own = _weight(how, "q.j", "q.j")
        last = own if how != "TFIDF" else "get(__x, array_max(transform(filter(ww, w -> w.st <= q.j and q.j < w.en), w -> w.j))).f"
        touch = _weight(how, "k", "q.j")
        return (
            f"transform(array({per}), ww -> named_struct('norm', aggregate(ww, 0D, (a, q) -> a + aggregate(q.t, 0D, (b, k) -> b + {touch})), "
            f"'s', transform({zero}, (v, l) -> aggregate(ww, 0D, (a, q) -> a + q.i * get(get(__x, q.j).s, l) * {last})), "
            f"'c', transform({zero}, (v, l) -> aggregate(ww, 0D, (a, q) -> a + size(filter(q.t, k -> get(get(__x, k).s, l) <> 0D))))))[0]"
        )
    shift = "coalesce(get(__x, greatest(k - 1, 0)).v, 1D) * " if kind == "y" else ""
    w = _weight(how, "k", "k")
    times = "" if w == "1D" else f" * {w}"
    norm = "0D" if w == "1D" or how == "TFIDF" else _all_weights(how) if kind is None and not sentence else f"aggregate(__h, 0D, (a, k) -> a + {w})"
    sums = ", ".join(f"aggregate(__h, 0D, (a, k) -> a + {shift}get(get(__x, k).s, {m}){times})" for m in range(size))
    counts = ", ".join(f"cast(size(filter(__h, k -> get(get(__x, k).s, {m}) <> 0D)) as double)" for m in range(size))
    return f"named_struct('norm', {norm}, 's', array({sums}), 'c', array({counts}))"


def _final(how: str) -> str:
    v = "get(r.s, l)"
    return {
        "counts": v,
        "TFIDF": f"if(get(r.c, l) = 0D, 0D, {v})",
        "proportional": f"coalesce(try_divide({v}, __n), 0D)",
        "proportionalSquareRoot": f"coalesce(try_divide({v}, sqrt(__n)), 0D)",
        "proportionalPol": f"coalesce(try_divide({v}, get(r.c, l)), 0D)",
    }.get(how, f"if(get(r.c, l) = 0D, 0D, try_divide({v}, r.norm))")


def inverse_frequencies(df: DataFrame, tokens: str, lexicons: Lexicons | Mapping[str, Lexicons], language: str | None = None) -> dict[str, float]:
    """log10(N / (1 + documents with the word)) for the words of the lexicons, N and documents those of the word's language.

    One aggregate: each document counts once for the empty word, and for each word of the lexicons that it has.
    """
    prefixes = _by_language(lexicons)
    words = F.array(*(F.lit(p + w) for p, lex in prefixes.items() for w in lex.word_map()))
    everyone = F.array(F.concat(F.col(language), F.lit(_MARK)) if language else F.lit(""))
    rows = df.select(F.explode_outer(F.concat(everyone, F.array_intersect(tokens, words))).alias("w")).groupBy("w").count().collect()  # at most as many as the lexicons have words
    counts = {r.w: r["count"] for r in rows}
    return {p + w: math.log10(counts[p] / (1 + counts[p + w])) for p, lex in prefixes.items() for w in lex.word_map() if p + w in counts}


def scored(df: DataFrame, tokens: str, lexicons: Lexicons | Mapping[str, Lexicons], how: str = "proportional", sentence: bool = False, language: str | None = None) -> DataFrame:
    """df with word_count and scores (an array in the order of the lexicons) from the array column ``tokens``.

    Null tokens count as none.  A score is null where its weights sum to zero.  With lexicons by language, the column
    ``language`` tells which ones are a row's own; the others score 0.
    """
    if how not in WITHIN:
        raise ValueError(f"unknown scheme {how!r}; choose one of {WITHIN}")
    parts = _by_language(lexicons).values()
    size, kinds = sum(map(len, parts)), {lex.kind for lex in parts}
    if len(kinds) > 1:
        raise ValueError("the lexicons of all languages must have shifters of one kind, or none")
    kind = kinds.pop()
    words = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    if language:
        words = F.transform(words, lambda t: F.concat(F.col(language), F.lit(_MARK), t))
    df = df.withColumn(tokens, words)
    idf = inverse_frequencies(df, tokens, lexicons, language) if how == "TFIDF" else None
    df = df.withColumn("__x", looked_up(F.col(tokens), _entries(lexicons, idf)))
    df = df.withColumn("__n", F.size("__x")).withColumn("__h", F.expr("filter(transform(__x, (e, k) -> if(e.h, k, null)), k -> k is not null)"))
    if sentence and kind == "t":
        df = df.withColumn("__p", F.expr("array_join(transform(__x, e -> if(e.p, '1', '0')), '')"))
    more = "'next', 0, " if kind == "t" and not sentence else ""
    nothing = f"named_struct({more}'norm', 0D, 's', array_repeat(0D, {size}), 'c', array_repeat(0D, {size}))"
    df = df.withColumn("__r", F.expr(f"if(size(__h) = 0, {nothing}, {_folded(how, size, kind, sentence)})"))
    df = df.withColumn("scores", F.expr(f"transform(array(__r), r -> transform(sequence(0, {size - 1}), l -> {_final(how)}))[0]"))  # once a row, not once a lexicon
    return df.withColumn("word_count", F.col("__n").cast("double")).drop("__x", "__n", "__h", "__p", "__r", tokens)


def checked_cores(n: int | None) -> int | None:
    """Spark decides how much runs at once; the number is checked only: one below 1 becomes 1, with a warning."""
    if n is not None and n < 1:
        warnings.warn("the number of cores is set to 1", stacklevel=3)
        return 1
    return n


def sentiment(corpus: DataFrame, lexicons: Lexicons | Mapping[str, Lexicons], how: str = "proportional", sentence: bool = False, tokens: str | None = None, features: list[str] | None = None, cores: int | None = None) -> DataFrame:
    """Long sentiment: id, [sentence_id,] [date,] word_count, lexicon, feature, score.

    ``corpus`` has id, texts (or the array column named by ``tokens``: words, or sentences of words), and may have date,
    language and feature columns (all other numeric columns by default; a lone 1 if there is none).  With a mapping of
    languages to lexicons, each document is scored with its own language's lexicons and 0 for the others, all in one pass;
    the query fails at a document of a language without lexicons.
    """
    checked_cores(cores)
    many = not isinstance(lexicons, Lexicons)
    names = [n for lex in lexicons.values() for n in lex] if many else list(lexicons)
    if len(set(names)) < len(names):
        raise ValueError("names of lexicons must be unique across languages")
    if many and "language" not in corpus.columns:
        raise ValueError("the corpus has no column 'language'")
    if many and len({lex.kind for lex in lexicons.values()}) > 1:
        return _by_kind(corpus, lexicons, names, how, sentence, tokens, features)
    reserved = {"id", "date", "texts", "language", "sentence_id", "word_count", tokens}
    feats = features if features is not None else [c for c, t in corpus.dtypes if c not in reserved and (t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal"))]
    values = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in feats] or [F.struct(F.lit("dummyFeature").alias("feature"), F.lit(1.0).alias("x"))]
    keys = ["id", *(["date"] if "date" in corpus.columns else [])]
    read = ["__f", *(["__lang"] if many else [])]
    df = corpus.select(*keys, F.array(*values).alias("__f"), F.col(tokens or "texts").alias("__t"), *([F.col("language").alias("__lang")] if many else []))
    df = spread(df)
    toks = F.col("__t") if tokens else T.sentence_tokens(F.col("__t")) if sentence else T.tokens(F.col("__t"))
    if many:
        toks = F.when(F.col("__lang").isin(list(lexicons)), toks).otherwise(F.raise_error(F.concat(F.lit("no lexicons of language "), F.coalesce("__lang", F.lit("null")))).cast("array<array<string>>" if sentence else "array<string>"))
    df = df.select(*keys, *read, toks.alias("__t"))
    if sentence:
        # outer: of a plain explode Spark infers a filter by its size, which would cut the text a second time, before it is spread
        df = df.select(*keys, *read, F.posexplode_outer("__t").alias("__s", "__t")).where("__s is not null").withColumn("sentence_id", F.col("__s") + 1).drop("__s")
        keys = ["id", "sentence_id", *keys[1:]]
    df = scored(df, "__t", lexicons, how, sentence, "__lang" if many else None)
    named = F.arrays_zip(F.array(*map(F.lit, names)).alias("lexicon"), F.col("scores").alias("score"))
    df = df.select(*keys, "word_count", "__f", F.explode(named).alias("__l")).select(*keys, "word_count", F.col("__l.lexicon").alias("lexicon"), F.col("__l.score").alias("__v"), F.explode("__f").alias("__g"))
    return df.select(*keys, "word_count", "lexicon", F.col("__g.feature").alias("feature"), (F.col("__v") * F.col("__g.x")).alias("score"))


def _by_kind(corpus: DataFrame, lexicons: Mapping[str, Lexicons], names: list[str], how: str, sentence: bool, tokens: str | None, features: list[str] | None) -> DataFrame:
    """Languages whose shifters are of different kinds: a pass for each kind."""
    kinds = list(dict.fromkeys(lex.kind for lex in lexicons.values()))
    parts = None
    for kind in kinds:
        own = {k: lex for k, lex in lexicons.items() if lex.kind == kind}
        others = [k for k in lexicons if k not in own]
        mine = F.col("language").isin(list(own)) if kind != kinds[-1] else ~F.coalesce(F.col("language").isin(others), F.lit(False))  # the last also meets unknown languages
        got = sentiment(corpus.where(mine), own, how, sentence, tokens, features)
        have = [n for lex in own.values() for n in lex]
        zeros = F.array(*(F.struct(F.lit(n).alias("lexicon"), F.lit(0.0).alias("score")) for n in names if n not in have))
        keys = [c for c in got.columns if c not in ("lexicon", "score")]
        first = F.struct("lexicon", "score")
        rows = F.when(F.col("lexicon") == have[0], F.concat(F.array(first), zeros)).otherwise(F.array(first))
        got = got.select(*keys, F.inline(rows)).select(got.columns)
        parts = got if parts is None else parts.unionAll(got)
    return parts
