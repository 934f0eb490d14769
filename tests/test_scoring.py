"""Tokens, lexicons and scores: goldens, an independent scorer, the JVM's own word iterator."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tonespan.functions import text as T
from tonespan.functions import weights as W
from tonespan.operators.lexicons import Lexicons, as_key, valence
from tonespan.operators.scoring import scored, sentiment

LEX = Lexicons({"l": {"good": 1.0, "bad": -1.0}})
TYPES = [{"x": "not", "t": 1}, {"x": "very", "t": 2}, {"x": "barely", "t": 3}, {"x": "but", "t": 4}]
CLUSTERS = Lexicons({"l": {"good": 1.0, "bad": -1.0}}, TYPES)


def score(spark, texts, lex, how="counts", sentence=False):
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)], "i int, t array<string>")
    return [r.scores for r in scored(df, "t", lex, how, sentence).orderBy("i").collect()]


GOLDEN = [
    ("this is not very good", -0.2, -0.2), ("very very good", 2.6, 2.6), ("barely good", 0.2, 0.2), ("barely barely good", 0, 0), ("not not good", 1, 1), ("but good", 1, 1.25),
    ("good but x", 1, 0.75), ("good bad", 0, 0), ("good a b bad", 1, 0), ("good a b c bad", 0, 0), ("good x c_c not bad", 0, 2), ("good x y not c_c z", 1, -1),
]


def test_cluster_goldens(spark):
    texts = [t for t, *_ in GOLDEN]
    assert [s[0] for s in score(spark, texts, CLUSTERS)] == pytest.approx([d for _, d, _ in GOLDEN])
    assert [s[0] for s in score(spark, texts, CLUSTERS, sentence=True)] == pytest.approx([s for *_, s in GOLDEN])


def test_bigram_goldens(spark):
    lex = Lexicons({"l": {"good": 1.0}}, [{"x": "not", "y": -1.0}, {"x": "very", "y": 1.8}])
    assert [s[0] for s in score(spark, ["not good", "very good", "not very good", "good"], lex)] == pytest.approx([-1, 1.8, 1.8, 1])
    own = Lexicons({"l": {"good": 1.0}}, [{"x": "good", "y": 3.0}])
    assert score(spark, ["good x", "x good"], own) == [[3.0], [1.0]]  # at its start a text's word shifts itself


UNI = {"counts": 1, "proportional": 0.25, "proportionalSquareRoot": 0.5, "proportionalPol": 1 / 3, "UShaped": 0.85, "inverseUShaped": -0.02272727, "exponential": 0.52942242, "inverseExponential": 0.67626438}
HIT = {"UShaped": 0.89473684, "inverseUShaped": -0.03448276, "exponential": 0.56259562, "inverseExponential": 0.85151086}


def test_position_weights(spark):
    shifters = Lexicons({"l": {"good": 1.0, "bad": -1.0}}, [{"x": "nope", "y": 2.0}])
    for how, want in UNI.items():
        assert score(spark, ["good a bad good"], LEX, how)[0][0] == pytest.approx(want, abs=1e-8)
        assert score(spark, ["good a bad good"], shifters, how)[0][0] == pytest.approx(HIT.get(how, want), abs=1e-8)
    # weights that add up to nothing leave no score; a text without words scores 0
    assert score(spark, ["a good b", "", "x"], shifters, "UShaped") == [[None], [0.0], [0.0]]


def test_tfidf(spark):
    got = score(spark, ["good bad bad", "good x", "y"], LEX, "TFIDF")
    assert got[0][0] == pytest.approx(-2 * math.log10(3 / 2)) and got[1][0] == pytest.approx(0) and got[2][0] == 0


def plain(tokens, lexs, types, how, sentence):
    """The cluster scorers, written out step by step."""
    n, union = len(tokens), {w for x in lexs for w in x}
    weight = {"UShaped": lambda x: (x - (n + 1) / 2) ** 2, "inverseUShaped": lambda x: 0.25 - (x - (n + 1) / 2) ** 2 / n**2, "exponential": lambda x: math.exp(5 * (x / n - 1)), "inverseExponential": lambda x: math.exp(5 * (1 - x / n))}.get(how, lambda _: 1.0)
    sums, counts, norm, start_low = [0.0] * len(lexs), [0] * len(lexs), 0.0, 0

    def touch(k, shift):
        nonlocal norm
        norm += weight(k + 1)
        for m, x in enumerate(lexs):
            s = x.get(tokens[k], 0.0)
            counts[m] += s != 0
            sums[m] += shift * s * weight(k + 1)

    j = 0
    while j < n:
        if tokens[j] not in union:
            j += 1
            continue
        start, end = (max(0, j - 5), min(n, j + 3)) if sentence else (max(start_low, j - 4), min(n, j + 3))
        if sentence:
            end = next((k for k in range(end, n) if tokens[k] == "c_c"), end)
        kinds = [0] * 5
        for k in range(start, end):
            if k == j:
                continue
            if tokens[k] in union:
                if not sentence:
                    touch(k, 1.0)
                else:  # counts again, but adds nothing
                    norm += weight(k + 1)
                    for m, x in enumerate(lexs):
                        counts[m] += x.get(tokens[k], 0.0) != 0
            elif tokens[k] in types:
                t = types[tokens[k]]
                kinds[t] += (1 if k < j else -1) if t == 4 else 1
        neg = kinds[1] % 2
        if sentence:
            impact = (1 + 0.8 * (1 - neg) * kinds[2] + max(-1, 0.8 * (-neg * kinds[2] - kinds[3]))) * (1 + 0.25 * kinds[4])
        else:
            impact = 1 + max(0.8 * ((1 - neg) * kinds[2] - (neg * kinds[2] + kinds[3])), -1)
        touch(j, -impact if neg else impact)
        if sentence:
            j += 1
        else:
            j = start_low = end + 1
    return sums, counts, norm, n


def finish(how, sums, counts, norm, n):
    out = []
    for s, c in zip(sums, counts):
        if how == "counts":
            out.append(s)
        elif how == "proportional":
            out.append(s / n if n else 0.0)
        elif how == "proportionalPol":
            out.append(s / c if c else 0.0)
        else:
            out.append(0.0 if c == 0 else s / norm if norm else None)
    return out


@pytest.mark.parametrize("how", ["counts", "proportional", "proportionalPol", "exponential", "UShaped"])
def test_clusters_against_the_plain_scorer(spark, how):
    rng = random.Random(11)
    vocabulary = ["good", "bad", "fine", "zero", "not", "very", "barely", "but", "a", "b", "c"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))) for _ in range(150)]
    two = {"l": {"good": 1.0, "bad": -1.0, "zero": 0.0}, "m": {"fine": 0.5, "bad": -2.0}}
    types = {t["x"]: t["t"] for t in TYPES}
    want = [finish(how, *plain(t.split(), list(two.values()), types, how, False)) for t in texts]
    for got, w, t in zip(score(spark, texts, Lexicons(two, TYPES), how), want, texts):
        assert got == [pytest.approx(x, abs=1e-9) if x is not None else None for x in w], t


def test_sentences_against_the_plain_scorer(spark):
    rng = random.Random(12)
    vocabulary = ["good", "bad", "not", "very", "barely", "but", "a", "c_c", "b"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))) for _ in range(150)]
    types = {t["x"]: t["t"] for t in TYPES}
    for lex in (LEX, Lexicons({"l": {"good": 1.0, "bad": -1.0, "c_c": 0.5}, "m": {"bad": -2.0, "a": 0.0}})):
        for how in ("counts", "proportional", "proportionalPol", "exponential", "UShaped"):
            want = [finish(how, *plain(t.split(), [lex[k] for k in lex], types, how, True)) for t in texts]
            for got, w, t in zip(score(spark, texts, Lexicons({k: lex[k] for k in lex}, TYPES), how, True), want, texts):
                assert got == [pytest.approx(x, abs=1e-9) if x is not None else None for x in w], (how, t)


def test_tokens(spark):
    df = spark.createDataFrame([("I can't defend 3.14, well-known u.s. economy",), ("covid19 19covid 3d x_y c_c AT&T 50%",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(T.tokens(F.col("t"))).collect()]
    assert got == [["i", "can't", "defend", "well", "known", "u.s", "economy"], ["19covid", "3d", "x_y", "c_c", "at", "t"], None, []]


def test_sentences(spark):
    text = 'Not good, bad. Mr. Smith went. "Hi!" he said. no. 5 is. End'
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(T.sentences(F.col("t")), T.sentence_tokens(F.col("t"))).first()
    assert got[0] == ["Not good, bad. ", "Mr. ", "Smith went. ", '"Hi!" ', "he said. no. 5 is. ", "End"]
    assert got[1][0] == ["not", "good", "c_c", "bad"]


def test_tokens_are_those_of_icu(spark):
    icu = spark._jvm.com.ibm.icu.text.BreakIterator
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").limit(40).select("text", T.tokens(F.col("text")).alias("t")).collect()
    for r in rows:
        low, it, want = r.text.lower(), icu.getWordInstance(spark._jvm.java.util.Locale.ENGLISH), []
        it.setText(low)
        a = it.first()
        while (b := it.next()) != -1:
            if it.getRuleStatus() >= 200:
                want.append(low.encode("utf-16-le")[2 * a : 2 * b].decode("utf-16-le"))
            a = b
        assert r.t == want


# --- lexicons


def test_lexicon_rules():
    assert as_key([("b", 1), ("A", 2), ("b", 3), ("Good", 1), ("good", 2)]) == {"a": 2.0, "good": 2.0}
    split = Lexicons({"p": {"u": 1.0, "v": -1.0, "w": 0.0}, "q": {"u": 2.0, "two words": 1.0}}, split=True)
    assert list(split) == ["p_POS", "q_POS", "p_NEG", "q_NEG"] and split["p_NEG"] == {"v": -1.0} and split["q_POS"] == {"u": 2.0}
    assert dict(valence([{"x": "NOT", "y": -1}, {"x": "not", "y": 5}, {"x": "at all", "y": 1}]).values) == {"not": -1.0}
    assert Lexicons({"a": {"x": 1.0}, "b": {"y": 2.0}})[["b"]]["b"] == {"y": 2.0}
    for wrong in ({}, {"a-b": {"x": 1.0}}, {"": {"x": 1.0}}):
        with pytest.raises(ValueError):
            Lexicons(wrong)
    with pytest.raises(ValueError):
        valence([{"x": "a", "t": 7}])
    with pytest.raises(KeyError):
        LEX[["none"]]
    with pytest.raises(TypeError):
        LEX["l"] = {}


# --- weights


def test_time_weights():
    assert W.time_weights(["linear"], 4)["linear"] == pytest.approx([0.1, 0.2, 0.3, 0.4])
    assert W.exponential(4, [0.2])["exponential0.2"] == pytest.approx([0.101536, 0.167405, 0.276004, 0.455054], abs=1e-6)
    a = W.almon(4)
    assert a["almon1"] == pytest.approx([0.45, 0.40, 0.15, 0]) and a["almon2_inv"] == pytest.approx([0.25, 0.40, 0.35, 0])
    assert a["almon3"] == pytest.approx([0.168182, 0.254545, 0.286364, 0.290909], abs=1e-6)
    b = W.beta(4, (1, 2), (1, 2, 3))
    assert b["beta12"] == pytest.approx([0.5, 1 / 3, 1 / 6, 0]) and b["beta23"] == pytest.approx([0.45, 0.40, 0.15, 0])
    assert W.almon(1)["almon1"] == [1.0] and W.beta(1)["beta11"] == [1.0]
    with pytest.raises(ValueError):
        W.time_weights(["linear", "own"], 3, own={"linear": [1, 1, 1]})


def test_languages(spark):
    df = spark.createDataFrame([("1", "nl", "dat is een goed boek", 0.5), ("2", "fr", "cela est un bien livre", 0.5), ("3", "en", "this is a good book", 0.5)], "id string, language string, texts string, ftr double")
    lex = {k: Lexicons({f"lex{k.upper()}": {w: 1.0}}) for k, w in (("nl", "goed"), ("fr", "bien"), ("en", "good"))}
    got = {(r.id, r.lexicon): (r.score, r.word_count) for r in sentiment(df, lex, "counts").collect()}
    assert got == {(i, n): (0.5 if i == j else 0.0, 5.0) for i in "123" for j, n in zip("123", ("lexNL", "lexFR", "lexEN"))}


def test_languages_have_frequencies_shifters_and_errors_of_their_own(spark):
    df = spark.createDataFrame([("1", "nl", "goed goed x"), ("2", "nl", "goed x"), ("3", "en", "good x"), ("4", "nl", "x"), ("5", "en", "not good")], "id string, language string, texts string")
    lex = {"nl": Lexicons({"l": {"goed": 1.0}}), "en": Lexicons({"m": {"good": 1.0, "goed": 5.0}})}
    got = {(r.id, r.lexicon): r.score for r in sentiment(df, lex, "TFIDF").collect()}
    assert got["1", "l"] == pytest.approx(2 * math.log10(3 / 3)) and got["3", "m"] == pytest.approx(math.log10(2 / 3)) and got["1", "m"] == 0
    mixed = {"nl": lex["nl"], "en": Lexicons({"m": {"good": 1.0}}, [{"x": "not", "y": -1.0}])}
    got = {(r.id, r.lexicon): r.score for r in sentiment(df, mixed, "counts").collect()}
    assert len(got) == 10 and got["5", "m"] == -1 and got["1", "l"] == 2 and got["5", "l"] == 0
    for wrong in (lex, mixed):
        with pytest.raises(Exception, match="no lexicons of language"):
            sentiment(df.withColumn("language", F.when(F.col("id") == "4", "fr").otherwise(F.col("language"))), wrong, "counts").collect()
    with pytest.raises(ValueError):
        sentiment(df, {"nl": lex["nl"], "en": lex["nl"]}, "counts")
    with pytest.warns(UserWarning, match="cores"):
        sentiment(df.drop("language"), lex["nl"], "counts", cores=0)


def test_a_small_table_in_one_file_is_spread(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id id", "text texts")
    assert sentiment(rows, LEX, "counts").rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    rows.repartition(9).write.parquet(str(tmp_path / "many"))
    assert "Repartition" not in sentiment(spark.read.parquet(str(tmp_path / "many")), LEX, "counts")._jdf.queryExecution().optimizedPlan().toString()


def test_long_windows_to_a_far_comma(spark):
    texts = ["good " + "a " * 3000 + "not c_c", "good good c_c", "c_c good", "good a a c_c"]
    types = {t["x"]: t["t"] for t in TYPES}
    want = [finish("counts", *plain(t.split(), [LEX["l"]], types, "counts", True)) for t in texts]
    assert [s[0] for s in score(spark, texts, CLUSTERS, "counts", True)] == [pytest.approx(w[0]) for w in want]


def test_sentences_have_ids(spark):
    df = spark.createDataFrame([("1", "Good day. Bad, not good. X 1"), ("2", ""), ("3", None)], "id string, texts string")
    got = sentiment(df, CLUSTERS, "counts", sentence=True).orderBy("id", "sentence_id").collect()
    assert [(r.id, r.sentence_id, r.word_count) for r in got] == [("1", 1, 2.0), ("1", 2, 4.0), ("1", 3, 1.0)]


def test_large_files_are_spread_in_small_parts(spark, tmp_path, monkeypatch):
    from tonespan import session

    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("texts"))
    rows.repartition(8).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(session, "SPREAD_EACH", 20_000)  # 8 files of 4 cores, but larger than that
    got = session.spread(table)
    assert got.rdd.getNumPartitions() > 8 and sorted(got.collect()) == sorted(table.collect())
    monkeypatch.setattr(session, "SPREAD_EACH", 64 << 20)
    assert session.spread(table).rdd.getNumPartitions() <= 8
    monkeypatch.setattr(session, "SPREAD_EACH", 20_000)
    assert session.spread(got.select("id", F.upper("texts").alias("texts")))._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
