"""Mixing, token counts, URL filter, token store, WARC, vectors, pipeline: edge cases and brute force."""

from __future__ import annotations

import gzip
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import difference, views
from tonespan.llm import decontaminate, embeddings, mixing, quality, queries, tokencount, tokenstore, urlfilter, warc
from tonespan.llm import kernels as K
from tonespan.llm.pretoken import TOKENIZER, encoder, load_ranks

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, src string, __id bigint, __position double, position double, n int, h int, part int, w0 double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "x", 1, 2.0, 3.0, 4, 5, 6, 7.0) for i, t, s in rows], COLUMNS)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    assert difference(queries.queries()[name](spark, SF).toPandas(), views(SF).execute(queries.oracle_sql()[name]).df()) == ""


# --- mixing


def test_positions_against_numeric_integration(spark):
    rng = random.Random(1)
    docs = frame(spark, [(i, "w " * rng.randrange(1, 40), rng.choice("aab")) for i in range(300)])
    schedule = spark.createDataFrame([("a", 0.9, 0.2, 0.2), ("b", 0.1, 0.8, 0.0)], "src string, w0 double, w1 double, w2 double")
    got = mixing.positions(docs, schedule).toPandas()
    t = np.linspace(0, 1, 200_001)
    w = {"a": np.interp(t, mixing.KNOTS, [0.9, 0.2, 1.0]), "b": np.interp(t, mixing.KNOTS, [0.1, 0.8, 0.0])}
    demand = {k: np.concatenate([[0], np.cumsum((v[1:] + v[:-1]) / 2)]) / 200_000 for k, v in w.items()}
    rows = docs.selectExpr("doc_id", "source", "size(split(trim(text), ' ')) n").toPandas()
    budget = min(rows[rows.source == k].n.sum() / demand[k][-1] for k in "ab")
    rows["h"] = (rows.doc_id % 2**31 * 1103515245 + 12345) % 2**31
    want = {}
    for k in "ab":
        mine = rows[rows.source == k].sort_values(["h", "doc_id"])
        middle = (mine.n.cumsum() - mine.n / 2) / budget
        want |= {i: np.interp(m, demand[k], t) for i, m in zip(mine.doc_id, middle) if m <= demand[k][-1] + 1e-9}
    assert set(got.doc_id) == set(want)
    assert max(abs(want[i] - p) for i, p in zip(got.doc_id, got.position)) < 1e-4


def test_mixing_edges(spark):
    docs = frame(spark, [(1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "x y", "s"), (1, "a b c", "s"), (4, "w " * 30_000, "t"), (5, "p q", None)])
    got = mixing.positions(docs).collect()
    assert all(0 <= r.position <= 1 for r in got) and None not in {r.doc_id for r in got}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert mixing.positions(docs.where("false")).count() == 0 and mixing.mixed(docs.where("false")).count() == 0
    assert mixing.positions(frame(spark, [(1, "", "s"), (2, None, "s")])).count() == 0  # no tokens at all


def test_ids_of_any_type_and_schedules_that_repeat_a_source(spark):
    docs = frame(spark, [(i, "w " * 5, "ab"[i % 2]) for i in range(40)]).withColumn("doc_id", F.col("doc_id").cast("string"))
    twice = spark.createDataFrame([("a", 0.5, 0.5, 0.5), ("a", 0.5, 0.5, 0.5), ("b", 1.0, 1.0, 1.0)], "src string, w0 double, w1 double, w2 double")
    got = mixing.positions(docs, twice).toPandas()
    assert len(got) == got.doc_id.nunique() == 40 and got.position.between(0, 1).all()
    assert mixing.mixed(docs, twice).count() == 40


def test_mixed_is_in_order_of_positions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    place = {r.doc_id: r.position for r in mixing.positions(docs).collect()}
    order = [place[r.doc_id] for r in mixing.mixed(docs).collect()]
    assert order == sorted(order) and len(order) == len(place)


def test_the_mixing_stage_keeps_every_document(spark):
    rng = random.Random(8)
    sizes = {"hot": 400, "b": 60, "c": 30, "tiny": 1, None: 1}
    rows = [(i, "w " * rng.randrange(1, 40), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = frame(spark, rows)
    assert sorted(r.doc_id for r in corpus_pipeline.source_mixing(spark, docs, SF).collect()) == [i for i, *_ in rows]
    place = mixing.positions(docs, mixing.whole_schedule).toPandas()
    assert len(place) == len(rows) and place.position.between(0, 1).all()
    for (s, early), total in zip(((s, place[(place.source == s) & (place.position < 0.5)].n_tokens.sum()) for s in ("hot", "c")), (place[place.source == s].n_tokens.sum() for s in ("hot", "c"))):
        assert early > 0.5 * total if s == "hot" else early < 0.5 * total


# --- token counts and store

ODD = ["", None, "it's we're I'LL 'tis ''s", "a  b\n\n c\t\td   ", "naïve 日本語 😀😀 é", "x y  z", "1234 5,678.9", "don't'll", "'", " '", "a'", "<|endoftext|>", "é" * 3000, "word " * 30_000]


def test_token_counts_are_the_tokenizer_s(spark):
    enc = encoder(load_ranks())
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(None, "null id", "s"), (0, "again", "s")]
    docs = frame(spark, rows).unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"), allowMissingColumns=True)
    got = sorted((r.doc_id or -1, r.n_tokens) for r in tokencount.token_counts(docs).collect())
    want = sorted((r.doc_id or -1 if r.doc_id != 0 else -1, len(enc.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert sorted(n for _, n in got) == sorted(n for _, n in want)
    assert {i: n for i, n in got if i > 0} == {i: n for i, n in want if i > 0}
    assert tokencount.token_counts(docs.where("false")).count() == 0


def test_store_gives_back_each_document(spark):
    enc = encoder(load_ranks())
    rows = [(i * 7 - 3, t, "s") for i, t in enumerate(ODD)] + [(None, "null id", "s"), (4, "a repeated id", "s")]
    docs = frame(spark, rows).coalesce(1).unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"), allowMissingColumns=True)
    out = tokenstore.token_store(docs, shard_ids=20_000, part_keys=64).collect()
    store = tokenstore.TokenStore(out)
    assert len(store.parts) > 1 and len(store.shards) > 1
    for r in docs.where("doc_id is not null and text <> 'a repeated id'").collect():
        assert store.get(r.doc_id).tolist() == enc.encode_ordinary(r.text or "")
    assert all(store.get(k) is None for k in range(50_000, 50_200))
    assert sum(r.n_docs for r in out if r.kind == "payload") == docs.count()
    assert sum(r.n_docs for r in out if r.kind == "index") == docs.where("doc_id is not null").select("doc_id").distinct().count()
    assert tokenstore.token_store(docs.where("false")).count() == 0 and tokenstore.TokenStore([]).get(1) is None


def test_a_saved_store_is_read_by_seeks(spark, tmp_path):
    enc = encoder(load_ranks())
    docs = frame(spark, [(i * 7 - 3, t, "s") for i, t in enumerate(ODD)] + [(None, "null id", "s")]).unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"), allowMissingColumns=True)
    folder = f"file://{tmp_path}/store"
    tokenstore.save(tokenstore.token_store(docs, shard_ids=20_000, part_keys=64), folder)
    reader = tokenstore.Reader(folder, most_open=3)
    want = {r.doc_id: enc.encode_ordinary(r.text or "") for r in docs.collect() if r.doc_id is not None}
    assert all(reader.get(k).tolist() == ids for k, ids in want.items()) and all(reader.get(k) is None for k in range(50_000, 50_200))
    keys = spark.createDataFrame([(k,) for k in [*want, 50_000, None, 4, 4]], "doc_id bigint").repartition(3)
    got = tokenstore.lookup(keys, folder).collect()
    assert len(got) == len(want) + 4 and all((r.ids is None and r.key in (50_000, None)) or r.ids == want[r.key] for r in got)
    shard = reader.place(1000)
    assert np.fromfile(f"{tmp_path}/store/{shard[0]}.ids", "<u2")[shard[1] : shard[1] + shard[2]].tolist() == want[1000]
    tokenstore.save(tokenstore.token_store(docs.where("false")), f"file://{tmp_path}/empty")
    assert tokenstore.Reader(f"file://{tmp_path}/empty").get(1) is None


def test_shards_follow_positions(spark):
    rng = random.Random(21)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(1, 3000), rng.random() if i % 50 else None) for i in range(2000)] + [(None, "x", 0.5)], "doc_id bigint, text string, at double").repartition(9)
    rows = sorted((r for r in tokenstore.token_store(docs, shard_ids=100_000, position_col="at").collect() if r.kind == "payload"), key=lambda r: r.shard)
    place = [(-1.0 if p is None else p, -1 if i is None else i) for r in rows for p, i in zip(r.positions, r.doc_ids)]
    assert len(rows) > 5 and len(place) == 2001 and place == sorted(place)


def test_a_part_without_keys(spark):
    docs = frame(spark, [(1, "one two", "s"), (2, None, "s")])
    store = tokenstore.TokenStore(tokenstore.token_store(docs, part_keys=1).collect())  # two parts, which may both be of one
    assert len(store.get(1)) == 2 and store.get(2).tolist() == [] and store.get(3) is None


def test_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 20_000))
    sizes, bits, slot = tokenstore.build_mph(keys)
    assert sorted(slot.tolist()) == list(range(len(keys))) and bits.sum() == len(keys) and sum(sizes) < 6 * len(keys)


# --- URL filter


def test_trees_learn_and_predict_alike():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, len(urlfilter.NAMES)))
    y = ((x[:, 2] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    trees = urlfilter.boost(x[:1500], y[:1500])
    p = urlfilter.predict(trees, x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.93
    for row, got in zip(x[1500:1520], p):  # the same walked by hand
        m = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            k = 0
            for _ in range(urlfilter.DEPTH):
                k = 2 * k + 1 + (row[f[k]] > t[k])
            m += v[k - (2**urlfilter.DEPTH - 1)]
        assert got == pytest.approx(1 / (1 + np.exp(-m)))


def test_boosting_against_plain_loops():
    """One tree after the other, each split by trying all cuts on sums made in a loop."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (120, 3)).astype(float)  # ties in all columns, repeated rows
    y = ((x[:, 0] > 1) ^ (rng.random(120) < 0.1)).astype(float)
    got = urlfilter.boost(x, y)
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, urlfilter.BINS + 1)[1:-1]))) for j in range(3)]
    margin = [got.base] * 120
    for t in range(3):
        g = [1 / (1 + np.exp(-m)) - v for m, v in zip(margin, y)]
        h = [(1 / (1 + np.exp(-m))) * (1 - 1 / (1 + np.exp(-m))) for m in margin]
        node, term = [0] * 120, lambda rows: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + urlfilter.PENALTY)
        for level in range(urlfilter.DEPTH):
            for k in range(2**level):
                rows = [i for i in range(120) if node[i] == k]
                gain, j, c = max([(term([i for i in rows if x[i, j] <= c]) + term([i for i in rows if x[i, j] > c]) - term(rows), j, c) for j in urlfilter.columns(t, 3) for c in cuts[j]], default=(0, 0, 0))
                at = 2**level - 1 + k
                mine = [i for i in rows if x[i, got.feature[t, at]] > got.threshold[t, at]]
                if gain > 1e-6:  # of equal gains any may be chosen; it must be one of the best
                    rest = [i for i in rows if i not in mine]
                    assert term(rest) + term(mine) - term(rows) == pytest.approx(gain, rel=1e-6)
                for i in rows:
                    node[i] = (node[i], i in mine)
            node = [2 * k + right for k, right in node]
        for k in range(2**urlfilter.DEPTH):
            rows = [i for i in range(120) if node[i] == k]
            assert got.value[t, k] == pytest.approx(-urlfilter.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + urlfilter.PENALTY))
        margin = [m + got.value[t, k] for m, k in zip(margin, node)]


def test_url_filter_on_hosts_not_met_in_training(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labels = urlfilter.seed_labels(pages)
    host = F.regexp_extract("url", "//([^/]+)", 1)
    seen = F.when(F.col("bad") == 1, host.rlike("|".join(urlfilter.SEEDS[:3]))).otherwise(F.pmod(F.xxhash64(host), F.lit(2)) == 0)
    shares = urlfilter.suffix_shares(pages).persist()
    got = urlfilter.filtered(pages, urlfilter.fit(labels.where(seen), shares), shares).join(labels.where(~seen).distinct(), "url").toPandas()
    rank, bad = got.score.rank(), got.bad == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    print("bad rejected", (~got[bad].keep).mean(), "good kept", got[~bad].keep.mean(), "AUC", auc)
    # three hosts are too few to learn what makes a host bad: unknown bad ones rank above good ones, few reach the threshold
    assert got[~bad].keep.mean() > 0.97 and auc > 0.85


def test_url_features():
    one = lambda s: pa.array([s])
    x = dict(zip(urlfilter.NAMES, urlfilter.lexical(one("http://a-b.c1.com/x/y?p=1&q=%20"), one("a-b.c1.com"), one("/x/y"), one("p=1&q=%20"), np.array([0.5]), np.array([0.1]))[0]))
    assert (x["length"], x["depth"], x["host_dots"], x["host_hyphens"], x["parameters"], x["percents"], x["host_digits"]) == (31, 2, 2, 1, 2, 1, 1)
    assert x["digit_ratio"] == pytest.approx(4 / 31) and x["suffix_share"] == 0.5


def test_url_filter_on_held_out_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labels = urlfilter.seed_labels(pages)
    shares = urlfilter.suffix_shares(pages).persist()
    model = urlfilter.fit(labels.where("pmod(hash(url), 2) = 0"), shares)
    got = urlfilter.filtered(pages, model, shares).join(labels.where("pmod(hash(url), 2) = 1").distinct(), "url").toPandas()
    assert (got.keep == (got.bad == 0)).mean() > 0.97
    assert got[got.bad == 0].keep.mean() > 0.97


def test_url_edges(spark):
    urls = [(1, "http://x.casino-win.com/a?b=1"), (2, "https://ok.example.org/"), (3, None), (4, ""), (None, "no scheme/path"), (2, "https://ok.example.org/"), (5, "http://h.com/" + "a/" * 40_000), (6, "http://é.fr:8080/ü#f")]
    pages = spark.createDataFrame([(i, u, "x", 1, 2) for i, u in urls], "page_id bigint, url string, html string, __u int, n int")
    got = urlfilter.url_filter(pages).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([], "url string, bad int")
    assert all(r.keep for r in urlfilter.url_filter(pages, labels).collect())
    assert urlfilter.url_filter(pages.where("false")).count() == 0


# --- WARC


def test_warc_round_trip_with_hostile_payloads(spark):
    inner = warc.record(99, "http://inner", "fake").decode()
    rows = [(1, "http://a/%20 b\n", inner * 3), (2, None, None), (None, "u", ""), (1, "http://a/%20 b\n", inner * 3), (3, "", "é😀\r\n\r\nWARC/1.0\r\n"), (4, "x", "long " * 400_000), (5, "ü%", "WARC/1.0\r\nContent-Length: 5\r\n\r\n")]
    pages = spark.createDataFrame([(*r, 1, "p") for r in rows], "page_id bigint, url string, html string, at int, path string")
    got = warc.round_trip(pages).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))
    assert warc.round_trip(pages.where("false")).count() == 0


def pages_of(spark, tmp_path, files):
    rows = [(None, 5), (str(tmp_path), None)]
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        rows += [(str(tmp_path / name), len(data))] * 2
    return warc.read_warc(spark, spark.createDataFrame(rows, "path string, size bigint")).collect()


def test_broken_files_end_the_chain(spark, tmp_path):
    good = warc.record(1, "u", "one") + warc.record(2, "u", "two")
    files = {"whole": good, "cut": good[:-7], "late": b"x" + good, "torn": warc.record(1, "u", "one") + b"junk" + warc.record(2, "u", "two"), "none": b""}
    assert sorted(r.page_id for r in pages_of(spark, tmp_path, files)) == [1, 1, 1, 2]


def test_headers_of_any_length_and_numbers_without_sense(spark, tmp_path):
    inner = "WARC/1.0\r\nContent-Length: 99999999999999999999\r\n\r\n" + "WARC/1.0\r\nContent-Length: 3\r\nContent-Length: 4\r\n\r\n" + "WARC/1.0\r\n" * 50
    long = "http://h/" + "x" * (5 << 20)
    pages = [(1, "u", "a" * (warc.RANGE - 300_000)), (2, long, inner), (3, "v", inner), (4, long, "z"), (5, "w", inner * 20)]
    data = b"".join(warc.record(*p) for p in pages)
    got = pages_of(spark, tmp_path, {"long": data, "other": warc.record(6, "o", "WARC/1.0\r\nWARC-Type: x")})
    assert sorted((r.page_id, r.url, r.html) for r in got) == [*pages, (6, "o", "WARC/1.0\r\nWARC-Type: x")]


def test_gzipped_records(spark, tmp_path):
    rng = random.Random(22)
    pages = [(i, f"http://h/{i}", "".join(chr(rng.randrange(32, 400)) for _ in range(rng.choice([0, 10, 3000])))) for i in range(300)]
    pages += [(300, "big", bytes(rng.randrange(256) for _ in range(3 << 20)).decode("latin-1") * 4), (301, None, None)]
    members = [gzip.compress(warc.record(*p)) for p in pages]
    whole = gzip.compress(b"".join(warc.record(*p) for p in pages[:5]))  # one member of several records
    got = pages_of(spark, tmp_path, {"a.gz": b"".join(members), "b.gz": whole, "c.gz": members[0] + b"junk" + members[1], "d.gz": members[2][:-3]})
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, pages + pages[:5] + pages[:1]))
    df = spark.createDataFrame(pages[:50], "page_id bigint, url string, html string")
    assert sorted(map(tuple, warc.round_trip(df, gzipped=True).collect())) == sorted(pages[:50])


def test_exits_of_a_range():
    at, to = np.array([0, 5, 9, 20]), np.array([9, 77, 20, 50])
    assert warc._exits(at, to).tolist() == [50, 77, 50, 50]


def test_pointer_jumping_is_a_walk():
    rng = np.random.default_rng(3)
    at = np.unique(np.append(rng.integers(0, 2000, 300), 0))
    to = np.array([int(rng.choice(at[at > a])) if (at > a).any() and rng.random() < 0.97 else 10**6 for a in at])
    want, k = set(), 0
    while k in set(at.tolist()):
        want.add(k)
        k = int(to[np.searchsorted(at, k)])
    assert set(at[warc.chain(at, to)].tolist()) == want


# --- vectors


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    d, n = 64, 4000
    a = rng.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = a + 0.04 * rng.normal(size=(n, d))
    b /= np.linalg.norm(b, axis=1)[:, None]
    bits, factor, *_ = embeddings.encode(a)
    _, _, q, low, step = embeddings.encode(b)
    true = (a * b).sum(1)
    error = embeddings.estimate(bits, factor, q, low, step) - true
    assert abs(error.mean()) < 0.003
    assert (np.abs(error) <= embeddings.margin(factor, step, d, float(true.min()))).mean() > 0.999


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 32))
    near = base[:60] + rng.normal(size=(60, 32)) * rng.uniform(0.01, 0.35, 60)[:, None]
    x = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, key int, id string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(u @ u.T >= embeddings.THRESHOLD)) if i < j}
    got = {(a, b) for r in embeddings.near_vectors(df).collect() for k, a in enumerate(r.vec_ids) for b in r.vec_ids[k + 1 :]}
    assert want and len(want & got) >= 0.9 * len(want) and not got - want


def test_vector_edges(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(5, v), (2, v), (2, v), (None, v), (3, None), (4, [0.0] * 4), (6, [1.0]), (7, [float("nan")] * 4), (8, [1.0, None, 2.0, 3.0]), (9, [-x for x in v]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in embeddings.near_vectors(df).collect()] == [(2, [2, 5], 2)]
    # each dimension among its own; of a repeated id a vector with a direction counts; lengths don't matter
    rows += [(20, [1.0, 2.0]), (21, [3.0, 6.0]), (22, [1.0]), (30, None), (30, [0.0, 0.0]), (30, [1e300, 2e300]), (31, [2.0, -1.0]), (32, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, id string, key int".replace("float", "double"))
    assert sorted(tuple(r) for r in embeddings.near_vectors(df).collect()) == [(2, [2, 5], 2), (6, [6, 22], 2), (20, [20, 21, 30], 3)]
    assert embeddings.near_vectors(df.where("false")).count() == 0


# --- pipeline


def test_stages_are_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    have = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        now = [r.doc_id for r in out.collect()]
        assert len(set(now)) == len(now) and set(now) <= have and len(now) > 0.5 * len(have)
        docs, have = out, set(now)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {i for r in rows if r.kind == "payload" for i in r.doc_ids} == have
    assert tokenstore.TokenStore(rows).get(min(have)) is not None


def test_stages_against_brute_force(spark):
    """Each stage over what the one before it kept, by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text, source = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.source for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    ids, texts = [*text], pa.array([*text.values()])
    buckets, at = quality.features(texts)
    z = [sum(float(model.weights[b]) for b in buckets[at[k] : at[k + 1]]) / max(at[k + 1] - at[k], 1) ** 0.5 + model.bias for k in range(len(ids))]
    kept = [i for k, i in enumerate(ids) if at[k + 1] > at[k] and z[k] >= 0]
    sets = {i: set(K.ngrams(*K.word_hashes(K.lower(pa.array([text[i]]))), 3)[0].tolist()) for i in kept}
    group = {i: i for i in kept}
    for a, b in itertools.combinations(kept, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = {i: new if g == old else g for i, g in group.items()}
    kept = [i for i in kept if group[i] == i]
    ix = decontaminate.build(sorted((r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    bytes_of = lambda t: b" " + decontaminate.normalised(pa.array([t]))[0].tobytes().strip() + b" "
    pieces = [ix.text[s : s + n].tobytes() for s, n in zip(ix.start, ix.length)]
    verbatim = {i for i in kept if any(p in bytes_of(text[i]) for p in pieces)}
    found = {i for i, hit in zip(kept, np.isin(np.arange(len(kept)), decontaminate.search(ix, pa.array([text[i] for i in kept]))[0])) if hit}
    assert verbatim <= found  # and that edited ones are found is held against full alignment elsewhere
    kept = [i for i in kept if i not in found]
    rows = corpus_pipeline.run(spark, SF).collect()
    payload = sorted((r for r in rows if r.kind == "payload"), key=lambda r: r.shard)
    order, enc, store = [i for r in payload for i in r.doc_ids], encoder(load_ranks()), tokenstore.TokenStore(rows)
    assert sorted(order) == sorted(kept)
    assert all(store.get(i).tolist() == enc.encode_ordinary(text[i]) for i in kept)
    # the schedule: each source's tokens are spread by the integral of its share, which falls or rises linearly
    n = {i: len(text[i].split()) for i in kept}
    supply = {s: sum(n[i] for i in kept if source[i] == s) for s in {source[i] for i in kept}}
    total, root = sum(supply.values()), sum(v**0.5 for v in supply.values())
    late = {s: (v**0.5 / root) / (v**0.5 / root + v / total) for s, v in supply.items()}
    mean = sum(late[s] * v / total for s, v in supply.items())
    want = {}
    for s, v in supply.items():
        done, c = 0, mean - late[s]
        for i in sorted((i for i in kept if source[i] == s), key=lambda i: ((i % 2**31 * 1103515245 + 12345) % 2**31, i)):
            m = (done + n[i] / 2) / v  # t + c t (1 - t) = m
            want[i] = m if abs(c) < 1e-9 else ((1 + c) - ((1 + c) ** 2 - 4 * c * m) ** 0.5) / (2 * c)
            done += n[i]
    place = {i: p for r in payload for i, p in zip(r.doc_ids, r.positions)}
    assert max(abs(place[i] - want[i]) for i in kept) < 1e-5
    assert order == sorted(order, key=lambda i: (place[i], i))


def test_the_training_order_outlives_a_reread_over_several_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = corpus_pipeline.source_mixing(spark, docs, SF).repartition(7).sortWithinPartitions("text")  # the worst that reading can do to the order
    files = corpus_pipeline.stored(mixed, "mixed")
    assert len(files.inputFiles()) == 7
    place = {r.doc_id: r.position for r in mixing.positions(docs, mixing.whole_schedule).collect()}
    rows = [r for r in corpus_pipeline.token_output(spark, files, SF).collect() if r.kind == "payload"]
    order = [i for r in sorted(rows, key=lambda r: r.shard) for i in r.doc_ids]
    assert len(order) == len(place) and [place[i] for i in order] == sorted(place.values())
    for r in rows:
        assert [place[i] for i in r.doc_ids] == r.positions


def test_stages_take_odd_rows(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()
    rows = [(i, r.text, "s") for i, r in enumerate(some)]
    rows += [(100, None, "s"), (101, "", None), (None, some[0].text, "s"), (3, some[3].text, "s"), (102, some[4].text, None), (103, "word " * 40_000, "t"), (104, "!?", "u")]
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    out = corpus_pipeline.token_output(spark, docs, SF).collect()
    assert sorted(i for r in out if r.kind == "payload" for i in r.doc_ids) == sorted(r.doc_id for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:  # each by itself
        stage(spark, frame(spark, rows), SF).count()


def test_empty_documents_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF) if docs.columns[0] == "doc_id" else docs
    assert docs.count() == 0


def test_tokenizer_is_a_parameter():
    assert TOKENIZER.startswith("/opt/tokenizers")
