"""Classifier, near copies, decontamination, repeated passages: edge cases and brute force."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tonespan.llm import decontaminate, minhash, passages, quality
from tonespan.llm import kernels as K

SF = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use themselves.
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, __id bigint, id string, key int, __rank int, __label int, label int, count int, __gone int, edits int"
EXTRA = (1, "x", 2, 3, 4, 5, 6, 7, 8)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *EXTRA) for i, t in rows], COLUMNS)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- kernels


def test_word_hashes_agree_with_words():
    texts = ["The cat, the CAT", "", None, "ünïcode x_y 3.5", "a" * 70_000 + " b"]
    h, docs = K.word_hashes(K.lower(pa.array(texts)))
    assert np.diff(docs).tolist() == [4, 0, 0, 5, 2]
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


def test_ngrams_of_short_documents():
    h, docs = K.word_hashes(pa.array(["a b", "a b c", "", "x a b c"]))
    g, at = K.ngrams(h, docs, 3)
    assert np.diff(at).tolist() == [1, 1, 0, 2] and g[1] == g[3] and g[0] != g[1]


def test_workers_give_back_what_they_freed():
    """Idle workers count as their executor's memory, so a stage mustn't leave them as large as its batches made them."""

    def held():
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) / 1024

    rng = random.Random(3)
    some = [" ".join(words(rng, 300)) for _ in range(50)]

    def batches():
        texts = [some[rng.randrange(50)] + f" n{i}" for i in range(8000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(8000), pa.int64()), pa.array(texts)], ["id", "text"])

    for f in (minhash._sketch, minhash._sets):
        for _ in f(batches().__iter__()):  # tables that are kept
            break
        K._give_back()
        before = held()
        assert sum(b.num_rows for b in f(batches())) == 8000
        assert held() - before < 25


# --- quality classifier


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("pmod(hash(doc_id), 2) = 0"), labels.where("pmod(hash(doc_id), 2) = 1")
    got = quality.scores(docs, quality.fit(docs, train)).join(test, "doc_id").toPandas()
    clean = (got.quality == 1) & (got.toxic == 0)
    assert got[clean].keep.mean() > 0.99 and (~got[got.quality == 0].keep).mean() > 0.97 and (~got[got.toxic == 1].keep).mean() > 0.2


def test_quality_edges(spark):
    docs = frame(spark, [(1, "good fine text here"), (2, "bad $$$ junk"), (3, None), (4, ""), (None, "good fine text"), (1, "good fine text here"), (5, "good " * 50_000), (6, "?!")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (9, 1, 0), (None, 1, 0), (3, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.scores(docs, model).collect()
    assert len(got) == 8
    assert all(r.score == 0 and not r.keep for r in got if r.doc_id in (3, 4))
    assert quality.keep_good(docs, model).schema == docs.schema
    none = quality.fit(docs, labels.where("false"))
    assert {r.doc_id: r.keep for r in quality.scores(docs, none).collect() if r.doc_id} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True}
    assert quality.scores(docs.where("false"), model).count() == 0 and quality.keep_good(docs.where("false"), model).count() == 0


def test_training_is_follow_the_regularised_leader():
    """Against the textbook's loop over single coordinates."""
    rng = np.random.default_rng(2)
    docs = [(rng.integers(0, 40, rng.integers(1, 30)), float(rng.random() < 0.5)) for _ in range(60)]
    docs[3] = (np.zeros(0, np.int64), 1.0)  # no words
    docs += docs[:5]  # ties and repeated rows
    z, n, zb, nb = {}, {}, 0.0, 0.0
    weight = lambda z, n, l1: 0.0 if abs(z) <= l1 else -(z - (1 if z > 0 else -1) * l1) / ((quality.BETA + n**0.5) / quality.ALPHA + quality.L2)
    for _ in range(quality.EPOCHS):
        for buckets, y in docs:
            if not len(buckets):
                continue
            x = {b: np.float32(list(buckets).count(b) / len(buckets) ** 0.5) for b in set(buckets.tolist())}
            w = {b: weight(z.get(b, 0.0), n.get(b, 0.0), quality.L1) for b in x}
            wb = weight(zb, nb, 0.0)
            p = 1 / (1 + np.exp(-(sum(w[b] * float(x[b]) for b in x) + wb)))
            for b in x:
                g = (p - y) * float(x[b])
                z[b] = z.get(b, 0.0) + g - ((n.get(b, 0.0) + g * g) ** 0.5 - n.get(b, 0.0) ** 0.5) / quality.ALPHA * w[b]
                n[b] = n.get(b, 0.0) + g * g
            g = p - y
            zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb**0.5) / quality.ALPHA * wb, nb + g * g
    model = quality.train(docs)
    want = np.zeros(1 << quality.BITS)
    for b in z:
        want[b] = weight(z[b], n[b], quality.L1)
    assert np.abs(model.weights - want).max() < 1e-4 and (want != 0).any()


def test_toxic_documents_are_no_good_examples(spark):
    rng = random.Random(16)
    rows = [(i, " ".join(words(rng, 40) + (["scum"] * 3 if i % 3 == 0 else []))) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0) if i else None) for i in range(90)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.scores(frame(spark, rows), quality.fit(frame(spark, rows), labels)).collect()}
    assert all(got[i] == bool(i % 3) for i in range(90, 120))


def test_quality_score_is_the_sparse_dot_product():
    texts = pa.array(["one two two three", "x"])
    m = quality.Model(np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32), 0.3)
    buckets, docs = quality.features(texts)
    assert np.diff(docs).tolist() == [7, 1]
    for k, p in enumerate(quality.score(m, texts)):
        mine = buckets[docs[k] : docs[k + 1]]
        z = sum(float(m.weights[b]) for b in mine) / len(mine) ** 0.5 + m.bias
        assert p == pytest.approx(1 / (1 + np.exp(-z)))


# --- MinHash


def test_circulant_signature():
    sh = K.mix64(np.arange(300, dtype=np.uint64))
    sig = minhash.signatures(sh, np.array([0, 200, 200, 300]), 16)
    table, (where, mask) = minhash._windows(16), minhash.places(sh)
    naive = [[min(int(table[x, k]) ^ int(m) for x, m in zip(where[part], mask[part])) for k in range(16)] for part in (slice(200), slice(200, None))]
    around = table[(1 << minhash.CIRCLE_BITS) - 1]  # the circle closes
    assert around[1] == table[0, 0] and len(np.unique(table[:, 0])) == 1 << minhash.CIRCLE_BITS
    assert sig[0].tolist() == naive[0] and sig[2].tolist() == naive[1] and (sig[1] == 0xFFFFFFFF).all()


def test_minhash_estimates_jaccard():
    a = K.mix64(np.arange(1000, dtype=np.uint64))
    b = K.mix64(np.arange(400, 1400, dtype=np.uint64))
    sig = minhash.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 512)
    assert (sig[0] == sig[1]).mean() == pytest.approx(600 / 1400, abs=0.08)


def test_sets_larger_than_a_circle_differ():
    a, b, c = (K.mix64(np.arange(k << 21, (k + 1) << 21, dtype=np.uint64)) for k in range(3))
    half = np.concatenate([a[: 1 << 20], c[: 1 << 20]])
    sig = minhash.signatures(np.concatenate([a, b, half]), np.array([0, 1, 2, 3]) << 21, 64)
    assert (sig[0] == sig[1]).sum() == 0 and 8 < (sig[0] == sig[2]).sum() < 40


def test_words_of_scripts_without_spaces_and_unicode_punctuation():
    count = lambda t: int(np.diff(K.word_hashes(K.lower(pa.array([t])))[1])[0])
    assert [count(t) for t in ("日本語。テスト", "“a”—b…", "a\u00a0b\u3000c", "ภาษาไทย", "naïve été", "한국어 문장", "«x»", "\U00020000\U00020001")] == [6, 2, 3, 7, 2, 2, 1, 2]


def shingles(text):
    h, docs = K.word_hashes(K.lower(pa.array([text])))
    return set(K.ngrams(h, docs, minhash.NGRAM)[0].tolist())


def test_near_duplicates_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, shingles(r.text)) for r in docs.select("doc_id", "text").collect()]
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x and y and not x.isdisjoint(y) and len(x & y) >= minhash.THRESHOLD * len(x | y)]
    want = components([i for i, _ in rows], edges)
    got = {r.id: r.comp for r in minhash.duplicate_groups(docs).collect()}
    assert all(want[i] == want[c] for i, c in got.items())  # exact verification: nothing false
    near = [i for i in want if sum(want[i] == c for c in want.values()) > 1]
    assert sum(got.get(i) == want[i] for i in near) >= 0.97 * len(near)


def test_near_duplicates_edges(spark):
    rng = random.Random(1)
    base = " ".join(words(rng, 200))
    rows = [(7, base), (3, base), (3, base), (9, base.upper() + " more"), (4, None), (5, ""), (None, base), (6, "!!! ???"), (10, "one"), (11, "One."), (12, " ".join(words(rng, 60_000)))]
    docs = frame(spark, rows)
    got = minhash.near_duplicates(docs).orderBy("group_id").collect()
    assert [(r.group_id, r.doc_ids, r.n_docs) for r in got] == [(3, [3, 7, 9], 3), (10, [10, 11], 2)]
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text is None) for r in kept.collect()) == [(0, False), (3, False), (4, True), (5, False), (6, False), (10, False), (12, False)]
    assert minhash.near_duplicates(docs.where("false")).count() == 0 and minhash.drop_near_duplicates(docs.where("false")).count() == 0


def test_a_large_group_is_whole(spark):
    rng = random.Random(2)
    base = words(rng, 120)
    rows = []
    for i in range(300):  # each differs from the others in two words
        w = list(base)
        for _ in range(2):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 1 and got[0].n_docs >= 297


# --- decontamination


def edits(short, long):
    """Least edits between short and any stretch of long."""
    row = [0] * (len(long) + 1)
    for i, a in enumerate(short, 1):
        new = [i]
        for j, b in enumerate(long, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_segments_against_brute_force():
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((1, 2, 3, 4, 6, 12, 40))]
    texts = []
    for i, t in items:
        for rate in (0, 0.02, 0.05, 0.1):
            out = list(t)
            for _ in range(int(rate * len(t))):
                k = rng.randrange(len(out))
                out[k : k + 1] = rng.choice([[], ["q"], [out[k], "z"]])
            texts.append(" ".join(words(rng, 30)) + " " + "".join(out) + " " + " ".join(words(rng, 30)))
    texts += [" ".join(words(rng, 100)) for _ in range(3)] + [items[0][1], items[1][1] + "x"]
    ix = decontaminate.build(items)
    row, seg, cost = decontaminate.search(ix, pa.array(texts))
    got = {(int(r), int(s)): int(c) for r, s, c in sorted(zip(row, seg, cost), key=lambda v: -v[2])}
    data, offs = decontaminate.normalised(pa.array(texts))
    for r, s in itertools.product(range(len(texts)), range(len(ix.item))):
        seg, text = ix.text[ix.start[s] : ix.start[s] + ix.length[s]].tobytes(), data[offs[r] : offs[r + 1]].tobytes()
        least = edits(seg, text) if len(seg) >= 16 else 0 if b" " + seg + b" " in b" " + text + b" " else 99
        assert ((r, s) in got) == (least <= ix.edits[s]), (r, s, least, ix.edits[s])
        if (r, s) in got:
            assert got[r, s] == least


def test_leaks_and_edges(spark):
    rng = random.Random(4)
    item = " ".join(words(rng, 30))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, "null item text of some length"), (4, "tiny"), (1, item)], "item_id bigint, text string")
    long = " ".join(words(rng, 50_000)) + " " + item
    docs = frame(spark, [(1, f"Intro. {item.upper()}! End"), (2, " ".join(words(rng, 50))), (3, None), (4, ""), (None, item), (5, item), (5, item), (6, long)])
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(1, 1, 0), (5, 1, 0), (6, 1, 0)]
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.drop_leaks(docs, bench.where("false")).count() == 8
    assert decontaminate.leaks(docs, bench.where("false")).count() == decontaminate.leaks(docs.where("false"), bench).count() == 0


def test_quotes_and_replaced_words():
    rng = random.Random(14)
    items = [(i, " ".join(words(rng, 30))) for i in range(40)]
    ix = decontaminate.build(items)

    def found(change):
        texts = [" ".join(words(rng, 60, 10**7) + change(t.split()) + words(rng, 60, 10**7)) for _, t in items]
        row, seg, _ = decontaminate.search(ix, pa.array(texts))
        return np.mean([i in ix.item[seg[row == i]] for i, _ in items])

    def every(k):
        return lambda w: [f"v{rng.randrange(4000)}" if j % k == k // 2 else x for j, x in enumerate(w)]

    assert found(lambda w: w[7:23]) == 1  # a verbatim quote of 16 words, 80 to 95 bytes
    assert found(every(30)) == found(every(12)) == 1 and found(every(10)) > 0.9
    assert found(lambda w: words(rng, 30)) == 0


def test_a_short_item_is_found_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "two, words"), (2, "x"), (3, "日本")], "item_id bigint, text string")
    docs = frame(spark, [(1, "Two words."), (2, "these two wordsmiths"), (3, "an X here"), (4, "xx"), (5, "私は日本人"), (6, "x"), (7, "  two -- WORDS")])
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(1, 1, 0), (3, 2, 0), (6, 2, 0), (7, 1, 0)]


def test_a_large_benchmark_takes_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    rng = random.Random(15)
    items = [" ".join(words(rng, 30)) for _ in range(80)]
    docs = frame(spark, [(i, "a b " + t) for i, t in enumerate(items)] + [(1000, " ".join(words(rng, 90)))])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(i, i) for i in range(80)}
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()] == [1000]


def test_every_item_inside_a_document_is_found(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    norm = lambda t: decontaminate.normalised(pa.array([t]))[0].tobytes().strip()
    texts = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    whole = {(i, b.item_id) for b in bench.collect() for i, t in texts if norm(b.text) in t}
    assert whole and whole <= got


# --- repeated passages


def test_windows_against_a_plain_search():
    rng = np.random.default_rng(5)
    toks, docs = rng.permutation(400).astype(np.uint64), np.array([0, 150, 150, 400])
    for fn in range(2):
        d, c, first, last = passages.windows(toks, docs, fn, 10)
        full = K.mix64(toks * passages._FN[fn] + np.uint64(fn + 1)) >> np.uint64(32)
        full = full | np.uint64(1)
        covered = set()
        for doc, centre, a, b in zip(d, c, first, last):
            h = full[docs[doc] : docs[doc + 1]]
            assert a <= centre <= b and b - a + 1 >= 10 and h[a : b + 1].min() == h[centre]
            covered |= {(int(doc), s) for s in range(a, b - 8) if s <= centre < s + 10}
        assert covered == {(doc, s) for doc in (0, 2) for s in range(docs[doc + 1] - docs[doc] - 9)}


def links(spark, rows):
    got = passages.repeated_passages(frame(spark, rows)).collect()
    text = {i: (t or "").split() for i, t in rows}
    for r in got:  # what is reported is there, on both sides
        b, a = text[r.doc_id][r.first_word : r.first_word + r.n_words], text[r.other_doc_id][r.other_first_word : r.other_first_word + r.other_n_words]
        grams = {tuple(a[k : k + 5]) for k in range(len(a) - 4)}
        assert sum(tuple(b[k : k + 5]) in grams for k in range(len(b) - 4)) >= 0.7 * (len(b) - 4), r
    return got


def classes(got):
    nodes = {x for r in got for x in (r.doc_id, r.other_doc_id)}
    return components(nodes, [(r.doc_id, r.other_doc_id) for r in got])


def test_passages_against_brute_force(spark):
    """All pairs, among documents that hold the passages' 5-grams scattered, parts of them, or long copies."""
    rng = random.Random(6)
    shared = [words(rng, n) for n in (50, 60, 120)]
    rows = []
    for i in range(90):
        w = words(rng, rng.randrange(20, 300))
        for k, s in enumerate(shared):
            if i >= 30 and i % (4 + k) == 0:
                at = rng.randrange(len(w) + 1)
                w[at:at] = s
        if i < 12:  # 5-grams of a passage among other words
            w = [x for k in range(0, len(shared[i % 3]) - 4, 3) for x in shared[i % 3][k : k + 5] + words(rng, 3)]
        elif i < 24:  # parts that are too short
            k = rng.randrange(20)
            w[5:5] = shared[i % 3][k : k + 30]
        rows.append((i, " ".join(w)))
    text = dict(rows)
    runs = {i: {tuple(w[k : k + 50]) for k in range(len(w) - 49)} for i, w in ((i, t.split()) for i, t in text.items())}
    edges = [(a, b) for a, b in itertools.combinations(text, 2) if not runs[a].isdisjoint(runs[b])]
    want = components({x for e in edges for x in e}, edges)
    assert classes(links(spark, rows)) == want


def test_a_passage_beside_scattered_grams_of_it(spark):
    rng = random.Random(17)
    p = words(rng, 60, 10**6)
    rows = [(i, " ".join(x for k in range(0, 56, 2) for x in p[k : k + 5] + words(rng, 2, 10**6))) for i in range(1, 13)]
    rows += [(i, " ".join(words(rng, 30, 10**6) + p + words(rng, 30, 10**6))) for i in (20, 21)]
    assert {(r.doc_id, r.other_doc_id) for r in links(spark, rows)} == {(21, 20)}


def test_a_line_in_all_documents_is_no_passage_and_hides_none(spark):
    rng = random.Random(18)
    line, p = words(rng, 30, 10**6), words(rng, 55, 10**6)
    rows = [(i, " ".join(words(rng, 25, 10**6) + line + (p if i in (7, 150) else words(rng, 25, 10**6)))) for i in range(200)]
    assert {(r.doc_id, r.other_doc_id) for r in links(spark, rows)} == {(150, 7)}


def test_edited_passages(spark):
    rng = random.Random(19)
    rows, want = [], 0
    for k in range(40):
        p = words(rng, 90, 10**6)
        q = list(p)
        q[rng.randrange(10, 80)] = "changed"
        q[40:40] = ["two", "more"] if k % 2 else []
        rows += [(2 * k, " ".join(words(rng, 40, 10**6) + p)), (2 * k + 1, " ".join(q + words(rng, 40, 10**6)))]
        want += 1
    got = {(r.doc_id, r.other_doc_id) for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert got <= {(2 * k + 1, 2 * k) for k in range(40)} and len(got) >= 0.9 * want


def test_a_hot_key_over_several_partitions(spark):
    rng = random.Random(20)
    p = words(rng, 60, 10**6)
    rows = [(i, " ".join(words(rng, 5, 10**6) + p)) for i in range(600)]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = classes(links(spark, rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == dict.fromkeys(range(600), 0)


def test_regions_are_where_windows_meet_on_both_sides():
    pack = lambda c, l, r: c << 12 | l << 6 | r
    one = [(0, 0, (100, 30, 30), (500, 30, 30)), (0, 1, (110, 20, 30), (510, 20, 30)), (0, 2, (300, 30, 30), (700, 30, 30)), (1, 0, (100, 30, 30), (500, 30, 30)), (1, 1, (110, 20, 30), (900, 20, 30)), (2, 0, (9, 9, 50), (9, 9, 50)), (2, 1, (80, 10, 20), (80, 10, 20))]
    pair, fn = (np.array(x) for x in zip(*((p, f) for p, f, *_ in one)))
    wa, wb = (np.array([pack(*r[k]) for r in one]) for k in (2, 3))
    assert passages.regions_of(pair, fn, wa, wb, 2).tolist() == [[0, 70, 140, 470, 540, 400]]
    assert len(passages.regions_of(pair, fn, wa, wb, 1)) == 6 and len(passages.regions_of(pair, fn, wa, wb, 3)) == 0


def test_passages_edges(spark):
    rng = random.Random(7)
    p = " ".join(words(rng, 60))
    near = p.split()
    near[10], near[40] = "changed", "words"
    rows = [(1, p), (2, f"A b. {p} c"), (2, f"A b. {p} c"), (3, " ".join(near)), (None, p), (4, None), (5, ""), (6, "word " * 5000), (7, " ".join(words(rng, 40_000)) + " " + p), (8, f"{p} x {p}")]
    got = passages.repeated_passages(frame(spark, rows + [(9, "short text"), (10, p[:40])])).collect()
    assert {r.doc_id for r in got} == {2, 3, 7, 8} and {r.other_doc_id for r in got} <= {1, 2, 3, 7}
    assert passages.repeated_passages(frame(spark, rows).where("false")).count() == 0


def test_passages_whose_least_document_holds_parts_only(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for k in range(30):  # two documents share 52 words, two of lower ids quote 30 of them each
        p, at = words(rng, 52, 10**6), 10 * k
        for i, part in enumerate((p[:30], p[22:], p, p)):
            rows.append((at + i, " ".join(words(rng, 40, 10**6) + part + words(rng, 40, 10**6))))
        want.add((at + 3, at + 2))
    got = {(r.doc_id, r.other_doc_id) for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.95 * len(want), sorted(want - got)


def test_edited_passages_whose_least_document_holds_parts_only(spark):
    """Two changed words, and documents of lower ids that take the groups of their seeds."""
    rng = random.Random(21)
    rows, want = [], set()
    for k in range(60):
        p, at = words(rng, 52, 10**6), 10 * k
        q = list(p)
        q[16 + k % 3], q[33 + k % 3] = "changed", "words"
        parts = p[:22], p[12:34], p[30:], p, q
        rows += [(at + i, " ".join(words(rng, 40, 10**6) + part + words(rng, 40, 10**6))) for i, part in enumerate(parts)]
        want.add((at + 4, at + 3))
    assert {(r.doc_id, r.other_doc_id) for r in links(spark, rows)} == want


def test_an_edited_passage_around_a_line_of_all_documents(spark):
    rng = random.Random(22)
    line, rows, want = words(rng, 30, 10**6), [], set()
    for i in range(120):
        rows.append((i, " ".join(words(rng, 90, 10**6) + line + words(rng, 90, 10**6))))
    for k in range(20):  # few words beside the line are shared: none of its seeds is elsewhere
        left, right = words(rng, 12, 10**6), words(rng, 12, 10**6)
        for i in (200 + 2 * k, 201 + 2 * k):
            rows.append((i, " ".join(words(rng, 50, 10**6) + left + line + ["other" if i % 2 else "word"] + right + words(rng, 50, 10**6))))
        want.add((201 + 2 * k, 200 + 2 * k))
    assert {(r.doc_id, r.other_doc_id) for r in links(spark, rows)} == want


def test_all_links_of_edited_copies_against_brute_force(spark):
    """Every pair that the verification accepts at a shift of 14 common words is in one class, whatever the ids' order."""
    rng = random.Random(23)
    shared, rows = [words(rng, n, 10**6) for n in (52, 60, 75, 110)], []
    for i in range(120):
        p = list(shared[i % 4])
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(p))
            p[k : k + 1] = rng.choice([[], ["new"], [p[k], "more"], ["x", "y"]])
        if i % 5 == 0:
            p = p[rng.randrange(30) :][: rng.randrange(25, 60)]
        rows.append((i, " ".join(words(rng, rng.randrange(60), 10**6) + p + words(rng, rng.randrange(60), 10**6))))
    toks = [passages.tokens(pa.array([t]))[0] for _, t in rows]
    runs = [{tuple(t[k : k + 10].tolist()): k for k in range(len(t) - 9)} for t in toks]
    codes = [(t >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in toks]
    edges = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        for shift in {runs[b][r] - runs[a][r] for r in runs[a].keys() & runs[b].keys()}:
            zero = lambda t: np.zeros(len(t), np.int64)
            m = passages.matched(codes[a], zero(toks[a]), np.arange(len(toks[a])), codes[b], zero(toks[b]), np.arange(len(toks[b])), np.array([shift]))
            if (np.maximum(m[:, 2] - m[:, 1], m[:, 4] - m[:, 3]) + 5 >= 50).any():
                edges.append((a, b))
    want = components({x for e in edges for x in e}, edges)
    assert len(want) > 80 and classes(passages.repeated_passages(frame(spark, rows)).collect()) == want


def test_links_grow_with_the_documents_that_share_a_passage(spark):
    """Copies that are all edited differently, none of them covered by the least document."""
    rng = random.Random(24)
    p, rows = words(rng, 90, 10**6), []
    for i in range(40):
        q = list(p[30:52] if i < 2 else p)
        if i >= 2:
            q[rng.randrange(5, 25)], q[rng.randrange(60, 85)] = f"new{i}", f"other{i}"
        rows.append((i, " ".join(words(rng, 40, 10**6) + q + words(rng, 40, 10**6))))
    got = links(spark, rows)
    assert classes(got) == dict.fromkeys(range(2, 40), 2)
    assert len({(r.doc_id, r.other_doc_id) for r in got}) < 5 * len(rows)


def test_groups_that_no_task_holds(spark, monkeypatch):
    monkeypatch.setattr(passages, "MANY", 3)
    monkeypatch.setattr(passages, "FEW", 4)
    test_edited_passages_whose_least_document_holds_parts_only(spark)
    test_an_edited_passage_around_a_line_of_all_documents(spark)
    test_all_links_of_edited_copies_against_brute_force(spark)


def rows_of_tokens(rng, n, lots):
    """Rows of tokens around centres: edited copies of a few texts, some with words that repeat, some at the ends of a document."""
    text = rng.integers(1, 2**31, (5, 2 * passages._AROUND + 1)).astype(np.int32) | 1
    text[1:, passages._AROUND - 12 : passages._AROUND + 12] = text[0, passages._AROUND - 12 : passages._AROUND + 12]
    text[3] = np.resize(text[3, :23], text.shape[1])
    rows = text[rng.integers(0, 5, n)]
    for r in rows:
        for _ in range(rng.integers(0, lots)):
            k, size = rng.integers(0, len(r)), rng.integers(1, 8)
            r[k:] = np.concatenate([rng.integers(1, 2**31, size), r[k:]])[: len(r) - k] | 1 if rng.random() < 0.5 else np.resize(r[k : k + size], len(r) - k)
        if rng.random() < 0.3:
            r[: rng.integers(0, passages._AROUND)] = 0
        if rng.random() < 0.3:
            r[rng.integers(passages._AROUND + 4, len(r)) :] = 0
    return rows


def test_pairs_at_once_are_what_matching_finds():
    rng = np.random.default_rng(25)
    rows = rows_of_tokens(rng, 3000, 4)
    a, b = rows[:1500], rows[1500:]
    zero, c = lambda i: np.zeros(len(i), np.int64), passages._AROUND
    want = []
    for x, y in zip(a, b):
        i, j = np.flatnonzero(x), np.flatnonzero(y)
        m = passages.matched(x[i], zero(i), i, y[j], zero(j), j, np.zeros(1, np.int64))
        want.append(bool(((np.maximum(m[:, 2] - m[:, 1], m[:, 4] - m[:, 3]) + 5 >= 50) & (m[:, 1] <= c) & (m[:, 2] >= c)).any()))
    want = np.array(want)
    assert 100 < want.sum() < 1400 and passages._same_passages(a, b).tolist() == want.tolist()
    assert passages._alike(np.where(a == 0, -1, a), np.where(b == 0, -1, b))[want].all()


def test_windows_that_only_seem_alike_take_little_time():
    """Words that one side repeats and the other has once: many in common, but no passage."""
    rng, n, c = np.random.default_rng(26), 300, passages._AROUND
    around = rng.integers(10**6, 10**6 + 3000, (n, 2 * c + 1)).astype(np.int32) | 1
    base = np.arange(1, 21, 2, dtype=np.int32)
    around[::2, c : c + 10] = base
    around[1::2, c - 20 : c + 30] = np.resize(base, 50)
    spins, began = [], time.process_time()
    assert len(passages.linked(around, np.arange(n), np.ones(n, bool), np.arange(n))) >= 0
    took = time.process_time() - began
    for _ in range(50):
        began = time.process_time()
        sum(range(50_000))
        spins.append(time.process_time() - began)
    assert took < 550 * float(np.median(spins)), took / np.median(spins)


def test_a_passage_that_goes_on_far_from_its_centre():
    """45 tokens around the centre, 14 changed ones, 49 more: the last ones count too."""
    rng, c = np.random.default_rng(27), passages._AROUND
    a, b, other = (rng.integers(1, 2**31, (3, 2 * c + 1)) | 1).astype(np.int32)
    b[c - 2 : c + 43], b[c + 57 :] = a[c - 2 : c + 43], a[c + 57 :]
    a[: c - 2] = b[: c - 2] = 0
    other[c + 43 : c + 57] = a[c + 43 : c + 57]  # else a and b were the same but for tokens that they have alone
    assert passages.linked(np.stack([a, b, other]), np.arange(3), np.ones(3, bool), np.arange(3)).tolist() == [[0, 1]]


def _junk(rng, n):
    """Rows around runs of one word among other runs, each row of a document of its own."""
    around = np.zeros((n, 2 * passages._AROUND + 1), np.int32)
    fresh = 1000
    for row in around:
        low, high = passages._AROUND - rng.randrange(0, 60) * rng.randrange(2), passages._AROUND + rng.randrange(4, 60)
        row[low:high] = 1
        for begin, end, step in ((high, len(row), 1), (low - 1, -1, -1)):
            at = begin
            while (at - end) * step < 0:
                size, word = rng.choice([(4, 0), (25, rng.randrange(1, 9)), (45, rng.randrange(1, 9))])
                for _ in range(size):
                    if (at - end) * step < 0:
                        fresh += 2
                        row[at] = word * 2 + 1 if word else fresh + 1
                        at += step
    return around


def test_links_among_runs_of_a_word_against_all_pairs():
    for seed in range(4):
        around = _junk(random.Random(seed), 120)
        n = len(around)
        x, y = np.triu_indices(n, 1)
        ok = passages._same_passages(around[x], around[y])
        got = passages.linked(around, np.arange(n), np.ones(n, bool), np.arange(n))
        assert components(range(n), got.tolist()) == components(range(n), zip(x[ok].tolist(), y[ok].tolist()))


def test_short_runs_of_a_word_are_not_compared_with_each_other(monkeypatch):
    around = np.zeros((400, 2 * passages._AROUND + 1), np.int32)
    for k, row in enumerate(around):
        row[:] = np.arange(len(row)) * 2 + 1001 + 1000 * (k // 2)  # two documents have the rest, so that it counts
        row[passages._AROUND : passages._AROUND + 31 + k % 13] = 1
        row[passages._AROUND + 50 :: 2] += 1000 * k
        row[: passages._AROUND - 10 : 2] += 3000 * k
    tried, same = [], passages._same_passages
    monkeypatch.setattr(passages, "_same_passages", lambda a, b: tried.append(len(a)) or same(a, b))
    passages.linked(around, np.arange(400), np.ones(400, bool), np.arange(400))
    assert sum(tried) < 4000  # all pairs are 79,800


def test_large_groups_are_thinned_to_what_can_match(spark, monkeypatch):
    rng = random.Random(11)
    line = words(rng, 12, 10**6)
    shared = [words(rng, 60, 10**6) for _ in range(4)]
    rows = [(k, " ".join(words(rng, 40, 10**6) + (shared[k % 4] if k % 3 == 0 else words(rng, 60, 10**6)) + line + words(rng, 40, 10**6))) for k in range(60)]
    whole = sorted(map(tuple, passages.repeated_passages(frame(spark, rows)).collect()))
    monkeypatch.setattr(passages, "SOME", 10)
    sizes, group = [], passages._thinned
    monkeypatch.setattr(passages, "_thinned", lambda r, m, a: sizes.append((m.count(), (t := group(r, m, a)).count())) or t)
    assert sorted(map(tuple, passages.repeated_passages(frame(spark, rows)).collect())) == whole
    assert sizes[0][1] < sizes[0][0]
