import hashlib
import math
import os
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiwave.llm import bytewords, components, embedding_dedup, fm_index, language_id, mixing, near_dedup, sampling, skew, substring_dedup
from lexiwave.llm.bytewords import text_buffers
from lexiwave.functions.scratch import Scratch

from .helpers import documents, prose, words


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(45)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)]
    edges = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges, Scratch(spark, "t"), "c").collect()}
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == roots(nodes, [p for p in pairs if p[0] != p[1]])
    assert components.components(edges.limit(0), Scratch(spark, "t"), "e").count() == 0


# op2

def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(0, 0.08, 8)).tolist(), i % 2) for i in range(120)]
    rows += [(200, rows[0][1], 0), (201, [2 * x for x in rows[0][1]], 0), (202, None, 0), (203, [0.0] * 8, 0), (204, [1.0] * 7 + [None], 0), (205, [float("nan")] + [1.0] * 7, 1)]
    rows += [(206, rows[1][1], None), (207, rows[0][1][:4], 0), (208, [], 0), (209, [1e200] * 8, 0), (210, [1e-200] * 8, 0), (5, rows[5][1], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n long, k string")
    links, edges = Counter(), []
    fine = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    for i, a in enumerate(fine):
        for b in fine[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v) / np.abs(v).max() for v in (a[1], b[1]))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[id(a)] += 1
                    links[id(b)] += 1
                    edges.append((a[0], b[0]))
    of = roots({r[0] for r in rows}, edges)
    expect = Counter((r[0], links[id(r)], of[r[0]], r[0] == of[r[0]]) for r in rows)
    for block, lists, asking in ((embedding_dedup.BLOCK, embedding_dedup.LIST, embedding_dedup.ASKING), (10, 8, 7), (100, 8, 1000)):
        monkeypatch.setattr(skew, "PARTS", 2000 if block > 10 else 20)
        assert Counter(tuple(r) for r in embedding_dedup.link_vectors(df, block=block, lists=lists, asking=asking).collect()) == expect
    monkeypatch.setattr(embedding_dedup, "SPLIT", 1)  # lists of two blocks have parts
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 24)
    for block, lists, asking in ((4, 20, 9),):
        assert Counter(tuple(r) for r in embedding_dedup.link_vectors(df, block=block, lists=lists, asking=asking).collect()) == expect
    single = df.where("vec_id < 209").withColumn("embedding", F.col("embedding").cast("array<float>"))
    got = Counter(tuple(r) for r in embedding_dedup.link_vectors(single, block=30, lists=8).collect())
    assert got == Counter((r[0], links[id(r)], of[r[0]], r[0] == of[r[0]]) for r in rows if r[0] < 209)
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables are not here")
def test_lists_and_parts_on_the_given_table(spark, monkeypatch):
    """Several lists a label, and parts of lists, find the links of brute force among the table's vectors and near copies of a third of them."""
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rng = np.random.default_rng(8)
    near = lambda v: (np.array(v) + np.linalg.norm(v) * rng.normal(0, 0.02, len(v))).tolist()
    copies = [(10**6 * i + r.vec_id, near(r.embedding), r.label) for i in (1, 2) for r in given.where("vec_id % 3 = 0 and embedding is not null").orderBy("vec_id").collect()]
    df = given.select("vec_id", "embedding", "label").unionByName(spark.createDataFrame(copies, given.select("vec_id", "embedding", "label").schema))
    rows = [r for r in df.collect() if r.embedding is not None and r.label is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    of = roots({r.vec_id for r in rows}, [(rows[i].vec_id, rows[j].vec_id) for i, j in zip(*np.nonzero(near))])
    expect = {r.vec_id: (int(n) - 1, of[r.vec_id]) for r, n in zip(rows, near.sum(1))}
    assert sum(n > 0 for n, _ in expect.values()) > 100
    monkeypatch.setattr(embedding_dedup, "SPLIT", 1)
    for block, lists in ((64, 12), (6, 40)):
        got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.link_vectors(df, block=block, lists=lists, asking=50).collect()}
        assert len(got) == df.count() and {k: got[k] for k in expect} == expect
        assert all(v == (0, k) for k, v in got.items() if k not in expect)


def test_probes_lose_nothing():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    x[1500:] = x[:1500] + rng.normal(0, 0.03, (1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    radius = float(np.sqrt(0.04))
    q = embedding_dedup.Quantiser.fit(x[:800], 12)
    cell, probes, codes, error = q.index(x, radius)
    far = np.sqrt(embedding_dedup._squared(x[:200], x))
    for i, j in zip(*np.nonzero(far <= radius)):
        assert cell[j] in probes[i]
        assert q.distances(x[i : i + 1], cell[j], codes[j : j + 1])[0, 0] <= radius + error[j] + 1e-9
    assert np.mean([len(p) for p in probes]) < 12


# op3

@pytest.mark.parametrize("hot", [substring_dedup.HOT, 1])
def test_substrings(spark, hot, monkeypatch):
    monkeypatch.setattr(skew, "PARTS", 30 if hot == 1 else 2000)  # both heavy and other keys
    passage = prose(9, 50)
    docs = documents(spark, [f"{prose(20 + i, 20)} {passage} {prose(40 + i, 15)}" for i in range(4)] + ["be " * 90, prose(60, 30) + " " + prose(61, 36) + "\n" + prose(61, 36), prose(9, 34)])
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    seen = Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    expect = Counter()
    for d, w in rows:
        gone = {i + j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expect[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in substring_dedup.remove_repeats(docs, hot=hot, shard=5).collect()) == expect
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_substrings_of_equal_rows(spark):
    """Thousands of equal rows, with an id and without: results as defined, and time in proportion to their number."""
    took = []
    for n in (500, 5000):
        texts = [(None, prose(1, 950)), (4, prose(2, 120))]
        rows = [texts[0]] * n + [texts[1]] * (n // 2) + [(i, prose(10 + i, 60)) for i in range(50)] + [(90, prose(1, 950)[:400])]
        begin = time.time()
        got = Counter(tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect())
        took.append(time.time() - begin)
        none = hashlib.sha256(b"").hexdigest()
        assert got[None, 950, 950, none] == n and got[4, 120, 120, none] == n // 2 and sum(got.values()) == len(rows)
        assert all(removed == 0 for i, _, removed, _ in got if i is not None and i < 90 and i != 4) and any(i == 90 and removed > 0 for i, _, removed, _ in got)
    assert took[1] < 20 * took[0]


def test_fm_index():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 400)
    index = fm_index.FMIndex(text, np.zeros(400, bool), 16)
    for _ in range(60):
        pattern = rng.integers(1, 5, int(rng.integers(1, 8)))
        low, high = np.array([0]), np.array([index.size])
        for s in pattern[::-1]:
            low, high = index.extend(np.array([s]), low, high)
        assert high[0] - low[0] == sum((text[i : i + len(pattern)] == pattern).all() for i in range(401 - len(pattern)))


# op4

def weighted(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def shingles(t):
    w = words(t)
    return Counter(zip(*[w[i:] for i in range(5)])) or Counter([tuple(w)] if w else [])


def test_near_duplicates(spark):
    base = prose(70, 150).split()
    near = [" ".join(base[:k] + [f"edit{k}"] + base[k + 1 :]) for k in range(5, 145, 6)]
    chain = [" ".join(base[:-9 * k] + prose(80, 9 * k).split()) for k in range(1, 5)]
    docs = documents(spark, [*near, *chain, "a b c d e", "b c d e a", "x " * 40 + "y", "x " * 40 + "z"])
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    edges = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if x and y and weighted(x, y) >= 0.8]
    of = roots({d for d, _ in rows}, edges)
    for block in (near_dedup.BLOCK, 4):
        got = near_dedup.near_duplicates(docs, block=block).collect()
        assert Counter(tuple(r) for r in got) == Counter((d, of[d], d == of[d]) for d, _ in rows)
    stay = near_dedup.near_dedup_stage(spark, docs, "")
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == sorted(set(of.values()))
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the given tables are not here")
def test_recall_by_band_on_the_given_table(spark):
    """Of all pairs of documents: every one of 0.8 or more is in one class, and classes are what these pairs join, nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: Counter(shingles(r.text)) for r in docs.collect()}
    holders = {}
    for i, own in rows.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    shared = Counter()
    for x, some in holders.items():
        for n, j in enumerate(some):
            for i in some[:n]:
                shared[i, j] += min(rows[i][x], rows[j][x])
    size = {i: sum(own.values()) for i, own in rows.items()}
    like = {pair: n / (size[pair[0]] + size[pair[1]] - n) for pair, n in shared.items()}
    of = {r.id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    bands = Counter()
    for (a, b), v in like.items():
        bands[min(int(v * 10), 9), of[a] == of[b]] += 1
    assert bands[8, True] + bands[9, True] > 50 and not bands[8, False] and not bands[9, False]
    assert of == roots(rows, [p for p, v in like.items() if v >= 0.8])
    assert bands[4, False] + bands[5, False] + bands[6, False] + bands[7, False] > 50  # what is left apart has less


def test_forests_join_what_is_linked(monkeypatch):
    rng = np.random.default_rng(8)
    for most in (near_dedup.MOST_BITS, 0):
        monkeypatch.setattr(near_dedup, "MOST_BITS", most)
        for _ in range(30):
            sets = [np.unique(rng.integers(0, 14, int(rng.integers(1, 12)))).astype(np.uint64) for _ in range(int(rng.integers(2, 14)))]
            m = len(sets)
            asks, label = rng.random(m) < 0.6, rng.integers(0, 2 * m, m)
            x, y = near_dedup.forest(np.array([len(s) for s in sets]), np.concatenate(sets), 0.5, asks, label)
            like = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.5
            links = [(i, j) for i in range(m) for j in range(i) if (asks[i] or asks[j]) and like(i, j)]
            same = [(i, j) for i in range(m) for j in range(i) if label[i] == label[j]]
            assert set(zip(np.maximum(x, y).tolist(), np.minimum(x, y).tolist())) <= set(links) and len(x) < m
            assert roots(range(m), [*same, *zip(x.tolist(), y.tolist())]) == roots(range(m), [*same, *links])


def test_large_buckets_of_several_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "band_keys", lambda s: np.broadcast_to(np.arange(near_dedup.BANDS, dtype=np.uint64), (len(s), near_dedup.BANDS)))
    monkeypatch.setattr(skew, "PARTS", 2)
    texts = []
    for c in range(5):  # parts of unequal size, in one bucket of many blocks
        base = prose(70 + c, 150).split()
        texts += [" ".join(base[:k] + [f"edit{k}"] + base[k + 1 :]) for k in range(5, 5 + 140 // (c + 1), 7)]
    rows = [(i, shingles(t)) for i, t in enumerate(texts)]
    of = roots(range(len(texts)), [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if weighted(x, y) >= 0.8])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: r.class_id for r in near_dedup.near_duplicates(docs, block=8).collect()} == of and len(set(of.values())) >= 5


def twins(n=1024):
    """Two different words of letters a and b with equal polynomial hashes modulo 2^64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_fool_polynomials(spark):
    one, two = twins()
    keys = bytewords.range_keys(np.frombuffer((one + two).encode(), np.uint8), np.array([0, 1024, 0, 5]), np.array([1024, 2048, 0, 5]))
    assert keys[0] != keys[1] and keys[2] == keys[3]
    bits = np.array([bin(i).count("1") % 2 for i in range(1024)], np.uint64)
    runs = bytewords.RunHash(np.concatenate([bits, 1 - bits]))
    assert len(set(runs(np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 2
    rows = [(i, " ".join([w, *prose(3, 60).split()[:34]])) for i, w in enumerate((one, two))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs).collect()] == [0, 0]
    lines = [(i, "\n".join([w, *[w2 + " x" for w2 in "ab"]] * 4)) for i, w in enumerate((one, two))]
    assert {r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(lines, "doc_id long, text string")).collect()} == {0, 1}


def test_run_hashes():
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 2, 200).astype(np.uint64)
    a = rng.integers(0, 200, 3000)
    b = np.minimum(a + rng.integers(0, 12, 3000), 200)
    got, seen = bytewords.RunHash(keys)(a, b), {}
    for h, i, j in zip(got.tolist(), a, b):
        assert seen.setdefault(h, tuple(keys[i:j])) == tuple(keys[i:j])
    assert len(seen) == len({tuple(keys[i:j]) for i, j in zip(a, b)})


def test_texts_of_a_shared_id_keep_their_links(spark):
    one, two, far = prose(70, 150), prose(71, 150), prose(72, 150)
    rows = [(10, one), (10, two), (10, None), (1, one + " end"), (2, two + " end"), (20, two + " last"), (21, far), (3, ""), (None, far), (None, far + " end")]
    for turned in (rows, rows[::-1]):
        got = near_dedup.near_duplicates(spark.createDataFrame(turned, "doc_id long, text string")).collect()
        assert Counter(tuple(r) for r in got) == Counter(
            [(10, 1, False)] * 3 + [(1, 1, True), (2, 1, False), (20, 1, False), (21, 21, True), (3, 3, True)] + [(None, None, True)] * 2
        )


def test_stage_keeps_rows_that_are_no_duplicates(spark):
    texts = [prose(k, 150) for k in range(70, 75)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, None), (5, texts[2]), (5, texts[3]), (5, texts[2]), (5, ""), (5, None), (6, texts[3] + " end"), (4, texts[2] + " end"), (7, texts[4])]
    for turned in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in turned], "doc_id long, text string, lang string, source string, n_chars long")
        stay = near_dedup.near_dedup_stage(spark, docs, "")
        assert stay.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in stay.collect()) == Counter([*rows[:4], (5, texts[3]), (5, None), rows[10], rows[11]])


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    element = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    signs = near_dedup.dart_signatures(np.repeat([0, 1], 300), np.concatenate([element, element]), np.concatenate([a, b]), 3)
    agree, truth = (signs[0] == signs[1]).mean(), np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(agree - truth) < 4 * np.sqrt(truth * (1 - truth) / near_dedup.COORDINATES) and not signs[2].any()


# op8

def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_ = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(out.values())
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s]} if open_ else set()
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: cap * sizes[s] for s in over}
        open_ -= over


def test_mixing(spark):
    extra = [prose(i, 5 + i * 13 % 60) for i in range(60)]
    docs = documents(spark, extra)
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    want = targets(sizes)
    for block in (mixing.BLOCK, 4):
        rows = mixing.mix_sources(docs, block=block).collect()
        assert len(rows) == docs.count() and sorted(r.id for r in rows) == sorted(r.doc_id for r in docs.collect())
        taken = Counter()
        for r in rows:
            assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
        # a source misses its target by at most half of the one document left over
        assert all(abs(taken[s] - want[s]) <= max(len(words(r.text)) for r in docs.collect() if r.source == s) / 2 for s in want), (taken, want)
        assert sorted(map(tuple, map(lambda r: (r.id, r.taken), rows))) == sorted((r.id, r.taken) for r in mixing.mix_sources(docs, block=block).collect())
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    copies = Counter()
    for r in mixing.mix_sources(docs).collect():
        copies[r.id] += r.copies
    stage = mixing.mixing_stage(spark, docs, "")
    assert stage.columns == docs.columns and Counter(r.doc_id for r in stage.collect()) == +copies


def test_mixing_of_equal_rows(spark, monkeypatch):
    """Thousands of rows of one id, or of none, and one length are not one mass."""
    monkeypatch.setattr(skew, "PARTS", 20)
    rows = [(None, prose(1, 37), "a")] * 5000 + [(7, prose(2, 20), "b")] * 1501 + [(i, prose(i, 1 + i % 50), "bc"[i % 2]) for i in range(100, 700)] + [(7, prose(3, 20), "b")] * 40 + [(None, None, None), (None, "", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    sizes, longest = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
        longest[s] = max(longest[s], len(words(t)))
    want, taken, copies = targets(sizes), Counter(), Counter()
    for r in mixing.mix_sources(docs).collect():
        taken[r.source] += r.taken
        copies[r.id, r.source] += r.copies
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 for s in want), (taken, want)
    stage = mixing.mixing_stage(spark, docs, "").groupBy("doc_id", "source").count().collect()
    assert Counter({(r.doc_id, r.source): r["count"] for r in stage}) == +copies


def test_targets_of_many_sources(spark):
    sizes = {f"s{i:03}": (i * 37) % 91 + 1 for i in range(120)} | {None: 5, "": 700}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(7)
    want = targets(sizes)
    got = {r.source: r.target for r in mixing.source_targets(rows, Scratch(spark, "t")).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


# op9

def test_gradients():
    rng = np.random.default_rng(5)
    net = language_id.Network.new(["a", "b", "c"], 4, 1)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    codes, target, weight = rng.integers(60, 200, (6, 5)), rng.integers(0, 3, 5), np.ones(5, np.float32)
    codes[4:, 2] = 256
    _, grads = net.loss(codes, target, weight)
    for name, value in net.params.items():
        at = (int(codes[1, 1]), 3) if name.startswith("inputs") else tuple(int(rng.integers(s)) for s in value.shape)
        old, ends = value[at], []
        for step in (1e-2, -1e-2):
            value[at] = old + step
            ends.append(net.loss(codes, target, weight)[0])
        value[at] = old
        assert abs((ends[0] - ends[1]) / 2e-2 - grads[name][at]) < 2e-4


def test_language_id(spark):
    forms = {"en": "the and tion ing of that with", "fr": "eau eux que les été çois pour"}
    texts = [(lang, " ".join(w.split()[(i * j + i) % 7] for j in range(40))) for i in range(40) for lang, w in forms.items()]
    labelled = spark.createDataFrame([(100 + i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    net = language_id.learn(labelled)
    out = language_id.predict(labelled, net, ["doc_id", "lang"]).withColumn("held", language_id.held_out(F.col("doc_id"))).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held]
    assert held and np.mean([r.lang_pred == r.lang for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in out)
    odd = language_id.predict(documents(spark, ["123 !?", "日本"]), net, ["doc_id", "n"]).collect()
    assert {r.doc_id: r.lang_pred for r in odd if r.doc_id in (0, 1, 2, 10)} == dict.fromkeys((0, 1, 2, 10), "und")
    assert all(r.lang_pred in net.languages for r in odd if r.doc_id in (5, 11))
    none = language_id.learn(documents(spark).where("false"))
    assert {r.lang_pred for r in language_id.predict(documents(spark), none, ["doc_id"]).collect()} == {"und"}
    assert language_id.predict(labelled.limit(0), net, ["doc_id"]).count() == 0


def test_sample_counts_a_key_once(spark):
    rows = [("a", i % 3, f"a{i % 3}") for i in range(900)] + [("a", 10 + i, f"a{10 + i}") for i in range(60)] + [("b", i, f"b{i}") for i in range(2)]
    df = spark.createDataFrame(rows, "g string, k long, v string")
    got = sampling.smallest_hashes_by(df, "g", "k", 40).collect()
    by = {g: [r.v for r in got if r.g == g] for g in "ab"}
    assert len(set(by["a"])) == len(by["a"]) == 20 and sorted(by["b"]) == ["b0", "b1"]
    again = sampling.smallest_hashes_by(df.repartition(7).unionByName(df), "g", "k", 40).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_learns_from_rows_without_an_id(spark):
    texts = {"en": "the and tion ing of that with", "fr": "eau eux que les été çois pour"}
    rows = [(None, " ".join(w.split()[(i * j + i) % 7] for j in range(40)), lang) for i in range(40) for lang, w in texts.items()]
    repeated = [(None, rows[0][1], "en")] * 3000  # more than a sample
    df = spark.createDataFrame(rows + repeated, "doc_id long, text string, lang string")
    out = language_id.predict(df, language_id.learn(df), ["lang"]).groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()
    assert len(out) == 2 and all(r.right > 0.95 for r in out)


def test_recurrence_number_by_number():
    """Scores of both directions against the gates' equations, a byte and a unit at a time."""
    hidden, codes = 3, [97, 256, 200, 98, 97]
    net = language_id.Network.new(["a", "b"], hidden, 5)
    net.params |= {f"bias_{d}": np.array([0.3, -0.2, 0.1], np.float32) for d in "fb"} | {"out_bias": np.array([0.5, -0.5], np.float32)}
    p, sigmoid = net.params, lambda x: 1 / (1 + math.exp(-x))
    want = [[float(b) for b in p["out_bias"]] for _ in codes]
    for d, steps in (("f", range(len(codes))), ("b", reversed(range(len(codes))))):
        h = [0.0] * hidden
        for t in steps:
            x, u = p[f"inputs_{d}"][codes[t]], [sum(h[i] * float(p[f"state_{d}"][i, j]) for i in range(hidden)) for j in range(3 * hidden)]
            z = [sigmoid(x[j] + u[j]) for j in range(hidden)]
            r = [sigmoid(x[hidden + j] + u[hidden + j]) for j in range(hidden)]
            c = [math.tanh(x[2 * hidden + j] + r[j] * (u[2 * hidden + j] + p[f"bias_{d}"][j])) for j in range(hidden)]
            h = [(1 - z[j]) * c[j] + z[j] * h[j] if codes[t] < 256 else 0.0 for j in range(hidden)]
            for k in range(2):
                want[t][k] += sum(h[j] * float(p["out"][j + (hidden if d == "b" else 0), k]) for j in range(hidden))
    assert np.allclose(net.logits(np.array(codes)[:, None])[:, :, 0], want, atol=1e-5)


def test_inference_is_the_trained_network():
    net = language_id.Network.new(["a", "b"], 5, 3)
    texts = ["abc d" * 60, "é", "", "12"]
    data, offsets = text_buffers(pa.array(texts))
    got = language_id.label_texts(net, data, offsets, window=32, margin=4)
    codes = data[:32].astype(np.int64)[:, None]
    run = np.concatenate([net._run(codes, d)["hidden"] for d in "fb"], axis=2) @ net.params["out"] + net.params["out_bias"]
    assert np.allclose(net.logits(codes).transpose(0, 2, 1), run, atol=1e-5) and np.allclose(got.sum(1), [1, 1, 0, 0])
    # every letter counts once, with labels from a window that holds it inside
    sums, text = np.zeros(2), data[: offsets[1]]
    letters = np.isin(text, np.frombuffer(b"abcd", np.uint8))
    for inner in range(0, len(text), 24):
        begin, end = max(inner - 4, 0), min(inner + 28, len(text))
        score = net.logits(text[begin:end].astype(np.int64)[:, None])[:, :, 0]
        prob = np.exp(score) / np.exp(score).sum(1, keepdims=True)
        at = np.arange(begin, end)
        sums += prob[letters[begin:end] & (at >= inner) & (at < inner + 24)].sum(0)
    assert np.allclose(got[0], sums / letters.sum(), atol=1e-5)


INSIDE = "row text lang_pred score site keys hits kept lines dropped ld_text ld_keys ld_host id kept_id a b place nd_id nd_a words size copies mx_id mx_words bucket __li_text __salt".split()


def test_stages_take_odd_tables(spark):
    """Nulls, empty texts, repeated ids with other texts, an empty table, and columns named as the stages' own."""
    import corpus_pipeline

    names = [c for c in INSIDE if c != "text"]
    long = prose(9, 9000)
    texts = [None, "", " \n", prose(1, 90), prose(1, 90), prose(2, 90), prose(3, 90), long, long + " end", "menu\n" + prose(4, 70), "menu\n" + prose(5, 70), None]
    ids = [0, 1, None, 3, 3, 3, None, None, 8, 9, 10, None]
    rows = [(i, t, ["en", "fr", None][k % 3], ["s", None][k % 2], k, *[f"{c}{k}" for c in names]) for k, (i, t) in enumerate(zip(ids, texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    assert docs.count() == 12
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "").collect()
        assert out or name == "language_id"
        for r in out:  # a row's other columns stay with it
            k = int(r["site"][4:])
            assert tuple(r[c] for c in names) == rows[k][5:] and (r.doc_id, r.lang, r.source) == (ids[k], rows[k][2], rows[k][3])
            assert r.text == texts[k] or name == "line_dedup" and r.text == texts[k].replace("menu\n", "")
        if name == "line_dedup":
            assert len(out) == 12
        if name == "near_dedup":  # null ids stay; of id 3 the repeated text goes once, the other text stays
            assert sorted(int(r["site"][4:]) for r in out) == [0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11]
        empty = stage(spark, docs.limit(0), "")
        assert empty.columns == docs.columns and empty.count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(last) == 12 and {r.decoded_sha256 for r in last if r.n_tokens == 0} == {hashlib.sha256(b"").hexdigest()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [prose(i, 60 + i) for i in range(30)] + [prose(3, 63)]
    spark.createDataFrame([(i, t, "en" if i % 2 else "fr", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and 30 not in {r.doc_id for r in got}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
