"""Registered queries against their SQL, on small tables with the driver's schemas."""

import datetime
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lexiwave.operators import cluster
from lexiwave.plans import catalogue

WORDS = "the of and to in a was he it word lamp kran floor tap".split()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    pick = lambda i, n: " ".join(WORDS[(i * 7 + j * j * (i % 5 + 1)) % len(WORDS)] for j in range(n))
    docs = [(i, pick(i, 3 + i % 17) + (" of the " if i % 3 else ". Été"), ["en", "fr"][i % 2], f"src{i % 3}", 10) for i in range(40)]
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(minutes=(i * 37) % 500), i % 4, catalogue.EVENT_TYPES[(i * i) % 5], float((i * 29) % 101), "") for i in range(120)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": ([(i, pick(i + 3, 6) + " unseen") for i in range(5)], "item_id long, text string"),
        "conversations": ([(i // 3, i % 3, "user", pick(i, 5)) for i in range(12)], "conv_id long, turn long, role string, text string"),
        "events": (events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
        "embeddings": ([(i, [math.sin(i * j + 1) for j in range(1, 7)], i % 3) for i in range(30)], "vec_id long, embedding array<float>, label int"),
    }
    tables["lineitem"] = ([(float(i * 7 % 50), (i * 3 % 11) / 100, "ANR"[i % 3]) for i in range(300)], "l_quantity double, l_discount double, l_returnflag string")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{top}/{name}.parquet")
    return str(top)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = [r.asDict() for r in df.collect()]
    assert rows
    if name in catalogue.SQL:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "conversations", "events", "embeddings", "lineitem"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
        rel = con.sql(catalogue.SQL[name])
        theirs = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
        key = lambda r: repr(sorted(r.items()))
        assert sorted(map(key, rows)) == sorted(map(key, theirs))


@pytest.mark.parametrize("d", [6, 3])
def test_whole_covariance(spark, tmp_path, d):
    rows = [(i, [math.sin(i * j + 1) for j in range(1, d + 1)], 0) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    expect = np.cov(np.array([x for _, x, _ in rows], np.float32).astype(float), rowvar=False, bias=True)
    full = {(r.i, r.j): r.cov for r in catalogue.cluster_covariance_full(spark, str(tmp_path)).collect()}
    assert len(full) == d * d and all(abs(v - expect[at]) < 2e-6 for at, v in full.items())
    few = {(r.i, r.j): r.cov for r in catalogue.cluster_covariance(spark, str(tmp_path)).collect()}
    assert few == {(i, j): full.get((i, j)) for i in range(4) for j in range(4)}


def test_models_are_of_documents_and_run_to_their_rules(spark, sf, monkeypatch):
    lines = {r[c] for r in catalogue.arpa_lines(spark, sf).collect() for c in r.asDict() if isinstance(r[c], str)}
    assert any("été" in x.lower() for x in lines) and not any("unseen" in x for x in lines)
    calls = []
    for name in ("kmeans", "gmm"):
        monkeypatch.setattr(catalogue.cluster, name, lambda *a, run=getattr(cluster, name), **k: (calls.append((a[1:], k)), run(*a, **k))[1])
    texts = []
    monkeypatch.setattr(catalogue.lm, "train", lambda kind, seqs, n, run=catalogue.lm.train: (texts.append(seqs.count()), run(kind, seqs, n))[1])

    assert catalogue.kmeans_full(spark, sf).count() == 4 and catalogue.gmm_em(spark, sf).count() == 2 and catalogue.rescore_best(spark, sf).count()
    assert [k for _, k in calls] == [{}, {}] and calls[0][0] == (4,) and texts == [40]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_a_model_too_large_for_a_trie(spark, sf, monkeypatch):
    """By joins the same perplexities."""
    key = lambda rows: sorted(map(tuple, rows))
    want = key(catalogue.trie_perplexity(spark, sf).collect())
    monkeypatch.setattr(catalogue.trie, "MOST_GRAMS", 1)
    assert key(catalogue.trie_perplexity(spark, sf).collect()) == want
