import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiwave.operators import cluster, decode, hmm, lm, metrics, signal, text
from lexiwave.sources.corpus import read_corpus, read_topologies, read_transcripts
from lexiwave.sources.wav import parse_wav, read_wav, register


def test_wer(spark):
    rows = [("a b d c c", "a b c d"), ("", "a b c"), ("a b", ""), ("a b", "a b"), (None, "x")]
    df = spark.createDataFrame(rows, "h string, r string")
    got = df.select(metrics.wer(spark, F.col("h"), F.col("r")).alias("x"), metrics.wer_sql(F.col("h"), F.col("r")).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got] == [0.5, 1.0, 2.0, 0.0, 1.0]


def test_features_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    rate, size, banks, keep = 16, 16, 4, 3
    rows = [(str(n), [float(x) for x in rng.normal(size=n)]) for n in (1, 2, 7, 8, 9, 10, 23)]
    df = spark.createDataFrame(rows, "path string, samples array<double>").withColumn("sample_rate", F.lit(rate))
    fr = signal.frames(df.withColumn("s", signal.pre_emphasis(F.col("samples"))), "path", F.col("s"), 8, 4)
    counts = {r.path: r.n for r in df.select("path", signal.frame_count(F.size("samples"), 8, 4).alias("n")).collect()}
    out = fr.withColumn("c", signal.dct(signal.log_mel(signal.power_spectrum(F.col("frame"), size), signal.mel_filterbank(size, rate, banks)), banks, keep))
    got = {(r.path, r.frame_no): r.c for r in out.collect()}
    fast = {(r.path, r.frame_no): r.features for r in signal.mfcc(df, length_s=0.5, step_s=0.25, banks=banks, coefficients=keep, size=size).collect()}
    assert got.keys() == fast.keys() and all(np.allclose(got[k], fast[k], atol=1e-6) for k in got)
    assert all(sum(k[0] == p for k in got) == n for p, n in counts.items())
    with pytest.raises(ValueError):
        signal.frame_count(F.lit(5), 4, 0)


def wav(samples, width=2, channels=1, rate=8000, extra=b""):
    body = b"".join(int(s).to_bytes(width, "little", signed=width > 1) for s in samples)
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * width * channels, width * channels, width * 8)
    chunks = b"fmt " + struct.pack("<I", 16) + fmt + extra + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_wav(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(wav([1, -2, 3, -4], extra=b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    r = read_wav(spark, str(tmp_path)).first()
    assert (r.sample_rate, r.samples) == (8000, [1, -2, 3, -4])
    assert parse_wav(wav([1, -2, 3, -4], channels=2), 2)[1].tolist() == [-2, -4]
    assert parse_wav(wav([128, 129, 0], width=1))[1].tolist() == [0, 1, -128]
    padded = wav([0] * 17 + [5, -6])
    assert parse_wav(padded, compat=True)[1].tolist() == [5, -6]
    for bad in (b"nope", wav([1])[:20]):
        with pytest.raises(ValueError):
            parse_wav(bad)


def test_text_sources(spark, tmp_path):
    (tmp_path / "w1").mkdir()
    (tmp_path / "w1" / "t.txt").write_text("word a b\nc \n")
    assert read_corpus(spark, str(tmp_path / "w1")).first().text == "word a b\nc \n"
    assert tuple(read_transcripts(spark, str(tmp_path / "*" / "t.txt")).first()) == ("w1", "word a b\nc")
    (tmp_path / "w1" / "t.txt").write_text("word a b c\n")
    r = read_topologies(spark, str(tmp_path / "*" / "t.txt")).first()
    assert (r.folder, r.word, r.phones) == ("w1", "word", ["a", "b", "c"])


def test_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.2, (40, 2)), rng.normal(3, 0.2, (60, 2))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, x array<double>")
    got = cluster.kmeans(df, 2, attempts=3)
    assert sorted(np.round(got.weight, 6).tolist()) == [0.4, 0.6]
    one = cluster.one_component(df)
    assert np.allclose(one.mean[0], x.mean(0)) and np.allclose(one.covariance[0], np.cov(x.T, ddof=0) + 1e-5 * np.eye(2))
    start = cluster.Mixture(np.full(2, 0.5), np.array([[0.5, 0.5], [2.0, 2.0]]), np.repeat(one.covariance, 2, 0))
    mix = cluster.gmm(df, start, turns=30)
    assert mix.nlp(x).sum() < start.nlp(x).sum() and np.allclose(sorted(mix.weight), [0.4, 0.6], atol=1e-3)
    centres = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 3.0]), (2, [99.0, 99.0])], "k int, centre array<double>")
    step = {r.k: r.centre for r in cluster.lloyd_step(df, centres).collect()}
    assert np.allclose(step[0], x[:40].mean(0)) and step[2] == [0.0, 0.0]


def paths(initial, moves, e):
    for p in itertools.product(range(len(initial)), repeat=len(e)):
        yield p, initial[p[0]] + e[0][p[0]] + sum(moves[a, b] + e[t + 1][b] for t, (a, b) in enumerate(zip(p, p[1:])))


def test_recursions(spark):
    rng = np.random.default_rng(2)
    n, steps = 3, 4
    initial, moves, e = -np.log(rng.dirichlet(np.ones(n))), -np.log(rng.dirichlet(np.ones(n), n)), rng.uniform(0, 3, (steps, n))
    moves[1, 0] = np.inf
    every = list(paths(initial, moves, e))
    total = -np.log(sum(np.exp(-c) for _, c in every))
    alpha, beta = hmm.forward(initial, moves, e), hmm.backward(moves, e)
    assert np.isclose(hmm.logsum(alpha[-1], 0), total) and np.isclose(hmm.logsum(initial + e[0] + beta[0], 0), total)
    gamma = np.exp(-hmm.occupancy(alpha, beta))
    assert np.allclose(gamma[1], [sum(np.exp(total - c) for p, c in every if p[1] == s) for s in range(n)])
    xi = np.exp(-hmm.transit(alpha, beta, moves, e))
    assert np.allclose(xi[2, 0, 2], sum(np.exp(total - c) for p, c in every if p[2:] == (0, 2)))
    df = spark.createDataFrame([(1, e.tolist())], "k int, e array<array<double>>")
    r = df.select(hmm.forward_sql(F.col("e"), initial, moves).alias("f"), hmm.forward_sql(F.col("e"), initial, moves, True).alias("v")).first()
    assert np.isclose(r.f, total) and np.isclose(r.v, min(c for _, c in every))


def state(mean):
    return cluster.Mixture(np.ones(1), np.array([[float(mean)]]), np.array([[[1.0]]]))


def test_training_raises_likelihood(spark):
    model = hmm.WordModel("w", ["a", "b"], [state(0), state(4)])
    rng = np.random.default_rng(3)
    seqs = [np.concatenate([rng.normal(0, 1, (n, 1)), rng.normal(4, 1, (m, 1))]) for n, m in ((3, 5), (2, 7), (4, 4))]
    rows = [("w", str(u), t, v.tolist()) for u, s in enumerate(seqs) for t, v in enumerate(s)]
    frames = spark.createDataFrame(rows, "word string, utt string, frame_no int, features array<double>")
    new = hmm.train_words(frames, {"w": model})["w"]
    score = lambda m: sum(float(hmm.logsum(hmm.forward(m.initial, m.transitions, m.emissions(s))[-1], 0)) for s in seqs)
    assert score(new) < score(model) and np.allclose(hmm.logsum(new.transitions, 1), 0, atol=1e-9)
    with pytest.raises(ValueError):
        hmm.WordModel("w", [])


def test_decoding(spark):
    words = [hmm.WordModel("low", ["l", "o"], [state(0), state(1)]), hmm.WordModel("high", ["h"], [state(9)])]
    x = np.array([[0.0], [1.0], [1.0], [9.0], [9.0], [9.0]])
    rows = spark.createDataFrame([("u", t, v.tolist()) for t, v in enumerate(x)], "utt string, frame_no int, features array<double>")
    costs = np.array([[0.3, 0.2], [0.2, 0.3]])
    for compat in (True, False):
        decoder = decode.Decoder(words, costs, scale=1.0, compat=compat)
        got = decode.recognise(rows, decoder, 4).orderBy("rank").collect()
        assert [r.cost for r in got] == sorted(r.cost for r in got) and got[0].words == ["low", "high"]
        assert decoder.decode([w.emissions(x) for w in words]).cost == got[0].cost
    distinct = decoder.n_best([w.emissions(x) for w in words], 8, distinct_words=True)
    assert len({tuple(h.words) for h in distinct}) == len(distinct)
    assert decode.Decoder(words, costs).n_best([w.emissions(x[:1]) for w in words], 3)
    with pytest.raises(ValueError):
        decode.Decoder(words, np.zeros((1, 1)))


def test_rescoring(spark):
    model = lm.train("laplace", text.sequences(spark.createDataFrame([("low high low high",)], ["text"])), 2)
    hyps = spark.createDataFrame([("u", 0, ["high", "high"]), ("u", 1, ["low", "high"])], "utt string, rank int, words array<string>")
    got = {r["rank"]: r for r in decode.rescore(hyps, model).collect()}
    assert got[1].best and not got[0].best
    costs = decode.word_costs(["low", "high"], model)
    assert costs[0, 1] < costs[0, 0]
    assert decode.rescore(hyps, model, compat=True).where("best").first()["rank"] == 0


@pytest.mark.parametrize("size,cell", [(4, 8), (16, 30), (7, None), (4096, None)])
def test_frames_of_long_signals(spark, size, cell):
    """Blocks and halos of any size give the frames of whole arrays; a recording of many blocks needs no array of its own."""
    rng = np.random.default_rng(1)
    lengths = {"a": 1, "b": 2, "c": 8, "d": 9, "e": 10, "f": 57, "g": 300, None: 33}
    signals = {p: rng.normal(size=n) for p, n in lengths.items()}
    rows = spark.createDataFrame([(p, i, float(v), 1) for p, xs in signals.items() for i, v in enumerate(xs)] + [("a", 5, None, 1)], "path string, i int, value double, frame_no int").repartition(3)
    for length, step in ((8, 4), (5, 5), (9, 2), (1, 1)):
        got = {}
        for r in signal.long_frames(rows, ["path"], ["i"], "value", length, step, size=size, cell=cell).collect():
            assert (r.path, r.frame_no) not in got
            got[r.path, r.frame_no] = r.frame
        want = {}
        for p, x in signals.items():
            y = x.copy()
            y[1:] -= 0.95 * x[:-1]
            number = (len(x) - 1 - length) // step + 1 if len(x) - 1 >= length else 0
            for f in range(number + 1):
                part = y[f * step : max(f * step, min(f * step + length, len(x) - 1))]
                want[p, f] = np.concatenate([part, np.zeros(length - len(part))]) * signal.hamming(length)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)
    features = signal.long_mfcc(signal.long_frames(rows, ["path"], ["i"], "value", 8, 4, size=size, cell=cell), ["path"], 16, 4, 3, 16).collect()
    for p, x in signals.items():
        own = np.stack([r.features for r in sorted((r for r in features if r.path == p), key=lambda r: r.frame_no)])
        assert np.allclose(own, signal.mfcc_array(x, 16, length_s=0.5, step_s=0.25, banks=4, coefficients=3, size=16))
    assert signal.long_frames(rows.limit(0), ["path"], ["i"], "value", 8, 4).count() == 0


def test_wav_source(spark, tmp_path):
    rng = np.random.default_rng(3)
    made = {f"{n}.wav": rng.integers(-30000, 30000, n).tolist() for n in (0, 1, 7, 1000, 5001)}
    register(spark)
    rows = spark.createDataFrame([(f"in/{k}", 8000, v) for k, v in made.items()], "path string, sample_rate int, samples array<int>")
    for mode in ("append", "append", "overwrite"):  # again and over: the same files
        rows.repartition(3).write.format("wav").mode(mode).save(str(tmp_path / "w"))
    assert sorted(p.name for p in (tmp_path / "w").rglob("*") if p.is_file()) == sorted(["_SUCCESS", *made])
    assert {r.path.split("/")[-1]: r.samples for r in read_wav(spark, str(tmp_path / "w")).collect()} == made
    for split, block, path in ((32 << 20, 1 << 16, str(tmp_path / "w")), (100, 7, f"file://{tmp_path}/w"), (1001, 1000, str(tmp_path / "w"))):
        df, got = spark.read.format("wav").option("splitBytes", split).option("blockSamples", block).load(path), {}
        for r in sorted(df.collect(), key=lambda r: (r.path, r["first"])):
            held = got.setdefault(r.path.split("/")[-1], [])
            assert r["first"] == len(held) and r.n_samples == len(made[r.path.split("/")[-1]]) and len(r.samples) <= block
            held += r.samples
        assert got == made
    assert df.select(F.spark_partition_id()).distinct().count() > 10
    heads = spark.read.format("wav").schema("n_samples long, path string").option("splitBytes", 100).load(str(tmp_path / "w")).collect()
    assert sorted(r.n_samples for r in heads) == sorted(map(len, made.values()))


def test_wav_source_of_odd_files(spark, tmp_path):
    register(spark)
    (tmp_path / "a.wav").write_bytes(wav([1, -2, 3, -4, 5, -6], channels=2, extra=b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    (tmp_path / "b.wav").write_bytes(wav([0] * 17 + [5, -6, 7, 8], channels=1))
    one = spark.read.format("wav").option("channel", 2).option("splitBytes", 5).load(str(tmp_path / "a.wav")).orderBy("first")
    assert [x for r in one.collect() for x in r.samples] == [-2, -4, -6]
    old = spark.read.format("wav").option("compat", "true").option("splitBytes", 5).load(str(tmp_path / "b.wav")).orderBy("first")
    assert [x for r in old.collect() for x in r.samples] == [5, -6, 7, 8]
    assert spark.read.format("wav").option("pathGlobFilter", "*.none").load(str(tmp_path)).count() == 0
    (tmp_path / "c.wav").write_bytes(b"nope")
    with pytest.raises(Exception, match="c.wav: not a RIFF file"):
        spark.read.format("wav").load(str(tmp_path)).collect()
    bad = spark.createDataFrame([("x.wav", 8000, [40000])], "path string, sample_rate int, samples array<int>")
    with pytest.raises(Exception, match="16 bits"):
        bad.write.format("wav").mode("append").save(str(tmp_path / "bad"))


def test_frames_of_a_file_in_ranges(spark, tmp_path):
    register(spark)
    samples = np.random.default_rng(4).integers(-9000, 9000, 3000).tolist()
    spark.createDataFrame([("x.wav", 8000, samples)], "path string, sample_rate int, samples array<int>").write.format("wav").mode("append").save(str(tmp_path / "w"))
    rows = spark.read.format("wav").option("splitBytes", 700).option("blockSamples", 100).load(str(tmp_path / "w"))
    each = rows.select("path", "first", F.posexplode("samples")).select("path", (F.col("first") + F.col("pos")).alias("at"), F.col("col").alias("x"))
    got = {r.frame_no: r.frame for r in signal.long_frames(each, ["path"], ["at"], "x", 200, 80, size=64).collect()}
    whole = read_wav(spark, str(tmp_path / "w")).withColumn("s", signal.pre_emphasis(F.col("samples").cast("array<double>")))
    want = {r.frame_no: r.frame for r in signal.frames(whole, "path", F.col("s"), 200, 80).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def test_error_rates_hold_one_pair_at_a_time():
    from lexiwave.operators import metrics

    class Text(str):
        now = most = 0

        def split(self, *a):
            class Words(list):
                def __del__(self):
                    Text.now -= 1

            Text.now += 1
            Text.most = max(Text.most, Text.now)
            return Words(str.split(self, *a))

    texts = [Text(f"a b c{i % 3}") for i in range(50)]
    assert metrics.error_rates(texts, texts[1:] + texts[:1]).count(1 / 3) == 50 and Text.most <= 5


def test_rescoring_reads_hypotheses_once(spark):
    from lexiwave.operators import decode, lm, text

    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    model = lm.train("laplace", text.sequences(spark.createDataFrame([("a b a c",)], "text string")), 3)
    rows = spark.createDataFrame([("u", 0, ["a", "b"]), ("u", 1, ["c", "c"])], "utt string, rank int, words array<string>")
    got = decode.rescore(rows.mapInArrow(seen, rows.schema), model)
    assert [r.best for r in got.orderBy("rank").collect()] == [True, False] and calls.value == 2

