import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiwave.operators import text
from lexiwave.streaming import incremental
from lexiwave.streaming.sinks import KeyedTable, SummedTable


def run(query_df, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return query_df.sparkSession.table(name)


def test_running_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a b a",), ("b a",)], "text string")
    rows.write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t"))
    got = {tuple(r.gram): r.cnt for r in run(incremental.running_counts(stream, 2), "counts", "complete").collect()}
    assert got == {tuple(r.gram): r.cnt for r in text.gram_counts(text.sequences(rows), 2).collect()}


def test_time_frames(spark, tmp_path):
    rows = spark.range(10).select((F.lit(0) + F.col("id") * 10).cast("timestamp").alias("ts"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t"))
    got = run(incremental.time_frames(stream, "ts", "25 seconds", "10 seconds", "1 minute"), "frames", "complete")
    assert got.agg(F.sum("n")).first()[0] == sum(1 for t in range(0, 100, 10) for s in range(-30, 100, 10) if s <= t < s + 25)


def test_online_viterbi(spark, tmp_path):
    rng = np.random.default_rng(0)
    initial, moves, emission = -np.log([0.6, 0.4]), -np.log(rng.dirichlet(np.ones(2), 2)), -np.log(rng.dirichlet(np.ones(3), 2))
    obs = rng.integers(0, 3, 12)
    rows = spark.createDataFrame([(1, i, int(o)) for i, o in enumerate(obs)], "k int, seq int, obs int")
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t"))
    got = run(incremental.online_viterbi(stream, "k", initial, moves, emission), "viterbi", "update").first()
    cost = initial + emission[:, obs[0]]
    for o in obs[1:]:
        cost = (cost[:, None] + moves).min(0) + emission[:, o]
    assert got.frames == 12 and abs(got.cost - cost.min()) < 1e-9 and got.state == int(cost.argmin())


def files(spark, root, schema, parts):
    """A stream with one file a trigger, in the order given."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/*")


def model(seed=0, n=3, symbols=4):
    rng = np.random.default_rng(seed)
    return -np.log(rng.dirichlet(np.ones(n))), -np.log(rng.dirichlet(np.ones(n), n)), -np.log(rng.dirichlet(np.ones(symbols), n))


def viterbi(obs, initial, moves, emission):
    cost, came = initial + emission[:, obs[0]], []
    for o in obs[1:]:
        ways = cost[:, None] + moves
        came.append(ways.argmin(0))
        cost = ways.min(0) + emission[:, o]
    path = [int(cost.argmin())]
    for back in came[::-1]:
        path.append(int(back[path[-1]]))
    return path[::-1], float(cost.min())


def test_paths_settle_as_they_come(spark, tmp_path):
    """Several triggers give the batch path; what is settled never changes, little stays open, and late or repeated rows are left out."""
    rng, three = np.random.default_rng(1), model()
    obs = {k: rng.integers(0, 4, n).tolist() for k, n in (("a", 90), ("b", 31), ("c", 1))}
    rows = [(k, f"{i:05}", o) for k, xs in obs.items() for i, o in enumerate(xs)]
    parts = [[r for r in rows if int(r[1]) % 90 < 20], [r for r in rows if 20 <= int(r[1]) < 25] + rows[3:9], [r for r in rows if int(r[1]) >= 25][::-1]]
    stream = files(spark, tmp_path / "in", "k string, seq string, obs int", parts)
    sink, seen, opens = KeyedTable(spark, f"file://{tmp_path}/out", incremental.online_paths(stream, "k", *three).schema, ["k", "began", "t"], compact=2), {}, []

    def keep(batch, number):
        sink.write(batch, number)
        for r in batch.collect():
            assert seen.get((r.k, r.t), r.state) == r.state
            if r.settled:
                seen[r.k, r.t] = r.state
        opens.append(batch.where("not settled").groupBy("k").count().agg(F.max("count")).first()[0] or 0)

    with incremental.rocks_state(spark):
        q = incremental.online_paths(stream, "k", *three).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {}
    for r in sink.rows().collect():
        got.setdefault(r.k, {})[r.t] = r.state
    for k, xs in obs.items():
        assert [got[k][t] for t in range(len(xs))] == viterbi(xs, *three)[0] and len(got[k]) == len(xs)
    assert len(seen) > 80 and max(opens) < 40 and spark.conf.get(incremental.PROVIDER, "").find("RocksDB") < 0


def test_idle_keys_end_their_run(spark, tmp_path):
    """A key without rows is settled as it stands and forgotten; its next rows are a new run. Such a stream runs until it is stopped."""
    three, schema, rows = model(4), "k string, seq string, obs int", []
    spark.createDataFrame([("a", f"{i}", i % 4) for i in range(9)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    with incremental.rocks_state(spark):
        q = incremental.online_paths(stream, "k", *three, idle_ms=300).writeStream.foreachBatch(lambda b, n: rows.extend(b.collect())).outputMode("update").option(
            "checkpointLocation", f"{tmp_path}/progress").start()

    def settled(began):
        return {r.t: r.state for r in rows if r.began == began and r.settled}

    def wait(began, n):
        end = time.time() + 90
        while len(settled(began)) < n and time.time() < end:
            time.sleep(0.5)

    try:
        wait("0", 9)
        spark.createDataFrame([("a", "90", 1), ("a", "91", 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
        wait("90", 2)
    finally:
        q.stop()
    assert [settled("0")[t] for t in range(9)] == viterbi([i % 4 for i in range(9)], *three)[0]
    assert [settled("90")[t] for t in range(2)] == viterbi([1, 2], *three)[0]


@pytest.mark.parametrize("compact", [1, 2, 16])
def test_a_killed_stream_goes_on(spark, tmp_path, compact):
    """Batches that are sent again, before or after they were written, count once."""
    parts = [[(i % 5, 1) for i in range(n)] for n in (7, 4, 9, 3, 6)]
    stream = files(spark, tmp_path / "in", "k int, one int", parts).groupBy("k").agg(F.sum("one").alias("n"))
    sink = KeyedTable(spark, f"file://{tmp_path}/out", stream.schema, ["k"], compact)
    kills, write = {(1, "before"), (2, "after"), (3, "before"), (3, "after")}, sink.write

    def fragile(batch, number):
        for when in ("before", "after"):
            if when == "after":
                write(batch, number)
            if (number, when) in kills:
                kills.discard((number, when))
                raise RuntimeError("killed")

    sink.write = fragile
    for _ in range(10):
        try:
            sink.start(stream).awaitTermination()
            break
        except Exception as e:
            assert "killed" in str(e)
    assert not kills
    want = {k: sum(r[0] == k for p in parts for r in p) for k in range(5)}
    assert {r.k: r.n for r in sink.rows().collect()} == want
    assert {r.k: r.n for r in KeyedTable(spark, f"file://{tmp_path}/out", stream.schema, ["k"], compact).rows().collect()} == want
    empty = KeyedTable(spark, f"file://{tmp_path}/none", stream.schema, ["k"])
    assert empty.rows().count() == 0
    with pytest.raises(ValueError):
        KeyedTable(spark, "x", stream.schema, [], compact=0)


def test_frames_close_and_late_rows_go(spark, tmp_path):
    """In append mode a frame is given once, when the watermark has passed it; rows behind the watermark of the trigger before count nowhere."""
    at = lambda *seconds: [(s, 1.0) for s in seconds]
    parts = [at(5, 8, 95), at(31, 3, 100), at(150), at(61, 200), at(62, 4, 400)]
    stream = files(spark, tmp_path / "in", "s int, value double", parts).select(F.timestamp_seconds("s").alias("ts"), "value")
    frames = incremental.time_frames(stream, "ts", "20 seconds", "10 seconds", "1 minute")
    sink = KeyedTable(spark, f"file://{tmp_path}/out", frames.schema, [])
    sink.start(frames, "append").awaitTermination()
    got = {(r.frame.start.timestamp(), r.n) for r in sink.rows().collect()}
    assert len(got) == sink.rows().count()
    closed, before, want = -1e9, -1e9, {}
    for p in parts:
        for s, _ in p:
            for begin in (s // 10 * 10, s // 10 * 10 - 10):
                if begin + 20 > before:
                    want[begin] = want.get(begin, 0) + 1
        before, closed = closed, max(closed, max(s for s, _ in p) - 60)
    assert got == {(float(b), n) for b, n in want.items() if b + 20 <= closed}
    assert (60.0, 1) in got and (-10.0, 3) in got  # the second of 61 and 62, and 4, came too late


def test_a_summed_table_counts_a_batch_once(spark, tmp_path):
    """A batch that is sent again takes its own place, before and behind a snapshot."""
    counted = lambda batch: text.gram_keys(text.sequences(batch), 2)
    parts = [spark.createDataFrame([(t,) for t in ts], "text string") for ts in (["a b", "a"], ["a b c"], ["b b", "a b"])]
    table = SummedTable(spark, str(tmp_path / "t"), counted(parts[0]).schema, ["model", "ord", "key"], counted, compact=2)
    for number in (0, 0, 1, 2, 2):
        table.write(parts[number], number)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert sorted(map(tuple, table.rows().collect())) == sorted(map(tuple, counted(whole).collect()))
