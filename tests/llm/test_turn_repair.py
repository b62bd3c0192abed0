import hashlib
import itertools
import random
import re
import zlib

import pytest

from lexiwave.llm import turn_repair
from lexiwave.llm.turn_repair import damaged, repair_conversations

SPACES = " \t\n\x0b\x0c\r"


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kind = "blank" if not text.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if text.strip(SPACES)[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def plain(rows):
    """Least (cost, audit) over all edits with at most two insertions in a gap, and what is left."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    kinds, best = faults(rows), None
    roles = ("user", "assistant")
    gaps = [()] + [(r,) for r in roles] + [(a, b) for a in roles for b in roles]
    for edits in itertools.product("DKua", repeat=len(rows)):
        if any(k in ("blank", "duplicate") and e != "D" for e, k in zip(edits, kinds)):
            continue
        for more in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for at in range(len(rows) + 1):
                cost, audit = cost + 3 * len(more[at]), audit + "I" * len(more[at])
                lines += [(r, "") for r in more[at]]
                if at < len(rows):
                    e, (_, role, text) = edits[at], rows[at]
                    cost += {"D": 4, "K": 0}.get(e, 3) + (3 if kinds[at] == "truncated" and e != "D" else 0)
                    audit += "R" if e in "ua" else e
                    if e != "D":
                        lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[e], text))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                best = (cost, audit, [f"{r}:{t}" for r, t in lines])
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], sha(best[2]))


def conversations(seed, number, most):
    r = random.Random(seed)
    return {c: [(r.choice([None, *range(6)]), r.choice(["user", "assistant", "user", "assistant", "system", "", "tool"]), r.choice(["a.", "b?", "c", " \n", "", "d! \t", "e.x"])) for _ in range(r.randrange(most + 1))] for c in range(number)}


SCHEMA = "conv_id long, turn long, role string, text string, seg long, audit string"


@pytest.mark.parametrize("segment,batch", [(64, 10_000), (1, 2), (2, 3)])
def test_against_all_edits(spark, segment, batch):
    convs = {k: v for k, v in conversations(5, 70, 3).items() if v}
    rows = [(c, *row, 0, "x") for c, some in convs.items() for row in some]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = repair_conversations(spark.createDataFrame(rows, SCHEMA), segment=segment).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r[0]: tuple(r[1:]) for r in got} == {c: plain(v) for c, v in convs.items()}


def test_long_conversations_and_batches(spark):
    """Segments and batches of any size give one result, and the turns are those of the audit."""
    convs = {c: [(i, role, text) for i, (_, role, text) in enumerate(v)] for c, v in conversations(9, 6, 400).items()}
    rows = [(c if c else None, *row, 0, "x") for c, some in convs.items() for row in some]
    df = spark.createDataFrame(rows, SCHEMA)
    results = []
    for segment, batch in ((1000, 10_000), (7, 50), (64, 33)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        results.append({r.conv: r.asDict(True) for r in repair_conversations(df, segment=segment, with_turns=True).collect()})
        results.append({r.conv: r.asDict(True) for r in repair_conversations(df, segment=segment).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for one in results[0].values():
        lines = [f"{t['role']}:{t['text']}" for t in one["turns"]]
        assert one["repaired_sha256"] == sha(lines) and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    bare = {c: {k: v for k, v in r.items() if k != "turns"} for c, r in results[0].items()}
    assert all(r == (bare if i % 2 else results[0]) for i, r in enumerate(results))
    assert sum(len(r["audit"]) for r in bare.values()) > 300


def test_damage_and_odd_rows(spark):
    rows = [(c, t, ["user", "assistant", None][t % 3 if t is not None else 2], [None, "Hi. You?", "no end", "  "][(c or 0) % 4]) for c in [*range(60), None] for t in (0, 1, 2, None)]
    got = {}
    for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text, r.gone))
    expect = {}
    for c, t, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        hit, role, text = zlib.crc32(f"{name(c)}:{name(t)}".encode()) % 20, name(role), name(text)
        one = (t, None, None, True) if hit == 0 else (t, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text, False)
        expect.setdefault(c, []).extend([one] * (2 if hit == 3 else 1))
    key = lambda x: repr(x)
    assert {c: sorted(v, key=key) for c, v in got.items()} == {c: sorted(v, key=key) for c, v in expect.items()}


def test_empty_and_dropped(spark):
    schema = "conv_id long, turn long, role string, text string, gone boolean"
    assert repair_conversations(spark.createDataFrame([], schema)).count() == 0
    one = repair_conversations(spark.createDataFrame([(3, 0, None, None, True)], schema), gone_col="gone").first()
    assert tuple(one) == (3, 0, 0, 0, 0, 0, 0, "", sha([]))
    long = "x" * 3_000_000 + "."
    two = repair_conversations(spark.createDataFrame([(None, None, "user", long, False), (None, None, "assistant", long, None)], schema)).first()
    assert tuple(two)[1:] == (0, 0, 0, 0, 0, 6, "IKKI", sha(["user:", f"assistant:{long}", f"user:{long}", "assistant:"]))


def test_query(spark, tmp_path):
    import duckdb

    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), r.choice(["A b.", "c", "Is it?", "A b.", ""])) for c in range(80) for t in range(r.randrange(1, 12))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = turn_repair.op12_turn_repair(spark, str(tmp_path))
    rel = con.sql(turn_repair.OP12_SQL)
    assert rel.columns == got.columns and sorted(rel.fetchall()) == sorted(map(tuple, got.collect()))
