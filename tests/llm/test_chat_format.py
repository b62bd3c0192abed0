import hashlib
import random

import pytest

from lexiwave.llm import chat_format
from lexiwave.llm.chat_format import conversation_log, format_conversations, read_conversations, render, turns_of, unescape

ODD = ["", "\\", "\\\\", "</turn>", "<turn user>", "\\</turn>\n", "a < b <t> <tur", "<<turn", "</turn", "é🙂\\<turn", "line\nline\n", r"\### Assistant: </turn> ok", ">", "<turn assistant>x</turn>\n"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), sum(len(render(r, t)[0]) for r, t in turns)


def test_render_and_read():
    turns = [(r, t) for t in ODD for r in ("user", "assistant", *ODD)]
    assert list(turns_of("".join(render(r, t)[0] for r, t in turns))) == turns
    for r, t in turns:
        text, a, b = render(r, t)
        assert unescape(text[a:b]) == t
    r = random.Random(0)
    for _ in range(500):
        turns = [("".join(r.choices(["\\", "<", ">", "turn ", "/turn>", "\n", "x"], k=r.randrange(9))),) * 2 for _ in range(4)]
        assert list(turns_of("".join(render(*t)[0] for t in turns))) == turns
    assert list(turns_of("")) == []
    for bad in ("x", "<turn a>b", "<turn a>b</turn>", "<turn a>b</turn>\n "):
        with pytest.raises(ValueError):
            list(turns_of(bad))


LOG = "conv_id string, message long, seq long, kind string, role string, text string, conv long, piece string"


def test_fold(spark):
    """Deltas, edits and regenerations against a plain fold, whatever the order of the rows and the size of pieces and batches."""
    r = random.Random(1)
    rows, expect = [], {}
    for conv in ["a", "b", None, "d"]:
        turns = []
        for m in [None, *range(r.randrange(2, 25))]:
            text, seq, role = "", 0, r.choice(["user", "assistant", None, "system"])
            rows.append((conv, m, seq, "open", role, None, 1, "x"))
            for _ in range(r.randrange(12)):
                seq, kind, new = seq + 1, r.choice(["delta"] * 6 + ["edit", "regenerate"]), r.choice([*ODD, None])
                rows.append((conv, m, seq, kind, None, new, 1, "x"))
                text = {"delta": text + (new or ""), "edit": new or "", "regenerate": ""}[kind]
            turns.append((role or "", text))
        expect[conv] = turns
    r.shuffle(rows)
    log = spark.createDataFrame(rows, LOG)
    for batch, piece in ((10_000, 1 << 20), (3, 40), (50, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        pieces = format_conversations(log, piece=piece)
        texts, masks = {}, {}
        for p in pieces.collect():
            assert p.piece == len(texts.setdefault(p.conv, []))
            texts[p.conv].append(p.formatted)
            masks.setdefault(p.conv, []).extend(unescape(p.formatted[s.start : s.end]) for s in p.loss)
        assert {c: list(turns_of("".join(t))) for c, t in texts.items()} == expect
        assert masks == {c: [t for role, t in turns if role == "assistant"] for c, turns in expect.items()}
        assert piece > 40 or max(map(len, texts.values())) > 3
        for back in (read_conversations(pieces), read_conversations(pieces.repartition(3), dealt=False)):
            assert {x[0]: tuple(x[1:]) for x in back.collect()} == {c: digests(t) for c, t in expect.items()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_log_of_rows(spark):
    """Every way a message may have come about gives its text; equal rows are turns of their own."""
    r = random.Random(3)
    rows = [(c, r.choice([None, 0, 1, 2]), r.choice(["user", "assistant", None]), r.choice([None, *ODD]) if i % 3 else f"{i} é🙂\n" * r.randrange(400), 5, 6) for c in [*range(12), None] for i in range(6)]
    rows += [rows[0]] * 3 + [(50, 0, "user", "y" * 2_000_000 + "\\", 5, 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long, copy long")
    log = conversation_log(df)
    assert {x.kind for x in log.select("kind").distinct().collect()} == {"open", "delta", "edit", "regenerate"}
    got = {}
    for p in format_conversations(log, message_cols=chat_format.MESSAGE).collect():
        got.setdefault(p.conv, []).extend(turns_of(p.formatted))
    expect = {}
    for c, t, role, text, *_ in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "")):
        expect.setdefault(c, []).append((role or "", text or ""))
    assert {c: sorted(v) for c, v in got.items()} == {c: sorted(v) for c, v in expect.items()}
    assert {c: [role for role, _ in v] for c, v in got.items()} == {c: [role for role, _ in v] for c, v in expect.items()}


def test_odd_logs(spark):
    assert read_conversations(format_conversations(spark.createDataFrame([], LOG))).count() == 0
    with pytest.raises(Exception, match="unknown event"):
        format_conversations(spark.createDataFrame([("a", 1, 1, "gone", None, None, 0, "")], LOG)).collect()
    bare = format_conversations(spark.createDataFrame([("a", 1, 1, "delta", None, "x", 0, "")], LOG)).first()
    assert bare.formatted == "<turn >x</turn>\n" and bare.loss == []


def test_query(spark, tmp_path):
    import duckdb

    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), r.choice(ODD)) for c in range(40) for t in range(r.randrange(1, 12))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = chat_format.op13_chat_format(spark, str(tmp_path))
    rel = con.sql(chat_format.OP13_SQL)
    assert rel.columns == got.columns and sorted(rel.fetchall()) == sorted(map(tuple, got.collect()))
    said = r"\### Assistant: </turn> ok"
    assert {x[0]: tuple(x[1:]) for x in got.collect()}[-7] == digests([("user", said), ("assistant", said)])
