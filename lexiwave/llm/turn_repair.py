"""Conversation structure repair: the cheapest edits that make a conversation's roles fit ``(s?(ua)+)?``.

Rows are hash-partitioned by conversation and sorted in each partition, where they are read in batches. A
batch's conversations are cut into segments of at most ``SEGMENT`` rows, and one recursive DuckDB query walks
all of them at once: each recursion advances one row everywhere and keeps, for each state of the grammar, the
least cost and of equals the ASCII-least audit. A segment that does not begin a conversation is walked from
every state, so its rows are a small table of (from, to, cost, audit), and segments are joined in order by
adding costs. Two audits that reach a state at equal cost are never one the beginning of the other, so the
least of the beginnings stays least whatever follows.

A conversation that a batch's end cuts goes on in the next batch from its states, each with a digest of what
it has repaired so far: texts are held for a batch, however long a conversation is. What grows with a
conversation is its audit, which is part of the result, and 16 bytes a different row to know duplicates by.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.shipping import ship

SEGMENT = 64
#: costs of keeping, changing a role, deleting and inserting; a truncated row that stays adds ``CUT``
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
WORD, END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

# states: nothing yet, behind s, behind u, behind a
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # a turn of the role that must follow
_KEPT = {(START, "s"): SYSTEM} | {(q, "a" if to == ASSISTANT else "u"): to for q, to in _NEXT.items()}


def _inserted(state: int) -> Iterator[tuple[str, int]]:
    """Letters and state of every number of insertions that does not come back to a state."""
    letters, seen = "", set()
    while state not in seen:
        yield letters, state
        seen.add(state)
        letters, state = letters + "I", _NEXT[state]


def _moves() -> list[tuple]:
    """(state, letters, next state, cost, initial that the row must have or '', whether the row stays)."""
    out = []
    for q in range(4):
        for letters, at in _inserted(q):
            cost = INSERT * len(letters)
            out.append((q, letters + "D", at, cost + DELETE, "", False))
            out.append((q, letters + "R", _NEXT[at], cost + REROLE, "", True))
            out += [(q, letters + "K", to, cost + KEEP, c, True) for (a, c), to in _KEPT.items() if a == at]
    return out


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows)


_WALK = f"""WITH RECURSIVE moves(state, letters, goes, cost, needs, stays) AS (VALUES {_values(_moves())}),
walk AS (
  SELECT seg, origin, 0 AS n, origin AS state, {{'cost': 0, 'audit': ''}} AS best FROM starts
  UNION ALL
  SELECT w.seg, w.origin, w.n + 1 AS n, m.goes AS state,
    min({{'cost': w.best.cost + m.cost + CASE WHEN m.stays AND r.cut THEN {CUT} ELSE 0 END, 'audit': w.best.audit || m.letters}}) AS best
  FROM walk w JOIN lines r ON r.seg = w.seg AND r.n = w.n + 1
  JOIN moves m ON m.state = w.state AND (m.needs = '' OR m.needs = r.initial) AND NOT (m.stays AND r.must)
  GROUP BY w.seg, w.origin, w.n, m.goes)
SELECT walk.seg, origin, state, best.cost, best.audit FROM walk JOIN (SELECT seg, max(n) AS n FROM lines GROUP BY seg) USING (seg, n) ORDER BY walk.seg"""


@dataclass
class _Open:
    """A conversation as far as it was read. A way to a state is (cost, audit, path); a path's last link is a digest and whether it is of any row."""

    conv: object
    ways: dict[int, tuple] = field(default_factory=lambda: {START: (0, "", (None, hashlib.sha256(), False, ()))})
    audit: list[str] = field(default_factory=list)
    seen: set[bytes] = field(default_factory=set)
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    last: str | None = None
    segments: list[int] = field(default_factory=list)

    def read(self, turn: int | None, role: str, text: str, initial: str, blank: bool, cut: bool) -> tuple[bool, bool]:
        """Count a row; whether it must go, and whether it is truncated."""
        if turn is not None:
            self.distinct += self.high is None or turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        again = not blank and mark in self.seen
        self.seen.add(mark)
        cut = cut and not blank and not again
        self.blank += blank
        self.duplicate += again
        self.truncated += cut
        return blank or again, cut

    def step(self, seg: int, walked: list[tuple]) -> None:
        new: dict[int, tuple] = {}
        for origin, state, cost, audit in walked:
            if origin in self.ways:
                c, a, path = self.ways[origin]
                way = (c + cost, a + audit, (path, seg, origin, audit))
                if state not in new or way[:2] < new[state][:2]:
                    new[state] = way
        self.ways = new

    def pause(self, rows: dict[int, list]) -> None:
        """Digest what is read, so that its texts can go, and put aside what all audits begin with."""
        self.ways = {q: (c, a, (None, *_digest(path, rows))) for q, (c, a, path) in self.ways.items()}
        audits = [a for _, a, _ in self.ways.values()]
        low, high = min(audits), max(audits)
        same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), len(low))
        self.audit.append(low[:same])
        self.ways = {q: (c, a[same:], path) for q, (c, a, path) in self.ways.items()}

    def finish(self, rows: dict[int, list]) -> tuple:
        behind = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
        cost, audit, q = min((c + INSERT * len(behind[q]), a + behind[q], q) for q, (c, a, _) in self.ways.items())
        digest, some, turns = _digest((self.ways[q][2], None, q, behind[q]), rows)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit) + audit, digest.hexdigest(), turns


def _repaired(letters: str, state: int, rows: list) -> Iterator[tuple[str, str]]:
    """The turns that edits make of rows, from a state of the grammar on."""
    rows = iter(rows)
    for x in letters:
        role, text = ("", "") if x == "I" else next(rows)
        if x == "K":
            state = _KEPT[state, role[:1]]
        elif x != "D":
            state = _NEXT[state]
            role = "assistant" if state == ASSISTANT else "user"
        if x != "D":
            yield role, text


def _digest(path: tuple, rows: dict[int, list]) -> tuple:
    """Digest of a path's turns, whether there are any, and those read since the path's last digest."""
    links = []
    while path[0] is not None:
        links.append(path[1:])
        path = path[0]
    _, digest, some, turns = path
    digest, turns = digest.copy(), list(turns)
    for seg, origin, letters in reversed(links):
        for role, text in _repaired(letters, origin, rows.get(seg, [])):
            digest.update(("\n" * some + f"{role}:{text}").encode())
            some = True
            turns.append((role, text))
    return digest, some, turns


def _read(batch: pa.RecordBatch, now: _Open | None, segment: int) -> tuple[list[_Open], dict[int, list], pa.Table, pa.Table]:
    """The batch's conversations, the first of which may be ``now``, the rows of its segments, and the tables that are walked."""
    found, rows = [] if now is None else [now], {}
    seg, n = -1, 0
    lines, starts = {c: [] for c in ("seg", "n", "initial", "must", "cut")}, {"seg": [], "origin": []}
    for conv, turn, role, text, gone, initial, blank, cut in zip(*(c.to_pylist() for c in batch.columns)):
        new = not found or found[-1].conv != conv
        if new:
            found.append(_Open(conv))
        if gone:
            continue
        one = found[-1]
        if not one.segments or n == segment:
            seg, n = seg + 1, 0
            rows[seg] = []
            for q in range(4) if one.last is not None else (START,):
                starts["seg"].append(seg)
                starts["origin"].append(q)
            one.segments.append(seg)
        n += 1
        rows[seg].append((role, text))
        for c, v in zip(lines, (seg, n, initial, *one.read(turn, role, text, initial, blank, cut))):
            lines[c].append(v)
    whole, kinds = pa.int64(), {"initial": pa.string(), "must": pa.bool_(), "cut": pa.bool_()}
    return found, rows, pa.table({c: pa.array(v, kinds.get(c, whole)) for c, v in lines.items()}), pa.table({c: pa.array(v, whole) for c, v in starts.items()})


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    gone_col: str | None = None, with_turns: bool = False, segment: int = SEGMENT,
) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and, if asked for, the repaired turns.

    Rows are read by turn, nulls first; those of one turn by role and text in code point order. Null roles and
    texts are read as one space. Null conversations are one conversation. Rows that ``gone_col`` marks only
    name their conversation, and one of such rows alone has zeros, an empty audit and the digest of nothing.
    Equal rows are duplicates of the first. An empty table gives an empty result; other columns are ignored,
    so none can clash. Very long texts and conversations are read in batches; only ``with_turns`` holds a
    whole conversation.
    """
    ship(rows.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    gone = F.coalesce(F.col(gone_col), F.lit(False)) if gone_col else F.lit(False)
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    marked = plain.withColumn("initial", F.substring("role", 1, 1)).withColumn("blank", ~F.rlike("text", F.lit(WORD))).withColumn("cut", ~F.rlike("text", F.lit(END)))
    dealt = marked.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    kind = plain.schema["conv"].dataType.simpleString()
    out = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = ["conv", *(c.split()[0] for c in out.split(", "))] + ["turns"] * with_turns
    types = [None, *[pa.int64()] * 6, pa.string(), pa.string()] + [pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))] * with_turns

    def pack(done: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [()] * 10
        if with_turns:
            columns[9] = [[{"role": a, "text": b} for a, b in turns] for turns in columns[9]]
        return pa.RecordBatch.from_arrays([pa.array(c, t or conv) for c, t in zip(columns, types)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con, now, kept = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}), None, pa.null()
        for batch in batches:
            kept = batch.schema.field(0).type
            found, texts, lines, starts = _read(batch, now, segment)
            con.register("lines", lines)
            con.register("starts", starts)
            walked: dict[int, list] = {}
            for seg, *way in con.execute(_WALK).fetchall():
                walked.setdefault(seg, []).append(tuple(way))
            for one in found:
                for seg in one.segments:
                    one.step(seg, walked[seg])
                one.segments = []
            *done, now = found or [None]
            if done:
                yield pack([x.finish(texts) for x in done], kept)
            if now is not None:
                now.pause(texts)
                if not with_turns:
                    now.ways = {q: (c, a, (*path[:3], ())) for q, (c, a, path) in now.ways.items()}
        if now is not None:
            yield pack([now.finish({})], kept)

    turns = ", turns array<struct<role: string, text: string>>" * with_turns
    return dealt.mapInArrow(work, f"conv {kind}, {out}{turns}")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` as op12 damages them, by a hash of conversation and turn; a dropped row stays without role and text, marked ``gone``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.encode(F.concat(name("conv_id"), F.lit(":"), name("turn")), "utf-8")) % 20
    role = F.when(F.col("hit") == 4, "user").when(F.col("hit") > 0, name("role"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace(name("text"), "[.!?]", "")).when(F.col("hit") > 0, name("text"))
    times: Column = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("hit", hit).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("hit") == 0).alias("gone"), times.alias("copy")).drop("copy")


def op12_turn_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_conversations(damaged(rows), gone_col="gone").withColumnRenamed("conv", "conv_id")


def _crc_table() -> list[int]:
    """What a byte does to a CRC-32 whose other bits are 0."""
    return [zlib.crc32(bytes([i ^ 255]), 0) ^ 0xFFFFFFFF ^ 0x00FFFFFF for i in range(256)]


_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)), lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"
OP12_SQL = rf"""WITH RECURSIVE moves(state, letters, goes, cost, needs, stays) AS (VALUES {_values(_moves())}),
h AS (SELECT *, {_CRC} % 20 AS hit FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations)),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(CASE hit WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  substr(role, 1, 1) AS c, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM d),
r AS (SELECT *, blank OR again AS must, cut AND NOT blank AND NOT again AS truncated, lag(c) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
walk AS (SELECT conv_id, 0::BIGINT AS n, 0 AS state, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, r.n, m.goes AS state, min({{'cost': w.best.cost + m.cost + CASE WHEN m.stays AND truncated THEN {CUT} ELSE 0 END, 'audit': w.best.audit || letters,
    'lines': list_concat(list_concat(w.best.lines, list_transform(range(1, len(letters)), lambda i: CASE WHEN (m.state = 2) = (i = 1) THEN 'assistant:' ELSE 'user:' END)),
      CASE WHEN NOT stays THEN [] WHEN needs <> '' THEN [role || ':' || text] ELSE [CASE WHEN goes = 3 THEN 'assistant:' ELSE 'user:' END || text] END)}}) AS best
  FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1 JOIN moves m ON m.state = w.state AND (needs = '' OR needs = r.c) AND NOT (stays AND must)
  GROUP BY w.conv_id, r.n, m.goes),
e AS (SELECT walk.conv_id, min({{'cost': best.cost + CASE state WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': best.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'lines': list_concat(best.lines, CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END)}}) AS best
  FROM walk JOIN (SELECT conv_id, max(n) AS n FROM walk GROUP BY conv_id) t ON t.conv_id IS NOT DISTINCT FROM walk.conv_id AND t.n = walk.n GROUP BY walk.conv_id),
s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
  count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256 FROM e LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv_id"""
