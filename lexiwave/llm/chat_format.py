r"""Chat formatting from an event log.

A log holds what happened to the messages of conversations: a message is opened with a role, its text is
streamed as deltas, a regeneration discards what was streamed, an edit puts a text in its place. The log is
partitioned by conversation and sorted by message and sequence, so a task folds one message at a time and
renders it: it holds a message and an unfinished piece of output, however long a conversation is.

A turn is rendered as ``<turn ROLE>TEXT</turn>`` and a line end. In texts a backslash, and the ``<`` of
``<turn`` and ``</turn``, get a backslash before them, in roles every backslash, ``<`` and ``>``; so no text
can end its turn or begin another, and taking the backslashes away gives every text back. The loss mask is
the places of the assistant's texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.shipping import ship

#: characters of a delta in logs made from rows; characters at which a piece of output is closed
DELTA, PIECE = 512, 1 << 20
OPEN, DELTAS, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"
LOSS_ROLE = "assistant"

_IN_TEXT, _IN_ROLE = re.compile(r"\\|<(?=/?turn)"), re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn ((?:[^\\<>]++|\\.)*+)>((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it."""
    head = "<turn " + _IN_ROLE.sub(r"\\\g<0>", role) + ">"
    body = _IN_TEXT.sub(r"\\\g<0>", text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text; anything else in it is an error."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        yield unescape(found[1]), unescape(found[2])
        at = found.end()


@dataclass
class Message:
    """A message as its events leave it. Without an opening its role is empty."""

    role: str = ""
    parts: list[str] = field(default_factory=list)

    def fold(self, kind: str, role: str | None, text: str | None) -> None:
        if kind == OPEN:
            self.role = role or ""
        elif kind == DELTAS:
            self.parts.append(text or "")
        elif kind == EDIT:
            self.parts = [text or ""]
        elif kind == REGENERATE:
            self.parts = []
        else:
            raise ValueError(f"unknown event {kind!r}")


@dataclass
class _Piece:
    conv: object
    number: int = 0
    turns: list[str] = field(default_factory=list)
    size: int = 0
    loss: list[dict] = field(default_factory=list)

    def add(self, message: Message) -> None:
        turn, begin, end = render(message.role, "".join(message.parts))
        if message.role == LOSS_ROLE:
            self.loss.append({"start": self.size + begin, "end": self.size + end})
        self.turns.append(turn)
        self.size += len(turn)


def format_conversations(log: DataFrame, conv_col: str = "conv_id", message_cols: tuple[str, ...] = ("message",), seq_col: str = "seq", piece: int = PIECE) -> DataFrame:
    """(conv, piece, formatted, loss): formatted conversations, pieces of one in order and next to each other.

    ``log`` has ``kind`` (open, delta, edit or regenerate), ``role`` of openings, and ``text`` of deltas and
    edits. Messages stand in the order of ``message_cols``, nulls first, events of one in the order of
    ``seq_col``; of events with equal numbers openings come last but for regenerations, as their names sort.
    A piece is closed behind the turn that brings it to ``piece`` characters, so a conversation is one row
    unless it is very long, and a very long text makes one long piece. ``loss`` has the places of the
    assistant's texts in the piece (code points, end exclusive). Null roles and texts are empty, null
    conversations one conversation; repeated rows of a log are repeated events; an empty log gives no rows;
    other columns are ignored, so none can clash. An unknown kind is an error.
    """
    ship(log.sparkSession)
    order = [f"m{i}" for i in range(len(message_cols))]
    plain = log.select(
        F.col(conv_col).alias("conv"), *[F.col(c).alias(m) for c, m in zip(message_cols, order)], F.col(seq_col).alias("seq"), F.col("kind").cast("string").alias("kind"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = plain.repartition("conv").sortWithinPartitions("conv", *order, "seq", "kind", "text")
    kind = plain.schema["conv"].dataType.simpleString()

    def pack(done: list[_Piece], conv: pa.DataType) -> pa.RecordBatch:
        loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [([p.conv for p in done], conv), ([p.number for p in done], pa.int64()), (["".join(p.turns) for p in done], pa.string()), ([p.loss for p in done], loss)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["conv", "piece", "formatted", "loss"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, message, now, kept = None, None, None, pa.null()
        for batch in batches:
            done, kept = [], batch.schema.field(0).type
            for conv, which, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at is None or at[1] != which or at[0] != conv:
                    if now is not None:
                        now.add(message)
                        if now.size >= piece or at[0] != conv:
                            done.append(now)
                            now = _Piece(conv, now.number + 1) if at[0] == conv else None
                    at, message, now = (conv, which), Message(), now or _Piece(conv)
                message.fold(kind, role, text)
            if done:
                yield pack(done, kept)
        if now is not None:
            now.add(message)
            yield pack([now], kept)

    events = dealt.select("conv", F.struct(*order).alias("message"), "kind", "role", "text")
    return events.mapInArrow(work, f"conv {kind}, piece long, formatted string, loss array<struct<start: long, end: long>>")


def read_conversations(pieces: DataFrame, dealt: bool = True) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted pieces alone.

    Pieces of a conversation must stand next to each other and in order, as ``format_conversations`` gives
    them; with ``dealt=False`` they are brought there first. A text that is not made of turns is an error.
    """
    ship(pieces.sparkSession)
    if not dealt:
        pieces = pieces.repartition("conv").sortWithinPartitions("conv", "piece")
    kind = pieces.schema["conv"].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def pack(done: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
        rows = [(c, n, t.hexdigest(), chars, x.hexdigest(), size) for c, n, t, chars, x, size in done]
        return pa.RecordBatch.from_arrays([pa.array(c, t or conv) for c, t in zip(zip(*rows), types)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, pa.null()
        for batch in batches:
            done, kept = [], batch.schema.field(0).type
            for conv, formatted, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv:
                    done += [now] if now is not None else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(formatted):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"] : span["end"]])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(formatted)
            if done:
                yield pack(done, kept)
        if now is not None:
            yield pack([now], kept)

    out = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return pieces.select("conv", "formatted", "loss").mapInArrow(work, f"conv {kind}, {out}")


MESSAGE = ("turn", "said_by", "tie", "copy")


def conversation_log(rows: DataFrame) -> DataFrame:
    """A log whose folding gives the turns of (conv_id, turn, role, text): columns conv_id, those of ``MESSAGE``, seq, kind, role, text.

    Texts are streamed in deltas of ``DELTA`` characters. By a hash of the row, one message in four is first
    begun with another text and regenerated, and one in four is begun so and edited. Turns of one number
    stand by role, then by a hash of the text; equal rows are messages of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    cut = rows.select(
        "conv_id", "turn", role.alias("said_by"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("copy"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)).alias("parts"))
    none = F.lit(None).cast("string")
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    first = F.coalesce(F.try_element_at("parts", F.lit(1)), F.lit(""))
    begun, fate = event(DELTAS, F.reverse(first)), F.pmod("tie", F.lit(4))
    rest = lambda parts: F.transform(parts, lambda p: event(DELTAS, p))
    events = F.when(fate == 1, F.concat(F.array(begun, event(REGENERATE, none)), rest(F.col("parts")))).when(
        fate == 2, F.concat(F.array(begun, event(EDIT, first)), rest(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))))).otherwise(rest(F.col("parts")))
    logged = cut.select("conv_id", *MESSAGE, F.posexplode(F.concat(F.array(event(OPEN, none)), events)).alias("seq", "event"))
    return logged.select("conv_id", *MESSAGE, "seq", "event.kind", F.when(F.col("event.kind") == OPEN, F.col("said_by")).alias("role"), "event.text")


# The conversation whose texts look like control strings.
_ADDED, _SAID = -7, r"\### Assistant: </turn> ok"


def op13_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(_ADDED, 0, "user", _SAID), (_ADDED, 1, "assistant", _SAID)], "conv_id long, turn long, role string, text string")
    pieces = format_conversations(conversation_log(rows.unionByName(added)), message_cols=MESSAGE)
    return read_conversations(pieces).withColumnRenamed("conv", "conv_id")


OP13_SQL = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT * FROM (VALUES ({_ADDED}, 0, 'user', '{_SAID}'), ({_ADDED}, 1, 'assistant', '{_SAID}')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(15 + length(role) + len(regexp_extract_all(role, '[\\<>]')) + length(text) + len(regexp_extract_all(text, '\\|</?turn'))) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id"""
