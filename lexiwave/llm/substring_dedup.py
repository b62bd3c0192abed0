"""Substring dedup: words in any window of words that also stands elsewhere are removed.

Windows are dealt to shards by content. Of the runs of ``ANCHOR`` words in a window, the one with the
least hash (the leftmost, of equals) is its anchor; equal windows have equal anchors at equal places. A
document is cut into segments of consecutive windows with one anchor. An anchor seen once has no
repeated window. The others' distinct segments, each with the number of its occurrences, are gathered in
shards by anchor; a shard builds an FM-index of its segments and searches each in it.

Equal segments, however many documents hold them, are summed before the shuffle. An anchor with more than
``HOT`` distinct segments (a passage that very many documents share, in different surroundings) is split:
its windows are dealt by their own hashes, equal ones summed, to shards that each index single windows.
So a shard stays near ``SHARD`` segments whatever the corpus holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.shipping import ship
from lexiwave.llm.bytewords import RunHash, Words, chunks, ranges, text_buffers
from lexiwave.llm.fm_index import repeated_windows
from lexiwave.functions.scratch import Scratch
from lexiwave.llm.skew import heavy_keys, spread_join

WINDOW = 35
ANCHOR = 8
HOT = 4096
SHARD = 8192

# a segment's place is its first word times _PLACES plus its number of windows; their mask is one signed integer
_PLACES, _MOST_WINDOWS = 64, 63


def _anchored(words: Words, width: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first word in the text, windows, anchor hash, content hash) of all segments."""
    keys = words.keys()
    n = len(keys)
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    if n < width:
        return none
    grams = n - anchor + 1
    at = np.arange(grams)
    least = RunHash(keys)(at, at + anchor)
    # the least of a window's grams, by doubling; windows that leave their text are dropped below
    span, place, covered = width - anchor + 1, at, 1
    while covered < span:
        step = min(covered, span - covered)
        a, b = least[: len(least) - step], least[step:]
        right = b < a
        least, place = np.where(right, b, a), np.where(right, place[step:], place[: len(place) - step])
        covered += step
    start = np.flatnonzero(words.doc[: n - width + 1] == words.doc[width - 1 :])
    if not len(start):
        return none
    place, least = place[start], least[start]
    new = np.ones(len(start), bool)
    new[1:] = place[1:] != place[:-1]
    head = np.flatnonzero(new)
    windows = np.diff(np.append(head, len(start)))
    begin = start[head]
    content = RunHash(keys, 1)(begin, begin + windows + width - 1)
    text = words.doc[begin]
    return text, begin - words.first[text], windows, least[head], content


def _segments(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    schema = pa.schema([(c, pa.int64()) for c in ("id", "tk", "place", "anchor", "content")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(*text_buffers(part.column(2)))
                text, begin, windows, least, content = _anchored(words, width, anchor)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array(begin * _PLACES + windows), pa.array(least.view(np.int64)), pa.array(content.view(np.int64))],
                    schema=schema,
                )

    return docs.mapInArrow(work, "id long, tk long, place long, anchor long, content long")


def _cut(docs: DataFrame, width: int) -> DataFrame:
    """The words of the wanted segments of (text, wanted): one row a segment, or one a window of hot ones."""
    names = ("anchor", "content", "bit", "window", "weight", "words")
    schema = pa.schema([(c, pa.binary() if c == "words" else pa.int64()) for c in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(*text_buffers(part.column(0)))
                hashes = RunHash(words.keys(), 1)
                raw, out = words.data.tobytes(), {c: [] for c in names}
                for i, wanted in enumerate(part.column(1).to_pylist()):
                    first = int(words.first[i])
                    for w in wanted:
                        begin, windows = first + w["place"] // _PLACES, w["place"] % _PLACES
                        pieces = [(b, b + width, b - begin) for b in range(begin, begin + windows)] if w["hot"] else [(begin, begin + windows + width - 1, -1)]
                        for b, e, bit in pieces:
                            key = int(hashes(np.array([b]), np.array([e])).view(np.int64)[0]) if w["hot"] else 0
                            piece = b" ".join(raw[words.start[b] : words.end[e - 1]].split())
                            for c, v in zip(names, (w["anchor"], w["content"], bit, key, w["weight"], piece)):
                                out[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[c], schema.field(c).type) for c in names], schema=schema)

    return docs.mapInArrow(work, "anchor long, content long, bit long, window long, weight long, words binary")


def _search(segments: DataFrame, width: int) -> DataFrame:
    """(key columns, mask) of every segment with a window repeated in its shard; bit i of mask is window i."""
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("mask", pa.int64())])

    def work(table: pa.Table) -> pa.Table:
        column = table.column("words").combine_chunks()
        column = column.cast(pa.string()) if not isinstance(column, pa.ChunkedArray) else pa.concat_arrays(column.chunks).cast(pa.string())
        words = Words(*text_buffers(column))
        _, symbols = np.unique(words.keys(), return_inverse=True)
        # a separator, symbol 1, behind every segment
        begin = words.first[:-1] + np.arange(len(words.count))
        end = begin + words.count
        text = np.ones(len(symbols) + len(begin), np.int64)
        text[ranges(begin, words.count)] = symbols + 2
        heavy = np.asarray(table.column("weight")) > 1
        found = repeated_windows(text, begin, end, heavy, width)
        masks = [sum(1 << int(s) for s in starts) for starts in found]
        out = pa.table([table.column("anchor").combine_chunks(), table.column("content").combine_chunks(), pa.array(masks, pa.int64())], schema=schema)
        return out.filter(pa.array([m > 0 for m in masks], pa.bool_()))

    return segments.groupBy("shard").applyInArrow(work, "anchor long, content long, mask long")


def repeated_segments(docs: DataFrame, scratch: Scratch, width: int, anchor: int, hot: int, shard: int, repeats: bool) -> DataFrame:
    """(id, tk, places) of (id, tk, text): the different segments with repeated windows, as struct(place, mask).

    Equal rows have equal segments: each counts as an occurrence, but only different places are gathered, before
    the shuffle too, so k copies of a row cost k times a row.
    """
    segments = scratch.save(_segments(docs, width, anchor), "segments")
    shared = scratch.save(segments.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    heavy = heavy_keys(shared, ["anchor"], "n")
    alive = scratch.save(spread_join(segments, shared.select("anchor"), ["anchor"], heavy, F.monotonically_increasing_id()), "alive")
    scratch.drop("segments")
    distinct = scratch.save(
        alive.groupBy("anchor", "content").agg(F.count("*").alias("weight"), F.min(F.struct("id", "tk", "place")).alias("at")), "distinct",
    )
    spread = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"))
    wanted = (
        spread_join(distinct, spread, ["anchor"], heavy, F.col("content")).groupBy("at.id", "at.tk")
        .agg(F.collect_list(F.struct(F.col("at.place").alias("place"), "anchor", "content", "weight", (F.col("kinds") > hot).alias("hot"))).alias("wanted"))
    )
    texts = docs.groupBy("id", "tk").agg(F.min("text").alias("text")) if repeats else docs
    located = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"]) & (texts["tk"] == wanted["tk"])).select("text", "wanted")
    pieces = scratch.save(_cut(located, width), "pieces")
    counts = pieces.agg(F.count("*"), F.count(F.when(F.col("bit") >= 0, 1))).first()
    shards = lambda n: F.lit(max(1, -(-n // shard)))
    whole = pieces.where("bit < 0").withColumn("shard", F.pmod(F.xxhash64("anchor"), shards(counts[0] - counts[1])))
    masks = _search(whole, width)
    if counts[1]:
        windows = pieces.where("bit >= 0")
        single = windows.groupBy("window").agg(F.sum("weight").alias("weight"), F.min("words").alias("words"))
        single = single.select(F.col("window").alias("anchor"), F.lit(0).cast("long").alias("content"), "weight", "words", F.pmod(F.xxhash64("window"), shards(counts[1])).alias("shard"))
        twice = _search(single, width).select(F.col("anchor").alias("window"))
        often = windows.groupBy("window").agg(F.count("*").alias("n"))
        bits = spread_join(windows, twice, ["window"], heavy_keys(scratch.save(often, "often"), ["window"], "n"), F.col("content")).groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, int(bit))")).alias("mask"))
        masks = masks.unionByName(bits)
    masks = scratch.save(masks, "masks")
    hits = spread_join(alive, masks, ["anchor", "content"], heavy_keys(distinct, ["anchor", "content"], "weight"), F.monotonically_increasing_id())
    return hits.groupBy("id", "tk").agg(F.collect_set(F.struct("place", "mask")).alias("places"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, shard: int = SHARD, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 and, if asked for, the kept words as text.

    A window is ``width`` consecutive words; a word goes when a window over it also starts anywhere else,
    in its own document or another. Windows are judged on the input. Kept words are joined by one space.
    Null and empty texts have no words. Repeated rows repeat each other's windows. A null id is an id, an
    empty table gives an empty result, and other columns are ignored. Words are told apart by 64-bit
    hashes, segments by two of them. Of equal hashes in a window the leftmost run is its anchor. A very long
    text is cut into segments, of which a task holds a shard at most; its own places are one row.
    """
    if not 1 <= anchor <= width or width - anchor + 1 > _MOST_WINDOWS:
        raise ValueError(f"an anchor has at least one word and is at most {_MOST_WINDOWS - 1} words shorter than a window")
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "substring_dedup")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("tk"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = plain.select("*", F.coalesce("id", F.lit(0)).alias("k_id"), F.col("id").isNull().alias("k_none"))
    keys = ["k_id", "k_none", "tk"]
    repeated = scratch.save(keyed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    found = repeated_segments(plain, scratch, width, anchor, hot, shard, repeated.limit(1).count() > 0)
    places = found.select(F.coalesce("id", F.lit(0)).alias("k_id"), F.col("id").isNull().alias("k_none"), "tk", "places")
    # copies of a row of very many are dealt over many tasks
    joined = spread_join(keyed, places, keys, heavy_keys(repeated, keys, "n"), F.monotonically_increasing_id(), "left").select("id", "text", "places")
    fields = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * with_text
    schema = pa.schema(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(*text_buffers(part.column(1)))
                depth = np.zeros(len(words.start) + 1, np.int64)
                lists = part.column(2).fill_null([]) if part.column(2).null_count else part.column(2)
                flat, owner = lists.flatten(), np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                if len(flat):
                    place, mask = (np.asarray(flat.field(c)) for c in ("place", "mask"))
                    bits = (mask[:, None] >> np.arange(width - anchor + 1)) & 1
                    row, bit = np.nonzero(bits)
                    begin = words.first[owner[row]] + place[row] // _PLACES + bit
                    np.add.at(depth, begin, 1)
                    np.add.at(depth, begin + width, -1)
                keep = np.cumsum(depth[:-1]) == 0
                kept = np.bincount(words.doc[keep], minlength=part.num_rows)
                # kept words with a space behind each
                size = (words.end - words.start)[keep]
                ends = np.cumsum(size + 1)
                joined = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
                joined[ranges(ends - size - 1, size)] = words.data[ranges(words.start[keep], size)]
                raw, edge = joined.tobytes(), np.append(0, ends)[np.append(0, np.cumsum(kept))]
                texts = [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:])]
                columns = [part.column(0), pa.array(words.count), pa.array(words.count - kept), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                if with_text:
                    columns.append(pa.array([t.decode() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return joined.mapInArrow(work, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).withColumnRenamed("id", "doc_id")
