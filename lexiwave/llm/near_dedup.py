"""Near-duplicate documents by DartMinHash over weighted word shingles.

An element of a document is a shingle of five words, its weight the number of times it occurs.
Similarity is weighted Jaccard: the sum of smaller weights by the sum of larger ones.

Signatures. Each element throws darts at a strip of the plane (weight up, rank along). Where they fall
depends on hashes of the element only: in a strip of weights they arrive at rank gaps that are
exponential in the strip's height. A document keeps the darts that fall under its elements' weights and
before a rank that leaves it a bounded number of darts whatever its length; each dart belongs to one of
``COORDINATES`` coordinates, and the earliest dart of each is the signature. A coordinate agrees between
two documents with a probability that equals their similarity. Documents with a coordinate left empty
look twice as far.

Search. Documents with equal words are one class from the start. Signatures of class representatives are
cut into bands; documents that share a band meet in its bucket. A pair with similarity s misses all
buckets with probability (1 - s^ROWS)^BANDS, 7e-6 at 0.8. Buckets with the same members are looked at
once. Within a bucket pairs that are not joined yet are compared exactly, on bit sets over the elements that
two members or more have; large buckets are cut into blocks. A task returns a spanning forest of the links
it found, so no pair ever becomes a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiwave.functions.shipping import ship
from lexiwave.llm.bytewords import RunHash, Words, chunks, mix, ranges, text_buffers
from lexiwave.llm.components import components
from lexiwave.functions.scratch import Scratch
from lexiwave.llm.skew import heavy_keys, spread_join

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * (np.log(COORDINATES) + 4)
#: texts of a bucket, or of a block of a larger one, compared in one task; bytes of their elements; bytes in a task
BLOCK, BLOCK_BYTES, TASK_BYTES = 1024, 16 << 20, 16 << 20
MOST_BITS = 1 << 26

_SALTS = mix(np.arange(101, 109, dtype=np.uint64))


def _times(salt: np.uint64, n: int) -> np.uint64:
    return np.uint64(int(salt) * n & 0xFFFFFFFFFFFFFFFF)


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight) of distinct elements sorted by text and element, and two hashes of each text's words.

    A text of fewer than ``width`` words, but some, has all of them as its one shingle.
    """
    words = Words(data, offsets)
    keys = words.keys()
    hashes = RunHash(keys)
    first, count = words.first[:-1], words.count
    whole = np.zeros((len(count), 2), np.uint64)
    for i in np.flatnonzero(count).tolist():
        whole[i] = np.frombuffer(hashlib.blake2b(keys[words.first[i] : words.first[i + 1]].tobytes(), digest_size=16).digest(), np.uint64)
    number = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(count)), number)
    begin = ranges(first, number)
    end = np.minimum(begin + width, words.first[1:][text])
    element = hashes(begin, end)
    order = np.lexsort((element, text))
    text, element = text[order], element[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (element[1:] != element[:-1])
    at = np.flatnonzero(new)
    return text[at], element[at], np.diff(np.append(at, len(text))), whole[:, 0], whole[:, 1]


def dart_signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, darts: float = DARTS) -> np.ndarray:
    """[texts, COORDINATES] hashes of the earliest darts; rows of texts without elements stay 0."""
    out = np.zeros((texts, COORDINATES), np.uint64)
    total = np.bincount(text, weight, texts)
    todo = total > 0
    reach = np.where(todo, darts / np.maximum(total, 1), 0.0)
    while todo.any():
        mine = todo[text]
        slots, ranks, values = _throw(text[mine], element[mine], weight[mine], reach)
        order = np.lexsort((ranks, slots))
        slots, values = slots[order], values[order]
        earliest = np.ones(len(slots), bool)
        earliest[1:] = slots[1:] != slots[:-1]
        slots, values = slots[earliest], values[earliest]
        full = np.bincount(slots // COORDINATES, minlength=texts) == COORDINATES
        done = full[slots // COORDINATES]
        out.reshape(-1)[slots[done]] = values[done]
        todo &= ~full
        reach = reach * 2
    return out


def _throw(text: np.ndarray, element: np.ndarray, weight: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text and coordinate, rank, hash) of all darts under the weights and within reach.

    Strips of weight are [0, 1), [1, 2), [2, 4), [4, 8) and so on.
    """
    slots, ranks, values = [], [], []
    low, height, strip, here = 0.0, 1.0, 0, np.arange(len(text))
    while len(here):
        own, rank = here, np.zeros(len(here))
        seed = mix(element[own] ^ _times(_SALTS[2], 2 * strip + 1))
        number = 0
        while len(own):
            dart = mix(seed + _times(_SALTS[3], number + 1))
            rank = rank - np.log(_unit(dart)) / height
            near = rank <= reach[text[own]]
            own, seed, rank, dart = own[near], seed[near], rank[near], dart[near]
            more = mix(dart ^ _SALTS[4])
            under = np.ones(len(own), bool) if height == 1 else low + height * _unit(mix(dart ^ _SALTS[5])) <= weight[own]
            slots.append((text[own] * COORDINATES + (more % np.uint64(COORDINATES)).astype(np.int64))[under])
            ranks.append(rank[under])
            values.append(more[under])
            number += 1
        low, height, strip = low + height, max(low + height, 1.0), strip + 1
        here = here[weight[here] > low]
    return np.concatenate(slots), np.concatenate(ranks), np.concatenate(values)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """[texts, BANDS] hashes of the bands' rows and the band's number."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(_SALTS[6] * np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys


def _sign(docs: DataFrame) -> DataFrame:
    """(id, a, b, n, bands) of (id, text): two hashes of the words, total weight, band keys."""
    schema = pa.schema([("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = text_buffers(part.column(1))
                text, element, weight, a, b = shingle_sets(data, offsets)
                n = np.bincount(text, weight, part.num_rows).astype(np.int64)
                signatures = dart_signatures(text, element, weight, part.num_rows)
                bands = band_keys(signatures)
                rows = np.where(n > 0, BANDS, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rows)), pa.int32()), pa.array(bands[n > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n), bands], schema=schema,
                )

    return docs.mapInArrow(work, "id long, a long, b long, n long, bands array<long>")


def _items(docs: DataFrame) -> DataFrame:
    """(id, items) of (id, a, b, text): sorted 64-bit hashes of elements, one for each unit of weight.

    Rows whose text has other word hashes than a and b are left out.
    """
    schema = pa.schema([("id", pa.int64()), ("items", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                text, element, weight, a, b = shingle_sets(*text_buffers(part.column(3)))
                same = (a.view(np.int64) == np.asarray(part.column(1))) & (b.view(np.int64) == np.asarray(part.column(2)))
                units = mix(np.repeat(element, weight) + ranges(np.zeros(len(weight), np.int64), weight).astype(np.uint64) * _SALTS[7])
                owner = np.repeat(text, weight)
                order = np.lexsort((units, owner))
                units, n = units[order], np.bincount(owner, minlength=part.num_rows)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(pa.array(same)), pa.array([units[e - k : e].tobytes() for e, k in zip(ends[same], n[same])], pa.binary())], schema=schema,
                )

    return docs.mapInArrow(work, "id long, items binary")


class Overlaps:
    """Numbers of common elements of sets that are cut from ``units`` by ``sizes``.

    Only elements of two sets or more matter. Each set's are bits; where that would take more than
    ``MOST_BITS``, the sets of each element are listed instead.
    """

    def __init__(self, sizes: np.ndarray, units: np.ndarray):
        self._m = m = len(sizes)
        owner = np.repeat(np.arange(m), sizes)
        _, which, count = np.unique(units, return_inverse=True, return_counts=True)
        mine = (count > 1)[which]
        number = (np.cumsum(count > 1) - 1)[which[mine]]
        owner, shared = owner[mine], int((count > 1).sum())
        self._bits = None
        if m * shared <= MOST_BITS:
            bits = np.zeros((m, max(64, -(-shared // 64) * 64)), bool)
            bits[owner, number] = True
            self._bits = np.packbits(bits, axis=1).view(np.uint64)
        else:
            self._number, self._first = number, np.searchsorted(owner, np.arange(m + 1))
            self._lists, self._count = owner[np.argsort(number, kind="stable")], count[count > 1]
            self._start = np.cumsum(self._count) - self._count

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        if self._bits is not None:
            return np.bitwise_count(self._bits[others] & self._bits[x]).sum(axis=1, dtype=np.int64)
        own = self._number[self._first[x] : self._first[x + 1]]
        return np.bincount(self._lists[ranges(self._start[own], self._count[own])], minlength=self._m)[others]


def forest(sizes: np.ndarray, units: np.ndarray, least: float, asks: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (x, y) that join the sets which are similar enough, one between parts not joined before.

    Sets that ask are compared with all others. Sets with one ``label`` are joined already, and those that
    an edge joins get one, so pairs that could tell nothing new are passed over: in a bucket whose texts
    belong together the work grows with their number, not its square.
    """
    label, overlaps = label.copy(), Overlaps(sizes, units)
    place, found_x, found_y = np.arange(len(sizes)), [], []
    for x in np.flatnonzero(asks).tolist():
        n = sizes[x]
        near = np.flatnonzero((label != label[x]) & ((place > x) | ~asks) & (np.minimum(n, sizes) >= least * np.maximum(n, sizes) - 1e-9))
        if len(near):
            common = overlaps.common(x, near)
            near = near[common >= least * (n + sizes[near] - common) - 1e-9]
            parts, first = np.unique(label[near], return_index=True)
            if len(parts):
                found_x.append(np.full(len(parts), x))
                found_y.append(near[first])
                label[np.isin(label, parts)] = label[x]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_x]), np.concatenate([none, *found_y])


def _links(members: DataFrame, least: float) -> DataFrame:
    """(x, y): the edges of each task's forests, of (task, part, turn, bucket, asks, label, id, items)."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def work(key, table):
        bucket, ids, label, asks = (np.asarray(table.column(c)) for c in ("bucket", "id", "label", "asks"))
        items = table.column("items").to_pylist()
        order = np.lexsort((ids, bucket))
        edges = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(order))
        xs, ys = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            own = order[a:b]
            sets = [np.frombuffer(items[i], np.uint64) for i in own]
            x, y = forest(np.array([len(s) for s in sets]), np.concatenate(sets), least, asks[own], label[own])
            xs.append(ids[own[x]])
            ys.append(ids[own[y]])
        return pa.table([np.concatenate(xs), np.concatenate(ys)], schema=schema)

    return members.groupBy("task", "part", "turn").applyInArrow(work, "x long, y long")


def _compare(members: DataFrame, items: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Links (x, y) of (bucket, blocks, block, bytes, id): a spanning forest of all pairs in a bucket that are similar enough.

    Buckets of one block are compared whole, many to a task. A larger bucket takes two turns. First each of
    its blocks is compared within itself and with block 0; that joins whatever belongs to the bucket's large
    parts. Then the texts outside its largest part are compared with all that they are not joined to. Both
    turns send a block or the rest to each task, so a bucket of one large part costs what its texts cost.
    """
    asks, zero = F.lit(True).alias("asks"), F.lit(0)
    small, large = members.where("blocks = 1"), members.where("blocks > 1")
    bytes_ = small.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(1, -(-int(bytes_) // TASK_BYTES))
    dealt = small.select(F.pmod(F.xxhash64("bucket"), F.lit(tasks)).alias("task"), zero.alias("part"), zero.alias("turn"), "bucket", asks, F.col("id").alias("label"), "id")
    own = large.select(F.col("bucket").alias("task"), F.col("block").alias("part"), F.lit(1).alias("turn"), "bucket", asks, F.col("id").alias("label"), "id")
    pivots = large.where("block = 0").select(
        F.col("bucket").alias("task"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("part"), F.lit(1).alias("turn"), "bucket",
        F.lit(False).alias("asks"), F.col("id").alias("label"), "id")
    first = scratch.save(_links(dealt.unionByName(own).unionByName(pivots).join(items.hint("merge"), "id"), least), "links")
    if not large.limit(1).count():
        return first
    # parts of large buckets so far; any link within one will do
    ids = large.select("id").distinct()
    inner = first.join(ids.withColumnRenamed("id", "x"), "x").join(ids.withColumnRenamed("id", "y"), "y").select("x", "y")
    of = components(inner, scratch, "parts-").select(F.col("node").alias("id"), "component")
    placed = scratch.save(large.join(of, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"), "placed")
    sizes = placed.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(
        F.max(F.struct("n", F.col("label").alias("main"))).alias("top"), F.sum("n").alias("all"))
    rest = sizes.select("bucket", "top.main", F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("rests")).where("rests > 0")
    # as many rows as there are large buckets with a rest, each of a thousand texts or a block's bytes
    open_ = scratch.save(placed.join(rest, "bucket"), "open")
    if not open_.limit(1).count():
        return first
    outside = F.col("label") != F.col("main")
    rest_no = F.pmod(F.xxhash64("id", F.lit(7)), F.col("rests")).cast("int")
    turn = lambda r, b: (r * F.col("blocks") + b + 2).alias("turn")
    asking = open_.where(outside).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.col("bucket").alias("task"), F.col("b").alias("part"), turn(rest_no, F.col("b")), "bucket", asks, "label", "id")
    others = open_.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).where(~outside | (rest_no != F.col("r"))).select(
        F.col("bucket").alias("task"), F.col("block").alias("part"), turn(F.col("r"), F.col("block")), "bucket", F.lit(False).alias("asks"), "label", "id")
    second = _links(asking.unionByName(others).join(items.hint("merge"), "id"), least)
    return first.unionByName(scratch.save(second, "links2"))


def _search(docs: DataFrame, id_col: str, text_col: str, least: float, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (id, a, b, n, bands), different texts (t, a, b, low) of rows with an id and a word, links (x, y) of texts, and the heavy (a, b).

    A text is known by its word hashes a and b or its number t, so rows that share an id do not mix their texts;
    ``low`` is its smallest id.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.save(_sign(plain), "signed")
    classes = signed.where("n > 0 and id is not null").groupBy("a", "b").agg(
        F.min("id").alias("low"), F.max("n").alias("n"), F.count("*").alias("rows"), F.first("bands").alias("bands"))
    classes = scratch.save(classes.withColumn("t", F.monotonically_increasing_id()), "texts")
    met = scratch.save(classes.select(F.col("t").alias("id"), "n", F.explode("bands").alias("bucket")), "met")
    part = lambda seed: F.sum(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 31)))
    buckets = met.groupBy("bucket").agg(
        F.count("*").alias("m"), part(1).alias("who"), part(2).alias("too"), F.min("id").alias("low"), F.sum(8 * F.col("n")).alias("all")).where("m > 1")
    once = buckets.groupBy("m", "who", "too", "low", "all").agg(F.min("bucket").alias("bucket"))
    once = scratch.save(once.select("bucket", "m", F.ceil(F.greatest(F.col("m") / block, F.col("all") / BLOCK_BYTES)).cast("int").alias("blocks")), "buckets")
    members = spread_join(met, once, ["bucket"], heavy_keys(once, ["bucket"], "m"), F.col("id")).select(
        "bucket", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), (8 * F.col("n")).alias("bytes"), "id")
    members = scratch.save(members, "members")
    scratch.drop("met")
    # the words of each text, from any row with its smallest id that holds them. The ids grow with the
    # input, so they are merged at every size and never broadcast.
    wanted = classes.select("t", "a", "b", "low").join(members.select(F.col("id").alias("t")).distinct().hint("merge"), "t")
    texts = plain.join(wanted.hint("merge"), F.col("id") == F.col("low")).select("t", "a", "b", "text")
    items = _items(texts)
    if signed.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count():
        items = items.groupBy("id").agg(F.max("items").alias("items"))
    items = scratch.save(items, "items")
    links = _compare(members, items, least, scratch)
    return signed, classes.select("t", "a", "b", "low"), links, heavy_keys(classes, ["a", "b"], "rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(id, class_id, kept) of every row: its class's smallest id, and whether it is that one.

    Classes are the components of documents linked by a similarity of ``least`` or more. Words are runs
    of characters other than space and U+0009 to U+000D, unchanged. Null texts and texts without a word
    link with nothing. Rows that share an id are one document and so in one class, linked by any of its
    texts. Rows with a null id are kept with a null class and link nothing. A similarity of exactly ``least``
    links; a class is named by its smallest id, so ties cannot matter. A very long text is compared whole, by
    all its elements. An empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near_dedup")
    signed, texts, links, heavy = _search(docs, id_col, text_col, least, block, scratch)
    shared = _shared_ids(signed)
    if shared:
        own = spread_join(signed.where("n > 0 and id is not null"), texts, ["a", "b"], heavy, F.col("id")).select("id", "t").distinct()
        links = links.unionByName(own.join(own.groupBy("id").agg(F.min("t").alias("y")), "id").where("t != y").select(F.col("t").alias("x"), "y"))
    of = components(links, scratch, "near-").withColumnRenamed("node", "t")
    lowest = of.join(texts.select("t", "low"), "t").groupBy("component").agg(F.min("low").alias("lowest"))
    classes = texts.join(of.join(lowest, "component").select("t", "lowest"), "t", "left").select("a", "b", F.coalesce("lowest", "low").alias("class"))
    named = (
        spread_join(signed.select("id", "a", "b", "n"), classes, ["a", "b"], heavy, F.col("id"), "left")
        .withColumn("class_id", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("class")).otherwise(F.col("id")))
    )
    if shared:  # a row without a word goes with the other rows of its id
        worded = named.where("n > 0 and id is not null").groupBy("id").agg(F.min("class_id").alias("worded"))
        named = named.join(worded, "id", "left").withColumn("class_id", F.coalesce("worded", "class_id"))
    return named.select("id", "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def _shared_ids(signed: DataFrame) -> bool:
    """Whether some id stands for different texts."""
    text = F.struct("a", "b")
    return signed.where("id is not null").groupBy("id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("lo != hi").limit(1).count() > 0


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "class_id", "kept")


def _hashed(rows: DataFrame) -> DataFrame:
    """(row, id, a, b) of (row, id, text): the two hashes of each text's words."""
    schema = rows.select("row", "id", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                *_, a, b = shingle_sets(*text_buffers(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["row", "id", "a", "b"])

    return rows.mapInArrow(work, schema)


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicate texts stays: the one with the smallest id, then hashes of words, then columns.

    Rows that share an id are rows of their own: each goes only if its text is in the class of a row that
    stays. Of rows with the same id and no word (null, empty and blank texts) one stays. All rows with a null
    id stay. Columns stay as they were, whatever their names; very long texts are compared whole; an empty table
    stays empty.
    """
    columns = [F.col("row")[c].alias(c) for c in docs.columns]
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    if rows.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count() == 0:
        # each id is one row, so ids name the rows that stay
        marked = near_duplicates(docs).where("kept and id is not null").select(F.col("id").alias("kept_id"))
        stay = rows.select("row", "id").join(marked, F.col("id") == F.col("kept_id"))
        return stay.select(*columns).unionByName(rows.where("id is null").select(*columns))
    ship(spark)
    scratch = Scratch(spark, "near_dedup_stage")
    signed, texts, links, _ = _search(docs, "doc_id", "text", SIMILARITY, BLOCK, scratch)
    of = components(links, scratch, "near-").withColumnRenamed("node", "t")
    first = texts.join(of, "t", "left").groupBy(F.coalesce("component", "t")).agg(F.min(F.struct("low", "a", "b")).alias("first")).select("first.*")
    keys = first.unionByName(signed.where("n = 0 and id is not null").select(F.col("id").alias("low"), "a", "b").distinct())
    stay = _hashed(rows).join(keys.withColumnRenamed("low", "id"), ["id", "a", "b"])
    by = Window.partitionBy("id", "a", "b").orderBy(F.to_json("row"))
    stay = stay.withColumn("place", F.row_number().over(by)).where("place = 1")
    return stay.select(*columns).unionByName(rows.where("id is null").select(*columns))
