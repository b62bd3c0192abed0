"""Embedding near-dedup with a product-quantised inverted index.

Vectors are scaled to length one, so a cosine of c is a distance of sqrt(2 - 2c). A coarse quantiser deals
them into lists; within a list the residual from the list's centre is coded one byte a subspace, and how far
the code's vector is from the true one is kept. A query reads its distances to all codes of a list from
tables (asymmetric: the query is not coded). Bounds are exact, not chosen for average recall:

* a list is probed unless the query is farther than the radius from the plane between its own centre and
  the list's, in which case no vector of the list can be within the radius;
* a coded vector is passed over only if its table distance exceeds radius + its coding error, which by the
  triangle inequality puts the vector itself out of reach.

What is left is compared by exact cosine in double precision, so no link is lost or made up. The quantisers
are fitted on a bounded sample; they decide how much is skipped and not what is found.

Equal vectors of a label are one entry with a weight. Two lists are compared once, by sending vectors of the
one with the lesser number to the other, in the precision they came in. A list that holds many vectors
is cut by centres of its own, fitted by executors on a sample of it, and what comes to the list is dealt
over its parts by the same bound: the half-plane argument needs no more than that a member lies with its
nearest centre. Parts are cut into blocks of ``BLOCK`` members, each a task or several, and a task returns
counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lexiwave.functions.shipping import ship
from lexiwave.llm.components import components, smallest
from lexiwave.llm.sampling import smallest_hashes
from lexiwave.llm.skew import heavy_keys, spread_join
from lexiwave.functions.scratch import Scratch, small

COSINE = 0.98
#: rows a quantiser is fitted on, four a list at least; vectors a list is meant to hold
SAMPLE, LIST = 20_000, 4096
SUBSPACES, CODES = 8, 64
#: members of a list in a task, and vectors from elsewhere that ask them
BLOCK, ASKING = 4096, 32_768
#: a list of more than ``SPLIT`` blocks is cut into parts of about a block each, ``PARTS`` at most, fitted on four vectors a part
SPLIT, PARTS = 4, 1024


def _centres(points: np.ndarray, k: int, turns: int, seed: int) -> np.ndarray:
    """Lloyd's k-means from random distinct rows; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    centre = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(turns):
        near = nearest(points, centre)
        size = np.bincount(near, minlength=len(centre))
        sums = np.zeros_like(centre)
        np.add.at(sums, near, points)
        centre[size > 0] = sums[size > 0] / size[size > 0, None]
    return centre


def _squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.maximum((points * points).sum(1)[:, None] - 2 * points @ centre.T + (centre * centre).sum(1)[None, :], 0)


def nearest(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.concatenate([_squared(points[i : i + 4096], centre).argmin(1) for i in range(0, len(points), 4096)] or [np.zeros(0, int)])


def _reach(x: np.ndarray, centre: np.ndarray, apart: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The nearest centre of each row, and all centres that can be nearest to something within ``radius`` of it."""
    own, probes = np.empty(len(x), np.int64), []
    for i in range(0, len(x), 1024):
        far = _squared(x[i : i + 1024], centre)
        mine = far.argmin(1)
        own[i : i + 1024] = mine
        least = far[np.arange(len(mine)), mine]
        plane = (far - least[:, None]) / (2 * np.maximum(apart[mine], 1e-12))
        for row, m in zip(plane <= radius + 1e-9, mine):
            row[m] = True
            probes.append(np.flatnonzero(row))
    return own, probes


@dataclass
class Quantiser:
    """Coarse centres [lists, d] and, a subspace each, codewords of residuals."""

    centre: np.ndarray
    cuts: list[slice]
    words: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 11) -> "Quantiser":
        d = sample.shape[1]
        edges = np.linspace(0, d, min(subspaces, d) + 1).astype(int)
        out = cls(_centres(sample, lists, 8, seed), [slice(a, b) for a, b in zip(edges, edges[1:])])
        rest = sample - out.centre[nearest(sample, out.centre)]
        out.words = [_centres(rest[:, s], codes, 6, seed + i) for i, s in enumerate(out.cuts)]
        return out

    @cached_property
    def apart(self) -> np.ndarray:
        return np.sqrt(_squared(self.centre, self.centre))

    def index(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """(list, lists to probe, codes, coding error) of vectors of length one."""
        own, probes = _reach(x, self.centre, self.apart, radius)
        rest = x - self.centre[own]
        codes = np.stack([nearest(rest[:, s], w) for s, w in zip(self.cuts, self.words)], axis=1).astype(np.uint8)
        made = np.concatenate([w[codes[:, j]] for j, w in enumerate(self.words)], axis=1)
        return own, probes, codes, np.linalg.norm(rest - made, axis=1)

    def distances(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """[queries, codes] distances from the queries to coded vectors of a list, by table look-up."""
        rest = queries - self.centre[cell]
        total = np.zeros((len(queries), len(codes)))
        for j, (s, w) in enumerate(zip(self.cuts, self.words)):
            total += _squared(rest[:, s], w)[:, codes[:, j]]
        return np.sqrt(total)


def _units(raw: list[bytes], d: int, kind: str) -> np.ndarray:
    """Vectors of length one, in double precision, from the bytes of the given ones."""
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, d).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fitted(classes: DataFrame, radius_lists: int, kind: str) -> dict[int, Quantiser]:
    """A quantiser a number of components, fitted on at most ``SAMPLE`` of its vectors."""
    sizes = classes.groupBy("label", "d").agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()
    out = {}
    for r in sizes:
        some = smallest_hashes(classes.where(F.col("d") == r.d), "k", SAMPLE).select("raw").collect()
        sample = _units([bytes(x.raw) for x in some], r.d, kind)
        out[r.d] = Quantiser.fit(sample, max(1, min(len(sample) // 4, -(-r.n // radius_lists))))
    return out


def _cut(arrived: DataFrame, at_list: list[str], scratch: Scratch, kind: str, radius: float, block: int, asking: int) -> DataFrame:
    """What arrives at lists, with the part it belongs to and the parts it asks (``later``).

    Members of a list ask the parts behind their own, vectors from other lists all parts within reach. Lists
    of up to ``SPLIT`` blocks are one part. A large list's sample and centres are one task's, and bounded;
    what is dealt over its parts is not, and goes to tasks of about ``asking`` rows.
    """
    none = F.array().cast("array<int>")
    whole = lambda df: df.withColumns({"part": F.lit(0), "later": F.when(F.col("asks"), F.array(F.lit(0))).otherwise(none)})
    members = arrived.where("not asks").groupBy(*at_list).agg(F.count("*").alias("members")).where(F.col("members") > SPLIT * block)
    large = scratch.save(members.withColumn("parts", F.least(F.ceil(F.col("members") / block), F.lit(PARTS)).cast("int")), "large")
    if not large.limit(1).count():
        return whole(arrived)
    few = small(large)
    some = arrived.where("not asks").join(few, at_list).where(F.pmod(F.xxhash64("k", "t", F.lit(3)), "members") < 4 * F.col("parts"))
    types = dict(arrived.dtypes)
    keys = ", ".join(f"{c} {types[c]}" for c in at_list)

    def fit(key, table):
        sample = _units(table.column("raw").to_pylist(), key[1].as_py(), kind)
        made = _centres(sample, table.column("parts")[0].as_py(), 8, 17).tobytes()
        return pa.table([*[table.column(c).slice(0, 1) for c in at_list], pa.array([made], pa.binary())], names=[*at_list, "centres"])

    centres = some.select(*at_list, "parts", "raw").groupBy(*at_list).applyInArrow(fit, f"{keys}, centres binary")
    slots = arrived.join(few.select(*at_list), at_list).groupBy(*at_list).agg(F.ceil(F.count("*") / asking).cast("int").alias("slots"))
    slots = scratch.save(slots, "slots")
    sent = centres.join(small(slots), at_list).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    dealt = arrived.join(small(slots), at_list).withColumn("slot", F.pmod(F.xxhash64("k", "t", F.lit(4)), "slots").cast("int")).drop("slots")
    names = arrived.columns

    def deal(key, table):
        d, given = key[1].as_py(), table.column("centres").drop_null()
        centre = np.frombuffer(given[0].as_py()).reshape(-1, d) if len(given) else np.zeros((1, d))
        rows = table.filter(table.column("centres").is_null()).select(names)
        own, probes = _reach(_units(rows.column("raw").to_pylist(), d, kind), centre, np.sqrt(_squared(centre, centre)), radius)
        later = [p if asks else p[p > o] for p, o, asks in zip(probes, own, rows.column("asks").to_pylist())]
        return rows.append_column("part", pa.array(own, pa.int32())).append_column("later", pa.array([p.astype(np.int32) for p in later], pa.list_(pa.int32())))

    shape = ", ".join(f"{c} {t}" for c, t in arrived.dtypes)
    cut = dealt.unionByName(sent, allowMissingColumns=True).groupBy(*at_list, "slot").applyInArrow(deal, f"{shape}, part int, later array<int>")
    return whole(arrived.join(few.select(*at_list), at_list, "left_anti")).unionByName(scratch.save(cut, "cut"))


def link_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = COSINE, block: int = BLOCK, lists: int = LIST, asking: int = ASKING,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Two rows link when their labels and numbers of components are equal and their cosine is ``least`` or
    more. Null vectors or labels, null ids, null or non-finite components and vectors of zeros link with
    nothing: n_links 0, component their own id, kept. Equal vectors link. Rows that share an id count as
    rows in n_links and have one component. A cosine of exactly ``least`` links. An empty table gives an empty
    result; other columns, texts among them, are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "embedding_dedup")
    single = isinstance(vectors.schema[vec_col].dataType.elementType, FloatType)
    kind, part = ("<f4", "float") if single else ("<f8", "double")
    v = F.transform(F.col(vec_col), lambda x: x.cast(part))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    fine = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    # a label and vector are known by two hashes
    rows = rows.withColumns({"fine": F.coalesce(fine, F.lit(False)), "k": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit("again"), "v", "label")})
    keys = scratch.save(rows.where("fine").select("id", "k", "k2"), "keys")
    kinds = keys.groupBy("k", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.count(F.lit(1)).alias("rows"))
    kinds = scratch.save(kinds.withColumn("t", F.monotonically_increasing_id()), "kinds")
    heavy = heavy_keys(kinds, ["k", "k2"], "rows")
    # of each different vector one row goes on: one with the least id
    first = spread_join(rows.where("fine"), kinds.select("k", "k2", "rep", "weight", "t"), ["k", "k2"], heavy, F.col("id")).where("id = rep")
    if keys.groupBy("k", "k2", "id").count().where("count > 1").limit(1).count():
        first = first.dropDuplicates(["t"])
    label_type = vectors.schema[label_col].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            column = batch.column(4)
            offsets = np.asarray(column.offsets)
            flat = np.asarray(column.values).astype(kind, copy=False)
            raw = [flat[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            sizes = pa.array(np.diff(offsets), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), sizes, pa.array(raw, pa.binary())], names=["label", "t", "rep", "weight", "k", "d", "raw"])

    classes = scratch.save(
        first.select("label", "t", "rep", "weight", "v", "k").mapInArrow(pack, f"label {label_type}, t long, rep long, weight long, k long, d int, raw binary"), "classes")
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    shared = spark.sparkContext.broadcast(_fitted(classes, lists, kind))

    def index(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(5))
            for d in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == d))
                cell, probes, codes, error = shared.value[d].index(_units(own.column(6).to_pylist(), d, kind), radius)
                # a pair of lists is looked at from the one with the lesser number
                later = [p[p > c].astype(np.int32) for p, c in zip(probes, cell)]
                made = [pa.array(cell, pa.int32()), pa.array(later, pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
                yield pa.RecordBatch.from_arrays([*own.columns, *made], names=[*own.schema.names, "cell", "later", "codes", "error"])

    indexed = scratch.save(classes.mapInArrow(
        index, f"label {label_type}, t long, rep long, weight long, k long, d int, raw binary, cell int, later array<int>, codes binary, error double"), "indexed")
    scratch.drop("classes")
    both, none = ["rep", "weight", "t", "raw"], {"codes": F.lit(None).cast("binary"), "error": F.lit(None).cast("double")}
    come = indexed.withColumns({"cell": F.explode("later"), "asks": F.lit(True), **none}).drop("later")
    entered = _cut(indexed.withColumn("asks", F.lit(False)).drop("later").unionByName(come), ["label", "d", "cell"], scratch, kind, radius, block, asking)
    at_list = ["label", "d", "cell", "part"]
    in_list = entered.where("not asks").groupBy(*at_list).agg(F.count("*").alias("members"))
    asked = entered.withColumn("part", F.explode("later")).groupBy(*at_list).agg(F.count("*").alias("askers"))
    mb = F.ceil(F.col("members") / block)
    sizes = in_list.join(asked, at_list, "left").select(
        *at_list, mb.cast("int").alias("mb"), F.ceil((F.coalesce("askers", F.lit(0)) + F.col("members") * (mb - 1) + 1) / asking).cast("int").alias("qb"))
    sizes = small(scratch.save(sizes, "sizes"), 100_000)
    slot = lambda n, seed: F.pmod(F.xxhash64("k", "t", F.lit(seed)), F.col(n)).cast("int")
    placed_ = entered.where("not asks").join(sizes, at_list).withColumn("own", slot("mb", 1))
    members = placed_.select(*at_list, F.col("own").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(False).alias("asks"), *both, "codes", "error")
    none = [c.alias(n) for n, c in none.items()]
    # a part's later blocks ask its earlier ones, and other parts and lists ask all of its blocks
    within = placed_.where("own > 0").withColumn("m", F.explode(F.sequence(F.lit(0), F.col("own") - 1))).select(*at_list, "m", slot("qb", 2).alias("q"), F.lit(True).alias("asks"), *both, *none)
    across = entered.withColumn("part", F.explode("later")).join(sizes, at_list).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).select(
        *at_list, "m", slot("qb", 2).alias("q"), F.lit(True).alias("asks"), *both, *none)
    out_schema = pa.schema([(c, pa.int64()) for c in ("t", "n", "rep", "tie")])

    def compare(key, table):
        d, cell, first_turn = key[1].as_py(), key[2].as_py(), key[5].as_py() == 0
        asks = np.asarray(table.column("asks"))
        ids, weight, t = (np.asarray(table.column(c)) for c in ("rep", "weight", "t"))
        m, q = np.flatnonzero(~asks), np.flatnonzero(asks)
        if not len(m):
            return out_schema.empty_table()
        quantiser, unit = shared.value[d], _units(table.column("raw").to_pylist(), d, kind)
        codes = np.frombuffer(b"".join(table.column("codes").take(pa.array(m)).to_pylist()), np.uint8).reshape(len(m), -1)
        reach = radius + np.asarray(table.column("error").take(pa.array(m))) + 1e-9
        links, ends = np.zeros(len(ids), np.int64), ([], [])
        # members are compared with each other once, by the task of the first askers
        for own, inner in [(q[i : i + 256], False) for i in range(0, len(q), 256)] + [(m[i : i + 256], True) for i in range(0, len(m) if first_turn else 0, 256)]:
            near = quantiser.distances(unit[own], cell, codes) <= reach[None, :]
            if inner:
                near &= own[:, None] < m[None, :]
            r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if len(r):
                good = (unit[own[r]] @ unit[m[c]].T >= least) & near[np.ix_(r, c)]
                links[own[r]] += good @ weight[m[c]]
                links[m[c]] += weight[own[r]] @ good
                a, b = np.nonzero(good)
                if len(a):  # a forest of this block's links
                    nodes, at = np.unique(np.concatenate([own[r[a]], m[c[b]]]), return_inverse=True)
                    root = smallest(len(nodes), at[: len(a)], at[len(a) :])
                    ends[0].append(nodes[root != np.arange(len(nodes))])
                    ends[1].append(nodes[root[root != np.arange(len(nodes))]])
        a, b = (np.concatenate(e) if e else np.zeros(0, int) for e in ends)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), int)
        place[order] = np.arange(len(ids))
        tie = ids[order[smallest(len(ids), place[a], place[b])[place]]]
        found, tied = np.flatnonzero(links > 0), np.flatnonzero(tie != ids)
        zero = np.zeros(len(tied), np.int64)
        return pa.table([np.concatenate(x) for x in ((t[found], zero), (links[found], zero), (ids[found], ids[tied]), (ids[found], tie[tied]))], schema=out_schema)

    found = scratch.save(
        members.unionByName(within).unionByName(across).groupBy(*at_list, "m", "q").applyInArrow(compare, "t long, n long, rep long, tie long"), "found",
    )
    counts = found.where("n > 0").groupBy("t").agg(F.sum("n").alias("n"))
    edges = found.where("rep != tie").select("rep", "tie")
    counted = kinds.join(counts, "t", "left").select("k", "k2", "rep", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"))
    placed = scratch.save(spread_join(keys, counted, ["k", "k2"], heavy, F.col("id")).select("id", "rep", "n_links"), "placed")
    same = placed.where("id != rep").select(F.col("id").alias("rep"), F.col("rep").alias("tie"))
    of = components(edges.unionByName(same), scratch, "near-")
    known = placed.join(of, F.col("node") == F.col("id"), "left").select("id", "n_links", F.coalesce("component", "id").alias("component_id"))
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return link_vectors(vectors).withColumnRenamed("id", "vec_id")
