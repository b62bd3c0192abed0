"""Ordered series to cepstral coefficients: pre-emphasis, frames, power and mel spectra, cosine transform.

Each step exists as a column expression over arrays, and ``mfcc`` runs them all in numpy for real frame
sizes. There an utterance is one row's array of samples, a recording of bounded length; ``long_frames`` and
``long_mfcc`` take recordings of any length, a row a sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiwave.functions.scratch import Scratch
from lexiwave.functions.shipping import ship
from lexiwave.operators import segments

EPSILON = float(np.finfo(float).eps)


def series(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, samples): the values of a key in order, nulls left out."""
    item = F.struct(*order, F.col(value).cast("double").alias("__x"))
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("s")).select(key, F.transform("s", lambda s: s["__x"]).alias("samples"))


def pre_emphasis(samples: Column, k: float = 0.95) -> Column:
    """Each sample less k times the one before; the first stays."""
    return F.transform(samples, lambda x, i: x - F.when(i > 0, k * F.element_at(samples, F.greatest(i, F.lit(1)))).otherwise(0.0))


def frame_count(size: Column, length: int, step: int) -> Column:
    """Full frames among all but the last sample, and one padded frame behind them; none without samples."""
    if length < 1 or not 1 <= step <= length:
        raise ValueError("a frame has 1 sample or more and steps on by 1 to its length")
    full = F.when(size - 1 >= length, F.floor((size - 1 - length) / step) + 1).otherwise(0)
    return F.when(size > 0, full + 1).otherwise(0).cast("int")


def hamming(length: int, k: float = 0.46) -> list[float]:
    return [1 - k - k * math.cos(2 * math.pi * i / (length - 1)) if length > 1 else 1 - 2 * k for i in range(length)]


def frames(df: DataFrame, key: str, samples: Column, length: int, step: int, k: float = 0.46) -> DataFrame:
    """(key, frame_no, frame): overlapping frames under a Hamming window, the last one padded with zeros.

    The last sample is in no frame. Slices are cut before the explode, so no row carries the samples.
    """
    window = F.array(*map(F.lit, hamming(length, k)))
    s = F.slice(F.col("s"), 1, F.greatest(F.size("s") - 1, F.lit(0)))
    one = lambda i: F.transform(
        F.arrays_zip(F.slice(F.concat(s, F.array_repeat(F.lit(0.0), length)), i * step + 1, length).alias("x"), window.alias("w")), lambda z: z["x"] * z["w"])
    number = frame_count(F.size("s"), length, step)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(number - 1, F.lit(0))), one)
    cut = F.when(number > 0, cut).otherwise(F.expr("cast(array() as array<array<double>>)"))
    return df.select(key, samples.alias("s")).select(key, F.posexplode(cut).alias("frame_no", "frame"))


def power_spectrum(frame: Column, size: int) -> Column:
    """|DFT|^2 / size of a frame cut or padded to ``size``, bins 0 to size / 2."""
    def part(values: list[float]) -> Column:
        return F.aggregate(F.arrays_zip(frame.alias("x"), F.array(*map(F.lit, values)).alias("c")), F.lit(0.0), lambda s, z: s + F.coalesce(z["x"] * z["c"], F.lit(0.0)))

    def power(b: int) -> Column:
        angle = [2 * math.pi * b * i / size for i in range(size)]
        re, im = part([math.cos(a) for a in angle]), part([math.sin(a) for a in angle])
        return (re * re + im * im) / size

    return F.array(*[power(b) for b in range(size // 2 + 1)])


def hz_to_mel(hz):
    return 2595 * np.log10(1 + np.asarray(hz) / 700)


def mel_to_hz(mel):
    return 700 * (10 ** (np.asarray(mel) / 2595) - 1)


def mel_filterbank(size: int, rate: int, banks: int = 40, low: float = 0, high: float | None = None) -> np.ndarray:
    """[banks, size / 2 + 1] triangles between neighbouring bins that are even on the mel scale."""
    edges = mel_to_hz(np.linspace(hz_to_mel(low), hz_to_mel(high or rate // 2), banks + 2))
    left, mid, right = (np.floor((size + 1) * edges / rate).astype(int)[i : i + banks, None] for i in range(3))
    k = np.arange(size // 2 + 1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        rise, fall = (k - left) / (mid - left), (right - k) / (right - mid)
    return np.where((k >= left) & (k < mid), rise, np.where((k >= mid) & (k < right), fall, 0.0))


def log_mel(power: Column, bank: np.ndarray) -> Column:
    """Natural log of each bank's energy; 0 counts as the machine epsilon."""
    def energy(weights: np.ndarray) -> Column:
        total = F.lit(0.0)
        for i in np.flatnonzero(weights).tolist():
            total = total + F.element_at(power, i + 1) * float(weights[i])
        return F.ln(F.when(total == 0, EPSILON).otherwise(total))

    return F.array(*[energy(w) for w in bank])


def dct_matrix(size: int, coefficients: int) -> np.ndarray:
    """Rows 1 to ``coefficients`` of the orthonormal DCT-II."""
    k, i = np.arange(1, coefficients + 1)[:, None], np.arange(size)[None, :]
    return np.sqrt(2 / size) * np.cos(np.pi * k * (2 * i + 1) / (2 * size))


def dct(values: Column, size: int, coefficients: int = 13) -> Column:
    def one(row: np.ndarray) -> Column:
        total = F.lit(0.0)
        for i, w in enumerate(row.tolist()):
            total = total + F.element_at(values, i + 1) * w
        return total

    return F.array(*[one(r) for r in dct_matrix(size, coefficients)])


def _features(cut: np.ndarray, rate: int, banks: int, coefficients: int, size: int) -> np.ndarray:
    """[frames, coefficients] of windowed frames."""
    power = np.abs(np.fft.rfft(cut, size)) ** 2 / size
    energy = power @ mel_filterbank(size, rate, banks).T
    return np.log(np.where(energy == 0, EPSILON, energy)) @ dct_matrix(banks, coefficients).T


def mfcc_array(samples: np.ndarray, rate: int, k: float = 0.95, length_s: float = 0.025, step_s: float = 0.01, window_k: float = 0.46, banks: int = 40, coefficients: int = 13, size: int = 512) -> np.ndarray:
    """[frames, coefficients] of one utterance."""
    x = np.asarray(samples, np.float64)
    length, step = int(length_s * rate), max(1, int(step_s * rate))
    if not len(x):
        return np.zeros((0, coefficients))
    y = x.copy()
    y[1:] -= k * x[:-1]
    y = y[:-1]
    number = (len(y) - length) // step + 1 if len(y) >= length else 0
    padded = np.concatenate([y, np.zeros(number * step + length)])
    cut = padded[(np.arange(number + 1) * step)[:, None] + np.arange(length)[None, :]] * np.array(hamming(length, window_k))
    return _features(cut, rate, banks, coefficients, size)


def mfcc(recordings: DataFrame, **settings) -> DataFrame:
    """(path, frame_no, features) of (path, sample_rate, samples)."""
    ship(recordings.sparkSession)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, rate, samples in batch.itertuples(index=False):
                out = mfcc_array(samples, int(rate), **settings)
                yield pd.DataFrame({"path": path, "frame_no": np.arange(len(out), dtype="int32"), "features": list(out)})

    return recordings.select("path", "sample_rate", "samples").mapInPandas(work, "path string, frame_no int, features array<double>")


def _cell_frames(x: np.ndarray, at: int, total: int, first: int, last: int, length: int, step: int, k: float, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, frames) of the frames that start from ``first`` up to ``last``, of samples x that begin at place ``at``: one before, if any, and all they cover."""
    y = x.astype(np.float64).copy()
    y[1:] -= k * x[:-1]
    if at == 0:
        y[:1] = x[:1]
    y = y[: max(0, total - 1 - at)]  # the last sample is in no frame
    count = ((total - 1 - length) // step + 1 if total - 1 >= length else 0) + 1
    number = np.arange(-(-first // step), min(count, -(-last // step)))
    padded = np.concatenate([y, np.zeros(length + step)])
    places = np.minimum((number * step - at)[:, None] + np.arange(length)[None, :], len(padded) - 1)
    return number, padded[places] * window


def long_frames(
    samples: DataFrame, key: list[str], order: list[str], value: str, length: int, step: int, k: float = 0.95, window_k: float = 0.46,
    scratch: Scratch | None = None, size: int = segments.BLOCK, cell: int | None = None,
) -> DataFrame:
    """(key, frame_no, frame) of a row a sample: pre-emphasis and frames of recordings of any length, as ``frames`` of ``pre_emphasis`` gives them.

    A recording is cut into blocks. One that is cut learns each block's place by a reduction tree, and its
    frames are dealt to cells of ``cell`` places, to which blocks send their samples and a halo: the one before
    the cell, and those behind it that its last frames still cover. Null values are left out. Frames without
    a sample of their own are zeros, as the last may be; an empty table gives no frames.
    """
    if length < 1 or not 1 <= step <= length:
        raise ValueError("a frame has 1 sample or more and steps on by 1 to its length")
    scratch = scratch or Scratch(samples.sparkSession, "long_frames")
    cell, window = max(cell or 16 * size, length), np.array(hamming(length, window_k))
    live = samples.where(F.col(value).isNotNull()).withColumn("__x", F.array(F.col(value).cast("double")))
    blocks = segments.blocks_of(live, key, order, "__x", scratch, "samples", size)
    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in key)

    def made(keys: list, number: np.ndarray, cut: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([v] * len(number), dtype=object) for c, v in zip(key, keys)} | {"frame_no": number, "frame": pd.Series(list(cut), dtype=object)})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for *keys, x in batch.itertuples(index=False):
                yield made(keys, *_cell_frames(x, 0, len(x), 0, len(x) + length, length, step, k, window))

    out = f"{kinds}, frame_no long, frame array<double>"
    short = blocks.rows.where("whole").select(*key, "x").mapInPandas(whole, out)
    if not blocks.cut:
        return short

    def down(_: tuple, c: np.ndarray | None, vs: list) -> list[np.ndarray]:
        counts = np.cumsum([0, *(v[0] for v in vs)])
        first, total = (0, counts[-1]) if c is None else (c[0], c[1])
        return [np.array([first + n, total]) for n in counts[:-1]]

    long = blocks.rows.where("not whole")
    counts = long.select(*key, "piece", "block", F.array(F.size("x").cast("double")).alias("v"))
    told = segments.tree(counts, key, lambda _, vs: np.array([sum(v[0] for v in vs)]), down)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *keys, x, c in batch.itertuples(index=False):
                a, total = int(c[0]), int(c[1])
                for g in range(max(0, (a - cell - length + 1) // cell + 1), (a + len(x)) // cell + 1):
                    low, high = max(a, g * cell - 1), min(a + len(x), g * cell + cell + length - 1)
                    if low < high:
                        rows.append((*keys, g, low, total, x[low - a : high - a]))
            yield pd.DataFrame(rows, columns=[*key, "cell", "at", "total", "x"])

    dealt = segments.joined(blocks, long, told, "c").select(*key, "x", "c").mapInPandas(deal, f"{kinds}, cell long, at long, total long, x array<double>")

    def cells(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        first = int(keys[-1]) * cell
        return made(list(keys[:-1]), *_cell_frames(np.concatenate(list(rows["x"])), int(rows["at"].iloc[0]), int(rows["total"].iloc[0]), first, first + cell, length, step, k, window))

    return short.unionByName(dealt.groupBy(*key, "cell").applyInPandas(cells, out))


def long_mfcc(framed: DataFrame, key: list[str], rate: int, banks: int = 40, coefficients: int = 13, size: int = 512) -> DataFrame:
    """(key, frame_no, features) of ``long_frames``."""
    kinds = ", ".join(f"{c} {framed.schema[c].dataType.simpleString()}" for c in key)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.drop(columns="frame").assign(features=list(_features(np.stack(batch["frame"].to_numpy()), rate, banks, coefficients, size)))

    return framed.select(*key, "frame_no", "frame").mapInPandas(work, f"{kinds}, frame_no long, features array<double>")
