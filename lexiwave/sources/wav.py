"""Recordings from and to WAV files.

``read_wav`` gives a row a recording. ``spark.read.format("wav")``, once ``register`` was called, gives a row
a run of samples: a large file is read by many tasks, a range of bytes each.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lexiwave.functions.shipping import ship

#: the fixed place from which compatible reading takes samples
COMPAT_OFFSET = 78


@dataclass
class Layout:
    """Where a file's samples lie: ``count`` of them a channel from byte ``start`` on."""

    channels: int
    rate: int
    bits: int
    start: int
    count: int

    @classmethod
    def of(cls, read: Callable[[int, int], bytes], size: int, channel: int = 1, compat: bool = False) -> "Layout":
        """From ``read(place, bytes)`` of a file of ``size`` bytes.

        Chunks are walked to the format and the data. ``compat`` reads the format at fixed places and takes
        samples from ``COMPAT_OFFSET`` to the end of the file, whatever lies there.
        """
        if read(0, 4) != b"RIFF":
            raise ValueError("not a RIFF file")
        if compat:
            if size < 36:
                raise ValueError("no format in the file")
            channels, rate, bits = struct.unpack("<HI6xH", read(22, 14))
            start, end = COMPAT_OFFSET, size
        else:
            at, channels, rate, bits, start, end = 12, 0, 0, 0, None, 0
            while at + 8 <= size and start is None:
                name, length = struct.unpack("<4sI", read(at, 8))
                if name == b"fmt ":
                    if size < at + 24:
                        break
                    channels, rate, bits = struct.unpack("<HI6xH", read(at + 10, 14))
                elif name == b"data":
                    start, end = at + 8, min(at + 8 + length, size)
                at += 8 + length + length % 2
            if not channels or start is None:
                raise ValueError("no format or no data in the file")
        if not 1 <= channel <= channels:
            raise ValueError(f"channel {channel} of {channels}")
        if bits not in (8, 16, 24, 32):
            raise ValueError(f"{bits} bits a sample")
        return cls(channels, rate, bits, start, max(0, end - start) // (bits // 8 * channels))

    @property
    def width(self) -> int:
        """Bytes from a sample to the next."""
        return self.bits // 8 * self.channels

    def samples(self, body: bytes, channel: int, compat: bool) -> np.ndarray:
        """A channel of whole samples."""
        raw = np.frombuffer(body, np.uint8).reshape(-1, self.channels, self.bits // 8)[:, channel - 1]
        if self.bits == 8 and not compat:
            return raw[:, 0].astype(np.int64) - 128
        value = np.zeros(len(raw), np.int64)
        for i in range(self.bits // 8):
            value |= raw[:, i].astype(np.int64) << (8 * i)
        return value - ((value >> (self.bits - 1)) << self.bits)


def parse_wav(data: bytes, channel: int = 1, compat: bool = False) -> tuple[int, np.ndarray]:
    """(sample rate, samples of a channel) of a PCM file."""
    found = Layout.of(lambda at, n: data[at : at + n], len(data), channel, compat)
    return found.rate, found.samples(data[found.start : found.start + found.count * found.width], channel, compat)


def read_wav(spark: SparkSession, path: str, channel: int = 1, compat: bool = False, glob: str = "*.wav") -> DataFrame:
    """(path, sample_rate, samples) of the files under a path."""
    ship(spark)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [parse_wav(c, channel, compat) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "sample_rate": [r for r, _ in parsed], "samples": [s for _, s in parsed]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(work, "path string, sample_rate int, samples array<long>")


_TYPES = {"path": pa.string(), "sample_rate": pa.int32(), "n_samples": pa.int64(), "first": pa.int64(), "samples": pa.list_(pa.int64())}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if path.split("/")[0].endswith(":") else (fs.LocalFileSystem(), path)


@dataclass
class Ranges(InputPartition):
    """(file, its size, first byte, byte behind the last) of a task."""

    pieces: list[tuple[str, int, int, int]]


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.columns = options["path"], schema.names
        unknown = set(self.columns) - set(_TYPES)
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        self.glob, self.channel = options.get("pathGlobFilter", "*.wav"), int(options.get("channel", 1))
        self.compat = str(options.get("compat", "false")).lower() == "true"
        self.split, self.block = int(options.get("splitBytes", 32 << 20)), int(options.get("blockSamples", 1 << 16))
        if self.split < 1 or self.block < 1:
            raise ValueError("splitBytes and blockSamples are 1 or more")

    def partitions(self) -> list[Ranges]:
        """Large files cut into ranges, small ones put together; only names and sizes are looked at."""
        store, root = _store(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        out, held = [Ranges([])], 0
        for path, size in sorted((f.path, f.size) for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.glob)):
            step = self.split if "samples" in self.columns else max(size, 1)
            for a in range(0, max(size, 1), step):
                b = min(a + step, size)
                if out[-1].pieces and held + b - a > self.split:
                    out.append(Ranges([]))
                    held = 0
                out[-1].pieces.append((path, size, a, b))
                held += b - a
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for path, size, a, b in partition.pieces:
            with store.open_input_file(path) as file:
                try:
                    found = Layout.of(lambda at, n: file.read_at(n, at), size, self.channel, self.compat)
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                # a sample is read by the task whose range holds its first byte
                first, last = (min(max(0, -((found.start - x) // found.width)), found.count) for x in (a, b))
                if "samples" not in self.columns or a == 0 and found.count == 0:
                    yield self._row(path, found, 0, np.zeros(0, np.int64))
                    continue
                for i in range(first, last, self.block):
                    n = min(self.block, last - i)
                    body = file.read_at(n * found.width, found.start + i * found.width)
                    yield self._row(path, found, i, found.samples(body, self.channel, self.compat))

    def _row(self, path: str, found: Layout, first: int, samples: np.ndarray) -> pa.RecordBatch:
        values = {"path": path, "sample_rate": found.rate, "n_samples": found.count, "first": first, "samples": samples}
        return pa.RecordBatch.from_arrays([pa.array([values[c]], _TYPES[c]) for c in self.columns], names=self.columns)


class WavWriter(DataSourceWriter):
    """A file of 16-bit samples a row. A file's name is its row's, so a task that runs again writes the same files."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        missing = {"path", "sample_rate", "samples"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        self.path = options["path"]
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        if overwrite:
            store.delete_dir_contents(root)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = _store(self.path)
        attempt = TaskContext.get().taskAttemptId()
        for row in iterator:
            samples = np.asarray(row["samples"], np.int64)
            if len(samples) and not -32768 <= samples.min() <= samples.max() <= 32767:
                raise ValueError(f"{row['path']}: a sample outside 16 bits")
            body, rate = samples.astype("<i2").tobytes(), row["sample_rate"]
            head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(body))
            folder, _, name = f"{root}/{row['path']}".rpartition("/")
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/.{name}.{attempt}") as out:
                out.write(head + body)
            store.move(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        store.open_output_stream(f"{root}/_SUCCESS").close()


class WavDataSource(DataSource):
    """``format("wav")``: PCM files under ``path``, in a store that ``pyarrow.fs`` knows by its URI.

    Reading gives path, sample_rate, n_samples (of the file), first (place of the row's first sample) and
    samples; a file without samples is one row. With a schema that leaves ``samples`` out, a row a file comes
    from its header alone. Options: channel (1), compat (false), pathGlobFilter (*.wav), splitBytes (32 MiB)
    and blockSamples (65,536 a row). A file that is no WAV is an error that names it.

    Writing takes path (relative to the folder), sample_rate and samples, a file a row.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path string, sample_rate int, n_samples long, first long, samples array<long>"

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("wav")`` known to a session."""
    ship(spark)
    spark.dataSource.register(WavDataSource)
