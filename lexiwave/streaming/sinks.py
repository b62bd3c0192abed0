"""Where streams end: tables kept up to date by key, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_NUMBER = "batch"


class KeyedTable:
    """The latest row of every key of a stream in update mode, as Parquet in a folder that all executors share.

    Each batch is a folder by its number, written whole or not at all: a batch that a restarted query sends
    again takes its own place, so nothing counts twice. Every ``compact`` batches the rows that are still the
    latest are written down as one snapshot, and ``rows`` reads the newest whole snapshot and the batches
    behind it. Without keys all rows stay, as a stream in append mode gives them.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], compact: int = 16):
        if compact < 1:
            raise ValueError("a snapshot holds one batch or more")
        self.spark, self.path, self.schema, self.keys, self.compact = spark, path.rstrip("/"), schema, list(keys), compact

    def write(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        batch.write.mode("overwrite").parquet(f"{self.path}/batches/{_NUMBER}={number}")
        if self.keys and number % self.compact == self.compact - 1:
            self._read(number).write.mode("overwrite").parquet(f"{self.path}/snapshots/{_NUMBER}={number}")

    def start(self, stream: DataFrame, mode: str = "update", **trigger) -> StreamingQuery:
        """Run a stream into the table; its progress lies beside it, so that a killed query goes on where it was."""
        writer = stream.writeStream.foreachBatch(self.write).outputMode(mode).option("checkpointLocation", f"{self.path}/progress")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def rows(self) -> DataFrame:
        """The latest row of every key."""
        numbers = self._whole("batches")
        return self._read(max(numbers)) if numbers else self.spark.createDataFrame([], self.schema)

    def _whole(self, kind: str) -> list[int]:
        """Numbers of the folders that were written to their end."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{_NUMBER}=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
        return [int(x.getPath().getParent().getName().partition("=")[2]) for x in found or []]

    def _upto(self, upto: int) -> DataFrame:
        """The newest whole snapshot and the batches behind it, up to one."""
        base = max((n for n in self._whole("snapshots") if n < upto), default=None)
        parts = [] if base is None else [self._folder("snapshots", base)]
        parts += [self._folder("batches", n) for n in sorted(self._whole("batches")) if n <= upto and (base is None or n > base)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows

    def _read(self, upto: int) -> DataFrame:
        rows = self._upto(upto)
        if not self.keys:
            return rows.drop(_NUMBER)
        rest = [c for c in rows.columns if c not in self.keys and c != _NUMBER]
        latest = F.max_by(F.struct(*rest), _NUMBER) if rest else F.lit(None)
        return rows.groupBy(*self.keys).agg(latest.alias("latest")).select(*self.keys, *[F.col(f"latest.{c}").alias(c) for c in rest]).select(*self.schema.fieldNames())

    def _folder(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{kind}/{_NUMBER}={number}").withColumn(_NUMBER, F.lit(number))


class SummedTable(KeyedTable):
    """Counts of an append stream: ``counted(batch)`` of every batch, and by key the sum over batches.

    The same folders, so a batch that is sent again is counted once; a snapshot holds the sums up to its batch.
    No state is kept between triggers, so a trigger costs what its own rows cost.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], counted: Callable[[DataFrame], DataFrame], compact: int = 16):
        super().__init__(spark, path, schema, keys, compact)
        self.counted = counted

    def write(self, batch: DataFrame, number: int) -> None:
        super().write(self.counted(batch), number)

    def _read(self, upto: int) -> DataFrame:
        rows = self._upto(upto)
        rest = [c for c in rows.columns if c not in self.keys and c != _NUMBER]
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in rest]).select(*self.schema.fieldNames())
