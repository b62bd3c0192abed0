"""Tables that cut lineage, written to the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a new local one in local mode, else an error."""
    path = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{_SETTING} must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexiwave-")
        spark.conf.set(_SETTING, path)
    return path.rstrip("/")


class Scratch:
    """Intermediate Parquet tables of one operator call.

    A written table outlives lost executors and makes Spark read, not recompute, it.
    ``drop`` deletes a table that nothing will read again; the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lexiwave/{name}-{uuid.uuid4().hex}"
        atexit.register(self._clear, "")

    def save(self, df: DataFrame, name: str, *by: str, compression: str = "snappy") -> DataFrame:
        """The table as written; with ``by``, in folders by these columns' values, of which a filter reads its own."""
        path = f"{self.root}/{name}"
        (df.write.partitionBy(*by) if by else df.write).mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def drop(self, name: str) -> None:
        self._clear(name)

    def _clear(self, name: str) -> None:
        try:
            jvm = self.spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        except Exception:  # the session may have ended; a leftover scratch file harms nothing
            pass


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df``, to be sent to every executor if it was counted to have at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
