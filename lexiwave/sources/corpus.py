"""Text corpora, transcripts and word topologies from files, and models as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(path: Column, above: int) -> Column:
    """The name of the folder that many levels above a file: words, phones and states are named by folders."""
    return F.element_at(F.split(path, "/"), -1 - above)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(corpus_id, text): one file is one sequence; line ends do not split it."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("corpus_id"), F.col("value").alias("text"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(utt_id, reference) with white space around the text cut off; the folder names the utterance."""
    return spark.read.text(path, wholetext=True).select(
        folder(F.col("_metadata.file_path"), 1).alias("utt_id"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("reference"))


def read_topologies(spark: SparkSession, path: str) -> DataFrame:
    """(folder, word, phones) of files that hold ``word phone phone ...``."""
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), " ", 2)
    return spark.read.text(path, wholetext=True).select(
        folder(F.col("_metadata.file_path"), 1).alias("folder"), parts[0].alias("word"), F.split(parts[1], " ").alias("phones"))


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Write a model's tables, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
