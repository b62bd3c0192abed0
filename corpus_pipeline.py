"""A training-data pipeline of five operators, each stage written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiwave.llm.bpe import bpe_stage
from lexiwave.llm.language_id import language_stage
from lexiwave.llm.line_dedup import line_dedup_stage
from lexiwave.llm.mixing import mixing_stage
from lexiwave.llm.near_dedup import near_dedup_stage
from lexiwave.functions.scratch import Scratch

STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: a trained network, hashed darts and byte-pair merges are beyond SQL; the tests compare by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{number}-{name}")
        if number > 1:
            scratch.drop(f"{number - 1}-{STAGES[number - 1][0]}")
    return docs
