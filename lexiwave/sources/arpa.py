"""Language models as ARPA text."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiwave.operators.lm import Katz
from lexiwave.operators.text import UNKNOWN


def arpa_lines(probs: DataFrame, backoffs: DataFrame, n: int, log10: bool = False, digits: int | None = None) -> DataFrame:
    """(section, line_no, text) of one model's (ord, gram, nlp) and (ord, ctx, nla) tables.

    Values are negative natural logs, or with ``log10`` the usual logs to base 10. ``<unk>`` comes first,
    grams follow in order; orders below n carry a back-off weight, 0 where there is none. Numbers have all
    their digits, or ``digits`` behind the point.
    """
    scaled = (lambda c: -c / math.log(10)) if log10 else (lambda c: c)
    shown = (lambda c: scaled(c).cast("string")) if digits is None else (lambda c: F.format_string(f"%.{digits}f", scaled(c) + 0.0))
    weights = backoffs.select((F.col("ord") - 1).alias("ord"), F.col("ctx").alias("gram"), "nla")
    rows = (
        probs.join(weights, ["ord", "gram"], "left")
        .withColumn("key", F.array_join("gram", " "))
        .withColumn("text", F.concat_ws("\t", shown(F.col("nlp")), "key", F.when(F.col("ord") < n, shown(F.coalesce("nla", F.lit(0.0))))))
        .select("ord", F.when(F.col("key") == UNKNOWN, 0).otherwise(1).alias("late"), "key", "text")
    )
    counts = probs.groupBy("ord").agg(F.count("*").alias("c"))
    head = counts.select(F.lit(0).alias("section"), F.format_string("%03d", "ord").alias("at"), F.format_string("ngram %d=%d", "ord", "c").alias("text"))
    spark = probs.sparkSession
    fixed = [(0, "", "\\data\\")] + [(m, "", f"\\{m}-grams:") for m in range(1, n + 1)] + [(m, "~", " ") for m in range(n + 1)] + [(n + 1, "", "\\end\\")]
    frame = spark.createDataFrame(fixed, "section int, at string, text string")
    body = rows.select(F.col("ord").alias("section"), F.concat(F.lit("!"), F.col("late"), F.col("key")).alias("at"), "text")
    end = F.when(F.col("at") == "~", 1).otherwise(0)
    return head.unionByName(frame).unionByName(body).select("section", end.alias("last"), "at", "text")


def write_arpa(lines: DataFrame, path: str) -> None:
    """Text files whose names are in the order of their lines, a range of them each; one behind the other they are the file."""
    keys = ["section", "last", "at"]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("text").write.mode("overwrite").text(path)


def write_arpa_file(lines: DataFrame, path: str) -> None:
    """One file that other tools read, at ``path``.

    Ranges of lines are written by many tasks beside it and then appended in order, a buffer at a time, so
    nobody holds the model; the file takes its name only when it is whole.
    """
    spark = lines.sparkSession
    parts, whole = f"{path}.parts", f"{path}.whole"
    write_arpa(lines, parts)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    hadoop = jvm.org.apache.hadoop
    target = hadoop.fs.Path(whole)
    files = target.getFileSystem(conf)
    out = files.create(target, True)
    try:
        for f in sorted((x.getPath() for x in files.globStatus(hadoop.fs.Path(f"{parts}/part-*"))), key=lambda p: p.getName()):
            piece = files.open(f)
            hadoop.io.IOUtils.copyBytes(piece, out, 1 << 20, False)
            piece.close()
    finally:
        out.close()
    files.delete(hadoop.fs.Path(path), True)
    files.rename(target, hadoop.fs.Path(path))
    files.delete(hadoop.fs.Path(parts), True)


def check_counts(lines: DataFrame) -> None:
    """An error if a header ``ngram k=c`` of (value) lines does not name the number of grams of each order."""
    said = lines.select(F.regexp_extract("value", r"^ngram (\d+)=(\d+)\s*$", 1).alias("ord"), F.regexp_extract("value", r"^ngram (\d+)=(\d+)\s*$", 2).alias("n")).where("ord <> ''")
    told = {int(r.ord): int(r.n) for r in said.collect()}  # a line an order
    found = lines.where(F.contains("value", F.lit("\t"))).groupBy(F.size(F.split(F.split("value", "\t")[1], " ")).alias("ord")).count()
    held = {r.ord: r["count"] for r in found.collect()}
    wrong = sorted(k for k in told.keys() | held.keys() if told.get(k, 0) != held.get(k, 0))
    if wrong:
        raise ValueError("; ".join(f"order {k}: the header says {told.get(k, 'nothing')}, the file has {held.get(k, 0)}" for k in wrong))


def read_arpa(spark: SparkSession, path: str, log10: bool = False, check: bool = True) -> Katz:
    """A Katz model. A line's order is its number of words, so lines need no order and any file splits; with ``check`` the header's numbers must be right."""
    if check:
        check_counts(spark.read.text(path))
    back = (lambda c: -c * math.log(10)) if log10 else (lambda c: c)
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(F.contains("value", F.lit("\t"))).select(
        back(parts[0].cast("double")).alias("nlp"), F.split(parts[1], " ").alias("gram"), back(F.try_element_at(parts, F.lit(3)).cast("double")).alias("nla"))
    lines = lines.withColumn("ord", F.size("gram")).withColumn("model", F.lit("all"))
    probs = lines.select("model", "ord", "gram", F.lit(None).cast("long").alias("cnt"), "nlp")
    n = int(probs.agg(F.max("ord")).first()[0] or 1)
    reserved = probs.where((F.col("ord") == 1) & (F.col("gram")[0] == UNKNOWN)).select(F.exp(-F.col("nlp"))).first()
    backoffs = lines.where(F.col("nla").isNotNull()).select("model", (F.col("ord") + 1).alias("ord"), F.col("gram").alias("ctx"), "nla")
    return Katz(n, reserved[0] if reserved else 0.0, spark.createDataFrame([], "model string, ord int, r long, d double"), probs, backoffs)
