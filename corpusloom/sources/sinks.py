"""Writers of corpora, examples, vocabularies and predictions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, or in a temporary folder where none is set on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="corpusloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _dealt(rows: DataFrame, per_file: int) -> DataFrame:
    """Rows by split, shard and file of about ``per_file`` rows: a large shard is written by several tasks."""
    largest = rows.groupBy("split", "shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    files = -(-largest // per_file) or 1
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(files))
    return rows.withColumn("_file", part).repartition("split", "shard", "_file").drop("_file")


def shards_text(docs: DataFrame, path: str, *, per_file: int = 100_000) -> None:
    """``docs``: (split, shard, sentences). A sentence a line, a blank line after each document, a folder for each shard with a
    file for about ``per_file`` documents."""
    rows = docs.select("split", "shard", F.concat(F.array_join("sentences", "\n"), F.lit("\n")).alias("value"))
    _dealt(rows, per_file).write.partitionBy("split", "shard").text(path)


def examples(rows: DataFrame, path: str, *, per_file: int = 1_000_000) -> None:
    """Fixed-length integer arrays as Parquet, by split and shard, a file for about ``per_file`` rows."""
    _dealt(rows, per_file).write.partitionBy("split", "shard").parquet(path)


def vocab(ranked: DataFrame, path: str) -> None:
    """``token count`` lines in order of rank; a vocabulary is small."""
    ranked.orderBy("id").select(F.concat_ws(" ", "token", F.col("n").cast("string")).alias("value")).coalesce(1).write.text(path)


def jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def last_predictions(rows: DataFrame, order: str) -> DataFrame:
    """(id, prediction): of repeated ids the last counts."""
    return rows.groupBy("id").agg(F.max_by("prediction", order).alias("prediction"))


def logits_lines(rows: DataFrame, key: str, scores: str) -> DataFrame:
    """(key, value, class): scores joined by spaces and the best class."""
    return rows.select(key, F.array_join(F.transform(scores, lambda s: F.format_string("%.4f", s)), " ").alias("value"), (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("class"))


def scores(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.csv(path, sep="\t", header=True)
