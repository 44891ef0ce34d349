"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with SQL that gives the same rows where there is one."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts that lie in fewer parts than there are cores are dealt out, as work on them is far more than reading;
    a large table has more parts, and nothing moves."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line) of the documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


#: The same as a common table expression.
LINES = "lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
#: The driver's tables hold no Chinese text; some letters and marks stand in for it.
LATIN, HANZI = "aeo,.!?;:", "今天好，。！？；："
