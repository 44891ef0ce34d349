"""Places in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.sinks import scratch


def numbered(rows: DataFrame, order: list[Column | str], *, by: list[str] | None = None, weight: str | None = None, name: str = "place") -> DataFrame:
    """The rows with ``name``: the number of rows (the sum of ``weight``) before each in this order, within each ``by``.

    Rows are cut into ranges of (by, order), as many as a shuffle has parts, and written once, so that ranges do not change if
    a task is run again. Places are counted inside a range and shifted by the totals of the ranges before it; one value of
    ``by`` with a third of all rows is many ranges. Rows of equal order stay in one range.
    """
    spark, by = rows.sparkSession, by or []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "ranges")
    rows.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranges = spark.read.parquet(path)
    n = F.lit(1) if weight is None else F.col(weight)
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(*by, "_range").agg(F.sum(n).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    offsets = totals.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_range").alias("_of"), "_before")
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_range") == F.col("_of")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    out = ranges.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(offsets, same)
    return out.select(*rows.columns, (F.col("_inside") + F.col("_before")).alias(name))
