"""Records that are written for the readers stay bounded."""

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import files
from corpusloom.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["read_nested_qa", "read_definitions"])
def test_hot_conversation(spark, tmp_path, monkeypatch, name):
    turns = spark.range(1000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"), F.lit("one two three").alias("text"))
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    paths, scratch = [], files.S.scratch
    monkeypatch.setattr(files.S, "scratch", lambda *a: paths.append(scratch(*a)) or paths[-1])
    assert QUERIES[name](spark, str(tmp_path)).count() == 1000
    longest = spark.read.text(paths[0]).agg(F.max(F.length("value"))).first()[0]
    assert longest < 64 * 200
