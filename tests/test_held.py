"""What is done where the rows are read gives the rows of the joins, and at scale nothing is shuffled by row."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import codebook as C
from corpusloom.operators import examples as E
from corpusloom.operators import features as X
from corpusloom.operators import tokens as K
from corpusloom.plans import metrics
from corpusloom.plans.registry import QUERIES

SF = Path("/root/testdata/sf0.001")
ROWS = [(1, ["ab", "b", "", "zz", "ab"]), (2, []), (3, None), (4, ["b", None, "c9"])]


def same(a, b):
    a, b = ({r[0]: r[1] for r in x.collect()} for x in (a, b))
    assert a == b and set(a) == {1, 2, 3, 4}
    return a


def test_ids_and_tokens(spark):
    df = spark.createDataFrame(ROWS, "k int, w array<string>").repartition(2)
    vocab = spark.createDataFrame([(0, "[UNK]"), (1, "ab"), (5, "b"), (7, "b")], "id int, token string")
    got = same(K.to_ids(df, ["k"], "w", vocab, unk=3)[0], K.to_ids(df, ["k"], "w", vocab, unk=3, held=0)[0])
    assert got[1] == [1, 7, 3, 3, 1] and got[3] == []
    ids = spark.createDataFrame([(1, [1, 7, 3]), (2, []), (3, None), (4, [5, None])], "k int, i array<int>")
    assert same(K.to_tokens(ids, ["k"], "i", vocab), K.to_tokens(ids, ["k"], "i", vocab, held=0))[1] == ["ab", "b", None]


def test_words_first(spark):
    df = spark.createDataFrame(ROWS, "k int, w array<string>")
    listed = spark.createDataFrame([("ab",)], "token string")
    book = spark.createDataFrame([("z", "yx1"), ("c", "x")], "ch string, code string")
    scored = spark.createDataFrame([("y", -1.0), ("x1", -1.0), ("x", -1.0), ("1", -3.0)], "token string, score double")
    assert same(K.words_first(df, ["k"], "w", listed, book, scored), K.words_first(df, ["k"], "w", listed, book, scored, held=0))[2] == []


def test_translate(spark):
    df = spark.createDataFrame([(1, "aXb\U00020000"), (2, ""), (3, None), (4, "b" * 300)], "k int, t string")
    table = spark.createDataFrame([("a", "1"), ("b", "22"), ("X", None)], "ch string, out string")
    here = C.translate(df, ["k"], "t", table)
    assert same(here, C.translate(df, ["k"], "t", table, held=1))[1] == "1X22\U00020000"
    assert "Exchange hashpartitioning" not in here._jdf.queryExecution().executedPlan().toString()


def test_max_context(spark):
    rng = random.Random(2)
    rows = []
    for k in range(50):
        n, m, step = rng.randint(1, 60), rng.randint(3, 9), rng.randint(1, 4)
        rows.append((k, [(s, min(m, n - s)) for s in range(0, n, step)]))
    df = spark.createDataFrame(rows, "k int, w array<struct<start:int,size:int>>")
    parts = df.select("k", F.posexplode("w").alias("window", "p")).select("k", "window", "p.*")
    here = df.select("k", F.posexplode(X.max_context_of(F.col("w"))).alias("pos", "window"))
    assert sorted(map(tuple, here.collect())) == sorted(map(tuple, X.max_context(parts, ["k"]).select("k", "pos", "window").collect()))


def test_cloze_records_meet_labels_once(spark):
    text = "x #idiom000001# y #idiom000002# #idiom000003#"
    rows = spark.createDataFrame([(1, text, ["o"]), (2, "none", ["o"]), (3, text, ["p"])], "k int, t string, o array<string>")
    labels = spark.createDataFrame([(1, "#idiom000001#", 4), (1, "#idiom000003#", None), (3, "#idiom000002#", 5)], "k int, tag string, answer int")
    got = E.cloze_examples(rows, ["k"], "t", "o", labels)
    assert sorted((r["k"], r["blank"], r["answer"] or 0) for r in got.collect()) == [(1, 0, 4), (1, 1, 0), (1, 2, 0), (3, 0, 0), (3, 1, 5), (3, 2, 0)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Join LeftOuter")  # blanks are made above the join


def test_hour_of_the_nearest_second(spark, tmp_path):
    at = lambda *x: datetime.datetime(2024, 1, 1, *x)
    rows = [(0, at(0, 59, 59, 700_000), "a", 9.0), (1, at(1, 0, 0), "a", 1.0), (2, at(0, 59, 59, 300_000), "a", 2.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["epoch"] % 24: r["score"] for r in metrics.runs(spark, str(tmp_path)).collect()}
    assert got == {0: 2.0, 1: 5.0}


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", "encode_corpus tokenize_words_first tokenize_wordpiece tokenize_unigram ids_to_tokens feat_two_level feat_windows_two_level max_context".split())
def test_no_shuffle_by_key(spark, name):
    plan = QUERIES[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan
