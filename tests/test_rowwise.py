"""Alignment inside a row gives the rows of the joins, and its queries move nothing but texts."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import align as A
from corpusloom.operators import rowwise as R
from corpusloom.plans.registry import QUERIES

KEYS = ["k"]
SF = Path("/root/testdata/sf0.001")


def cut(text, rng, longest):
    out, at = [], 0
    while at < len(text):
        n = rng.randint(1, longest)
        out.append(text[at : at + n])
        at += n
    return out


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(5)
    rows = []
    for k in range(1400):
        text = "".join(rng.choice("ab中\U00020000 　\t") for _ in range(rng.choice([0, 1, 2, 9, 30])))
        bare = "".join(text.split())
        spans = []
        for start in rng.sample(range(len(bare)), min(len(bare), rng.randint(0, 4))):
            spans.append((rng.choice(["X", "Y"]), start, min(len(bare), start + rng.randint(1, 6))))
        values = [rng.choice([None, None, rng.randint(0, 9)]) for _ in range(rng.randint(0, 8))]
        labels = [rng.choice(["O", "S-X", "B-X", "I-X", "I-Y"]) for _ in range(40)]
        t = cut(bare, rng, 4)
        rows.append((k, text, cut(bare, rng, 3), t, spans, values, labels[: len(t)]))
    rows += [(2000, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "k int, text string, s array<string>, t array<string>, spans array<struct<type:string,start:int,stop:int>>, v array<int>, l array<string>").repartition(2).cache()  # more rows than are done at a time
    return df, A.positions(df, KEYS, "s"), A.positions(df, KEYS, "t")


def same(row_form, long_form, value):
    flat = row_form.select("k", F.posexplode("x").alias("pos", "x")).where("x is not null")
    a = sorted(map(tuple, flat.collect()))
    assert a and a == sorted(tuple(r) for r in long_form.select("k", "pos", value).where(F.col(value).isNotNull()).collect())


def test_owner(both):
    df, s, t = both
    same(df.select("k", R.owner("s", "t").alias("x")), A.owner(s, t, KEYS), "owner")
    same(df.select("k", R.owner("t", "s").alias("x")), A.token_to_subchar(s, t, KEYS), "first")


def test_text_index(both):
    df, _, t = both
    same(df.select("k", R.text_index("text", "t").alias("x")), A.inverse_text_index(df, KEYS, "text", t), "text_pos")


def test_labels(both):
    df, s, t = both
    spans = df.select("k", F.explode("spans").alias("e")).select("k", "e.*")
    same(df.select("k", R.token_labels("spans", "t").alias("x")), A.labels_to_tokens(spans, t, KEYS), "label")
    of = df.select("k", F.posexplode("l").alias("pos", "label"))
    labelled = t.join(of, ["k", "pos"])
    same(df.select("k", R.piece_labels("l", "t", "s").alias("x")), A.labels_to_pieces(labelled, s, KEYS), "label")
    chars = A.labels_to_chars(labelled, KEYS)
    same(df.select("k", R.char_labels("l", "t").alias("x")), chars, "label")
    names = ["O", "B-X", "I-X", "S-X"]
    got = {r["k"]: r["x"] for r in df.select("k", R.label_ids(R.char_labels("l", "t"), names, 12, edge=7).alias("x")).collect()}
    assert got == {r["k"]: r["ids"] for r in A.label_ids(df, chars, KEYS, names, 12, edge=7).collect()}


@pytest.mark.parametrize("is_start", [True, False])
def test_nearest_filled(both, is_start):
    df, _, _ = both
    long = A.nearest_filled(df.select("k", F.posexplode("v").alias("pos", "value")), KEYS, is_start=is_start)
    same(df.select("k", R.nearest_filled("v", is_start=is_start).alias("x")), long, "value")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", "subchar_to_token_pos token_to_subchar_pos subchar_owner inverse_text_index labels_char_to_token labels_char_to_subchar labels_token_to_char pos_left_right nearest_filled".split())
def test_no_shuffle_by_key(spark, name):
    plan = QUERIES[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Sort " not in plan and "Window" not in plan
