"""Places in order against a plain sort."""

import random

from pyspark.sql import functions as F

from corpusloom.operators.order import numbered


def test_places_of_a_hot_group_nulls_and_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 300), k, rng.randint(1, 3)) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, x int, k int, w int")
    got = {r["k"]: (r["place"], r["before"]) for r in numbered(numbered(df, [F.desc("x"), "k"], by=["g"]), [F.desc("x"), "k"], by=["g"], weight="w", name="before").collect()}
    want = {}
    for g in ("a", "b", None):
        before = 0
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            want[r[2]] = (place, before)
            before += r[3]
    assert got == want


def test_places_without_groups_and_of_nothing(spark):
    df = spark.createDataFrame([(k,) for k in (5, 3, 9)], "x int")
    assert {r["x"]: r["place"] for r in numbered(df, ["x"]).collect()} == {3: 0, 5: 1, 9: 2}
    assert numbered(df.where("x > 99"), ["x"]).count() == 0
