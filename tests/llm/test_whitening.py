"""Whitening against numpy's own integers and eigenvectors."""

import os
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<double>, label int, k int, x int, z string, n int, component string"


def frame(spark, vectors, keys=None):
    keys = range(len(vectors)) if keys is None else keys
    return spark.createDataFrame([(k, v, 1, 2, 3, "z", 4, "c") for k, v in zip(keys, vectors)], SCHEMA).repartition(3)


def plain(vectors, most=4):
    """{place: (deviation, whitened)}, n, explained; exact integers."""
    x = [[int(np.floor(256 * c)) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, dim = len(fit), len(x[0])
    s = [sum(r[d] for r in fit) for d in range(dim)]
    v = np.array([[(n * sum(r[a] * r[b] for r in fit) - s[a] * s[b]) / n**2 for b in range(dim)] for a in range(dim)])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:most], w[:, ::-1][:, :most]
    off = [[n * c - t for c, t in zip(r, s)] for r in x]
    return [sum(c * c for c in r) for r in off], np.array([[c / n for c in r] for r in off]) @ w / np.sqrt(e), n, e / np.trace(v)


def check(rows, vectors, most=4):
    deviations, z, n, share = plain(vectors, most)
    assert len(rows) == len(vectors) * z.shape[1]
    sign = {}
    for r in sorted(rows, key=lambda r: (r["component"], -abs(r["whitened"]))):
        c = r["component"] - 1
        want = z[r["vec_id"]][c]
        assert abs(r["whitened"] * sign.setdefault(c, np.sign(r["whitened"] * want)) - want) < 1e-9
        assert r["n"] == n and abs(r["explained"] / share[c] - 1) < 1e-9 and r["identity_error"] < 1e-9
        assert (r["deviation"] if r["deviation"] is not None else int(r["deviation_text"])) == deviations[r["vec_id"]]


def test_whitening(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(400, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 1).tolist()
    vectors += [vectors[0]] * 200 + [[-0.0, 0.0, 1e-9, -1e-9, 300.0, -300.0]]
    check(whitening.whiten(frame(spark, vectors)).collect(), vectors)


def test_wide_entries(spark):
    """Many bit planes, and deviations of more than 64 bits."""
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(90, 3)) * [1e9, 1e5, 1]).tolist()
    rows = whitening.whiten(frame(spark, vectors)).collect()  # the third variance is beyond the precision of the first
    check(rows, vectors, 2)
    assert any(r["deviation"] is None for r in rows)


@pytest.mark.parametrize("dim", [1, 2])
def test_few_dimensions(spark, dim):
    vectors = np.random.default_rng(5).normal(size=(30, dim)).tolist()
    check(whitening.whiten(frame(spark, vectors)).collect(), vectors, dim)


def test_rows_that_are_dropped(spark):
    good = np.random.default_rng(6).normal(size=(50, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 2.0], [float("-inf"), 0.0, 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    rows = whitening.whiten(frame(spark, bad + good, [-1 - k for k in range(len(bad))] + list(range(len(good))))).collect()
    check(rows, good, 3)


def test_without_variance(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[], []]):
        got = whitening.whiten(frame(spark, vectors))
        assert got.count() == 0 and got.columns[:2] == ["vec_id", "component"]
    flat = [[float(i), 7.0] for i in range(5)]  # one component has no variance
    assert {r["component"] for r in whitening.whiten(frame(spark, flat)).collect()} == {1}


def test_null_keys_and_floats(spark):
    vectors = np.random.default_rng(7).normal(size=(20, 4)).astype("float32").tolist()
    rows = spark.createDataFrame([(None, v) for v in vectors], "vec_id string, embedding array<float>")
    got = whitening.whiten(rows, most=2).collect()
    assert Counter((r["vec_id"], r["component"]) for r in got) == {(None, 1): 20, (None, 2): 20}


def test_common_bits():
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2**13, (130, 5), np.uint64)
    into = np.zeros((25, 5, 5), np.int64)
    whitening.common_bits(whitening.planes(y, 13), into)
    got = sum(into[w].astype(object) << w for w in range(25))
    assert (np.triu(got.astype(float)) == np.triu((y.T @ y).astype(float))).all()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_registered(spark):
    from corpusloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    got = QUERIES["op12_whitening"](spark, sf).withColumnRenamed("vec_id", "id").collect()
    place = {r["vec_id"]: k for k, r in enumerate(rows)}
    check([{"vec_id": place[r["id"]], "deviation_text": None} | {c: r[c] for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")} for r in got], [r["embedding"] for r in rows])
