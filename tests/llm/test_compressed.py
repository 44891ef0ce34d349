"""The compression classifier: held-out accuracy, plain sizes, and cases at the edge."""

import math
import os
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from corpusloom.llm import compressed

SCHEMA = "doc_id bigint, text string, k string, h string, label int, margin string, score double, use string, tie string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "k", "h", 9, "m", 0.1, "u", "t") for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def made(spark):
    """Clean and junk texts of invented words, and their labels."""
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    clean = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(20, 300))) + "."
    junk = lambda: " ".join(rng.choice(words) + rng.choice(["$$$", "###", "%%%"]) for _ in range(rng.randint(20, 300)))
    texts, labels = [], []
    for i in range(1200):
        good = rng.random() < 0.8
        texts.append(clean() if good else junk())
        labels.append((i, int(good)))
    edge = [None, "", " ", "x", "y" * 2_000_000, texts[0], texts[0]]
    return texts + edge, labels + [(None, 1), (5, None), (6, 7), (99_999, 1), (1, labels[1][1])]


@pytest.fixture(scope="module")
def model(spark, made):
    docs, labels = docs_of(spark, made[0]), spark.createDataFrame(made[1], "doc_id bigint, quality int")
    return compressed.fit(docs.where(compressed.remainder(F.col("doc_id"), 5) != 0), labels, label="quality")


def test_held_out(spark, made, model):
    got = {r["doc_id"]: r["score"] for r in compressed.score(docs_of(spark, made[0]), model).collect()}
    assert len(got) == len(made[0]) and all(0 <= s <= 1 for s in got.values())
    held = [(i, q) for i, q in made[1][:1200] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == q for i, q in held) / len(held) >= 0.97
    assert got[0] == got[len(made[0]) - 1] == got[len(made[0]) - 2]
    empty = 1 / (1 + math.exp(-model.offset))
    assert got[1200] == pytest.approx(empty) and got[1201] == pytest.approx(empty)


def test_plain_sizes(model):
    """The margin is what two plain compressors give, block by block."""
    text = ("lorem $$$ ipsum, " * 200).encode()
    size = lambda d: sum(
        len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(text[i : i + 512])) for i in range(0, len(text), 512)
    )
    bad, good = model.dictionaries
    assert compressed._Sizer(model).margin(text) == (size(bad) - size(good)) / len(text)


def test_columns_stay(spark, made, model):
    docs = docs_of(spark, made[0][:50])
    got = compressed.score(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert sorted(r["text"] for r in got.collect()) == sorted(made[0][:50])
    assert compressed.score(docs, model, columns=["doc_id"]).columns == ["doc_id", "score"]


def test_without_labels(spark, made):
    docs = docs_of(spark, made[0][:40])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    for labels in (none, spark.createDataFrame([(i, 1) for i in range(20)], none.schema)):
        scores = {r["score"] for r in compressed.score(docs, compressed.fit(docs, labels, label="quality")).collect()}
        assert len(scores) == 1 and (scores == {0.5}) == (labels.count() == 0)
    few = compressed.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(4)], none.schema), label="quality")
    assert compressed.score(docs, few).count() == 40
    assert compressed.score(docs.where("false"), few).count() == 0
    assert compressed.fit(docs.where("false"), none, label="quality").slope == 0


def test_curve():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=4000) * 0.02
    y = rng.random(4000) < 1 / (1 + np.exp(-(150 * x - 1)))
    slope, offset = compressed.curve(x, y.astype(float))
    assert abs(slope - 150) < 15 and abs(offset + 1) < 0.15
    apart = compressed.curve(np.array([-1.0, -1.0, 1.0, 1.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert apart[0] > 1 and abs(apart[1]) < 1e-6


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_registered(spark):
    """Accuracy on the labelled documents that were never learnt from."""
    from corpusloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op13_compression"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r for r in held if r["quality"]], [r for r in held if not r["quality"]]
    order = [(g["score"] > b["score"]) + (g["score"] == b["score"]) / 2 for g in good for b in bad]
    assert sum(order) / len(order) > 0.98
    assert sum(r["predicted"] for r in good) / len(good) > 0.97
