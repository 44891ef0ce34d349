"""Near copies against all pairs compared plainly."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import nearcopies, simhash


def grams(x, width=5):
    w = (x or "").encode().lower().split()
    return frozenset(b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def least_of_groups(rows):
    """The least key of each group of Jaccard 0.8 or more."""
    sets = sorted({grams(x) for _, x in rows}, key=sorted)
    root = {s: s for s in sets}

    def top(s):
        while root[s] != s:
            s = root[s]
        return s

    for a in sets:
        for b in sets:
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                root[top(a)] = top(b)
    least = {}
    for i, x in rows:
        g = top(grams(x))
        least[g] = min((v for v in (least.get(g), i) if v is not None), default=None)
    return Counter(least.values())


def random_rows():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    out = [None, "", " \n", "One", "one", "a b c d e", "A b c d E", "a b c d e f"]
    licence = rng.choices(words, k=25)
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(30, 400))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy + licence * rng.randint(0, 1)))
    base = rng.choices(words, k=120)  # a large group
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out)) + [(3, out[3]), (None, out[5]), (None, "only without a key")]


@pytest.mark.parametrize("few, piece", [(3, 20), (3, 1000), (32, 10)])
def test_keep_first(spark, monkeypatch, few, piece):
    monkeypatch.setattr(nearcopies, "FEW", few)
    monkeypatch.setattr(nearcopies, "PIECE", piece)
    monkeypatch.setattr(nearcopies, "SKETCHES", 2 * piece)
    rows = random_rows()
    docs = spark.createDataFrame([(i, x, "s") for i, x in rows], "doc_id bigint, text string, source string").repartition(3)
    kept = nearcopies.keep_first(docs)
    assert kept.columns == docs.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got == least_of_groups(rows) and len(got) < len(rows) - 80
    assert nearcopies.keep_first(docs.where("false")).count() == 0


def test_stage_takes_copies_beyond_three_bits(spark):
    """The pipeline's stage, on pairs just at and just under the similarity."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = [f"x{k}" for k in range(904)]  # 900 shingles

    def changed(k):
        """``k`` shingles at the end are others: 900 - k of 900 + k are shared."""
        return " ".join(base[: 904 - k] + [f"y{j}" for j in range(k)])

    docs = spark.createDataFrame([(1, " ".join(base)), (2, changed(100)), (3, " ".join(f"z{k}" for k in range(50))), (4, " ".join(base).upper())], "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}
    docs = spark.createDataFrame([(1, " ".join(base)), (2, changed(101))], "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 2}


def test_candidates_come_from_the_fingerprint_tree(spark, monkeypatch):
    """Near copies within the radius are grouped by the tree and the exact check alone; what the tree alone says is no link."""
    rng = random.Random(41)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]
    near, other = [*base[:-1], "end"], [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([base, near, other])], "doc_id bigint, text string")
    fp = [simhash.majority(nearcopies.shingles(" ".join(w))) for w in (base, near, other)]
    assert (fp[0] ^ fp[1]).bit_count() <= nearcopies.BITS < (fp[0] ^ fp[2]).bit_count()
    monkeypatch.setattr(nearcopies, "_candidates", lambda pairs: pairs.where("false").select("u", "v"))
    assert {r["doc_id"] for r in nearcopies.keep_first(docs).collect()} == {0, 2}
    monkeypatch.setattr(nearcopies, "by_fingerprint", lambda nodes: nodes.select(F.lit(0).alias("u"), F.col("id").alias("v")).where("v != 0"))
    assert {r["doc_id"] for r in nearcopies.keep_first(docs).collect()} == {0, 2}
