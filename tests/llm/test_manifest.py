"""The Merkle manifest against a plain tree, and its SQL against DuckDB."""

import hashlib
import os
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, g string, k string, h string, rank string, n int, lo int, hi int, path string, kids string, root string, part int"
CLASH = ("g", "k", "h", "r", 1, 2, 3, "p", "kids", "root", 4)


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def low(x):
    return x if x is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def plain_leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, o in enumerate(own):
            first = o // 16 * 16
            paths[i].append(("".join(nodes[first:o]), "".join(nodes[o + 1 : first + 16])))
        own = [o // 16 for o in own]
        nodes = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    """All result rows, as a bag."""
    groups = {}
    for r in rows:
        groups.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append(r)
    trees = {}
    for g in sorted(groups):
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
        trees[g] = plain_tree([plain_leaf(r, r["text"]) for r in groups[g]])
    root, upper = plain_tree([trees[g][0] for g in sorted(groups)])
    out = Counter()
    for g, above in zip(sorted(groups), upper):
        for r, path in zip(groups[g], trees[g][1]):
            own, path = plain_leaf(r, r["text"]), path + above
            seen = plain_leaf(r, low(r["text"])) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else own
            for a, b in path:
                seen = digest(a + seen + b)
            out[r["doc_id"], own, trees[g][0], root, digest("".join(a + b for a, b in path)), seen, seen == root] += 1
    return out


def audit(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in manifest.audit(df, seen=manifest.tampered(df)).select(cols).collect())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"Text {i} ÄB", "en", "hot", 7, *CLASH) for i in range(-20, 300)]
    rows += [(i, t, None, s, None, *CLASH) for i, (t, s) in enumerate([(None, None), ("", None), ("X" * 300_000, "z"), ("B", "Z"), ("B", "é"), ("B", ""), (" \n", "")])]
    rows += [(i, "same", "en", "row", 4, *CLASH) for i in (1, 1, 1, 2, 2, None, None)] + [(1, "Other", "en", "row", 5, *CLASH)]
    rows += [(i, "One", "en", f"src{i}", 3, *CLASH) for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_manifest(docs):
    got = audit(docs)
    assert got == plain(docs.collect())
    assert {r[6] for r in got} == {True, False}


def test_small_tables(spark, docs):
    for some in (docs.where("false"), docs.where("source is null and text is null"), docs.where("source = 'hot'"), docs.where("source = 'hot' and doc_id between 1 and 16"), docs.where("source = 'hot' and doc_id between 1 and 17")):
        assert audit(some) == (plain(some.collect()) if some.count() else Counter())


def test_other_key_and_fields(spark):
    rows = spark.createDataFrame([("b", 1, "T"), ("a", 1, "U"), ("c", 2, None)], "id string, part int, body string")
    made = manifest.manifest(rows, key="id", group="part", fields=("id", "body")).collect()
    leaves = {i: digest("".join("-" if v is None else f"{len(v)}:{v}" for v in (i, t))) for i, t in (("a", "U"), ("b", "T"), ("c", None))}
    first = digest(leaves["a"] + leaves["b"])
    root = digest(first + leaves["c"])
    assert {(r["id"], r["leaf"], r["subroot"], r["root"]) for r in made} == {("a", leaves["a"], first, root), ("b", leaves["b"], first, root), ("c", leaves["c"], leaves["c"], root)}
    assert {r["id"]: r["path"] for r in made}["c"] == [(first, "")]


def test_no_large_group(docs):
    """A node has at most ``FAN`` children, so no join or group is larger, whatever the source."""
    leaves = manifest.ranked(docs.select(F.lit("g").alias("g"), F.col("doc_id").alias("k"), manifest.leaf([docs.doc_id]).alias("h")), ["k", "h"])
    tree = manifest.levels(leaves)
    assert [t.count() for t in tree] == [docs.count(), 24, 2, 1]
    assert max(t.agg(F.max(F.size("kids"))).first()[0] for t in tree[1:]) == 16


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_manifest_sql(spark):
    import duckdb

    from corpusloom.llm.queries import ORACLES, QUERIES

    sf = Path("/root/testdata/sf0.001")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    r = c.execute(ORACLES["op11_manifest"])
    names = [d[0] for d in r.description]
    got = QUERIES["op11_manifest"](spark, str(sf)).select(names)
    assert Counter(map(tuple, got.collect())) == Counter(r.fetchall())
