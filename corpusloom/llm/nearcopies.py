"""Near copies at an exact Jaccard similarity of five-word shingles, by a fingerprint tree and by prefix filtering.

The SimHash fingerprints of the sets go through the vantage-point tree of :mod:`simhash`; what it links, and sets of one
fingerprint, are candidates. At the similarity of 0.8 sets may lie further apart than any radius that the tree can prune by, so
prefix filtering adds the candidates beyond it; an exact check follows for all of them.

All shingles stand in one order, common ones last. Of two sets at the similarity or more, each has a shingle of the other
among its first n - ceil(similarity * n) + 1 in that order, so no pair is missed: only these prefixes are dealt out by
shingle, and sets that meet there are candidates. The order rests on counts in a sample; it decides about work only, not
about results.

Where few sets meet, their pairs are listed, and a bound on what a pair can share drops most of them. Where many meet, no pairs
are listed: each set is named with the smallest of them, so that the many shingles of one passage or group of copies make few
such *meetings*; a meeting is dealt into pieces of bounded size, and every two pieces meet in one task. Listed pairs and
meetings alike are first told by sketches of ``SKETCH`` minimum hashes, which a pair at the similarity passes but for a chance
of about 1e-9; a task returns a forest of what passes, never more than it has sets. The components of that are *crowds*. Only
they are read again: in pieces as before, compared shingle by shingle, into a forest of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.llm.bloom import bloom
from corpusloom.llm.common import stage_table
from corpusloom.llm.components import components

#: Similarity as a fraction, so that all bounds are whole numbers.
SIMILARITY = (4, 5)
WIDTH = 5
#: Radius of the fingerprint tree in bits.
BITS = 3
#: Documents of the sample, about, and most common shingles that are put last in the order.
SAMPLE, COMMON = 20_000, 200_000
#: Sets that meet at a shingle are paired up to this number.
FEW = 32
#: Sketches in one piece of a meeting; sets and shingles in one piece of a crowd, about.
SKETCHES, PIECE, PIECE_SHINGLES = 4000, 1000, 1_000_000
#: Minimum hashes of a sketch, and how many must agree: six standard deviations fewer than expected at the similarity.
SKETCH, AGREE = 128, 75


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct XXH64 (seed 42) of a text's word shingles, sorted. Words are those of ``simhash.fingerprint``; a text of
    fewer words than ``width`` has one shingle, one without words or a null has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64))


def _common(docs: DataFrame, text: str) -> np.ndarray:
    """The most common shingles of a sample, the rarest of them first."""
    share = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.concatenate([np.empty(0, np.uint64), *(shingles(t.as_py()) for t in b.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    sample = docs.where(F.pmod(F.xxhash64(text, F.lit(1)), F.lit(share)) == 0).select(text)
    counts = sample.mapInArrow(run, "h bigint").groupBy("h").count().where("count > 2")
    top = counts.orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    return top.column("h").to_numpy()[::-1].view(np.uint64)


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, td, row, node, n, fp, sketch, prefix): digests of a row's text and of its shingle set, the size of the set, its
    fingerprint, and its prefix, in 48 bits a shingle. Sets count as equal if their 64-bit digests are; shingles that only look equal in the prefix make
    candidates, no links."""
    last = _common(docs, text)
    order = np.argsort(last)
    held = docs.sparkSession.sparkContext.broadcast((last[order], order))
    num, den = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = held.value
        for b in batches:
            node, n, fp, sketch, prefix = [], [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py())
                node.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                n.append(len(s))
                fp.append(simhash.majority(s))
                sketch.append(_sketch(s).tobytes())
                first = s
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    first = s[np.argsort(np.where(known[at] == s, place[at] + 1, 0), kind="stable")]
                prefix.append((first[: len(s) - -(-num * len(s) // den) + 1 if len(s) else 0] >> np.uint64(16)).view(np.int64))
            ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *prefix])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sketch, pa.binary()), lists], names=["k", "td", "node", "n", "fp", "sketch", "prefix"])

    rows = docs.select(docs[key].alias("k"), F.xxhash64(text).alias("td"), docs[text].alias("t"))
    rows = rows.mapInArrow(run, f"k {dict(docs.dtypes)[key]}, td bigint, node bigint, n int, fp bigint, sketch binary, prefix array<bigint>")
    return stage_table(rows.withColumn("row", F.monotonically_increasing_id()), "sets")


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity."""
    num, den = SIMILARITY
    return np.minimum(a, b) * den >= np.maximum(a, b) * num


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches that come sorted by the first column, cut only where it changes."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy() for c in b.columns]
        h = cols[0]
        cut = int(np.searchsorted(h, h[-1]))
        if cut or (held and held[-1][0][-1] != h[0]):
            whole = [*held, [c[:cut] for c in cols]]
            yield [np.concatenate(c) for c in zip(*whole)]
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _meetings(few: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that meet at a shingle; where many meet, each of them (v) with the smallest (u), and no sizes."""
    names = ["u", "v", "nu", "nv", "pu", "pv"]
    for h, node, n, pos in _buckets(batches):
        o = np.lexsort((node, n, h))
        h, node, n, pos = h[o], node[o], n[o], pos[o]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[first, len(h)])
        least = np.repeat(np.minimum.reduceat(node, first), size)
        size = np.repeat(size, size)
        i = np.flatnonzero((size > 1) & (size <= few))
        for d in range(1, few):
            i = i[i + d < len(h)]
            i = i[(h[i + d] == h[i]) & _close(n[i], n[i + d])]  # sizes rise: none further on is closer
            if not len(i):
                break
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[i + d], n[i], n[i + d], pos[i], pos[i + d])], names=names)
        i = np.flatnonzero(size > few)
        if len(i):
            u, v = np.unique(np.stack([least[i], node[i]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *[pa.nulls(len(u), pa.int32())] * 4], names=names)


def _candidates(pairs: DataFrame) -> DataFrame:
    """(u, v) of the pairs that can reach the similarity, by what they share in the prefixes and all behind the last place
    there. A pair that also meets where many do may be dropped here; it is told there."""
    num, den = SIMILARITY
    turn = F.col("u") > F.col("v")
    turned = lambda a, b: [F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a), F.when(turn, F.col(a)).otherwise(F.col(b)).alias(b)]
    one = pairs.select(*turned("u", "v"), *turned("nu", "nv"), *turned("pu", "pv"))
    met = one.groupBy("u", "v", "nu", "nv").agg(F.count("*").alias("c"), F.max("pu").alias("pu"), F.max("pv").alias("pv"))
    most = F.col("c") + F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")) - 1
    return met.where(most * (num + den) >= (F.col("nu") + F.col("nv")) * num).select("u", "v")


_RANDOM = np.random.default_rng(17).integers(1, 1 << 63, (2, SKETCH), dtype=np.uint64)


def _sketch(s: np.ndarray) -> np.ndarray:
    """A byte of each of ``SKETCH`` minimum hashes of a set."""
    least = np.full(SKETCH, ~np.uint64(0))
    for k in range(0, len(s), 4096):
        least = np.minimum(least, (s[k : k + 4096, None] * (_RANDOM[0] | np.uint64(1)) + _RANDOM[1]).min(0))
    return (least >> np.uint64(32)).astype(np.uint8)


def _plausible(sketch: np.ndarray, n: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """A forest with the same groups as all pairs that pass by their sketches and sizes; with ``side``, of different sides."""
    label, out = np.arange(len(n)), []
    for i in range(1, len(n)):
        near = np.flatnonzero(_close(n[:i], n[i]) & (label[:i] != label[i]) & (True if side is None else side[:i] != side[i]))
        for j in near[np.count_nonzero(sketch[near] == sketch[i], axis=1) >= AGREE]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(j), i))
    return out


def _pieces(rows: DataFrame, group: str, size: Column) -> DataFrame:
    """Rows of (group, node, ...) dealt so that every two pieces of a group meet under one (group, one, two)."""
    counted = rows.groupBy(group).agg(F.ceil(size).cast("int").alias("pieces"))
    rows = rows.join(counted, group).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return rows.withColumns({"one": F.least("piece", "with"), "two": F.greatest("piece", "with")}).drop("pieces", "with")


def _forest(group: pa.Table, make: Callable) -> pa.Table:
    """The edges that ``make`` finds inside one piece, or between two."""
    node, piece = (group.column(c).to_numpy(zero_copy_only=False) for c in ("node", "piece"))
    across = len(node) and group.column("one")[0] != group.column("two")[0]
    found = make(group, piece if across else None) if len(node) else []
    u, v = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"u": pa.array(node[u], pa.int64()), "v": pa.array(node[v], pa.int64())})


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SKETCH)


def _linked(sets: list[np.ndarray], side: np.ndarray | None) -> list[tuple[int, int]]:
    """A forest with the same groups as all links between the sets; with ``side``, between sets of different sides."""
    num, den = SIMILARITY
    k = len(sets)
    n, sketch, label, out = np.array([len(s) for s in sets]), np.stack([_sketch(s) for s in sets]), np.arange(k), []
    start, every = np.cumsum(n) - n, np.concatenate(sets)
    for i in range(1, k):
        near = np.flatnonzero(_close(n[:i], n[i]) & (label[:i] != label[i]) & (True if side is None else side[:i] != side[i]))
        agree = np.count_nonzero(sketch[near] == sketch[i], axis=1)
        near, agree = near[agree >= AGREE], agree[agree >= AGREE]
        near = near[np.argsort(-agree, kind="stable")]
        a = 0
        while a < len(near):
            part = near[a : a + (4 if a == 0 else 256)]  # the likeliest first; most others are then in the same group
            a += len(part)
            part = part[label[part] != label[i]]
            if not len(part):
                continue
            edge = np.r_[0, np.cumsum(n[part])]
            value = every[np.repeat(start[part] - edge[:-1], n[part]) + np.arange(edge[-1])]
            found = sets[i][np.minimum(np.searchsorted(sets[i], value), n[i] - 1)] == value
            shared = np.add.reduceat(found.astype(np.int64), edge[:-1])
            for j in part[shared * (num + den) >= (n[part] + n[i]) * num]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    out.append((int(j), i))
    return out


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(u, v): candidates among sets (id, n, fp) by the fingerprint tree, at ``BITS`` bits or fewer, enough of them to join every
    group of such sets: of each fingerprint the set with the smallest id, and it with the others of its fingerprint."""
    some = nodes.where("n > 0").select("id", "fp")
    least = stage_table(some.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    side = lambda fp, name: least.select(F.col("fp").alias(fp), F.col("least").alias(name))
    apart = simhash.links(least.select("fp"), BITS).toDF("a", "b").join(side("a", "u"), "a").join(side("b", "v"), "b").select("u", "v")
    equal = some.join(least, "fp").where("id != least").select(F.col("least").alias("u"), F.col("id").alias("v"))
    return apart.union(equal)


def links(rows: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(u, v): pairs of different sets at the similarity or more, by the ids of ``nodes``, enough of them to join every group."""
    entries = rows.join(nodes.select(F.col("id").alias("row")), "row", "left_semi").select(F.posexplode("prefix").alias("pos", "h"), F.col("row").alias("node"), "n")
    entries = entries.select("h", "node", "n", "pos").repartition("h").sortWithinPartitions("h")
    met = stage_table(entries.mapInArrow(partial(_meetings, FEW), "u bigint, v bigint, nu int, nv int, pu int, pv int"), "meetings")
    sketches = nodes.select("id", "sketch")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0, 1]).filter(pa.array(np.count_nonzero(_bytes(b.column(2)) == _bytes(b.column(3)), axis=1) >= AGREE))

    def told(group: pa.Table) -> pa.Table:
        return _forest(group, lambda g, side: _plausible(_bytes(g.column("sketch")), g.column("n").to_numpy(zero_copy_only=False), side))

    def linked(group: pa.Table) -> pa.Table:
        return _forest(group, lambda g, side: _linked([shingles(t.as_py()) for t in g.column("t")], side))

    pairs = _candidates(met.where("nu is not null"))
    pairs = pairs.join(sketches.toDF("u", "a"), "u").join(sketches.toDF("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(agree, "u bigint, v bigint")
    meetings = _pieces(met.where("nu is null").select(F.col("u").alias("meeting"), F.col("v").alias("node")).distinct(), "meeting", F.count("*") / SKETCHES)
    meetings = meetings.join(nodes.select(F.col("id").alias("node"), "sketch", "n"), "node").groupBy("meeting", "one", "two").applyInArrow(told, "u bigint, v bigint")
    crowds = components(by_fingerprint(nodes).union(pairs).union(meetings))
    asked = stage_table(crowds.join(nodes.select(F.col("id").alias("node"), "k", "td", "n"), "node"), "asked")
    dealt = _pieces(asked.withColumnsRenamed({"k": "_k", "td": "_td"}), "component", F.greatest(F.count("*") / PIECE, F.sum("n") / PIECE_SHINGLES))
    in_crowd = bloom(asked.select(F.xxhash64("k", "td")))
    texts = docs.select(docs[key].alias("k"), F.xxhash64(text).alias("td"), docs[text].alias("t")).where(in_crowd(F.xxhash64("k", "td")))
    texts = texts.join(dealt, (F.col("td") == F.col("_td")) & F.col("k").eqNullSafe(F.col("_k"))).select("component", "one", "two", "node", "piece", "t")
    return stage_table(texts.groupBy("component", "one", "two").applyInArrow(linked, "u bigint, v bigint"), "links")


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, the one with the smallest key, with all its columns. A group is what links of
    ``SIMILARITY`` or more reach; texts without words are one group. A null key stays only where all keys of its group are
    null; of repeated rows (equal key and text) one stays."""
    rows = _sets(docs, key, text)
    least = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "td"))
    nodes = rows.groupBy("node").agg(least.alias("least"), F.min(F.struct("row", "td", "k")).alias("at"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"))
    nodes = stage_table(nodes.select("least", F.col("at.row").alias("id"), "at.k", "at.td", "n", "fp", "sketch"), "nodes")
    groups = components(links(rows, nodes, docs, key, text)).withColumnRenamed("node", "id")
    named = nodes.join(groups, "id", "left").groupBy(F.coalesce("component", "id").alias("group")).agg(F.min("least").alias("f"))
    first = named.select(F.col("f.k").alias("_k"), F.col("f.td").alias("_td"))
    found = rows.join(first, (F.col("td") == F.col("_td")) & F.col("k").eqNullSafe(F.col("_k")), "left")
    found = found.groupBy("k", "td").agg(F.count("*").alias("copies"), F.max(F.col("_td").isNotNull()).alias("stays"))
    # rows that surely stay as they are are not shuffled; of the others the few that stay are found by a join
    found = stage_table(found.where("not stays or copies > 1"), "found")
    asked = bloom(found.select(F.xxhash64("k", "td")))
    marked = docs.select(F.struct(*docs.columns).alias("_row"), docs[key].alias("_key"), F.xxhash64(text).alias("_text"))
    marked = marked.withColumn("_asked", asked(F.xxhash64("_key", "_text")))
    sure, rest = marked.where("not _asked").select("_row.*"), marked.where("_asked")
    match = (F.col("_text") == F.col("td")) & F.col("_key").eqNullSafe(F.col("k"))
    rest = rest.join(found, match, "left").where("stays is null or stays")
    number = Window.partitionBy("_key", "_text").orderBy("_text")
    again = rest.where("copies > 1").withColumn("_n", F.row_number().over(number)).where("_n = 1").select("_row.*")
    return sure.union(rest.where("copies is null").select("_row.*")).union(again)
