"""SimHash fingerprints and near-duplicate groups by a distributed vantage-point tree.

Fingerprints of 64 bits are cut into blocks; each block has a vantage point, and a fingerprint's distance to it within the
block is its *ring* there. By the triangle inequality two fingerprints at distance d have rings whose differences, added up
over the blocks, are d at most. The top of the tree partitions by the rings of a few wide blocks: a shard is one vector of
rings. A fingerprint is stored in its own shard and sent as a query to those shards whose vectors differ from its own by
``max_bits`` in all, which are the only ones that can hold a partner. Inside a shard the tree goes on over narrow blocks:
at each level a query visits the children that its remaining budget reaches, and where few candidates are left they are
compared bit by bit. The result is exact.

Shards of one place get more pieces where they hold more fingerprints, so no task grows with a dense region, and a piece
returns a forest of links (nodes and no more edges than nodes) in place of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.common import stage_table

#: Vantage points: any constant does; this one has as many ones as zeros.
VANTAGE = 0x9E3779B97F4A7C15
#: Fingerprints stored in one piece of a shard, about.
PIECE = 20_000
#: Pairs compared at once.
BLOCK = 1 << 20


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the XXH64 (seed 42) of a text's word shingles: a bit is 1 if it is in over half of them.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z in lower case. A text of fewer words than
    ``width`` has one shingle, one without words or a null has fingerprint 0.
    """
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only those six characters separate
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) > width else [b" ".join(words)]
    return majority(np.fromiter(map(_hash, shingles), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of these 64-bit numbers."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _hash(shingle: bytes) -> int:
    return xxhash.xxh64_intdigest(shingle, 42)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of each row as a signed 64-bit number. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["k", "fp"])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {dict(docs.dtypes)[key]}, fp bigint").withColumnRenamed("k", key)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def blocks(levels: int) -> list[int]:
    """Masks of ``levels`` blocks that together are all 64 bits."""
    edge = [round(64 * k / levels) for k in range(levels + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:])]


def _rings(fp: Column, levels: int) -> list[Column]:
    return [F.bit_count(fp.bitwiseXOR(F.lit(signed(VANTAGE))).bitwiseAND(F.lit(signed(m)))) for m in blocks(levels)]


def _levels(n: int) -> int:
    """More levels, so smaller shards, for more fingerprints."""
    return 2 if n < 20_000 else 3 if n < 30_000_000 else 4


def _weight(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a)


class _Leaf:
    """Links between the queries and the stored fingerprints of one piece, collected as small forests."""

    def __init__(self, max_bits: int):
        self.max_bits, self.u, self.v = max_bits, [], []

    def visit(self, s: np.ndarray, q: np.ndarray, used: np.ndarray, masks: list[np.uint64]) -> None:
        """One node of the tree: stored ``s`` against queries ``q`` that have ``used`` of their budget above."""
        if not len(s) or not len(q):
            return
        if not masks or len(s) * len(q) <= BLOCK // 8:
            for k in range(0, len(q), max(1, BLOCK // len(s))):
                self.compare(s, q[k : k + max(1, BLOCK // len(s))])
            return
        mask, rest = masks[0], masks[1:]
        ring_s, ring_q = _weight((s ^ np.uint64(VANTAGE)) & mask).astype(np.int64), _weight((q ^ np.uint64(VANTAGE)) & mask).astype(np.int64)
        for ring in np.unique(ring_s):
            now = used + np.abs(ring_q - ring)
            reach = now <= self.max_bits
            self.visit(s[ring_s == ring], q[reach], now[reach], rest)

    def compare(self, s: np.ndarray, q: np.ndarray) -> None:
        for k in range(0, len(s), BLOCK):
            part = s[k : k + BLOCK]
            near = _weight(part[None, :] ^ q[:, None]) <= self.max_bits
            near &= part[None, :] != q[:, None]
            n = int(np.count_nonzero(near))
            if n > 4 * (len(part) + len(q)):
                self.forest(near, part, q)
            elif n:
                i, j = np.nonzero(near)
                self.u.append(q[i])
                self.v.append(part[j])

    def forest(self, near: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        """The same groups as all links of the block would give, by trees of 16 children a node."""
        top = len(s) + len(q)
        ls = np.where(near.any(0), np.arange(len(s)), top)
        while True:
            lq = np.where(near, ls[None, :], top).min(1)
            new = np.minimum(ls, np.where(near, lq[:, None], top).min(0))
            if (new == ls).all():
                break
            ls = new
        label, value = np.r_[ls, lq], np.r_[s, q]
        value, label = value[label < top], label[label < top]
        value, label = (lambda o: (value[o], label[o]))(np.lexsort((value, label)))
        first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        place = np.arange(len(label)) - np.repeat(first, np.diff(np.r_[first, len(label)]))
        child = np.flatnonzero(place)
        self.u.append(value[child])
        self.v.append(value[child - place[child] + (place[child] - 1) // 16])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.u:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pair = np.stack([np.concatenate(self.u), np.concatenate(self.v)])
        pair.sort(axis=0)
        pair = np.unique(pair, axis=1)
        return pair[0].view(np.int64), pair[1].view(np.int64)


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """(u, v): links between different fingerprints at ``max_bits`` or fewer, enough of them to join every group.

    ``nodes`` has distinct fingerprints in a column fp. The table of shards that is broadcast has at most one row for each
    vector of rings (about 10,600 for three levels, 83,500 for four), however many rows there are.
    """
    spark = nodes.sparkSession
    levels = _levels(nodes.count())
    widths = [m.bit_count() for m in blocks(levels)]
    base = [1]
    for w in widths[:-1]:
        base.append(base[-1] * (w + 1 + 2 * max_bits))
    rings = _rings(F.col("fp"), levels)
    own = sum((r.cast("int") + max_bits) * b for r, b in zip(rings, base))
    placed = nodes.select("fp", own.alias("shard"))
    sizes = placed.groupBy("shard").count().select("shard", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces"))
    # half of the ball around a vector, so that of two shards one is asked by the other
    offsets = [sum(d * b for d, b in zip(v, base)) for v in product(range(-max_bits, max_bits + 1), repeat=levels) if sum(map(abs, v)) <= max_bits and v[::-1] >= (0,) * levels]
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    stored = placed.join(F.broadcast(sizes), "shard").select("fp", "shard", piece.alias("piece"), F.lit(False).alias("asks"))
    asking = placed.select("fp", F.explode(F.array(*[F.col("shard") + o for o in offsets])).alias("shard"), F.col("shard").alias("home"))
    asking = asking.join(F.broadcast(sizes), "shard").where("shard != home or pieces > 1")
    asking = asking.select("fp", "shard", "home", piece.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    asking = asking.where("shard != home or piece > mine").select("fp", "shard", "piece", F.lit(True).alias("asks"))
    narrow = [np.uint64(((1 << 4) - 1) << (4 * k)) for k in range(16)]

    def join(_: tuple, group: pa.Table) -> pa.Table:
        fp, asks = group.column("fp").to_numpy().view(np.uint64), group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        s, q = np.sort(fp[~asks]), np.sort(fp[asks])
        leaf = _Leaf(max_bits)
        for x in (s, q):
            leaf.visit(s, x, np.zeros(len(x), np.int64), narrow)
        u, v = leaf.edges()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return stored.union(asking).groupBy("shard", "piece").applyInArrow(join, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """(key, fp, fingerprint, component_id): component_id is the smallest key that is reachable over links of ``max_bits``
    or fewer differing bits, the row itself included.

    Null and empty texts have fingerprint 0 and are linked like any other; a null key keeps its row and counts for no
    component unless all keys of a group are null; repeated rows give repeated rows. Only ``key`` and ``text`` are read.
    """
    rows = stage_table(fingerprints(docs, key=key, text=text, width=width), "fingerprints")
    nodes = stage_table(rows.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    groups = components(links(nodes.select("fp"), max_bits))
    named = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = stage_table(named, "named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = named.join(ids, "component").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(key, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of each group of :func:`near_duplicates`, the one with the smallest key, with all its columns. Of repeated
    rows (equal key and text) one stays; a null key stays only where all keys of its group are null."""
    groups = near_duplicates(docs, key=key, text=text, width=width, max_bits=max_bits)
    first = groups.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_first")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), docs[key].alias("_key"), F.xxhash64(text).alias("_text"))
    kept = rows.join(first, F.col("_key").eqNullSafe(F.col("_first")), "left_semi")
    again = Window.partitionBy("_key", "_text").orderBy("_text")
    return kept.withColumn("_n", F.row_number().over(again)).where("_n = 1").select("_row.*")
