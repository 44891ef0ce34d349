"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has ``RING`` places; a key's place is the top bits of its hash. Every shard has virtual nodes on the ring, and a
key belongs to the first one clockwise. Each shard has a capacity; keys that overflow a full shard continue clockwise to
the next virtual node whose shard has room. How many keys of which stretch of the ring (arc) go where follows from the
number of keys at each place alone, so only these counts (at most ``RING`` of them, whatever the table's size) come to the
driver; each row then finds its shard by its rank within its arc.

With ``load`` None the capacities add up to the number of rows, so counts are at most one apart. With a factor of 1 or more
the capacity is that factor times the mean, and fewer rows move when shards are added.

Null keys are placed like any other value; rows that are equal in all of key, size and checksum are interchangeable. Null
texts have size 1 and checksum 0. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import math
from collections import defaultdict

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stage_table

RING_BITS = 16
RING = 1 << RING_BITS


def virtual_nodes(shards: int, each: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, clockwise; of nodes at one place the first shard's stays."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for k in range(each):
            at.setdefault(xxhash.xxh64_intdigest(f"{shard}/{k}".encode(), 7) >> (64 - RING_BITS), shard)
    return sorted(at.items())


def flow(owners: list[int], waiting: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, first slot): which keys of each arc, by rank, a shard takes, and the slot of the first.

    First every virtual node takes keys of its own arc while its shard has room; then in each round what is left moves on
    by one virtual node.
    """
    room, filled = list(capacity), [0] * len(capacity)
    out, queue = [], defaultdict(list)
    for arc, n in enumerate(waiting):
        if n:
            queue[arc].append((arc, 0, n))
    while queue:
        later = defaultdict(list)
        for node in sorted(queue):
            shard = owners[node]
            for arc, lo, hi in queue[node]:
                take = min(room[shard], hi - lo)
                if take:
                    out.append((arc, lo, lo + take, shard, filled[shard]))
                    room[shard] -= take
                    filled[shard] += take
                if lo + take < hi:
                    later[(node + 1) % len(owners)].append((arc, lo + take, hi))
        if sum(room) <= 0 and later:
            raise ValueError("capacities are too small")
        queue = later
    return out


def assign(docs: DataFrame, shards: int, *, key: str = "doc_id", text: str = "text", each: int = 128, load: float | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of each row; slots of a shard have no gaps and start at 0."""
    spark = docs.sparkSession
    nodes = virtual_nodes(shards, each)
    if len({s for _, s in nodes}) < shards:
        raise ValueError("more virtual nodes are needed")
    places, owners = [p for p, _ in nodes], [s for _, s in nodes]
    hashed = F.xxhash64(docs[key])
    place = F.shiftrightunsigned(hashed, 64 - RING_BITS)
    counts = stage_table(docs.select(place.cast("int").alias("place")).groupBy("place").count(), "ring")
    per_place = {r["place"]: r["count"] for r in counts.collect()}
    arc_of = lambda p: bisect.bisect_left(places, p) % len(places)
    waiting = [0] * len(places)
    for p, n in per_place.items():
        waiting[arc_of(p)] += n
    total = sum(waiting)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    parts = flow(owners, waiting, quota if load is None else [max(math.ceil(load * total / shards), 1)] * shards)

    def small(rows: list, schema: str) -> DataFrame:
        """A table of at most as many rows as the ring has places."""
        return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")

    arcs = [{"arc": a, "a": (places[a - 1] + 1) if a else -(RING - 1 - places[-1]), "b": places[a]} for a in range(len(places))]
    spread = small(arcs, "arc:int,a:int,b:int").select("arc", F.explode(F.sequence("a", "b")).alias("turn"))
    spread = spread.select("arc", "turn", F.pmod("turn", F.lit(RING)).alias("place")).join(counts, "place")
    before = F.sum("count").over(Window.partitionBy("arc").orderBy("turn")) - F.col("count")
    offsets = spread.select("place", "arc", before.alias("before"))
    taken = small([dict(zip(("arc", "lo", "hi", "shard", "first"), p)) for p in parts], "arc:int,lo:bigint,hi:bigint,shard:int,first:bigint")

    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key], (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), hashed.alias("_h"), place.cast("int").alias("place"))
    order = Window.partitionBy("place").orderBy("_h", key, "text_crc32", "size")
    ranked = rows.withColumn("_n", F.row_number().over(order) - 1).join(F.broadcast(offsets), "place").withColumn("_n", F.col("_n") + F.col("before"))
    placed = ranked.join(F.broadcast(taken), "arc").where("_n >= lo and _n < hi")
    return placed.select(key, "size", "text_crc32", "shard", (F.col("first") + F.col("_n") - F.col("lo")).alias("slot"))
