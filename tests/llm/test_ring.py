"""The ring key by key: a second implementation, which moves lists of keys and no counts."""

import bisect
import math
import random

import pytest
import xxhash

from corpusloom.llm import ring


def plain_ring(rows, shards, each, load):
    """[(key, shard, slot)] of rows (key, size, crc)."""
    at = {}
    for s in range(shards):
        for k in range(each):
            at.setdefault(xxhash.xxh64_intdigest(f"{s}/{k}".encode(), 7) >> 48, s)
    places = sorted(at)
    hashed = lambda key: 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    arcs = [[] for _ in places]
    for key, size, crc in rows:
        h = hashed(key)
        p = h >> 48
        arc = bisect.bisect_left(places, p) % len(places)
        arcs[arc].append((p if p <= places[-1] else p - (1 << 16), h, key is not None, key or 0, crc, size, key))
    total = len(rows)
    room = [total // shards + (s < total % shards) for s in range(shards)] if load is None else [max(math.ceil(load * total / shards), 1)] * shards
    slots, out = [0] * shards, []
    waiting = {n: [sorted(keys)] for n, keys in enumerate(arcs) if keys}
    while waiting:
        moved = {}
        for node in sorted(waiting):
            shard = at[places[node]]
            for keys in waiting[node]:
                n = min(room[shard], len(keys))
                for k in keys[:n]:
                    out.append((k[-1], shard, slots[shard]))
                    slots[shard] += 1
                room[shard] -= n
                if keys[n:]:
                    moved.setdefault((node + 1) % len(places), []).append(keys[n:])
        waiting = moved
    return sorted(out, key=repr)


@pytest.mark.parametrize("shards, each, load", [(16, 128, None), (5, 3, None), (7, 16, 1.25), (3, 1, 1.0), (1, 1, None)])
def test_ring_is_that_of_single_keys(spark, shards, each, load):
    rng = random.Random(shards)
    keys = [rng.randrange(-(10**12), 10**12) for _ in range(900)] + [7, 7, 7, None, None, 0, -1]
    docs = spark.createDataFrame([(k, "t" * (i % 5)) for i, k in enumerate(keys)], "doc_id bigint, text string").repartition(4)
    got = ring.assign(docs, shards, each=each, load=load).collect()
    rows = [(r["doc_id"], r["size"], r["text_crc32"]) for r in got]
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got if r["doc_id"] is not None) == sorted(x for x in plain_ring(rows, shards, each, load) if x[0] is not None)
    assert sorted(repr((r["doc_id"], r["shard"], r["slot"])) for r in got) == sorted(map(repr, plain_ring(rows, shards, each, load)))
