"""Pretraining examples: shards, chunks, sentence pairs, masks. All randomness is a hash of a seed and keys, so results do
not depend on how rows are dealt over tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.examples import truncate_pair
from corpusloom.operators.order import numbered
from corpusloom.sources.sinks import scratch


#: Chunks of one document that are asked of a partner in one row.
ASKED = 1024


def draw(seed: int, n: Column | int, *keys: Column | str) -> Column:
    """An even number from 0 to n - 1 for these keys."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    value = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("long")
    return F.pmod(value, n if isinstance(n, Column) else F.lit(n))


def ranked(rows: DataFrame, first: str, key: str, *, seed: int = 0, buckets: int = 64) -> DataFrame:
    """The rows with a gapless ``rank`` from 0 by ``first`` descending, in hashed order among equals. Ranks are counted inside
    small groups (a value of ``first`` and a bucket) and shifted by the groups' totals, so no task sorts everything."""
    r = rows.withColumns({"_b": draw(seed, buckets, key), "_h": F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))})
    groups = r.groupBy(first, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(F.desc(first), "_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    offsets = groups.select(first, "_b", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(first, "_b").orderBy("_h", key)) - 1
    return r.withColumn("_r", inside).join(offsets, [first, "_b"]).withColumn("rank", F.col("_r") + F.col("_before")).drop("_b", "_h", "_r", "_before")


def _levelled(room: list[int], size: int, n: int) -> list[int]:
    """How many of ``n`` equal documents each shard gets if each goes to the one with most room, the first of several.

    A shard's k-th document finds it with room - (k - 1) * size; the ``n`` largest of these numbers win. The least of them is
    found by halving, so the work does not grow with ``n``.
    """

    def above(level: int) -> list[int]:
        return [max(0, -((level - r) // size)) if r > level else 0 for r in room]  # how often a room stays over the level

    low, high = min(room) - size * (n + 1), max(room)
    while high - low > 1:  # more than n are over low, at most n over high
        middle = (low + high) // 2
        low, high = (middle, high) if sum(above(middle)) > n else (low, middle)
    got = above(high)
    left = n - sum(got)
    for i, r in enumerate(room):  # those that are level with it, in order
        if left and r - got[i] * size == high:
            got[i] += 1
            left -= 1
    return got


def pack(sizes: list[tuple[int, int]], budgets: list[int]) -> list[tuple[int, int, int, int]]:
    """(size, shard, first, end): which documents of a size, by their number among equals, a shard gets.

    ``sizes``: (size, documents). Largest first, a document goes to the shard with most of its budget left; budgets that are
    used up go on below nought, all alike. Where there are no more documents than empty shards, these get them. A document
    without a size counts as one of size 1.
    """
    room, empty, out = list(budgets), set(range(len(budgets))), []
    left = sum(n for _, n in sizes)
    for size, n in sorted(sizes, reverse=True):
        got = [0] * len(room)
        while n:
            free = min(n, left - len(empty))
            if free > 0:
                given = _levelled(room, max(size, 1), free)
            else:
                i = max(empty, key=lambda e: (room[e], -e))
                free, given = 1, [int(k == i) for k in range(len(room))]
            for i, k in enumerate(given):
                got[i] += k
                room[i] -= k * max(size, 1)
                if k:
                    empty.discard(i)
            n, left = n - free, left - free
        first = 0
        for i, k in enumerate(got):
            if k:
                out.append((size, i, first, first + k))
            first += k
    return out


def shard_balance(docs: DataFrame, size: str, key: str, shards: int, *, test_shards: int | None = None, test_permille: int = 100, seed: int = 0) -> DataFrame:
    """The documents with ``split`` and ``shard``: every document is in one shard; the shards of a split get equal budgets of
    sentences, and documents go largest first to the shard with most room (:func:`pack`), so that shards differ by little and
    none is empty unless there are fewer documents than shards.

    What comes to the driver is the number of documents of each size. Documents are numbered among those of their size, in a
    hashed order and in ranges (:func:`order.numbered`), so a frequent size is no single task; a size's plan is looked up.
    """
    test_shards = shards if test_shards is None else test_shards
    sized, path = docs.withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long")), scratch(docs.sparkSession, "sizes")
    sized.write.parquet(path)  # counting, numbering and placing read it, and sizes may be dear
    sized = docs.sparkSession.read.schema(sized.schema).parquet(path)
    counts = [(r["_size"], r["n"]) for r in sized.groupBy("_size").agg(F.count("*").alias("n")).collect()]
    total = sum(z * n for z, n in counts)
    training = total * (1000 - test_permille) // 1000
    budgets = [training // shards] * shards + [(total - training) // max(test_shards, 1)] * test_shards
    plans: dict[int, tuple[list[int], list[int]]] = {}
    for z, shard, _, end in pack(counts, budgets):
        ends, names = plans.setdefault(z, ([], []))
        ends.append(end)
        names.append(shard)
    table = docs.sparkSession.createDataFrame([(z, *p) for z, p in plans.items()], "_size bigint, _ends array<bigint>, _shards array<int>")
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    placed = numbered(sized.withColumn("_mixed", mixed), ["_mixed", key], by=["_size"], name="_place").join(table, "_size")
    shard = F.get("_shards", F.size(F.filter("_ends", lambda e: e <= F.col("_place"))))
    split = F.when(shard < shards, "training").otherwise("test")
    return placed.select(*docs.columns, split.alias("split"), F.when(shard < shards, shard).otherwise(shard - shards).cast("long").alias("shard"))


def duplicate(docs: DataFrame, times: int) -> DataFrame:
    return docs.withColumn("dupe", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def chunk_target(most: int, short_permille: int, seed: int, *keys: Column | str) -> Column:
    """The target of a document: ``most``, or with a chance of ``short_permille`` in a thousand an even number from 2 to it."""
    short = draw(seed, 1000, *keys, F.lit("short")) < short_permille
    return F.when(short, 2 + draw(seed, most - 1, *keys, F.lit("target"))).otherwise(most)


def pack_chunks(docs: DataFrame, key: str, sizes: str, target: int | Column) -> DataFrame:
    """(key, chunk, first, last): sentences are collected until their tokens reach the target or the document ends.
    ``sizes``: the numbers of tokens of a document's sentences."""
    wanted = target if isinstance(target, Column) else F.lit(target)

    def one(batches):
        for pdf in batches:
            out = []
            for k, lengths, most in zip(pdf[key], pdf["sizes"], pdf["_most"]):
                first, total, chunk = 0, 0, 0
                for i, n in enumerate(lengths):
                    total += n
                    if total >= most or i == len(lengths) - 1:
                        out.append((k, chunk, first, i))
                        first, total, chunk = i + 1, 0, chunk + 1
            yield pd.DataFrame(out, columns=[key, "chunk", "first", "last"])

    return docs.select(key, F.col(sizes).alias("sizes"), wanted.cast("long").alias("_most")).mapInPandas(one, f"{key} {dict(docs.dtypes)[key]}, chunk bigint, first bigint, last bigint")


def _draw(seed: int, n: int, *keys: object) -> int:
    """What :func:`draw` gives for these keys."""
    return int(hashlib.md5("|".join(map(str, (seed, *keys))).encode()).hexdigest()[:7], 16) % n


def fold_chunks(key: str, sizes: list[int], most: int, seed: int) -> list[tuple[int, int, int, int, bool, int]]:
    """(chunk, first, last, cut, follows, left) of a document's chunks, in order.

    Sentences are collected until their tokens reach ``most`` or the document ends. The first ``cut`` of them are part A. If B
    does not follow, which is so by a coin and for a single sentence, the rest of the chunk is put back: the next chunk begins
    after A, and B is to have ``left`` tokens.
    """
    out, first, total, i = [], 0, 0, 0
    while i < len(sizes):
        total += sizes[i]
        if total >= most or i == len(sizes) - 1:
            chunk, several = len(out), i > first
            cut = 1 + _draw(seed, i - first, key, chunk, "cut") if several else 1
            follows = several and _draw(seed, 2, key, chunk, "next") == 0
            out.append((chunk, first, i, cut, follows, most - sum(sizes[first : first + cut])))
            first, total = (i + 1 if follows else first + cut), 0
            i = first - 1
        i += 1
    return out


def next_sentence(docs: DataFrame, key: str, sizes: str, most: int | Column, seed: int) -> DataFrame:
    """(key, chunk, first, last, cut, is_next, b_doc, b_first, b_last): part A is ``cut`` sentences from ``first``; part B the
    sentences ``b_first`` to ``b_last`` of ``b_doc``.

    ``sizes``: the numbers of tokens of a document's sentences; those without tokens, and documents without any, do not count.
    B follows A in the chunk, or it begins at a random sentence of another document and fills up to the chunk's target, and
    then sentences of the chunk that are not in A are used again (:func:`fold_chunks`). Only if there is no other document is
    it the same, with ``is_next`` false. Texts are cut once, into written tables of sizes and of ranked documents. What is asked
    of a partner meets its sizes in one row for up to ``ASKED`` questions, so sizes are not copied to each of them.
    """
    wanted = most if isinstance(most, Column) else F.lit(most)
    full = docs.select(key, F.filter(sizes, lambda n: n > 0).cast("array<bigint>").alias("_sizes"), wanted.cast("long").alias("_most")).where(F.size("_sizes") > 0)
    full = _staged(full.withColumn("_count", F.size("_sizes")), "sizes")
    places = _staged(ranked(full, "_count", key, seed=seed).select(key, "_count", "_sizes", "_most", "rank"), "places")
    total = places.count()
    kind = dict(docs.dtypes)[key]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, r, *c) for k, name, r, s, m in zip(pdf[key], pdf["_name"], pdf["rank"], pdf["_sizes"], pdf["_most"]) for c in fold_chunks(name, s.tolist(), m, seed)]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "_r", "chunk", "first", "last", "cut", "is_next", "_left"])

    named = places.select(key, F.col(key).cast("string").alias("_name"), "rank", "_sizes", "_most")
    kinds = f"{key} {kind}, chunk bigint, first bigint, last bigint, cut bigint, is_next boolean"
    c = _staged(named.mapInPandas(fold, f"{key} {kind}, _r bigint, chunk bigint, first bigint, last bigint, cut bigint, is_next boolean, _left bigint"), "chunks")
    follows = c.where("is_next").select(key, "chunk", "first", "last", "cut", "is_next", F.col(key).alias("b_doc"), (F.col("first") + F.col("cut")).alias("b_first"), F.col("last").alias("b_last"))
    others = c.where("not is_next").withColumn("_p", F.pmod(F.col("_r") + 1 + draw(seed, max(total - 1, 1), key, "chunk", F.lit("doc")), F.lit(max(total, 1))))
    partner = places.select(F.col("rank").alias("_p"), F.col(key).alias("b_doc"), F.col("_count").cast("long").alias("_n"), "_sizes")
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("chunk").cast("string"), F.lit("start"))), 1, 7), 16, 10).cast("long")
    one = F.struct(key, "chunk", "first", "last", "cut", "is_next", "_left", hashed.alias("_h"))
    asked = others.select("_p", F.floor(F.col("chunk") / ASKED).alias("_part"), one.alias("_q")).groupBy("_p", "_part").agg(F.collect_list("_q").alias("_q"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked_of, questions = np.diff(b.column("_q").offsets.to_numpy()), b.column("_q").flatten()
            size, sizes = np.diff(b.column("_sizes").offsets.to_numpy()), b.column("_sizes").flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), asked_of)
            ends = np.cumsum(size)
            running, begin = np.r_[0, np.cumsum(sizes)], (ends - size)[row]
            at = questions.field("_h").to_numpy() % size[row]
            last = np.searchsorted(running[1:], running[begin + at] + questions.field("_left").to_numpy())
            last = np.minimum(np.maximum(last, begin + at), ends[row] - 1) - begin
            cols = [questions.field(n) for n in (key, "chunk", "first", "last", "cut", "is_next")]
            yield pa.RecordBatch.from_arrays([*cols, b.column("b_doc").take(pa.array(row)), pa.array(at), pa.array(last)], names=[key, "chunk", "first", "last", "cut", "is_next", "b_doc", "b_first", "b_last"])

    met = asked.join(partner, "_p").select("_q", "b_doc", "_sizes")
    return follows.union(met.mapInArrow(fill, f"{kinds}, b_doc {kind}, b_first bigint, b_last bigint"))


def _staged(rows: DataFrame, name: str) -> DataFrame:
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def front_drops(n: Column, seed: int, *keys: Column | str) -> Column:
    """How many of ``n`` dropped tokens are taken from the front: each with probability one half."""
    coins = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: draw(seed, 2, *keys, i))
    return F.when(n > 0, F.aggregate(coins, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(0)


def truncate_random(a: Column, b: Column, most: int, seed: int, *keys: Column | str) -> tuple[Column, Column]:
    """Two sequences cut to ``most`` in all: the longer loses one (the second, if equal) until they fit, each time at its front
    or at its back with even chances."""
    left = truncate_pair(F.size(a), F.size(b), most)

    def cut(x: Column, n: Column, name: str) -> Column:
        front = front_drops(F.size(x) - n, seed, *keys, F.lit(name))
        return F.slice(x, (front + 1).cast("int"), n)

    return cut(a, left[0], "a"), cut(b, left[1], "b")


def masked_count(size: Column, permille: int, most: int) -> Column:
    """min(most, max(1, round(size * p))), halves to even."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.bround(size * F.lit(permille / 1000)).cast("int")))


def mask_places(tokens: Column, count: Column, seed: int, *keys: Column | str) -> tuple[Column, Column]:
    """(places, labels): the ``count`` places of least hash that are no specials, in order, and the tokens there."""
    special = ["[CLS]", "[SEP]"]
    at = F.filter(F.transform(tokens, lambda t, i: F.struct(draw(seed, 1 << 28, *keys, i).alias("h"), i.alias("i"), t.isin(special).alias("s"))), lambda x: ~x["s"])
    places = F.array_sort(F.transform(F.slice(F.array_sort(at), F.lit(1), count), lambda x: x["i"]))
    return places, F.transform(places, lambda i: F.get(tokens, i))


def mask(rows: DataFrame, keys: list[str], tokens: str, count: Column, vocab: DataFrame, seed: int) -> DataFrame:
    """(keys, tokens, places, labels): of the places of :func:`mask_places` eight in ten are masked, one keeps its token, one
    gets an even draw of the whole vocabulary (id from 0 without gaps, token). Keys name a row.

    A replacement is drawn as an id, and ids are joined to the vocabulary: about one token in a hundred takes part.
    """
    size = vocab.count()
    places, labels = mask_places(F.col(tokens), count, seed, *keys)
    r = rows.select(*keys, F.col(tokens).alias("_t"), places.alias("places"), labels.alias("labels"))
    how = lambda i: draw(seed + 1, 10, *keys, i)
    drawn = r.select(*keys, F.explode(F.filter("places", lambda i: how(i) > 8)).alias("_i")).withColumn("id", draw(seed + 2, max(size, 1), *keys, "_i"))
    others = drawn.join(vocab.select("id", "token"), "id").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_i", "token"))).alias("_other"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = r.alias("a").join(others.alias("b"), same, "left").select("a.*", "_other")

    def change(t: Column, i: Column) -> Column:
        return F.when(how(i) < 8, "[MASK]").when(how(i) == 8, t).otherwise(F.coalesce(F.element_at("_other", i), t))

    return both.select(*keys, F.transform("_t", lambda t, i: F.when(F.array_contains("places", i), change(t, i)).otherwise(t)).alias("tokens"), "places", "labels")


def dense_labels(places: Column, ids: Column, size: int) -> Column:
    """-1 everywhere but at masked places; what follows the first padded place (0) is no label."""
    n = F.coalesce(F.nullif(F.array_position(places, 0), F.lit(0)) - 1, F.size(places)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.coalesce(F.get(ids, (F.nullif(F.array_position(F.slice(places, F.lit(1), n), p), F.lit(0)) - 1).cast("int")), F.lit(-1)))


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """A global random order."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])))
