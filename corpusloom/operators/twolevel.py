"""Features of two levels: the sub-characters of a text, and the tokens of the same text that they belong to.

Both are segmentations of one text. Sub-characters are cut to the length that a model takes; which tokens are left, their ids
and the range of tokens of each sub-character are derived from what the cut leaves, so the levels cannot come apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import rowwise, tokens
from corpusloom.operators.examples import mask_of, padded, truncate_pair
from corpusloom.operators.rowwise import by_rows, heads_of, ints, lists, offsets_of, owners_of, ranges, sizes_of

#: Pieces of passages that are cut into windows at once, about; a passage is not parted.
PIECES = 200_000


def owners(rows: DataFrame, keys: list[str], subs: str, whole: str, out: str) -> DataFrame:
    """The rows with ``out``, for each of ``subs`` the one of ``whole`` that holds its start."""
    return rows.withColumn(out, rowwise.owner(subs, whole))


def _with_ids(rows: DataFrame, keys: list[str], columns: list[str], vocab: DataFrame) -> tuple[DataFrame, int, int]:
    """(the rows with ids in place of tokens, the id of [CLS], that of [SEP]). A vocabulary that tasks hold is looked up where
    the rows are; a larger one is joined, and keys name a row."""
    table = tokens.held_table(vocab, "token", "id") if dict(vocab.dtypes)["id"] == "int" else None
    if table is not None:
        look = tokens.id_lookup(rows.sparkSession, table)
        return rows.withColumns({c: look(c) for c in columns}), table.get("[CLS]") or 0, table.get("[SEP]") or 0
    for c in columns:
        ids, _ = tokens.to_ids(rows, keys, c, vocab, held=0)
        rows = rows.drop(c).join(ids.withColumnRenamed("ids", c), keys)
    marks = {r["token"]: r["id"] for r in vocab.where(F.col("token").isin("[CLS]", "[SEP]")).groupBy("token").agg(F.max("id").alias("id")).collect()}
    return rows, marks.get("[CLS]", 0), marks.get("[SEP]", 0)


def _count(owner: Column) -> Column:
    """How many tokens the sub-characters that are left have touched."""
    return F.coalesce(F.try_element_at(owner, F.lit(-1)) + 1, F.lit(0))


def _features(rows: DataFrame, keys: list[str], subs: tuple[int, int], whole: tuple[int, int], most: int, *, pair: bool) -> DataFrame:
    """Both levels of rows (keys, sa, ta, oa[, sb, tb, ob]) of ids that are cut already: each token has an owner's number.
    ``subs`` and ``whole``: the ids of [CLS] and [SEP]."""
    one = lambda x: F.array(x)
    n = F.size("ta")

    def joined(a: str, b: str, cls: int, sep: int) -> Column:
        ends = one(F.lit(sep))
        return F.concat(one(F.lit(cls)), F.col(a), ends, *((F.col(b), ends) if pair else ()))

    segments = F.array_repeat(F.lit(0), F.size("sa") + 2)
    place = F.concat(one(F.lit(0)), F.transform("oa", lambda x: x + 1), one(n + 1))
    if pair:
        segments = F.concat(segments, F.array_repeat(F.lit(1), F.size("sb") + 1))
        place = F.concat(place, F.transform("ob", lambda x: x + n + 2), one(n + F.size("tb") + 2))
    r = rows.select(*keys, joined("sa", "sb", *subs).alias("ids"), joined("ta", "tb", *whole).alias("token_ids"), segments.alias("segments"), place.alias("left"))
    r = r.withColumn("right", F.transform("left", lambda x, i: F.greatest(F.coalesce(F.get("left", i + 1), F.size("token_ids")), x + 1)))
    fit = lambda c, fill=0: padded(F.col(c), most, fill).alias(c)
    return r.select(*keys, padded(F.col("ids"), most).alias("input_ids"), mask_of(F.col("ids"), most).alias("input_mask"), fit("segments"), fit("token_ids"), padded(F.col("left"), most, -1).alias("pos_left"), padded(F.col("right"), most, -1).alias("pos_right"))


def two_level(rows: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str] | None, sub_vocab: DataFrame, token_vocab: DataFrame, most: int) -> DataFrame:
    """(keys, input_ids, input_mask, segments, token_ids, pos_left, pos_right), each ``most`` long: [CLS] A [SEP] or [CLS] A
    [SEP] B [SEP] of sub-characters, the ids of the tokens that hold them, and for each sub-character the range of tokens,
    -1 where there is none. ``a`` and ``b``: columns of (sub-characters, tokens); vocabularies: (id, token)."""
    r = owners(rows.select(*keys, F.col(a[0]).alias("sa"), F.col(a[1]).alias("ta"), *([F.col(b[0]).alias("sb"), F.col(b[1]).alias("tb")] if b else [])), keys, "sa", "ta", "oa")
    if b:
        r = owners(r, keys, "sb", "tb", "ob")
        ka, kb = truncate_pair(F.size("sa"), F.size("sb"), most - 3)
        r = r.withColumns({"_ka": ka, "_kb": kb})
        r = r.withColumns({c: F.slice(c, F.lit(1), F.col(k)) for c, k in (("sa", "_ka"), ("oa", "_ka"), ("sb", "_kb"), ("ob", "_kb"))})
        r = r.withColumn("tb", F.slice("tb", F.lit(1), _count(F.col("ob"))))
    else:
        r = r.withColumns({c: F.slice(c, 1, most - 2) for c in ("sa", "oa")})
    r = r.withColumn("ta", F.slice("ta", F.lit(1), _count(F.col("oa"))))
    r, *subs = _with_ids(r, keys, ["sa", "sb"] if b else ["sa"], sub_vocab)
    r, *whole = _with_ids(r, keys, ["ta", "tb"] if b else ["ta"], token_vocab)
    return _features(r, keys, subs, whole, most, pair=b is not None)


def _windows_of(s: pa.Array, o: pa.Array, t: pa.Array, room: np.ndarray, stride: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """How many windows each passage has, and their fields start, first, sb, ob and tb, one window's after the other: they are cut
    from the flat arrays, so that one costs its own length and not the passage's."""
    n, m = sizes_of(s), sizes_of(t)
    many = np.where(n <= room, 1, -(-(n - room) // stride) + 1)
    row = np.repeat(np.arange(len(n)), many)
    start = ranges(np.zeros(len(n), np.int64), many) * stride
    size = np.minimum(room[row], n[row] - start)
    at = ranges(offsets_of(n)[row] + start, size)
    subs, own, whole = (np.append(np.asarray(x.flatten()), 0).astype(np.int64) for x in (s, o, t))
    some, begin = size > 0, np.minimum(offsets_of(n)[row] + start, len(own) - 1)
    first = np.where(some, own[begin], 0)
    tokens = np.where(some, own[np.minimum(begin + np.maximum(size, 1) - 1, len(own) - 1)] + 1 - first, 0)
    of_tokens = ranges(offsets_of(m)[row] + first, tokens)
    return many, {"start": ints(start), "first": ints(first), "sb": lists(size, ints(subs[at])), "ob": lists(size, ints(own[at] - np.repeat(first, size))), "tb": lists(tokens, ints(whole[of_tokens]))}


def _windows(sb: Column, ob: Column, tb: Column, room: Column, stride: int) -> Column:
    """array<struct<start, first, sb, ob, tb>>: the windows of a passage."""

    @F.arrow_udf("array<struct<start:int,first:int,sb:array<int>,ob:array<int>,tb:array<int>>>")
    @by_rows
    def run(s: pa.Array, o: pa.Array, t: pa.Array, length: pa.Array) -> pa.Array:
        many, fields = _windows_of(s, o, t, np.asarray(length).astype(np.int64), stride)
        return lists(many, pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    return run(sb, ob, tb, room)


def _by_pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``PIECES`` pieces of that column."""
    of = np.cumsum(sizes_of(batch.column(column))) // PIECES
    cuts = np.flatnonzero(np.diff(of)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(start, stop - start)


def _held_windows(rows: DataFrame, keys: list[str], sub_table: dict, token_table: dict, most: int, most_query: int, stride: int) -> DataFrame:
    """(keys, window, sa, ta, oa, start, first, sb, ob, tb) of rows (keys, sa, ta, sb, tb) of texts, in one pass: a task holds a batch
    as it came and the windows of a slice of it, whatever the passages' lengths, and no second Python beside it."""
    spark = rows.sparkSession
    sub_ids, token_ids = tokens.ids_of(spark, sub_table), tokens.ids_of(spark, token_table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_pieces(batch, "sb") if batch.num_rows else ():
                sa, ta, sb, tb = (part.column(c) for c in ("sa", "ta", "sb", "tb"))
                oa = heads_of(owners_of(sa, ta), most_query)
                sa = heads_of(sa, most_query)
                n, last = sizes_of(oa), np.append(np.asarray(pc.fill_null(oa.flatten(), -1)), -1)
                ta = heads_of(ta, np.where(n > 0, last[offsets_of(n)[1:] - 1], -1) + 1)
                many, fields = _windows_of(sub_ids(sb), owners_of(sb, tb), token_ids(tb), most - n - 3, stride)
                row = pa.array(np.repeat(np.arange(len(many)), many))
                query = {"sa": sub_ids(sa), "ta": token_ids(ta), "oa": oa}
                columns = {k: part.column(k).take(row) for k in keys} | {"window": ints(ranges(np.zeros(len(many), np.int64), many))} | {c: x.take(row) for c, x in query.items()} | fields
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kinds = dict(rows.dtypes)
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return rows.select(*keys, "sa", "ta", "sb", "tb").mapInArrow(run, f"{out}, window int, sa array<int>, ta array<int>, oa array<int>, start int, first int, sb array<int>, ob array<int>, tb array<int>")


def two_level_windows(
    rows: DataFrame, keys: list[str], query: tuple[str, str], passage: tuple[str, str], sub_vocab: DataFrame, token_vocab: DataFrame, *, most: int, most_query: int = 64, stride: int = 128
) -> DataFrame:
    """The same for every window of a passage's sub-characters after a query of at most ``most_query`` of them; also
    ``window``, ``start`` (sub-character) and ``first`` (token): in a window both levels count from its own first ones."""
    if most < most_query + 4:
        raise ValueError("a query leaves no room for the text")
    r = rows.select(*keys, *[F.col(c).alias(n) for c, n in zip((*query, *passage), ("sa", "ta", "sb", "tb"))])
    stride = min(stride, most - most_query - 3)
    tables = [tokens.held_table(v, "token", "id") if dict(v.dtypes)["id"] == "int" else None for v in (sub_vocab, token_vocab)]
    if None not in tables:
        subs, whole = ((t.get("[CLS]") or 0, t.get("[SEP]") or 0) for t in tables)
        return _features(_held_windows(r, keys, *tables, most, most_query, stride), [*keys, "window", "start", "first"], subs, whole, most, pair=True)
    r = owners(owners(r, keys, "sa", "ta", "oa"), keys, "sb", "tb", "ob")
    r = r.withColumns({c: F.slice(c, 1, most_query) for c in ("sa", "oa")})
    r = r.withColumn("ta", F.slice("ta", F.lit(1), _count(F.col("oa"))))
    r, *subs = _with_ids(r, keys, ["sa", "sb"], sub_vocab)
    r, *whole = _with_ids(r, keys, ["ta", "tb"], token_vocab)
    cut = _windows(F.col("sb"), F.col("ob"), F.col("tb"), F.lit(most) - F.size("sa") - 3, stride)
    w = r.select(*keys, "sa", "ta", "oa", F.posexplode(cut).alias("window", "w")).select(*keys, "window", "sa", "ta", "oa", "w.*")
    return _features(w, [*keys, "window", "start", "first"], subs, whole, most, pair=True)
