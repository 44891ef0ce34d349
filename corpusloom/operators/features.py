"""Feature arrays: windows over long passages, choices, sequences, spans, batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.examples import padded
from corpusloom.operators.order import numbered
from corpusloom.operators.rowwise import ints, lists, offsets_of, ranges, sizes_of


def window_starts(size: Column, length: Column, stride: int) -> Column:
    """Starts of windows of ``length`` every ``stride`` tokens, up to the first that reaches the end."""
    last = F.when(size <= length, 0).otherwise(F.ceil((size - length) / stride) * stride)
    return F.sequence(F.lit(0), last.cast("int"), F.lit(stride))


def windows(rows: DataFrame, tokens: str, length: Column, stride: int) -> DataFrame:
    """A row for each window, with ``window``, ``start`` and ``part`` (its tokens) in place of ``tokens``: windows are cut
    before they become rows, so no row carries the whole passage."""
    cut = F.transform(window_starts(F.size(tokens), length, stride), lambda at: F.struct(at.alias("start"), F.slice(F.col(tokens), at + 1, length.cast("int")).alias("part")))
    rest = [F.col(f"`{c}`") for c in rows.columns if c != tokens]
    return rows.select(*rest, F.posexplode(cut).alias("window", "_cut")).select(*rest, "window", "_cut.start", "_cut.part")


def pieces_of(words: Column, cut) -> Column:
    """array<struct<piece, source>>: the pieces of the words and the word each comes from; ``cut`` makes an array of a word."""
    return F.flatten(F.transform(words, lambda w, i: F.transform(cut(w), lambda p: F.struct(p.alias("piece"), i.alias("source")))))


def reading_features(rows: DataFrame, query: str, pieces: str, *, most: int, most_query: int = 64, stride: int = 128) -> DataFrame:
    """A row for each window of ``pieces`` (see :func:`pieces_of`) after a query cut at ``most_query`` tokens, with ``window``,
    ``start``, ``tokens`` ([CLS] query [SEP] window [SEP], ``most`` of them at most) and ``source``, an array of
    struct(pos, source): the source word of each place of the window. A stride is never more than a window is long."""
    if most < most_query + 4:
        raise ValueError("a query leaves no room for the text")
    q = rows.withColumn(query, F.slice(query, 1, most_query))
    room = F.lit(most) - F.size(query) - 3
    out = windows(q, pieces, room, min(stride, most - most_query - 3))
    cls, sep = F.array(F.lit("[CLS]")), F.array(F.lit("[SEP]"))
    tokens = F.concat(cls, F.col(query), sep, F.transform("part", lambda x: x["piece"]), sep)
    source = F.transform("part", lambda x, i: F.struct((i + F.size(query) + 2).alias("pos"), x["source"].alias("source")))
    return out.withColumns({"tokens": tokens, "source": source})


def max_context(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, window): for each place the window in which it has most context on its shorter side, the first of
    equals. ``parts``: (keys, window, start, size)."""
    inside = parts.select(*keys, "window", "start", "size", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos"))
    context = F.least(F.col("pos") - F.col("start"), F.col("start") + F.col("size") - 1 - F.col("pos")) * 100 + F.col("size")
    return inside.groupBy(*keys, "pos").agg(F.min_by("window", F.struct(-context, F.col("window"))).alias("window"))


def max_context_of(windows: Column) -> Column:
    """array<int>: the same for the windows of a row, array<struct<start, size>> in their order: the window of each place from 0
    on, null for a place in none."""

    def some(x: pa.Array) -> pa.Array:
        n, flat = sizes_of(x), x.flatten()
        start, size = (np.asarray(flat.field(c)).astype(np.int64) for c in ("start", "size"))
        row = np.repeat(np.arange(len(n)), n)
        upto = np.zeros(len(n), np.int64)
        np.maximum.at(upto, row, np.where(size > 0, start + size, 0))
        number = np.repeat(np.arange(len(size)) - offsets_of(n)[row], size)
        at = ranges(start, size)
        context = np.minimum(at - np.repeat(start, size), np.repeat(start + size, size) - 1 - at) * 100 + np.repeat(size, size)
        at += np.repeat(offsets_of(upto)[row], size)
        best = np.full(upto.sum(), -1, np.int64)
        np.maximum.at(best, at, context)
        good = np.flatnonzero(context == best[at])[::-1]
        window = np.full(upto.sum(), -1, np.int64)
        window[at[good]] = number[good]  # backwards, so that the first of equals is written last
        return lists(upto, ints(window, window >= 0))

    @F.arrow_udf("array<int>")
    def run(x: pa.Array) -> pa.Array:
        parts = [some(x.slice(i, 1000)) for i in range(0, len(x), 1000)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return run(windows)


def window_label(start: Column, size: Column, answer_start: Column, answer_end: Column, offset: Column) -> Column:
    """struct(start, end) of an answer inside a window, shifted by ``offset``; 0, 0 where it is not wholly inside."""
    inside = (answer_start >= start) & (answer_end < start + size)
    return F.when(inside, F.struct((answer_start - start + offset).alias("start"), (answer_end - start + offset).alias("end"))).otherwise(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))


def span_arrays(entities: Column, size: Column) -> tuple[Column, Column]:
    """Type ids at the starts and at the ends of entities, 0 elsewhere. ``entities``: array<struct<type int, start, end>>."""
    at = lambda which: F.transform(F.sequence(F.lit(0), size - 1), lambda p: F.coalesce(F.get(F.filter(entities, lambda e: e[which] == p), F.lit(0))["type"], F.lit(0)))
    return at("start"), at("end")


def sequence_features(tokens: Column, labels: Column, most: int, *, cls_at_end: bool = False, pad_left: bool = False) -> tuple[Column, Column]:
    """(tokens, labels) with specials labelled O, cut and padded to ``most``."""
    t, lab = F.slice(tokens, 1, most - 2), F.slice(labels, 1, most - 2)
    cls, sep, o = F.array(F.lit("[CLS]")), F.array(F.lit("[SEP]")), F.array(F.lit("O"))
    t = F.concat(t, sep, cls) if cls_at_end else F.concat(cls, t, sep)
    lab = F.concat(lab, o, o) if cls_at_end else F.concat(o, lab, o)
    return padded(t, most, "[PAD]", left=pad_left), padded(lab, most, "O", left=pad_left)


def batch_trim(rows: DataFrame, order: list[str], column: str, length: str, batch: int, *, by: str) -> DataFrame:
    """Arrays cut to the longest row of their batch. Batches are of ``batch`` rows in order within each ``by``."""
    placed = numbered(rows, order, by=[by], name="_place").withColumn("batch", F.floor(F.col("_place") / batch).cast("long")).drop("_place")
    longest = F.max(length).over(Window.partitionBy(by, "batch"))
    return placed.withColumn("longest", longest).withColumn(column, F.slice(F.col(column), F.lit(1), F.col("longest")))
