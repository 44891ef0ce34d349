"""Alignment of two segmentations of one text: interval joins inside a text's key.

A segmentation is an array of strings whose concatenation is the text without white space. Every join has an equality on
the keys, so no pair of different texts ever meets. Keys name a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, keys: list[str], pieces: str) -> DataFrame:
    """(keys, pos, piece, start, stop): where each piece lies in the concatenation."""
    flat = rows.select(*keys, F.posexplode(pieces).alias("pos", "piece"))
    before = F.sum(F.length("piece")).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return flat.withColumn("stop", before).withColumn("start", F.col("stop") - F.length("piece")).select(*keys, "pos", "piece", "start", "stop")


def holder(points: DataFrame, units: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``points`` (with a column start) and, in ``held``, ``value`` of the unit that lies there: the last one that starts at
    the point or before it. One sort of both sides by key and place; units and points of one text never meet pairwise."""
    kind = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in points.schema if f.name not in keys) + ">"
    held = units.select(value.alias("v")).schema["v"].dataType
    a = points.select(*keys, "start", F.lit(1).alias("_kind"), F.struct(*[c for c in points.columns if c not in keys]).alias("_row"), F.lit(None).cast(held).alias("_v"))
    b = units.select(*keys, "start", F.lit(0).alias("_kind"), F.lit(None).cast(kind).alias("_row"), value.alias("_v"))
    order = Window.partitionBy(*keys).orderBy("start", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("held", F.last("_v", ignorenulls=True).over(order)).where("_kind = 1").select(*keys, "_row.*", "held")


def owner(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, owner): for each piece of ``inner`` the piece of ``outer`` that holds its start."""
    return holder(inner.select(*keys, "pos", "start"), outer, keys, F.col("pos")).where("held is not null").select(*keys, "pos", F.col("held").alias("owner"))


def subchar_to_token(subchars: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    return owner(subchars, tokens, keys)


def token_to_subchar(subchars: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """For each token the sub-character that its first character belongs to."""
    return owner(tokens, subchars, keys).withColumnRenamed("owner", "first")


def inverse_text_index(rows: DataFrame, keys: list[str], text: str, tokens: DataFrame) -> DataFrame:
    """(keys, pos, text_pos): the place in the text of each token's first character, and the text's length at the end.
    White space in the text belongs to no token."""
    chars = rows.select(*keys, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("text_pos", "ch"))
    full = chars.where(~F.col("ch").rlike(r"(?U)\s")).withColumn("start", F.row_number().over(Window.partitionBy(*keys).orderBy("text_pos")) - 1)
    found = tokens.select(*keys, "pos", "start").join(full.select(*keys, "start", "text_pos"), [*keys, "start"]).select(*keys, "pos", "text_pos")
    ends = rows.select(*keys, F.length(text).alias("text_pos")).join(tokens.groupBy(*keys).agg((F.max("pos") + 1).alias("pos")), keys)
    return found.unionByName(ends.select(*keys, "pos", "text_pos"))


def labels_to_tokens(spans: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, label): entity spans (keys, type, start, stop; stop exclusive) on the tokens they touch. One token gets S,
    more get B and then I; tokens outside get O. Where spans share a token the later one counts."""
    first = holder(spans.select(*keys, "type", "start", "stop"), tokens, keys, F.col("pos"))
    ends = first.select(*keys, "type", F.col("start").alias("_from"), F.col("held").alias("_a"), (F.col("stop") - 1).alias("start"))
    both = holder(ends, tokens, keys, F.col("pos")).where("_a is not null and held is not null")
    touched = both.select(*keys, "type", "_from", "_a", F.col("held").alias("_b"), F.explode(F.sequence("_a", "held")).alias("pos"))
    tag = F.when(F.col("_a") == F.col("_b"), "S").when(F.col("pos") == F.col("_a"), "B").otherwise("I")
    last = touched.groupBy(*keys, "pos").agg(F.max_by(F.concat(tag, F.lit("-"), F.col("type")), "_from").alias("label"))
    return tokens.join(last, [*keys, "pos"], "left").select(*keys, "pos", F.coalesce("label", F.lit("O")).alias("label"))


def spread_label(label: Column, nth: Column, size: Column) -> Column:
    """The label of the ``nth`` (from 0) of ``size`` pieces of something labelled: B then I; a single piece keeps S."""
    kind = F.substring(label, 3, 1000)
    return (
        F.when(label == "O", label).when((size == 1) | (label.startswith("I-")), label)
        .when(nth == 0, F.concat(F.lit("B-"), kind)).otherwise(F.concat(F.lit("I-"), kind))
    )


def labels_to_pieces(labelled: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, label): labels of larger units (keys, pos, start, label) on the pieces that start in them."""
    held = holder(pieces.select(*keys, "pos", "start"), labelled, keys, F.struct("pos", "label")).where("held is not null")
    unit = Window.partitionBy(*keys, "_unit")
    rows = held.select(*keys, "pos", F.col("held.pos").alias("_unit"), F.col("held.label").alias("_label"))
    rows = rows.withColumns({"_n": F.row_number().over(unit.orderBy("pos")) - 1, "_size": F.count("*").over(unit)})
    return rows.select(*keys, "pos", spread_label(F.col("_label"), F.col("_n"), F.col("_size")).alias("label"))


def labels_to_chars(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, label): labels of tokens (keys, pos, start, stop, label) on the characters that they cover, the inverse of
    :func:`labels_to_tokens`. A B and the I of its type that follow it are one entity over all their characters, S if these
    are one; an S over several characters becomes B and I; an I that continues nothing stays I; a token may cover none."""
    order = Window.partitionBy(*keys).orderBy("pos")
    kind, before = F.substring("label", 3, 1000), F.lag("label").over(order)
    goes_on = F.col("label").startswith("I-") & (F.substring(before, 3, 1000) == kind) & (before != "O")
    run = F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    r = labelled.select(*keys, "pos", "start", "stop", "label", kind.alias("_kind"), run.alias("_run"))
    whole = Window.partitionBy(*keys, "_run")
    in_order = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of_run = F.first("label").over(in_order).startswith("B-")
    begin = F.when(of_run, F.min("start").over(whole)).otherwise(F.col("start"))
    size = F.when(of_run, F.sum(F.col("stop") - F.col("start")).over(whole)).otherwise(F.col("stop") - F.col("start"))
    r = r.withColumns({"_whole": of_run, "_begin": begin, "_size": size}).where("stop > start")
    c = r.select("*", F.explode(F.sequence("start", F.col("stop") - 1)).alias("_at"))
    as_it_is = (F.col("label") == "O") | (F.col("label").startswith("I-") & ~F.col("_whole"))
    tag = F.when(F.col("_size") == 1, "S-").when(F.col("_at") == F.col("_begin"), "B-").otherwise("I-")
    return c.select(*keys, F.col("_at").alias("pos"), F.when(as_it_is, F.col("label")).otherwise(F.concat(tag, "_kind")).alias("label"))


def label_ids(rows: DataFrame, labels: DataFrame, keys: list[str], names: list[str], most: int, *, edge: int, fill: int = 0) -> DataFrame:
    """(keys, ids): an array for each of ``rows``, ``edge`` at both ends of its labels' ids (``names`` from 1 on), filled up to
    ``most``; longer ones are not cut."""
    number = F.array_position(F.array(*map(F.lit, names)), F.col("label")).cast("int")
    packed = labels.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", number.alias("id")))), lambda x: x["id"]).alias("_ids"))
    ids = F.concat(F.array(F.lit(edge)), F.coalesce("_ids", F.array().cast("array<int>")), F.array(F.lit(edge)))
    padded = F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(F.lit(most) - F.size(ids), F.lit(0))))
    return rows.select(*keys).join(packed, keys, "left").select(*keys, padded.alias("ids"))


def pos_left_right(owners: DataFrame, keys: list[str], n_tokens: DataFrame) -> DataFrame:
    """(keys, pos, left, right): the token of each sub-character and that of the next one, at least one apart; the last one's
    right end is the number of tokens (keys, n)."""
    nxt = F.lead("owner").over(Window.partitionBy(*keys).orderBy("pos"))
    both = owners.withColumn("_next", nxt).join(n_tokens, keys)
    return both.select(*keys, "pos", F.col("owner").alias("left"), F.greatest(F.coalesce("_next", "n"), F.col("owner") + 1).alias("right"))


def nearest_filled(mapping: DataFrame, keys: list[str], *, is_start: bool, size: Column | None = None) -> DataFrame:
    """(keys, pos, value): ``value``, or where it is null one that lies between the nearest filled neighbours: just after
    the left one for a start, just before the right one for an end. ``size``: the number of values there can be."""
    order = Window.partitionBy(*keys).orderBy("pos")
    left = F.last("value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("value", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    m = mapping.withColumns({"_l": left, "_r": right})
    lo, hi = F.col("_l"), F.col("_r")
    only_right = F.when(hi >= 1, F.lit(0) if is_start else hi - 1).otherwise(hi)
    only_left = lo if size is None else F.when(lo < size - 1, lo + 1 if is_start else size - 1).otherwise(lo)
    between = F.when(hi > lo + 1, lo + 1 if is_start else hi - 1).otherwise(hi if is_start else lo)
    value = F.when(F.col("value").isNotNull(), F.col("value")).when(lo.isNull(), only_right).when(hi.isNull(), only_left).otherwise(between)
    return m.select(*keys, "pos", value.alias("value"))


def improve_span(tokens: Column, start: Column, end: Column, answer: Column) -> Column:
    """struct(start, end): the first inner span whose tokens joined by spaces are the tokenised answer; else the span itself.
    Tokens hold no spaces, so a span has as many tokens as the answer, and each place is looked at once."""
    size = F.size(F.split(answer, " "))
    last = end - size + 1
    places = F.when(last >= start, F.sequence(start, F.greatest(last, start))).otherwise(F.array().cast("array<int>"))
    good = F.filter(places, lambda s: F.array_join(F.slice(tokens, s + 1, size), " ") == answer)
    first = F.get(good, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first.alias("start"), (first + size - 1).alias("end"))).otherwise(F.struct(start.alias("start"), end.alias("end")))
