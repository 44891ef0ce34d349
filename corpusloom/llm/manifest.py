"""A Merkle manifest of a dataset: a tree of digests over the rows of each source, a tree over the sources, and a proof for
each row.

A leaf is the digest of a row's fields. In each source the leaves ascend by key (equal keys by digest, so rows that are equal
in all fields are interchangeable); while several nodes remain, every ``FAN`` neighbours become one node. What remains is the
source's subroot; the subroots, in the order of the sources, give the root in the same way.

A node carries the interval of leaf ranks that it covers. Parents are found by a join of two neighbouring levels on the bucket
of the interval's start, where the parent's interval contains the child's; a node's siblings are the children that lie in the
difference of both intervals. A group of a join is one parent with its children, so a source with a third of all rows is many
small groups. Levels are made from the leaves up and ancestors are attached from the root down, so what moves shrinks by
``FAN`` with each level. Every level is a written table; the driver sees the largest number of leaves and nothing else.

Nulls: a null field has its own mark in the digest; rows without a source form a source of their own, which is the first; rows
without a key come first in their source. Empty and long texts are digested whole. An empty table gives no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import stage_table

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Digest of the concatenated parts, as hexadecimal text."""
    return F.sha2(F.concat(*parts), 256)


def leaf(values: list[Column]) -> Column:
    """Digest of a row's fields: ``-`` for a null, else the number of bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``rank``, the number of rows before each in its group ``g``, and ``n``, the rows of the group.

    Rows are cut into ranges of (g, order), which are written, so that a task that is run again sees the same ranges. Ranks
    are counted in a range and shifted by the group's rows in the ranges before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stage_table(rows.repartitionByRange(parts, "g", *order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("g", "part").agg(F.count("*").alias("rows"))
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("g", "part", before.alias("shift"), F.sum("rows").over(whole).alias("n"))
    inside = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order)) - 1
    return ranges.withColumn("inside", inside).join(shifts, ["g", "part"]).select(*rows.columns, (F.col("inside") + F.col("shift")).alias("rank"), "n")


def _bucket(level: int) -> Column:
    """Which node of ``level`` covers an interval, by the interval's start."""
    return F.floor(F.col("lo") / F.lit(FAN**level)).cast("long")


def _several(level: int) -> Column:
    """Whether a group has several nodes at ``level``."""
    return F.col("n") > FAN**level


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Tables (g, n, lo, hi, h, kids) of the nodes of each level. The first are the leaves, (g, n, rank, h) with columns of
    their own. A group's last node stands alone at the highest level that has one of its nodes."""
    nodes = leaves.withColumnRenamed("rank", "lo").withColumn("hi", F.col("lo"))
    most, out = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        out.append(nodes)
        level = len(out)
        if most <= FAN ** (level - 1):
            return out
        kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "h")))
        grouped = out[-1].where(_several(level - 1)).withColumn("bucket", _bucket(level)).groupBy("g", "n", "bucket").agg(kids.alias("kids"))
        hashed = F.sha2(F.array_join("kids.h", ""), 256)
        nodes = stage_table(grouped.select("g", "n", F.array_min("kids.lo").alias("lo"), F.array_max("kids.hi").alias("hi"), hashed.alias("h"), "kids"), "level")


def _beside(kids: Column, lo: Column, hi: Column) -> Column:
    """The digests of the siblings before and after the interval, each as one text."""

    def joined(which: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(F.filter(kids, which), lambda x: x["h"]), "")

    return F.struct(joined(lambda x: x["hi"] < lo).alias("before"), joined(lambda x: x["lo"] > hi).alias("after"))


def attach(tree: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """The leaves with ``path``, what lies beside each and beside each of its ancestors, nearest first, and what ``tops`` has.

    ``tops``: (g, path, *carried) of every group's last node. Each level takes its ancestors from the level above; a path is
    made where its node is and moves with it only if it has children.
    """
    above = None
    for level in range(len(tree) - 1, -1, -1):
        nodes = tree[level]
        keep = [*nodes.columns, "path", *carried]
        got = nodes.where(~_several(level)).join(tops, "g").select(keep)
        if above is not None:
            up = above.select("g", _bucket(level + 1).alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("kids").alias("row"), F.col("path").alias("rest"), *carried)
            down = nodes.where(_several(level)).withColumn("bucket", _bucket(level + 1))
            inside = down.join(up, ["g", "bucket"]).where("lo >= from and hi <= to")
            path = F.concat(F.array(_beside(F.col("row"), F.col("lo"), F.col("hi"))), F.col("rest"))
            got = got.unionByName(inside.withColumn("path", path).select(keep))
        above = got
    return above


def _tops(tree: list[DataFrame]) -> DataFrame:
    """(g, h) of every group's last node."""
    found = None
    for level, nodes in enumerate(tree):
        last = nodes.where(~_several(level)).where(_several(level - 1) if level else F.lit(True)).select("g", "h")
        found = last if found is None else found.union(last)
    return found


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest and its path give."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def proof(path: Column) -> Column:
    """The digests of a path as one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def manifest(docs: DataFrame, *, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, path, *extra) of every row. ``extra``: other columns that are made from the rows."""
    named = extra or {}
    g = F.coalesce(F.concat(F.lit("1"), docs[group].cast("string")), F.lit("0"))  # in the order of the sources, null first
    rows = docs.select(g.alias("g"), docs[key].alias("k"), leaf([docs[f] for f in fields]).alias("h"), *[c.alias(f"x_{n}") for n, c in named.items()])
    leaves = stage_table(ranked(stage_table(rows, "leaves"), ["k", "h"]), "leaves")
    tree = levels(leaves)
    subroots = stage_table(_tops(tree), "subroots")
    sources = stage_table(ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("source"), "h"), ["source"]), "sources")
    upper = levels(sources)
    nothing = F.array().cast(PATH).alias("path")
    over = attach(upper, _tops(upper).select("g", nothing, F.col("h").alias("root")), ["root"])
    tops = over.select(F.col("source").alias("g"), "path", F.col("h").alias("subroot"), "root")
    out = attach(tree, stage_table(tops, "tops"), ["subroot", "root"])
    return out.select(F.col("k").alias(key), F.col("h").alias("leaf"), "subroot", "root", "path", *[F.col(f"x_{n}").alias(n) for n in named])


def tampered(docs: DataFrame, *, key: str = "doc_id", text: str = "text", fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of a row whose text was lower-cased (A to Z), where 5 divides the checksum of its key; else null."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate(docs[text], capitals, capitals.lower())
    changed = leaf([low if f == text else docs[f] for f in fields])
    return F.when(F.crc32(docs[key].cast("string").cast("binary")) % 5 == 0, changed)


def audit(docs: DataFrame, *, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, seen: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: ``seen`` is the leaf that was found later
    (null: the row is unchanged); it is held against the root by the row's proof."""
    made = manifest(docs, key=key, group=group, fields=fields, extra={"seen": F.lit(None).cast("string") if seen is None else seen})
    made = made.withColumn("folded_root", fold(F.coalesce("seen", "leaf"), F.col("path"))).withColumn("proof_sha256", F.sha2(proof(F.col("path")), 256))
    return made.select(key, "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
