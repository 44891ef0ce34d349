"""Noisy copies of test sets: characters replaced by others of the same digit-free code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.codebook import invert
from corpusloom.operators.pretrain import draw


def groups(book: DataFrame, *, drop_punct: bool = False) -> DataFrame:
    """(ch, others): the other characters of each character's digit-free code."""
    rows = book.where(~T.is_punct("ch")) if drop_punct else book
    rows = rows.select("ch", T.drop_digits("code").alias("code"))
    both = rows.join(invert(rows), "code").groupBy("ch").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("chars")))).alias("all"))
    return both.select("ch", F.array_remove("all", F.col("ch")).alias("others"))


def noisy(rows: DataFrame, keys: list[str], text: str, same: DataFrame, permille: int, seed: int) -> DataFrame:
    """(keys, text, changed, chars): each character, with a chance of ``permille`` in a thousand, replaced by another of its
    group; one without others stays. Always from the original text; draws depend on seed, keys and place only."""
    chars = rows.select(*keys, F.posexplode_outer(F.filter(F.split(text, ""), lambda c: c != "")).alias("_pos", "ch"))
    found = chars.join(F.broadcast(same) if same.limit(100_001).count() <= 100_000 else same, "ch", "left")
    hit = (draw(seed, 1000, *keys, "_pos") < permille) & (F.size("others") > 0)
    other = F.get("others", draw(seed + 1, F.greatest(F.size("others"), F.lit(1)), *keys, "_pos").cast("int"))
    new = found.select(*keys, "_pos", F.when(F.coalesce(hit, F.lit(False)), other).otherwise(F.coalesce("ch", F.lit(""))).alias("_new"), "ch")
    packed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_new"))), lambda x: x["_new"]), "")
    changed = F.sum(F.when(F.col("_new") != F.col("ch"), 1).otherwise(0))
    return new.groupBy(*keys).agg(packed.alias(text), changed.alias("changed"), F.count("ch").alias("chars"))


def sweep(rows: DataFrame, keys: list[str], text: str, kinds: dict[str, DataFrame], rates: list[int], seed: int) -> DataFrame:
    """A noisy copy for each kind and rate, with ``kind`` and ``rate``."""
    parts = [noisy(rows, keys, text, same, rate, seed).select(F.lit(kind).alias("kind"), F.lit(rate).alias("rate"), *keys, text, "changed", "chars") for kind, same in kinds.items() for rate in rates]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
