"""Task metrics as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusloom.operators.order import numbered


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def accuracy(rows: DataFrame, pred: str, gold: str) -> DataFrame:
    return rows.agg(F.avg((F.col(pred) == F.col(gold)).cast("int")).alias("acc"))


def _counts(rows: DataFrame, pred: str, gold: str) -> DataFrame:
    p, g = F.col(pred) == 1, F.col(gold) == 1
    return rows.agg(F.count("*").alias("n"), _n(p & g).alias("tp"), _n(p & ~g).alias("fp"), _n(~p & g).alias("fn"), _n(~p & ~g).alias("tn"))


def acc_f1(rows: DataFrame, pred: str, gold: str) -> DataFrame:
    c = _counts(rows, pred, gold).select(((F.col("tp") + F.col("tn")) / F.col("n")).alias("acc"), F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))
    return c.withColumn("acc_and_f1", (F.col("acc") + F.col("f1")) / 2)


def matthews(rows: DataFrame, pred: str, gold: str) -> DataFrame:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return _counts(rows, pred, gold).select(F.when(under == 0, 0.0).otherwise((tp * tn - fp * fn) / under).alias("mcc"))


def pearson_spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Both correlations and their mean. Ranks come from the counts of distinct values in
    order."""

    def ranked(c: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count("*").alias("_n"))
        return numbered(counts, [c], weight="_n", name="_before").select(c, (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"_r{c}"))

    both = rows.join(ranked(x), x).join(ranked(y), y)
    return both.agg(F.corr(x, y).alias("pearson"), F.corr(f"_r{x}", f"_r{y}").alias("spearman")).withColumn("corr", (F.col("pearson") + F.col("spearman")) / 2)


def exact_match(pred: Column, answers: Column, clean) -> Column:
    return F.exists(answers, lambda a: clean(a) == clean(pred)).cast("int")


def _longest_run(a: np.ndarray | None, b: np.ndarray | None) -> int:
    """One row of the dynamic programme after the other, each over all of ``b`` at once."""
    if a is None or b is None or not len(a) or not len(b):
        return 0
    place = {x: k for k, x in enumerate(dict.fromkeys(x for x in b if x is not None))}
    y, best, row = np.array([place.get(x, -2) for x in b]), 0, np.zeros(len(b) + 1, np.int64)
    for x in a:
        k = place.get(x)
        if k is None:
            row[:] = 0
            continue
        row[1:] = (row[:-1] + 1) * (y == k)
        best = max(best, int(row.max()))
    return best


@F.pandas_udf(LongType())
def _longest_runs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_longest_run(x, y) for x, y in zip(a, b)], dtype="int64")


def lcs(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, lcs): length of the longest common run of two arrays. Each row is told by itself in time of the product of its
    two lengths and memory of one; no elements meet across rows, so frequent ones cost nothing more. Nulls match nothing."""
    return rows.select(*keys, _longest_runs(a, b).alias("lcs"))


def f1_of(run: Column, pred: Column, gold: Column) -> Column:
    """F1 of a common run and the sizes of both sides."""
    p, r = F.try_divide(run, pred), F.try_divide(run, gold)
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def best_f1(rows: DataFrame, keys: list[str], pred: str, answers: str) -> DataFrame:
    """(keys, f1): the best F1 of the longest common runs with any of the ``answers`` (an array of arrays); 0 without one."""
    each = rows.select(*keys, F.col(pred).alias("_p"), F.posexplode_outer(answers).alias("_k", "_g"))
    scores = each.select(*keys, f1_of(_longest_runs("_p", "_g"), F.size("_p"), F.size("_g")).alias("f1"))
    return scores.groupBy(*keys).agg(F.max("f1").alias("f1"))


def qa_report(scored: DataFrame) -> DataFrame:
    """Percentages over all questions; ``f1`` and ``em`` are null for a question without an answer, which counts as 0."""
    pct = lambda c: 100 * F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) / F.count("*")
    out = scored.agg(pct("f1").alias("f1"), pct("em").alias("em"), F.count("*").alias("total"), _n(F.col("f1").isNull()).alias("skipped"))
    return out.withColumn("average", (F.col("f1") + F.col("em")) / 2)


def qa_report_negative(scored: DataFrame, kind: str) -> DataFrame:
    """Adds the accuracy of YES, NO and unanswerable questions (null where there are none)."""
    part = lambda k: F.try_divide(100.0 * F.sum(F.when(F.col(kind) == k, F.coalesce("em", F.lit(0))).otherwise(0)), _n(F.col(kind) == k))
    more = scored.agg(part("YES").alias("yes_acc"), part("NO").alias("no_acc"), part("unanswerable").alias("unanswerable_acc"))
    return qa_report(scored).join(more, F.lit(True))


def prf(gold: DataFrame, pred: DataFrame, on: list[str], type_: str = "type") -> DataFrame:
    """(type, found, gold, right, precision, recall, f1) for each gold type and, with a null type, overall. Entities are equal
    if all of ``on`` are; repeated ones count once."""
    g, p = gold.select(*on).distinct(), pred.select(*on).distinct()
    both = g.withColumn("_g", F.lit(1)).join(p.withColumn("_p", F.lit(1)), on, "full")
    c = both.rollup(type_).agg(_n(F.col("_p") == 1).alias("found"), _n(F.col("_g") == 1).alias("gold"), _n((F.col("_p") == 1) & (F.col("_g") == 1)).alias("right"))
    ratio = lambda b: F.coalesce(F.try_divide(F.col("right"), F.col(b)), F.lit(0.0))
    c = c.where(F.col(type_).isNull() | (F.col("gold") > 0)).withColumns({"precision": ratio("found"), "recall": ratio("gold")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return c.withColumn("f1", f1)


def best_epoch(scores: DataFrame, by: list[str], score: str, *, latest: bool = True) -> DataFrame:
    """The epoch of the best score of each run; of equal ones the latest or the earliest."""
    tie = F.desc("epoch") if latest else F.asc("epoch")
    return scores.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))).where("_n = 1").drop("_n")
