"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Measures of a text: its words (runs of characters other than space and U+0009 to U+000D), their code points, symbols,
lines, stop words, and words in three-word windows that occur twice or more. A rule is a ratio of two measures and the
bounds, in thousandths, within which it must lie. Everything is integer arithmetic on JVM-side expressions, evaluated row
by row without a shuffle.

Null and empty texts have no words and fail the base rules; a ratio with a zero denominator passes. Repeated rows give
repeated results; empty tables give empty results; other columns are kept (a clash with a measure's name is an error of
the caller only in :func:`measure`; :func:`keep` adds no columns).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words of four languages (fixed values).
STOP_WORDS = (
    "the of and to in a is that it for as with was on be at by this are or from an not have had but which you all were "
    "de la le les et des en un du une que est pour qui dans par plus pas au sur ne se ce avec il sont "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es werden aus er hat "
    "el y los del las con no una su para al lo como más o pero sus"
).split()


class Rule(NamedTuple):
    """``least`` <= 1000 * numerator / denominator <= ``most``; a bound may be None."""

    name: str
    numerator: str
    denominator: str
    least: int | None
    most: int | None


#: The production table.
RULES = (
    Rule("symbols a word", "n_symbols", "n_words", None, 100),
    Rule("characters a word", "word_chars", "n_words", 2000, 15000),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 500),
    Rule("stop words", "n_stop_words", "n_words", 30, None),
)
BASE_WORDS, BASE_REPEATS = 50, 500
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
SPACES = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that are found twice or more: windows are sorted with their places, equal neighbours
    give places, and the places' words are counted once each."""
    three = F.sequence(F.lit(0), F.size(words) - 3)

    def window(i: Column) -> Column:
        return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def covered(s: Column) -> Column:
        twin = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda k: (F.get(s, k)["g"] == F.coalesce(F.get(s, k - 1)["g"], F.lit(""))) | (F.get(s, k)["g"] == F.coalesce(F.get(s, k + 1)["g"], F.lit(""))),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twin, lambda k: _let(F.get(s, k)["p"], lambda p: F.array(p, p + 1, p + 2))))))

    places = F.transform(three, lambda i: F.struct(window(i).alias("g"), i.alias("p")))
    several = _let(F.transform(three, window), lambda g: F.size(F.array_distinct(g)) < F.size(g))
    return F.when(F.size(words) < 4, 0).when(several, _let(F.sort_array(places), covered)).otherwise(0)


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    return F.struct(_let(words, of_words).alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("s"))


def _values(m: Column) -> dict[str, Column]:
    """The measures by name, from a struct of :func:`measures`."""
    w, lines = m["w"], m["l"]
    got = {"n_words": w["n_words"], "word_chars": w["word_chars"], "n_symbols": m["s"], "n_lines": lines["n"], "n_dup_lines": lines["dup"], "n_repeat_words": w["n_repeat_words"], "n_stop_words": w["n_stop_words"]}
    return {k: v.cast("long") for k, v in got.items()}


def _bounds(rule: Rule, v: dict[str, Column]) -> Column:
    up, down = v[rule.numerator] * 1000, v[rule.denominator]
    checks = [up >= down * rule.least] * (rule.least is not None) + [up <= down * rule.most] * (rule.most is not None)
    ok = F.lit(True)
    for check in checks:
        ok = ok & check
    return ok | (down == 0)


def _base_failed(v: dict[str, Column]) -> Column:
    return (v["n_words"] < BASE_WORDS) | (v["n_repeat_words"] * 1000 > v["n_words"] * BASE_REPEATS)


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a text passes the base rules and the table. One expression that makes its measures once, so that it stays
    one when the optimizer moves a filter."""

    def judge(m: Column) -> Column:
        v = _values(m)
        ok = ~_base_failed(v)
        for rule in rules:
            ok = ok & _bounds(rule, v)
        return ok

    return _let(measures(text), judge)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text") -> DataFrame:
    """The rows with all measures, base_failed, failed_rules and kept. A column of ``docs`` that has one of these names gives
    way to it; the text is read before, so it may be one of them. ``keep`` returns all columns as they were."""
    m = docs.withColumn("__quality", measures(docs[text]))
    m = m.withColumns(_values(F.col("__quality"))).drop("__quality")
    v = {k: F.col(k) for k in MEASURES}
    failed = F.array_compact(F.array(*[F.when(~_bounds(r, v), F.lit(r.name)) for r in rules]))
    m = m.withColumns({"base_failed": _base_failed(v), "failed_rules": failed})
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text") -> DataFrame:
    """The rows that pass all rules, with their own columns only."""
    return docs.where(verdict(docs[text], rules))
