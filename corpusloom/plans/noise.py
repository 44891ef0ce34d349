"""Queries of noise and of tables of runs, on the benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import codebook as C
from corpusloom.operators import noise as N
from corpusloom.plans.base import query, table
from corpusloom.plans.codebooks import LETTERS, NO_DIGITS, book, code, coded, per_char
from corpusloom.plans.pretraining import d

# Names of tokenizers, longer ones before those that they contain.
FAMILIES = (
    "pinyin_concat_wubi pinyin_shuffled wubi_shuffled pinyin_no_index wubi_no_index pinyin_cws wubi_cws cws_raw cws_wubi cws_zhuyin "
    "cangjie stroke pinyin wubi zhengma zhuyin raw bert"
).split()


def others(scheme: str) -> dict[str, str]:
    plain = {c: code(scheme, k).rstrip("0123456789") for k, c in enumerate(LETTERS)}
    return {c: "".join(sorted(x for x in LETTERS if x != c and plain[x] == plain[c])) for c in LETTERS}


def noisy_sql(scheme: str, permille: int, seed: int) -> str:
    table_ = "MAP {" + ", ".join(f"'{c}': '{o}'" for c, o in others(scheme).items()) + "}"
    return (
        f"SELECT item_id, string_agg(CASE WHEN hit THEN o[other + 1] ELSE c END, '' ORDER BY p) AS text, count(*) FILTER (hit) AS changed, count(*) AS chars FROM (SELECT *, "
        f"length(o) > 0 AND {d(seed, 1000, 'item_id', 'p')} < {permille} AS hit, {d(seed + 1, 'greatest(length(o), 1)', 'item_id', 'p')} AS other FROM (SELECT item_id, p, c, coalesce(({table_})[c], '') AS o FROM "
        "(SELECT item_id, unnest(range(length(text))) AS p, unnest(list_filter(string_split(lower(text), ''), lambda x: x <> '')) AS c FROM benchmark))) GROUP BY item_id"
    )


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("text"))


@query("noise_same_sound", noisy_sql("pinyin", 300, 11))
def noise_same_sound(spark, sf_dir):
    return N.noisy(items(spark, sf_dir), ["item_id"], "text", N.groups(book(spark)), 300, 11)


@query("noise_same_shape", noisy_sql("wubi", 300, 11))
def noise_same_shape(spark, sf_dir):
    return N.noisy(items(spark, sf_dir), ["item_id"], "text", N.groups(book(spark, "wubi"), drop_punct=True), 300, 11)


RATES = [0, 100, 200, 300, 400, 500, 1000]
SWEEP = " UNION ALL ".join(f"SELECT '{k}' AS kind, {r} AS rate, item_id, text, changed, chars FROM ({noisy_sql(s, r, 5)})" for k, s in (("sound", "pinyin"), ("shape", "wubi")) for r in RATES)


def sweep(spark, sf_dir):
    kinds = {"sound": N.groups(book(spark)), "shape": N.groups(book(spark, "wubi"), drop_punct=True)}
    return N.sweep(items(spark, sf_dir), ["item_id"], "text", kinds, RATES, 5)


@query("noise_sweep", SWEEP)
def noise_sweep(spark, sf_dir):
    return sweep(spark, sf_dir)


@query("noise_ratio", f"SELECT kind, rate, sum(changed)::BIGINT AS changed, sum(chars)::BIGINT AS chars, sum(changed) / sum(chars) AS ratio FROM ({SWEEP}) GROUP BY kind, rate")
def noise_ratio(spark, sf_dir):
    return sweep(spark, sf_dir).groupBy("kind", "rate").agg(F.sum("changed").alias("changed"), F.sum("chars").alias("chars"), (F.sum("changed") / F.sum("chars")).alias("ratio"))


def coded_sql(x: str) -> str:
    """Digit-free coding of a text."""
    return per_char(coded(NO_DIGITS), f"regexp_replace(lower({x}), '\\s', '', 'g')")


@query("noise_invariance", f"SELECT count(*) AS items, sum((a <> b)::INTEGER)::BIGINT AS differ FROM (SELECT {coded_sql('o.text')} AS a, {coded_sql('n.text')} AS b FROM benchmark o JOIN ({noisy_sql('pinyin', 300, 11)}) n USING (item_id))")
def noise_invariance(spark, sf_dir):
    """Digit-free coding does not see sound noise: no item may differ."""
    plain, noisy = items(spark, sf_dir), noise_same_sound(spark, sf_dir)
    coded = lambda df, name: df.select("item_id", C.encode("text", book(spark), index=False).alias(name))
    both = coded(plain, "a").join(coded(noisy, "b"), "item_id")
    return both.agg(F.count("*").alias("items"), F.coalesce(F.sum((F.col("a") != F.col("b")).cast("long")), F.lit(0)).alias("differ"))


FAMILY_SQL = "CASE " + " ".join(f"WHEN contains(name, '{f}') THEN '{f}'" for f in FAMILIES) + " END"
NAMES = "'run_' || (['pinyin', 'wubi_no_index', 'cws_raw', 'bert', 'none', 'pinyin_shuffled', 'raw'])[doc_id % 7 + 1] || '_' || doc_id"


@query("run_family", f"SELECT name, {FAMILY_SQL} AS family FROM (SELECT {NAMES} AS name FROM documents)")
def run_family(spark, sf_dir):
    """The first known name that a run's name contains."""
    kinds = F.split(F.lit("pinyin wubi_no_index cws_raw bert none pinyin_shuffled raw"), " ")
    name = F.concat(F.lit("run_"), F.get(kinds, (F.col("doc_id") % 7).cast("int")), F.lit("_"), F.col("doc_id"))
    found = F.filter(F.array(*map(F.lit, FAMILIES)), lambda f: F.contains(F.col("name"), f))
    return table(spark, sf_dir, "documents").select(name.alias("name")).select("name", F.get(found, F.lit(0)).alias("family"))


@query("experiment_grid", "WITH g AS (SELECT l.lang, s.source FROM (SELECT DISTINCT lang FROM documents) l, (SELECT DISTINCT source FROM documents) s), r AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, source, coalesce(n, 0) AS n, n IS NULL AS missing FROM g LEFT JOIN r USING (lang, source)")
def experiment_grid(spark, sf_dir):
    """All pairs of two small dimensions, and which of them have no rows."""
    docs = table(spark, sf_dir, "documents")
    values = docs.agg(F.collect_set("lang").alias("l"), F.collect_set("source").alias("s"))
    grid = values.select(F.explode("l").alias("lang"), "s").select("lang", F.explode("s").alias("source"))
    runs = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return grid.join(runs, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))
