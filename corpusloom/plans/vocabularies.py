"""Queries of vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import vocab as V
from corpusloom.operators.order import numbered
from corpusloom.plans.base import query, table
from corpusloom.plans.codebooks import CHARS, NOSPACE, WORDS, corpus_words

SPECIAL_SQL = "SELECT * FROM (VALUES (0, '[UNK]', 0), (1, '[PAD]', 0), (2, '[CLS]', 0), (3, '[SEP]', 0), (4, '[MASK]', 0)) s(id, token, n)"


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_words(spark, sf_dir).groupBy(F.col("w").alias("token")).agg(F.count("*").alias("n"))


def word_vocab(spark: SparkSession, sf_dir: str, size: int = 505) -> DataFrame:
    return V.ranked(word_counts(spark, sf_dir), size)


def vocab_sql(size: int = 505, name: str = "vocab") -> str:
    """Expects WORDS."""
    return f"{name} AS ({SPECIAL_SQL} UNION ALL SELECT 4 + row_number() OVER (ORDER BY n DESC, encode(token)), token, n FROM (SELECT w AS token, count(*) AS n FROM words GROUP BY w ORDER BY n DESC, encode(w) LIMIT {size - 5}))"


@query("char_vocab", f"WITH {CHARS}, c AS (SELECT ch AS token, count(*) AS n FROM chars WHERE {NOSPACE} GROUP BY ch) {SPECIAL_SQL} UNION ALL SELECT 4 + row_number() OVER (ORDER BY n DESC, encode(token)), token, n FROM c")
def char_vocab(spark, sf_dir):
    return V.char_vocab(table(spark, sf_dir, "documents")).select(F.col("id").cast("long").alias("id"), "token", "n")


def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    w = docs.select("source", F.explode(F.split(F.lower("text"), r"(?U)\s+")).alias("token")).where("token != ''")
    return w.groupBy("source", "token").agg(F.count("*").alias("n"))


@query("merge_token_stats", f"WITH {WORDS}, {vocab_sql()}, c AS (SELECT w AS token, count(*) AS n FROM words GROUP BY w) SELECT CASE WHEN v.token IS NULL THEN '[UNK]' ELSE c.token END AS token, sum(c.n)::BIGINT AS n FROM c LEFT JOIN vocab v USING (token) GROUP BY 1")
def merge_token_stats(spark, sf_dir):
    return V.merge_token_stats(source_stats(spark, sf_dir), word_vocab(spark, sf_dir))


@query("unk_count", f"WITH {WORDS}, {vocab_sql()} SELECT count(*) AS n FROM words w LEFT JOIN vocab v ON v.token = w.w WHERE v.token IS NULL")
def unk_count(spark, sf_dir):
    return V.merge_token_stats(source_stats(spark, sf_dir), word_vocab(spark, sf_dir)).where("token = '[UNK]'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def coded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary of a coded corpus: words whose vowels stand for separators, numbered by word."""
    tokens = corpus_words(spark, sf_dir).select(F.translate("w", "eo", T.SEP * 2).alias("token")).distinct()
    sized = tokens.withColumn("_size", F.length("token"))
    return numbered(sized, ["token"], by=["_size"]).select("token", (F.col("place") + 1).alias("id"))


CODED = f"coded AS (SELECT token, row_number() OVER (PARTITION BY length(token) ORDER BY encode(token)) AS id FROM (SELECT DISTINCT translate(w, 'eo', '{T.SEP * 2}') AS token FROM words))"
SEPS = f"(length(token) - length(replace(token, '{T.SEP}', '')))"


@query("vocab_makeup", f"WITH {WORDS}, {CODED} SELECT CASE WHEN length(token) = 1 AND regexp_matches(token, '^[{T.PUNCT}]$') THEN 'punctuation' WHEN regexp_matches(token, '^[a-z]$') THEN 'letter' WHEN {SEPS} = 0 THEN 'sub-character' WHEN {SEPS} = 1 THEN 'character' ELSE 'phrase' END AS class, count(*) AS n FROM coded GROUP BY 1")
def vocab_makeup(spark, sf_dir):
    return V.makeup(coded_tokens(spark, sf_dir))


@query("vocab_composition", f"WITH {WORDS}, {CODED}, b AS (SELECT *, regexp_replace(token, '{T.SEP}$', '') AS body FROM coded WHERE id >= 5), k AS (SELECT CASE WHEN length(token) = 1 AND NOT regexp_matches(lower(token), '^[0-9a-z]$') THEN 'char' WHEN length(body) = 3 THEN 'char' WHEN regexp_matches(lower(body), '^[0-9a-z]*$') THEN 'sub-char' ELSE 'composite' END AS class FROM b) SELECT class, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM k GROUP BY class")
def vocab_composition(spark, sf_dir):
    """Three-letter tokens stand for whole codes."""
    vocab = coded_tokens(spark, sf_dir)
    codes = vocab.select(F.regexp_replace("token", f"{T.SEP}$", "").alias("code")).where("length(code) = 3")
    return V.composition(vocab, codes)


@query("word_vocab_composition", f"WITH {WORDS} SELECT CASE WHEN length(w) = 1 THEN 'char' ELSE 'word' END AS class, count(DISTINCT w) AS n FROM words GROUP BY 1")
def word_vocab_composition(spark, sf_dir):
    kind = F.when(F.length("w") == 1, "char").otherwise("word")
    return corpus_words(spark, sf_dir).distinct().groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("vocab_decode_overlap", f"WITH {WORDS}, t AS (SELECT DISTINCT array_to_string(list_transform(string_split(w, ''), lambda c: CASE WHEN c BETWEEN 'a' AND 'i' THEN c || '{T.SEP}' ELSE c END), '') AS token, w FROM words), p AS (SELECT token, unnest(range(len(x))) AS k, unnest(x) AS code FROM (SELECT token, list_filter(string_split(token, '{T.SEP}'), lambda s: s <> '') AS x FROM (SELECT DISTINCT token FROM t))), b AS (SELECT unnest(string_split('abcdefghi', '')) AS code), g AS (SELECT token, count(*) AS n, count(b.code) AS m, string_agg(b.code, '' ORDER BY k) AS word FROM p LEFT JOIN b USING (code) GROUP BY token) SELECT (SELECT count(DISTINCT token) FROM t) AS tokens, count(*) FILTER (n = m) AS decodable, count(*) FILTER (n = m AND word IN (SELECT w FROM words)) AS in_raw FROM g")
def vocab_decode_overlap(spark, sf_dir):
    words = corpus_words(spark, sf_dir).distinct()
    vocab = words.select(F.regexp_replace("w", "([a-i])", "$1" + T.SEP).alias("token")).distinct()
    letters = spark.range(1).select(F.explode(F.split(F.lit("abcdefghi"), "")).alias("ch")).where("ch != ''").withColumn("code", F.col("ch"))
    return V.decode_overlap(vocab, letters, words.select(F.col("w").alias("token")))


@query("tokens_per_text", "SELECT lang, 'space' AS tokenizer, avg(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) AS tokens FROM documents GROUP BY lang UNION ALL SELECT lang, 'char', avg(length(regexp_replace(text, '\\s', '', 'g'))) FROM documents GROUP BY lang")
def tokens_per_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("lang", F.explode(F.create_map(F.lit("space"), F.size(T.words("text")), F.lit("char"), F.length(F.regexp_replace("text", r"(?U)\s", "")))).alias("tokenizer", "n"))
    return sizes.groupBy("lang", "tokenizer").agg(F.avg("n").alias("tokens"))


@query("vocab_set_ops", f"WITH {WORDS}, b AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '\\s+')) AS w FROM benchmark), a AS (SELECT DISTINCT w FROM words) SELECT 'both' AS part, count(*) AS n FROM (SELECT w FROM a INTERSECT SELECT w FROM b WHERE w <> '') UNION ALL SELECT 'documents', count(*) FROM (SELECT w FROM a EXCEPT SELECT w FROM b) UNION ALL SELECT 'benchmark', count(*) FROM (SELECT w FROM b WHERE w <> '' EXCEPT SELECT w FROM a)")
def vocab_set_ops(spark, sf_dir):
    a = corpus_words(spark, sf_dir).distinct()
    b = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"(?U)\s+")).alias("w")).where("w != ''").distinct()
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(a.intersect(b), "both").unionAll(count(a.exceptAll(b), "documents")).unionAll(count(b.exceptAll(a), "benchmark"))


@query("label_distribution", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def label_distribution(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("train_bpe")
def train_bpe(spark, sf_dir):
    return V.train_bpe(word_counts(spark, sf_dir).select(F.col("token").alias("word"), "n"), 22_675)


@query("train_unigram")
def train_unigram(spark, sf_dir):
    return V.train_unigram(word_counts(spark, sf_dir).select(F.col("token").alias("word"), "n"), 22_675, specials=V.SPECIALS)
