"""Queries of codebooks and transliteration, with a small Latin codebook given by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import codebook as C
from corpusloom.plans.base import LINES, lines, query, table

LETTERS = "abcdefghijklmnopqrstuvwxyzéóèñçüêäöí"
SYMBOLS = [chr(0x100 + k) for k in range(256)]


def code(scheme: str, k: int) -> str:
    return chr(97 + k // 3) + str(k % 3 + 1) if scheme == "pinyin" else chr(97 + k % 4) + chr(97 + k % 3)


def book(spark: SparkSession, scheme: str = "pinyin") -> DataFrame:
    """The stand-in codebook: several letters share a digit-free code."""
    values = ", ".join(f"('{s}', '{c}', '{code(s, k)}')" for s in ("pinyin", "wubi") for k, c in enumerate(LETTERS))
    return C.of_scheme(spark.sql(f"SELECT * FROM VALUES {values} AS t(scheme, ch, code)"), scheme)


K = f"(instr('{LETTERS}', c) - 1)"
CODE = {"pinyin": f"chr((97 + {K} // 3)::INTEGER) || ({K} % 3 + 1)", "wubi": f"chr((97 + {K} % 4)::INTEGER) || chr((97 + {K} % 3)::INTEGER)"}
BOOK = "book AS (SELECT scheme, c AS ch, CASE scheme WHEN 'pinyin' THEN {pinyin} ELSE {wubi} END AS code FROM (SELECT unnest(string_split('{letters}', '')) AS c), (VALUES ('pinyin'), ('wubi')) s(scheme))".format(letters=LETTERS, **CODE)
STRIP = "regexp_replace(lower(line), '\\s', '', 'g')"


def per_char(expr: str, source: str = STRIP) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({source}, ''), lambda c: c <> ''), lambda c: {expr}), '')"


def coded(code_sql: str) -> str:
    return f"CASE WHEN instr('{LETTERS}', c) > 0 THEN {code_sql} || '{T.SEP}' ELSE translate(c, '{T.LITERALS}', '{T.SHIFTED}') END"


def of_lines(name: str, make, sql: str) -> None:
    query(name, f"WITH {LINES} SELECT doc_id, line_no, {sql} AS out FROM lines")(lambda s, d: lines(s, d).select("doc_id", "line_no", make(s).alias("out")))


NO_DIGITS = f"regexp_replace({CODE['pinyin']}, '[0-9]', '', 'g')"
ROTATED = LETTERS[5:] + LETTERS[:5]


def rotation(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{a}', '{b}')" for a, b in zip(LETTERS, ROTATED))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(ch, to)")


of_lines("encode_common", lambda s: C.encode("line", book(s)), per_char(coded(CODE["pinyin"])))
of_lines("encode_no_index", lambda s: C.encode("line", book(s), index=False), per_char(coded(NO_DIGITS)))
of_lines("encode_concat", lambda s: C.encode_concat("line", book(s), book(s, "wubi")), per_char(coded(f"{NO_DIGITS} || {CODE['wubi']}")))
of_lines("encode_shuffled", lambda s: C.encode_shuffled("line", book(s), rotation(s)), per_char(coded(CODE["pinyin"]), f"translate(regexp_replace(line, '\\s', '', 'g'), '{LETTERS}', '{ROTATED}')"))
of_lines("encode_plain", lambda s: F.lower("line"), "lower(line)")
of_lines("encode_spaced", lambda s: F.concat(F.lit(" "), C.encode("line", book(s), all_space=False)), "' ' || " + per_char(coded(CODE["pinyin"]), "lower(line)"))
of_lines("encode_bytes", lambda s: C.encode_bytes("line", SYMBOLS), per_char(f"array_to_string(list_transform(regexp_extract_all(hex(encode(c)), '..'), lambda h: chr((256 + 16 * (instr('0123456789ABCDEF', h[1]) - 1) + instr('0123456789ABCDEF', h[2]) - 1)::INTEGER)), '') || '{T.SEP}'", "regexp_replace(line, '\\s', '', 'g')"))


@query("encode_corpus", f"WITH {LINES} SELECT doc_id, line_no, {per_char(coded(CODE['pinyin']), 'lower(trim(line))')} AS out FROM lines WHERE length(trim(line)) > 3")
def encode_corpus(spark, sf_dir):
    """Inner spaces are kept and short lines left out; the relational form is for books that tasks do not hold."""
    rows = lines(spark, sf_dir).where(F.length(F.trim("line")) > 3).withColumn("line", F.lower(F.trim("line")))
    return C.translate(rows, ["doc_id", "line_no"], "line", C.replacements(book(spark)))


@query("encode_two_schemes", f"WITH {LINES} SELECT doc_id, line_no, 'pinyin' AS scheme, {per_char(coded(CODE['pinyin']))} AS out FROM lines UNION ALL SELECT doc_id, line_no, 'wubi', {per_char(coded(CODE['wubi']))} FROM lines")
def encode_two_schemes(spark, sf_dir):
    rows = lines(spark, sf_dir)
    parts = [rows.select("doc_id", "line_no", F.lit(x).alias("scheme"), C.encode("line", book(spark, x)).alias("out")) for x in ("pinyin", "wubi")]
    return parts[0].unionAll(parts[1])


def corpus_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(F.split(F.lower("text"), "")).alias("ch")).where(r"ch != '' AND NOT ch RLIKE '(?U)\\s'")


CHARS = "chars AS (SELECT unnest(string_split(lower(text), '')) AS ch FROM documents)"
NOSPACE = "ch <> '' AND NOT regexp_matches(ch, '\\s')"
INDEX = f"idx AS (SELECT ch, 9999 + row_number() OVER (ORDER BY md5('7|' || ch), ch) AS n FROM (SELECT DISTINCT ch FROM chars WHERE {NOSPACE}))"


@query("build_random_index", f"WITH {CHARS}, {INDEX} SELECT ch, n::INTEGER AS n FROM idx")
def build_random_index(spark, sf_dir):
    return C.build_random_index(corpus_chars(spark, sf_dir), 7)


@query("encode_random_index", f"WITH {LINES}, {CHARS}, {INDEX}, m AS (SELECT map_from_entries(list((ch, n::VARCHAR))) AS m FROM idx) SELECT doc_id, line_no, {per_char(f'''coalesce(m[c], c) || '{T.SEP}' ''')} AS out FROM lines, m")
def encode_random_index(spark, sf_dir):
    index = C.build_random_index(corpus_chars(spark, sf_dir), 7)
    return lines(spark, sf_dir).select("doc_id", "line_no", C.encode_random_index("line", index).alias("out"))


@query("build_full_shuffle", f"WITH {CHARS}, d AS (SELECT DISTINCT ch FROM chars WHERE {NOSPACE}), a AS (SELECT ch, row_number() OVER (ORDER BY encode(ch)) AS n FROM d), b AS (SELECT ch AS \"to\", row_number() OVER (ORDER BY md5('3|' || ch), ch) AS n FROM d) SELECT ch, \"to\" FROM a JOIN b USING (n)")
def build_full_shuffle(spark, sf_dir):
    return C.build_permutation(corpus_chars(spark, sf_dir), 3)


WORDS = "words AS (SELECT w FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents) WHERE w <> '')"


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"(?U)\s+")).alias("w")).where("w != ''")


@query("build_shuffle_map", f"WITH {WORDS}, d AS (SELECT DISTINCT w AS ch, length(w) AS g FROM words), a AS (SELECT ch, g, row_number() OVER (PARTITION BY g ORDER BY encode(ch)) AS n FROM d), b AS (SELECT ch AS \"to\", g, row_number() OVER (PARTITION BY g ORDER BY md5('5|' || ch), ch) AS n FROM d) SELECT ch, \"to\" FROM a JOIN b USING (g, n)")
def build_shuffle_map(spark, sf_dir):
    """Words stand in for codes: a permutation inside groups of equal length."""
    return C.build_permutation(corpus_words(spark, sf_dir).select(F.col("w").alias("ch")), 5, F.length("ch"))


@query("build_byte_table", f"WITH {CHARS}, r AS (SELECT ch, count(*) AS c FROM chars WHERE {NOSPACE} AND NOT regexp_matches(ch, '^[0-9a-z\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E\\p{{P}}]$') GROUP BY ch) SELECT ch, (row_number() OVER (ORDER BY c DESC, ch) - 1)::INTEGER AS byte FROM r QUALIFY byte < 257")
def build_byte_table(spark, sf_dir):
    """The most frequent characters that are neither marks nor literals, numbered from 0 to 256."""
    from pyspark.sql import Window

    plain = corpus_chars(spark, sf_dir).where(~F.col("ch").rlike(f"^[0-9a-z{T.PUNCT}]$")).groupBy("ch").agg(F.count("*").alias("c"))
    top = plain.orderBy(F.desc("c"), "ch").limit(257)
    return top.select("ch", (F.row_number().over(Window.orderBy(F.desc("c"), "ch")) - 1).alias("byte"))


def corpus_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook of the corpus' words: the code is their first two letters and their length."""
    return corpus_words(spark, sf_dir).distinct().select(F.col("w").alias("ch"), F.concat(F.substring("w", 1, 2), F.length("w").cast("string")).alias("code"))


WORD_BOOK = f"{WORDS}, wb AS (SELECT DISTINCT w AS ch, w[1:2] || length(w) AS code FROM words)"


@query("invert_codebook", f"WITH {WORD_BOOK} SELECT code, string_agg(ch, ' ' ORDER BY encode(ch)) AS chars FROM wb GROUP BY code")
def invert_codebook(spark, sf_dir):
    return C.invert(corpus_book(spark, sf_dir)).select("code", F.array_join("chars", " ").alias("chars"))


@query("code_collisions", f"WITH {WORD_BOOK}, g AS (SELECT regexp_replace(code, '[0-9]', '', 'g') AS code, count(DISTINCT ch) AS size FROM wb GROUP BY 1) SELECT size::INTEGER AS size, count(*) AS codes FROM g GROUP BY size")
def code_collisions(spark, sf_dir):
    return C.collisions(corpus_book(spark, sf_dir))


@query("codebook_coverage", f"WITH {BOOK}, c AS (SELECT source, unnest(string_split(lower(text), '')) AS ch FROM documents) SELECT source, count(*) AS n, avg((b.ch IS NOT NULL)::INTEGER) AS covered FROM (SELECT * FROM c WHERE {NOSPACE}) c LEFT JOIN (SELECT ch FROM book WHERE scheme = 'pinyin') b USING (ch) GROUP BY source")
def codebook_coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chars = docs.select("source", F.explode(F.split(F.lower("text"), "")).alias("ch")).where(r"ch != '' AND NOT ch RLIKE '(?U)\\s'")
    # counted by source and character first, so that few rows meet the codebook
    few = chars.groupBy("source", "ch").agg(F.count("*").alias("n")).join(F.broadcast(book(spark).select("ch", F.lit(1).alias("in"))), "ch", "left")
    return few.groupBy("source").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("in") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("covered"))


@query("top_codes", f"WITH {LINES}, e AS (SELECT unnest(regexp_extract_all({per_char(coded(CODE['pinyin']))}, '[^{T.SEP}]+{T.SEP}')) AS code FROM (SELECT unnest(regexp_extract_all(line, '[^!?？！。.]+[!?？！。.]?')) AS line FROM lines)) SELECT code, count(*) AS n FROM e GROUP BY code ORDER BY n DESC, code LIMIT 20")
def top_codes(spark, sf_dir):
    """Sentences, coded, and their twenty most frequent codes: the flagship query."""
    sentences = lines(spark, sf_dir).select(F.explode(T.sentence_split("line")).alias("s"))
    return C.count_codes(sentences, "s", book(spark)).orderBy(F.desc("n"), "code").limit(20)


PHRASES = {"tion": "T", "th": "þ", "the": "ð", "é": "e", "ñ": "n"}


def phrases(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{a}', '{b}')" for a, b in PHRASES.items())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(ch, out)")


def simplified(spark: SparkSession, x: Column | str) -> Column:
    return C.phrase_translator(phrases(spark))(x)


def transducer(spark: SparkSession):
    return C.phrase_transducer(phrases(spark))


def simplified_sql(x: str) -> str:
    """No phrase begins inside another one but at its start, so the longer ones can be replaced first."""
    for a in sorted(PHRASES, key=len, reverse=True):
        x = f"replace({x}, '{a}', '{PHRASES[a]}')"
    return x


@query("to_simplified", f"WITH {LINES} SELECT doc_id, line_no, {simplified_sql('line')} AS out FROM lines")
def to_simplified(spark, sf_dir):
    """Phrases and letters stand in for traditional forms."""
    return lines(spark, sf_dir).select("doc_id", "line_no", simplified(spark, "line").alias("out"))
