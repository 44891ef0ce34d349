"""Queries of tokenising and id mapping, on the lines of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import tokens as K
from corpusloom.plans.base import LINES, lines, query, table
from corpusloom.plans.codebooks import BOOK, WORDS, book
from corpusloom.plans.vocabularies import vocab_sql, word_counts, word_vocab

KEYS = ["doc_id", "line_no"]
TOKENS = f"{LINES}, t AS (SELECT doc_id, line_no, unnest(range(len(w))) AS k, unnest(w) AS token FROM (SELECT doc_id, line_no, list_filter(string_split_regex(lower(line), '\\s+'), lambda x: x <> '') AS w FROM lines))"
JOINED = "SELECT l.doc_id, l.line_no, coalesce(string_agg({x}, '{s}' ORDER BY t.k), '') AS out FROM lines l LEFT JOIN {t} t USING (doc_id, line_no) GROUP BY ALL"


def token_lines(spark, sf_dir):
    return lines(spark, sf_dir).select(*KEYS, T.words(F.lower("line")).alias("tokens"))


@query("tokenize_chars", f"WITH {LINES} SELECT doc_id, line_no, array_to_string(list_filter(string_split(replace(lower(line), ' ', ''), ''), lambda c: c <> ''), '|') AS out FROM lines")
def tokenize_chars(spark, sf_dir):
    return lines(spark, sf_dir).select(*KEYS, F.array_join(K.tokenize_chars("line"), "|").alias("out"))


@query("tokens_to_ids", f"WITH {TOKENS}, {WORDS}, {vocab_sql()}, i AS (SELECT doc_id, line_no, k, coalesce(id, 0)::VARCHAR AS id FROM t LEFT JOIN vocab USING (token)) " + JOINED.format(x="id", s=",", t="i"))
def tokens_to_ids(spark, sf_dir):
    ids, _ = K.to_ids(token_lines(spark, sf_dir), KEYS, "tokens", F.broadcast(word_vocab(spark, sf_dir)))
    return ids.select(*KEYS, F.array_join(F.col("ids").cast("array<string>"), ",").alias("out"))


@query("tokens_too_long", f"WITH {LINES} SELECT doc_id, line_no, len(list_filter(string_split_regex(lower(line), '\\s+'), lambda x: x <> ''))::INTEGER AS size FROM lines WHERE size > 64")
def tokens_too_long(spark, sf_dir):
    return K.to_ids(token_lines(spark, sf_dir), KEYS, "tokens", word_vocab(spark, sf_dir), max_len=64)[1]


@query("tokens_to_ids_two", f"WITH {TOKENS}, {WORDS}, {vocab_sql(105, 'a')}, {vocab_sql(505, 'b')}, i AS (SELECT doc_id, line_no, k, coalesce(a.id, 105 + b.id, 105)::VARCHAR AS id FROM t LEFT JOIN a USING (token) LEFT JOIN b USING (token)) " + JOINED.format(x="id", s=",", t="i"))
def tokens_to_ids_two(spark, sf_dir):
    ids = K.to_ids_two(token_lines(spark, sf_dir), KEYS, "tokens", word_vocab(spark, sf_dir, 105), word_vocab(spark, sf_dir, 505))
    return ids.select(*KEYS, F.array_join(F.col("ids").cast("array<string>"), ",").alias("out"))


@query("ids_to_tokens", f"WITH {TOKENS}, {WORDS}, {vocab_sql()}, i AS (SELECT doc_id, line_no, k, coalesce(v.token, '[UNK]') AS token FROM t LEFT JOIN vocab v USING (token)) " + JOINED.format(x="token", s=" ", t="i").replace("t.k", "t.k"))
def ids_to_tokens(spark, sf_dir):
    vocab = word_vocab(spark, sf_dir)
    ids, _ = K.to_ids(token_lines(spark, sf_dir), KEYS, "tokens", vocab)
    return K.to_tokens(ids, KEYS, "ids", vocab).select(*KEYS, F.array_join("tokens", " ").alias("out"))


@query("oov_rate", f"WITH {WORDS}, {vocab_sql()}, t AS (SELECT source, token FROM (SELECT source, unnest(string_split_regex(lower(text), '\\s+')) AS token FROM documents) WHERE token <> '') SELECT source, count(*) AS n, avg((v.token IS NULL)::INTEGER) AS oov FROM t LEFT JOIN vocab v USING (token) GROUP BY source")
def oov_rate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", T.words(F.lower("text")).alias("tokens"))
    return K.oov_rate(docs, ["source"], "tokens", word_vocab(spark, sf_dir))


#: Words in the vocabulary of pieces.
PIECES = 22_675


def piece_vocab(spark, sf_dir):
    """Pieces of the corpus: letters and frequent words, each also as a continuation."""
    counts = word_counts(spark, sf_dir)
    words = counts.orderBy(F.desc("n"), "token").limit(PIECES).select("token")
    letters = counts.select(F.explode(F.split("token", "")).alias("token")).where("token != ''").distinct()
    both = words.unionAll(letters).distinct()
    return both.unionAll(both.select(F.concat(F.lit("##"), "token"))).distinct()


#: Every distinct word, from its start on, by the longest piece at each place; a word that does not come to its end is unknown.
GREEDY = f"""RECURSIVE {TOKENS}, {WORDS}, top AS (SELECT token FROM (SELECT w AS token, count(*) AS n FROM words GROUP BY w ORDER BY n DESC, encode(w) LIMIT {PIECES}) UNION SELECT * FROM (SELECT unnest(string_split(w, '')) AS c FROM words) WHERE c <> ''),
pv AS (SELECT token FROM top UNION SELECT '##' || token FROM top), big AS (SELECT max(length(token)) AS most FROM top), d AS (SELECT DISTINCT token AS word FROM t),
g AS (SELECT word, 0::BIGINT AS place, []::VARCHAR[] AS pieces FROM d UNION ALL
  SELECT word, max(stop), list_append(any_value(pieces), arg_max(piece, stop)) FROM (SELECT c.* FROM (SELECT word, pieces, stop, CASE WHEN place > 0 THEN '##' ELSE '' END || word[place + 1:stop] AS piece
    FROM (SELECT word, place, pieces, unnest(range(place + 1, least(length(word), place + most) + 1)) AS stop FROM g, big WHERE place < length(word))) c JOIN pv ON pv.token = c.piece) GROUP BY word),
cut AS (SELECT d.word, CASE WHEN length(d.word) > 100 OR g.word IS NULL THEN '[UNK]' ELSE array_to_string(g.pieces, ' ') END AS piece FROM d LEFT JOIN g ON d.word = g.word AND g.place = length(d.word)),
p AS (SELECT doc_id, line_no, k, piece FROM t JOIN cut ON t.token = cut.word)"""


@query("tokenize_wordpiece", f"WITH {GREEDY} " + JOINED.format(x="piece", s=" ", t="p"))
def tokenize_wordpiece(spark, sf_dir):
    out = K.tokenize_wordpiece(token_lines(spark, sf_dir), KEYS, "tokens", piece_vocab(spark, sf_dir))
    return out.select(*KEYS, F.array_join("tokens", " ").alias("out"))


@query("tokenize_unigram")
def tokenize_unigram(spark, sf_dir):
    total = word_counts(spark, sf_dir)
    scored = piece_vocab(spark, sf_dir).where("token not like '##%'").join(total, "token", "left").select("token", F.log(F.coalesce("n", F.lit(1)) / 1e7).alias("score"))
    out = K.tokenize_unigram(token_lines(spark, sf_dir), KEYS, "tokens", scored)
    return out.select(*KEYS, F.array_join("tokens", " ").alias("out"))


def code_pieces(spark):
    """Pieces of the stand-in codes: their letters and digits by use, and whole codes that are likelier (digit 1) or less
    likely (digit 2) than their parts."""
    codes = book(spark).select("code").withColumn("d", F.substring("code", 2, 1))
    parts = codes.select(F.explode(F.split("code", "")).alias("token")).where("token != ''").groupBy("token").agg(F.count("*").cast("double").alias("n"))
    whole = codes.where("d != '3'").select(F.col("code").alias("token"), F.when(F.col("d") == "1", 2.0).otherwise(0.5).alias("n"))
    return parts.unionAll(whole).select("token", F.log(F.col("n") / 36).alias("score"))


FIRST = f"""{TOKENS}, {WORDS}, {vocab_sql()}, {BOOK}, codes AS (SELECT ch, code FROM book WHERE scheme = 'pinyin'),
pieces AS (SELECT token, ln(count(*) / 36.0) AS score FROM (SELECT unnest(string_split(code, '')) AS token FROM codes) GROUP BY token UNION ALL SELECT code, ln(CASE code[2] WHEN '1' THEN 2.0 ELSE 0.5 END / 36.0) FROM codes WHERE code[2] <> '3'),
best AS (SELECT ch, CASE WHEN w.score > a.score + b.score THEN '{T.SEP}' || code ELSE '{T.SEP}' || code[1] || ' {T.SEP}' || code[2] END AS s FROM codes JOIN pieces a ON a.token = code[1] JOIN pieces b ON b.token = code[2] LEFT JOIN pieces w ON w.token = code),
c AS (SELECT doc_id, line_no, k * 10000 + unnest(range(len(x))) AS k, unnest(x) AS c, whole FROM (SELECT doc_id, line_no, k, v.token IS NOT NULL AS whole, CASE WHEN v.token IS NOT NULL THEN [t.token] ELSE list_filter(string_split(t.token, ''), lambda y: y <> '') END AS x FROM t LEFT JOIN vocab v USING (token))),
p AS (SELECT doc_id, line_no, k, CASE WHEN whole OR v.token IS NOT NULL THEN c WHEN contains('{T.LITERALS}', c) THEN '{T.SEP}' || translate(c, '{T.LITERALS}', '{T.SHIFTED}') ELSE coalesce(best.s, '{T.SEP}' || c) END AS s FROM c LEFT JOIN vocab v ON v.token = c.c LEFT JOIN best ON best.ch = c.c)"""


@query("tokenize_words_first", f"WITH {FIRST} " + JOINED.format(x="s", s=" ", t="p"))
def tokenize_words_first(spark, sf_dir):
    out = K.words_first(token_lines(spark, sf_dir), KEYS, "tokens", word_vocab(spark, sf_dir), book(spark), code_pieces(spark))
    return out.select(*KEYS, F.array_join("tokens", " ").alias("out"))
