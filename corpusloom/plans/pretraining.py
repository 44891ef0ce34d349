"""Queries of pretraining examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import pretrain as P
from corpusloom.plans.base import query, table
from corpusloom.plans.codebooks import WORDS
from corpusloom.plans.features import PAIR, pair, text_of
from corpusloom.plans.vocabularies import vocab_sql, word_vocab


def d(seed: int, n, *keys: str) -> str:
    return f"(('0x' || md5({' || '.join([repr(str(seed))] + [f'{chr(39)}|{chr(39)} || {k}' for k in keys])})[1:7])::BIGINT % {n})"


SENT = "sent AS (SELECT doc_id, regexp_extract_all(text, '[^!?？！。.]+[!?？！。.]?') AS s FROM documents), n AS (SELECT doc_id, len(s)::INTEGER AS n, list_transform(s, lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda y: y <> ''))) AS sizes FROM sent)"


def sentences(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentence_split("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.transform("s", lambda x: F.size(T.words(x))).alias("sizes"))


#: One document after the other: largest first, to the shard (1 to 16, the last eight of the test) with most room, or, where
#: there are no more documents than empty shards, to one of these. Only the numbers of each size and shard count.
SHARD = f"""RECURSIVE {SENT}, ord AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k, count(*) OVER () AS total, sum(n) OVER () AS s FROM n),
bud AS (SELECT any_value(total) AS total, list_concat(list_transform(range(8), lambda i: ((s * 900) // 1000)::BIGINT // 8), list_transform(range(8), lambda i: (s - (s * 900) // 1000)::BIGINT // 8)) AS room FROM ord GROUP BY s),
dealt AS (SELECT 0::BIGINT AS k, NULL::INTEGER AS n, 0::BIGINT AS shard, room, list_transform(range(16), lambda i: 0::BIGINT) AS docs FROM bud UNION ALL
  SELECT k, n, shard, list_transform(room, lambda r, i: r - CASE WHEN i = shard THEN greatest(n, 1) ELSE 0 END), list_transform(docs, lambda c, i: c + (i = shard)::BIGINT)
  FROM (SELECT k, n, room, docs, list_position(key, list_max(key)) AS shard FROM (SELECT o.k, o.n, d.room, d.docs,
    CASE WHEN o.total - o.k + 1 <= len(list_filter(d.docs, lambda c: c = 0)) THEN list_transform(d.room, lambda r, i: CASE WHEN d.docs[i] = 0 THEN r ELSE -9000000000000000 END) ELSE d.room END AS key FROM dealt d JOIN ord o ON o.k = d.k + 1))),
per AS (SELECT n, shard, sum(count(*)) OVER (PARTITION BY n ORDER BY shard) AS stop, count(*) AS c FROM dealt WHERE k > 0 GROUP BY n, shard),
placed AS (SELECT doc_id, n, row_number() OVER (PARTITION BY n ORDER BY md5('0|' || doc_id), doc_id) - 1 AS p FROM n),
sh AS (SELECT doc_id, placed.n, CASE WHEN shard <= 8 THEN 'training' ELSE 'test' END AS split, (shard - 1) % 8 AS shard FROM placed JOIN per ON placed.n = per.n AND p < stop AND p >= stop - c)"""


def shards(spark, sf_dir):
    return P.shard_balance(sentences(spark, sf_dir).select("doc_id", "n"), "n", "doc_id", 8)


@query("shard_balance", f"WITH {SHARD} SELECT doc_id, split, shard FROM sh")
def shard_balance(spark, sf_dir):
    return shards(spark, sf_dir).select("doc_id", "split", "shard")


@query("shard_stats", f"WITH {SHARD} SELECT split, shard, count(*) AS docs, sum(n)::BIGINT AS sentences, median(n) AS median FROM sh GROUP BY split, shard")
def shard_stats(spark, sf_dir):
    return shards(spark, sf_dir).groupBy("split", "shard").agg(F.count("*").alias("docs"), F.sum("n").alias("sentences"), F.percentile("n", 0.5).alias("median"))


@query("duplicate_factor", "SELECT doc_id, unnest(range(5))::INTEGER AS dupe FROM documents")
def duplicate_factor(spark, sf_dir):
    return P.duplicate(table(spark, sf_dir, "documents").select("doc_id"), 5)


CHUNK = f"RECURSIVE {SENT}, ck AS (SELECT doc_id, 1 AS i, sizes, n, CASE WHEN {d(8, 1000, 'doc_id', repr('short'))} < 100 THEN 2 + {d(8, 124, 'doc_id', repr('target'))} ELSE 125 END AS most, sizes[1] AS total, 0 AS chunk, 0 AS first FROM n WHERE n > 0 UNION ALL SELECT doc_id, i + 1, sizes, n, most, CASE WHEN total >= most THEN 0 ELSE total END + sizes[i + 1], chunk + (total >= most)::INTEGER, CASE WHEN total >= most THEN i ELSE first END FROM ck WHERE i < n), chunks AS (SELECT doc_id, chunk::BIGINT AS chunk, first::BIGINT AS first, max(i)::BIGINT - 1 AS last FROM ck GROUP BY doc_id, chunk, first)"


def chunks(spark, sf_dir):
    return P.pack_chunks(sentences(spark, sf_dir), "doc_id", "sizes", P.chunk_target(125, 100, 8, "doc_id"))


@query("pack_chunks", f"WITH {CHUNK} SELECT doc_id, chunk, first, last FROM chunks")
def pack_chunks(spark, sf_dir):
    return chunks(spark, sf_dir)


CUT = f"CASE WHEN last > first THEN 1 + {d(9, '(last - first)', 'doc_id', 'chunk', repr('cut'))} ELSE 1 END"


@query("split_ab", f"WITH {CHUNK} SELECT doc_id, chunk, {CUT} AS cut FROM chunks")
def split_ab(spark, sf_dir):
    c = chunks(spark, sf_dir)
    n = F.col("last") - F.col("first")
    return c.select("doc_id", "chunk", F.when(n > 0, 1 + P.draw(9, F.greatest(n, F.lit(1)), "doc_id", "chunk", F.lit("cut"))).otherwise(1).alias("cut"))


#: Sentences with words, documents with such sentences, and chunks whose unused sentences are put back.
PAIRS = f"""RECURSIVE {SENT}, f AS (SELECT doc_id, len(sizes)::INTEGER AS n, sizes, CASE WHEN {d(8, 1000, "doc_id", repr("short"))} < 100 THEN 2 + {d(8, 124, "doc_id", repr("target"))} ELSE 125 END AS most
  FROM (SELECT doc_id, list_filter(sizes, lambda x: x > 0) AS sizes FROM n) WHERE len(sizes) > 0),
steps AS (SELECT doc_id, sizes, n, most, 0 AS first, 0 AS i, 0 AS chunk, sizes[1]::BIGINT AS total FROM f UNION ALL
  SELECT doc_id, sizes, n, most, CASE WHEN ended THEN start ELSE first END, CASE WHEN ended THEN start ELSE i + 1 END, chunk + ended::INTEGER, CASE WHEN ended THEN sizes[start + 1] ELSE total + sizes[i + 2] END
  FROM (SELECT *, CASE WHEN i > first AND {d(9, 2, "doc_id", "chunk", repr("next"))} = 0 THEN i + 1 WHEN i > first THEN first + 1 + {d(9, "(i - first)", "doc_id", "chunk", repr("cut"))} ELSE first + 1 END AS start
    FROM (SELECT *, total >= most OR i = n - 1 AS ended FROM steps)) WHERE NOT ended OR start < n),
pairs AS (SELECT doc_id, chunk::BIGINT AS chunk, first::BIGINT AS first, i::BIGINT AS last, CASE WHEN i > first THEN 1 + {d(9, "(i - first)", "doc_id", "chunk", repr("cut"))} ELSE 1 END AS cut,
  i > first AND {d(9, 2, "doc_id", "chunk", repr("next"))} = 0 AS is_next, most, sizes FROM steps WHERE total >= most OR i = n - 1),
rk AS (SELECT doc_id, n, sizes, row_number() OVER (ORDER BY n DESC, {d(9, 64, "doc_id")}, md5('9|' || doc_id), doc_id) - 1 AS r, count(*) OVER () AS total FROM f),
partner AS (SELECT p.*, most - list_sum(p.sizes[first + 1:first + cut]) AS missing, rk.doc_id AS b_doc, rk.n AS b_n, rk.sizes AS b_sizes, {d(9, "rk.n", "p.doc_id", "chunk", repr("start"))} AS b_start
  FROM (SELECT pairs.*, (r + 1 + {d(9, "greatest(total - 1, 1)", "pairs.doc_id", "chunk", repr("doc"))}) % total AS p FROM pairs JOIN rk ON pairs.doc_id = rk.doc_id) p JOIN rk ON p.p = rk.r)"""


@query("next_sentence", f"WITH {PAIRS} SELECT doc_id, chunk, first, last, cut, is_next, CASE WHEN is_next THEN doc_id ELSE b_doc END AS b_doc, CASE WHEN is_next THEN first + cut ELSE b_start END AS b_first, CASE WHEN is_next THEN last ELSE least(b_start + len(list_filter(range(b_start + 1, b_n + 1), lambda k: list_sum(b_sizes[b_start + 1:k]) < missing)), b_n - 1) END AS b_last FROM partner")
def next_sentence(spark, sf_dir):
    return P.next_sentence(sentences(spark, sf_dir), "doc_id", "sizes", P.chunk_target(125, 100, 8, "doc_id"), 9)


def front_sql(x: str, n: str, name: str) -> str:
    """Words left of a list: as many coins as words are dropped tell how many of them stand in front."""
    front = f"coalesce(list_sum(list_transform(range(1, len({x}) - {n} + 1), lambda i: {d(4, 2, 'conv_id', 'turn', repr(name), 'i')})), 0)::BIGINT"
    return f"array_to_string({x}[{front} + 1:{front} + {n}], ' ')"


@query("truncate_pair_random", f"WITH p AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS a, list_filter(string_split(role, ''), lambda x: x <> '') AS b FROM conversations), k AS (SELECT *, CASE WHEN len(a) + len(b) <= 12 OR len(a) <= 6 THEN len(a) WHEN len(b) <= 6 THEN 12 - len(b) ELSE 6 END AS ka, CASE WHEN len(a) + len(b) <= 12 THEN len(b) WHEN len(a) <= 6 THEN 12 - len(a) WHEN len(b) <= 6 THEN len(b) ELSE 6 END AS kb FROM p) SELECT conv_id, turn, {front_sql('a', 'ka', 'a')} AS a, {front_sql('b', 'kb', 'b')} AS b FROM k")
def truncate_pair_random(spark, sf_dir):
    """Words of a turn and letters of its role, twelve in all."""
    z = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words("text").alias("a"), F.filter(F.split("role", ""), lambda x: x != "").alias("b"))
    a, b = P.truncate_random(F.col("a"), F.col("b"), 12, 4, "conv_id", "turn")
    return z.select("conv_id", "turn", F.array_join(a, " ").alias("a"), F.array_join(b, " ").alias("b"))


#: Words of the vocabulary that replacements are drawn from.
VOCABULARY = 22_675
MASKED = f"{PAIR}, {WORDS}, {vocab_sql(VOCABULARY)}, t AS (SELECT conv_id, turn, len(tokens) AS n, unnest(range(len(tokens))) AS i, unnest(tokens) AS token FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY token IN ('[CLS]', '[SEP]'), {d(1, 1 << 28, 'conv_id', 'turn', 'i')}, i) AS rk, token IN ('[CLS]', '[SEP]') AS sp FROM t), m AS (SELECT *, NOT sp AND rk <= least(5, greatest(1, round_even(n * 0.15, 0)::INTEGER)) AS hit, {d(2, 10, 'conv_id', 'turn', 'i')} AS how, {d(3, '(SELECT count(*) FROM vocab)', 'conv_id', 'turn', 'i')} AS other FROM r)"


@query("mask_tokens", f"WITH {MASKED} SELECT conv_id, turn, string_agg(CASE WHEN NOT hit OR how = 8 THEN m.token WHEN how < 8 THEN '[MASK]' ELSE v.token END, ' ' ORDER BY i) AS tokens, string_agg(i::VARCHAR, ' ' ORDER BY i) FILTER (hit) AS places, string_agg(m.token, ' ' ORDER BY i) FILTER (hit) AS labels FROM m LEFT JOIN vocab v ON m.other = v.id GROUP BY conv_id, turn")
def mask_tokens(spark, sf_dir):
    masked = P.mask(pair(spark, sf_dir), ["conv_id", "turn"], "tokens", P.masked_count(F.size("tokens"), 150, 5), word_vocab(spark, sf_dir, VOCABULARY), 1)
    out = masked.select("conv_id", "turn", text_of("tokens").alias("m"), text_of("places").alias("places"), text_of("labels").alias("labels"))
    return out.withColumnRenamed("m", "tokens")


@query("pad_encode", f"WITH {PAIR} SELECT conv_id, turn, array_to_string(list_transform(tokens, lambda x: length(x)), ' ') || repeat(' 0', (40 - len(tokens))::INTEGER) AS ids, repeat('1', len(tokens)::INTEGER) || repeat('0', (40 - len(tokens))::INTEGER) AS mask, repeat('0', first::INTEGER) || repeat('1', second::INTEGER) || repeat('0', (40 - len(tokens))::INTEGER) AS segments FROM f")
def pad_encode(spark, sf_dir):
    """A token's length stands in for its id."""
    from corpusloom.operators import examples as E

    p = pair(spark, sf_dir)
    ids = F.transform("tokens", lambda x: F.length(x))
    return p.select("conv_id", "turn", text_of(E.padded(ids, 40)).alias("ids"), text_of(E.mask_of(ids, 40), "").alias("mask"), text_of(E.padded(F.col("segments"), 40), "").alias("segments"))


@query("dense_labels", f"WITH {MASKED}, g AS (SELECT conv_id, turn, i, CASE WHEN hit THEN length(token) ELSE -1 END AS v FROM m), s AS (SELECT conv_id, turn, unnest(range(32)) AS i FROM f) SELECT s.conv_id, s.turn, string_agg(coalesce(v, -1)::VARCHAR, ' ' ORDER BY s.i) AS labels FROM s LEFT JOIN g USING (conv_id, turn, i) GROUP BY s.conv_id, s.turn")
def dense_labels(spark, sf_dir):
    p = pair(spark, sf_dir)
    places, labels = P.mask_places(F.col("tokens"), P.masked_count(F.size("tokens"), 150, 5), 1, "conv_id", "turn")
    m = p.select("conv_id", "turn", F.concat(places, F.array(F.lit(0))).alias("p"), F.concat(F.transform(labels, lambda x: F.length(x)), F.array(F.lit(0))).alias("l"))
    return m.select("conv_id", "turn", text_of(P.dense_labels(F.col("p"), F.col("l"), 32)).alias("labels"))


@query("shuffle_examples", "SELECT doc_id, md5('6|' || doc_id) AS place FROM documents")
def shuffle_examples(spark, sf_dir):
    return P.shuffled(table(spark, sf_dir, "documents").select("doc_id"), 6, "doc_id").withColumn("place", F.md5(F.concat_ws("|", F.lit("6"), F.col("doc_id").cast("string"))))
