"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import compressed, decontaminate, htmltext, manifest, pii, quality, ring, sentencepiece, simhash, substrings, tokencounts, warc, whitening
from corpusloom.llm.common import table

ORACLES: dict[str, str] = {}


def piece_model() -> str:
    """The public model's place; its package is installed on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "base_failed", "kept"]
    return quality.measure(table(spark, sf_dir, "documents")).select(*columns)


ORACLES["op2_quality"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twin AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twin) GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM l GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(ln.dup, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(ln.n, 0)::BIGINT AS n_lines,
  len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in quality.STOP_WORDS)})))::BIGINT AS n_stop_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 1000 * n_symbols <= 100 * n_words AND 1000 * word_chars BETWEEN 2000 * n_words AND 15000 * n_words
  AND 1000 * n_dup_lines <= 500 * n_lines AND 1000 * n_stop_words >= 30 * n_words AS kept FROM b
"""


#: Key of the surrogates in the registered queries; a real run passes its own secret.
SURROGATE_KEY = "corpusloom"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), SURROGATE_KEY, length="n_chars").select("doc_id", "text", "n_chars")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.assign(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_documents(table(spark, sf_dir, "documents"), piece_model(), full=False)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.main_text(pages, htmltext.train()).withColumn("n_chars", F.length("text").cast("long"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencounts.tokens_per_document(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def _damage(key: Column, data: Column) -> Column:
    """One byte in the middle of one in about a hundred records is changed, and the first byte of as many others."""
    kind = F.pmod(F.xxhash64(key), F.lit(97))
    at = F.when(kind == 0, F.floor(F.octet_length(data) / 2)).when(kind == 1, F.lit(1)).cast("int")
    other = F.when(F.substring(data, at, F.lit(1)) == F.unhex(F.lit("00")), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    return F.when(at.isNull(), data).otherwise(F.overlay(data, other, at, F.lit(1)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages are archived, one record in about fifty damaged, and the archive audited against the table."""
    ours, theirs = warc.replicas(table(spark, sf_dir, "pages").select("page_id", "url", "html"), _damage)
    found = warc.audit(ours, theirs).select("file", "offset", "status")
    return ours.join(found, ["file", "offset"], "full").select("page_id", "file", "offset", "length", "sha256", F.coalesce("status", F.lit("same")).alias("status"))

def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their proofs, and what these say of one in five whose text was lower-cased."""
    docs = table(spark, sf_dir, "documents")
    return manifest.audit(docs, seen=manifest.tampered(docs))


def _tree_sql(name: str, leaves: str, depth: int) -> str:
    """Tables of a tree over ``leaves`` (g, i, h, n): {name}0 to {name}{depth}, each node with what lies before and after it
    under its parent, and {name}_top (g, h)."""
    out, from_ = [], f"SELECT g, i, h, n FROM {leaves}"
    for k in range(depth + 1):
        beside = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
        out.append(
            f"{name}{k} AS (SELECT *, coalesce(string_agg(h, '') OVER ({beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,"
            f" coalesce(string_agg(h, '') OVER ({beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM ({from_}))"
        )
        from_ = f"SELECT g, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, n FROM {name}{k} WHERE n > {16**k} GROUP BY g, i // 16, n"
    last = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n <= {16**k}" + (f" AND n > {16 ** (k - 1)}" if k else "") for k in range(depth + 1))
    return ", ".join([*out, f"{name}_top AS ({last})"])


def _climb_sql(name: str, rows: str, depth: int) -> str:
    """``rows`` (g, i, n, f, p, ...) with f folded, and p lengthened, by each level of a tree: {name}_up."""
    out = [f"{name}_c0 AS (SELECT * FROM {rows})"]
    for k in range(depth):
        out.append(
            f"{name}_c{k + 1} AS (SELECT c.* REPLACE (CASE WHEN c.n > {16**k} THEN sha256(t.before || c.f || t.after) ELSE c.f END AS f,"
            f" CASE WHEN c.n > {16**k} THEN c.p || t.before || t.after ELSE c.p END AS p) FROM {name}_c{k} c LEFT JOIN {name}{k} t ON c.g = t.g AND c.i // {16**k} = t.i)"
        )
    return ", ".join([*out, f"{name}_up AS (SELECT * FROM {name}_c{depth})"])


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}) || ':' || {x} END" for x in fields) + ")"


#: Trees of at most 16^5 rows a source and 16^4 sources.
ORACLES["op11_manifest"] = f"""
WITH d AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {_leaf_sql("text")} AS h,
  {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low,
  xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch:
    list_transform(range(8), lambda b: ((ascii(ch) >> b::INT) & 1)::BIGINT)))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS crc FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree_sql("t", "leaves", 5)},
sources AS (SELECT '' AS g, g AS source, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t_top),
{_tree_sql("s", "sources", 4)},
starts AS (SELECT *, CASE WHEN crc % 5 = 0 THEN low ELSE h END AS f, '' AS p FROM leaves),
{_climb_sql("t", "starts", 5)},
between_ AS (SELECT s.g, s.i, s.n, u.f, u.p, u.doc_id, u.h AS leaf, s.h AS subroot FROM t_up u JOIN sources s ON u.g = s.source),
{_climb_sql("s", "between_", 4)}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM s_up, s_top r
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four strongest components."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from the labelled documents whose remainder is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(compressed.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = compressed.fit(docs.where(~held_out), labels, label="quality")
    scored = compressed.score(docs, model, columns=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_sharding": op4_sharding,
    "op5_decontaminate": op5_decontaminate,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_substrings": op7_substrings,
    "op8_html": op8_html,
    "op9_token_counts": op9_token_counts,
    "op10_warc": op10_warc,
    "op11_manifest": op11_manifest,
    "op12_whitening": op12_whitening,
    "op13_compression": op13_compression,
}
