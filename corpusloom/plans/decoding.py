"""Queries of decoding. Vectors stand in for scores, events of a user in order of time for label sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import decode as D
from corpusloom.operators import twolevel as Y
from corpusloom.plans.base import query, table

LABEL = "['B-PER', 'I-PER', 'I-LOC', 'O', 'S-LOC', 'B-LOC', 'I-LOC']"
SEQ = f"seq AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, ({LABEL})[event_id % 7 + 1] AS label, event_type FROM events)"


def labels(spark, sf_dir):
    from pyspark.sql import Window

    names = F.split(F.lit("B-PER I-PER I-LOC O S-LOC B-LOC I-LOC"), " ")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", pos.cast("long").alias("pos"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("label"), "event_type")


def vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    return v.withColumn("b", F.reverse("a"))


VEC = "vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS a, list_reverse(embedding::DOUBLE[]) AS b FROM embeddings)"
TOP = "(SELECT * FROM (SELECT vec_id, label, idx, s, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, idx) AS rank FROM (SELECT vec_id, label, unnest(range(len({c}))) AS idx, unnest({c}) AS s FROM vec)) WHERE rank <= 5)"


@query("top_n_index", f"WITH {VEC} SELECT vec_id, idx, s AS score, rank FROM {TOP.format(c='a')}")
def top_n_index(spark, sf_dir):
    return D.top_n(vectors(spark, sf_dir), ["vec_id"], "a", 5).withColumns({"idx": F.col("idx").cast("long"), "rank": F.col("rank").cast("long")})


@query("argmax_class", f"WITH {VEC} SELECT vec_id, (list_position(a, list_max(a)) - 1)::INTEGER AS class FROM vec")
def argmax_class(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", D.argmax_class("a").alias("class"))


@query("match_results", f"WITH {VEC} SELECT d.doc_id AS unique_id, d.source, v.label FROM documents d JOIN vec v ON d.doc_id = v.vec_id")
def match_results(spark, sf_dir):
    features = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("unique_id"), "source")
    return D.match_results(features, vectors(spark, sf_dir).select(F.col("vec_id").alias("unique_id"), "label"))


CAND = f"{VEC}, ta AS MATERIALIZED {TOP.format(c='a')}, tb AS MATERIALIZED {TOP.format(c='b')}, cand AS (SELECT x.vec_id, x.vec_id // 3 AS q, x.idx AS s, y.idx AS e, x.s + y.s AS score FROM ta x JOIN tb y ON x.vec_id = y.vec_id WHERE y.idx >= x.idx AND y.idx < x.idx + 30 AND greatest(x.idx, y.idx) < 20 + x.vec_id % 40 AND least(x.idx, y.idx) >= 2 + x.vec_id % 3 AND (x.idx + x.vec_id) % 7 <> 0)"


def candidates(spark, sf_dir):
    """Features of 20 to 59 tokens after a query of two to four; one start in seven has more context in another window."""
    at, v = F.sequence(F.lit(0), F.size("a") - 1), F.col("vec_id")
    source = F.transform(at, lambda i: F.when(i >= 2 + v % 3, i - 2 - v % 3))
    context = F.transform(at, lambda i: (i + v) % 7 != 0)
    c = D.span_candidates(vectors(spark, sf_dir), ["vec_id"], "a", "b", 5, 30, n_tokens=20 + v % 40, source=source, max_context=context)
    return c.select("vec_id", F.floor(F.col("vec_id") / 3).cast("long").alias("q"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "score")


@query("span_candidates", f"WITH {CAND} SELECT vec_id, s, e, round(score, 6) AS score FROM cand")
def span_candidates(spark, sf_dir):
    return candidates(spark, sf_dir).select("vec_id", "s", "e", F.round("score", 6).alias("score"))


BEAM = f"{VEC}, w AS (SELECT doc_id AS vec_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:15 + doc_id % 20] AS w FROM documents), s AS (SELECT vec_id, unnest(range(3)) AS i, a, b FROM vec), p AS (SELECT *, i * 2 + unnest(range(2)) AS place FROM s), c AS (SELECT vec_id, i * 7 AS s, place * 4 AS e, round(a[i + 1] + b[place + 1], 6) AS score FROM p), o AS (SELECT c.*, array_to_string(w, ' ') AS text, length(array_to_string(w[1:s], ' ')) + (s > 0)::INTEGER AS char_start, length(array_to_string(w[1:e + 1], ' ')) - 1 AS char_end FROM c JOIN w USING (vec_id) WHERE e >= s AND e < s + 15 AND s < len(w) - 1 AND e < len(w) - 1 AND (s + vec_id) % 5 <> 0)"


@query("span_topk_beam", f"WITH {BEAM} SELECT vec_id, s, e, score, char_start::BIGINT AS char_start, char_end::BIGINT AS char_end, text[char_start + 1:char_end + 1] AS answer FROM o")
def span_topk_beam(spark, sf_dir):
    """Passages of fifteen to 34 words; one start in five has more context in another window."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.slice(T.words("text"), F.lit(1), (15 + F.col("doc_id") % 20).cast("int")).alias("w"))
    v = vectors(spark, sf_dir).withColumns({"si": F.sequence(F.lit(0), F.lit(14), F.lit(7)), "ei": F.sequence(F.lit(0), F.lit(20), F.lit(4))}).join(words, "vec_id")
    last = F.transform("w", lambda x, i: F.length(F.array_join(F.slice("w", F.lit(1), i + 1), " ")) - 1)
    v = v.withColumns({"last": last, "text": F.array_join("w", " ")})
    first = F.transform("w", lambda x, i: F.get("last", i) - F.length(x) + 1)
    context = F.transform("w", lambda x, i: (i + F.col("vec_id")) % 5 != 0)
    out = D.span_beam(v, ["vec_id"], "si", "a", "ei", "b", 2, 15, n_tokens=F.size("w"), max_context=context, text=F.col("text"), first_char=first, last_char=F.col("last"))
    longs = [F.col(c).cast("long").alias(c) for c in ("s", "e", "char_start", "char_end")]
    return out.select("vec_id", *longs, "answer", F.round("score", 6).alias("score"))


NBEST = f"{CAND}, nb AS (SELECT q, text, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, text) AS rank FROM (SELECT q, s || '-' || e AS text, max(score) AS score FROM cand GROUP BY ALL) QUALIFY rank <= 4), nbest AS (SELECT * FROM nb UNION ALL SELECT DISTINCT vec_id // 3, 'empty', 0.0, 1 FROM vec WHERE vec_id // 3 NOT IN (SELECT q FROM nb))"


def best(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("text", F.concat_ws("-", "s", "e"))
    questions = vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 3).cast("long").alias("q")).distinct()
    return D.nbest(c, ["q"], "text", 4, questions=questions)


@query("span_nbest", f"WITH {NBEST} SELECT q, rank, text, round(score, 6) AS score FROM nbest")
def span_nbest(spark, sf_dir):
    return best(spark, sf_dir).select("q", F.col("rank").cast("long").alias("rank"), "text", F.round("score", 6).alias("score"))


@query("softmax_group", f"WITH {NBEST}, e AS (SELECT q, rank, exp(score - max(score) OVER (PARTITION BY q)) AS e FROM nbest) SELECT q, rank, round(e / sum(e) OVER (PARTITION BY q), 6) AS prob FROM e")
def softmax_group(spark, sf_dir):
    return D.softmax(best(spark, sf_dir), ["q"], "score").select("q", F.col("rank").cast("long").alias("rank"), F.round("prob", 6).alias("prob"))


@query("null_answer", f"WITH {NBEST}, n AS (SELECT vec_id // 3 AS q, min(a[1] + b[1]) AS z FROM vec GROUP BY 1) SELECT q, CASE WHEN z - score > -1.0 THEN '' ELSE text END AS text FROM nbest JOIN n USING (q) WHERE rank = 1")
def null_answer(spark, sf_dir):
    nulls = vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 3).cast("long").alias("q"), (F.get("a", F.lit(0)) + F.get("b", F.lit(0))).alias("null_score"))
    return D.null_answer(best(spark, sf_dir).where("rank = 1"), nulls, ["q"], -1.0)


@query("span_single", f"WITH {CAND}, d AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, s, e) AS n FROM cand) SELECT vec_id, s, e FROM d WHERE n = 1")
def span_single(spark, sf_dir):
    """The best span of one passage each."""
    c = candidates(spark, sf_dir)
    best = c.groupBy("vec_id").agg(F.min_by(F.struct("s", "e"), F.struct(-F.col("score"), F.col("s"), F.col("e"))).alias("b"))
    return best.select("vec_id", "b.s", "b.e")


PLAIN = "list_filter(string_split_regex(regexp_replace(array_to_string(list_transform(string_split(lower(o), ''), lambda c: CASE WHEN c = 'ß' THEN c ELSE strip_accents(c) END), ''), '([" + T.PUNCT + "])', ' \\1 ', 'g'), '\\s+'), lambda x: x <> '')"


@query("span_text", f"WITH {CAND}, w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), d AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, s, e) AS n FROM cand), o AS (SELECT doc_id, coalesce(array_to_string(w[s + 1:e + 1], ' '), '') AS o FROM d JOIN w ON doc_id = vec_id WHERE n = 1), t AS (SELECT doc_id, o, {PLAIN} AS t FROM o), p AS (SELECT doc_id, o, array_to_string(t, '') AS tok, flatten(list_transform(t, lambda x: list_transform(range((length(x) + 2) // 3), lambda i: CASE WHEN i = 0 THEN '' ELSE '##' END || x[3 * i + 1:3 * i + 3]))) AS p FROM t), said AS (SELECT *, replace(array_to_string(CASE doc_id % 3 WHEN 1 THEN p[2:] WHEN 2 THEN p[1:greatest(len(p) - 1, 0)] ELSE p END, ''), '##', '') AS said, list_filter(range(1, length(o) + 1), lambda i: o[i] <> ' ') AS c FROM p) SELECT doc_id, CASE WHEN coalesce(said, '') = '' OR instr(tok, said) = 0 OR len(c) <> length(tok) THEN o ELSE o[c[instr(tok, said)]:c[instr(tok, said) + length(said) - 1]] END AS answer FROM said")
def span_text(spark, sf_dir):
    """Answers predicted in pieces of three letters: whole spans, spans without their first and spans without their last piece."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), T.words("text").alias("w"))
    both = span_single(spark, sf_dir).join(docs, "vec_id").select(F.col("vec_id").alias("doc_id"), D.span_text(F.col("w"), F.col("s"), F.col("e")).alias("source"))
    cut = lambda t: F.transform(F.regexp_extract_all(t, F.lit("(?s).{1,3}"), 0), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("##"), p)))
    both = both.withColumn("pieces", F.flatten(F.transform(T.basic_tokenize("source"), cut)))
    some = F.when(F.col("doc_id") % 3 == 1, F.slice("pieces", F.lit(2), F.size("pieces"))).when(F.col("doc_id") % 3 == 2, F.slice("pieces", F.lit(1), F.greatest(F.size("pieces") - 1, F.lit(0)))).otherwise(F.col("pieces"))
    return both.select("doc_id", D.final_text(some, F.col("source")).alias("answer"))


CHOICE = f"{VEC}, ch AS (SELECT vec_id // 6 AS passage, vec_id % 6 AS blank, unnest(range(6)) AS choice, unnest(a[1:6]) AS score FROM vec)"


def choice_scores(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 6).cast("long").alias("passage"), (F.col("vec_id") % 6).alias("blank"), F.posexplode(F.slice("a", 1, 6)).alias("choice", "score"))
    return v.withColumn("choice", F.col("choice").cast("long"))


@query("assign_argmax", f"WITH {CHOICE} SELECT passage, blank, choice FROM (SELECT *, row_number() OVER (PARTITION BY passage, blank ORDER BY score DESC, choice) AS n FROM ch) WHERE n = 1")
def assign_argmax(spark, sf_dir):
    return D.assign_argmax(choice_scores(spark, sf_dir), ["passage", "blank"])


#: The best free pair of each passage again and again.
GREEDY = f"RECURSIVE {CHOICE}, g AS (SELECT passage, []::BIGINT[] AS bs, []::BIGINT[] AS cs, NULL::STRUCT(b BIGINT, c BIGINT) AS p FROM (SELECT DISTINCT passage FROM ch) UNION ALL SELECT passage, list_append(bs, p.b), list_append(cs, p.c), p FROM (SELECT g.passage, g.bs, g.cs, first({{'b': ch.blank, 'c': ch.choice}} ORDER BY ch.score DESC, ch.blank, ch.choice) AS p FROM g JOIN ch ON g.passage = ch.passage WHERE NOT list_contains(g.bs, ch.blank) AND NOT list_contains(g.cs, ch.choice) GROUP BY g.passage, g.bs, g.cs))"


@query("assign_greedy", f"WITH {GREEDY} SELECT passage, p.b AS blank, p.c AS choice FROM g WHERE p IS NOT NULL")
def assign_greedy(spark, sf_dir):
    return D.assign_greedy(choice_scores(spark, sf_dir), "passage", "blank")


ISLAND = f"{SEQ}, isl AS (SELECT *, sum(CASE WHEN label LIKE 'I-%' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM seq), hd AS (SELECT user_id, island, arg_min(label, pos) AS head, min(pos) AS \"start\" FROM isl GROUP BY ALL), bb AS (SELECT i.*, h.\"start\", h.head[3:] AS type FROM isl i JOIN hd h USING (user_id, island) WHERE h.head LIKE 'B-%')"
SINGLE = "SELECT user_id, label[3:] AS type, pos AS \"start\", pos AS \"end\" FROM seq WHERE label LIKE 'S-%'"
LOOSE = f"{ISLAND}, loose AS (SELECT user_id, type, \"start\", max(pos) AS \"end\", count(*) AS n FROM bb WHERE label[3:] = type GROUP BY user_id, type, \"start\")"
STRICT = f"{ISLAND}, cut AS (SELECT *, min((label[3:] = type)::INTEGER) OVER (PARTITION BY user_id, island ORDER BY pos) AS ok FROM bb), strict AS (SELECT user_id, type, \"start\", max(pos) AS \"end\" FROM cut WHERE ok = 1 GROUP BY user_id, type, \"start\" UNION ALL {SINGLE})"


@query("decode_bios", f"WITH {STRICT} SELECT * FROM strict")
def decode_bios(spark, sf_dir):
    return D.decode_bios(labels(spark, sf_dir), ["user_id"])


@query("decode_bios_loose", f"WITH {LOOSE} SELECT user_id, type, \"start\", \"end\" FROM loose WHERE n > 1 UNION ALL {SINGLE}")
def decode_bios_loose(spark, sf_dir):
    return D.decode_bios(labels(spark, sf_dir), ["user_id"], strict=False)


@query("decode_bio", f"WITH {LOOSE} SELECT user_id, type, \"start\", \"end\" FROM loose")
def decode_bio(spark, sf_dir):
    return D.decode_bio(labels(spark, sf_dir), ["user_id"])


@query("decode_start_end", f"WITH {SEQ} SELECT a.user_id, a.label[3:] AS type, a.pos AS \"start\", min(b.pos) AS \"end\" FROM seq a JOIN seq b ON a.user_id = b.user_id AND a.label[3:] = b.label[3:] AND b.pos >= a.pos WHERE a.label[1] IN ('B', 'S') AND b.label[1] IN ('I', 'S') GROUP BY ALL")
def decode_start_end(spark, sf_dir):
    marks = labels(spark, sf_dir).select("user_id", "pos", F.when(F.col("label").rlike("^[BS]-"), F.substring("label", 3, 100)).alias("s"), F.when(F.col("label").rlike("^[IS]-"), F.substring("label", 3, 100)).alias("e"))
    return D.decode_start_end(marks, ["user_id"])


@query("entity_submission", f"WITH {STRICT}, x AS (SELECT user_id, type, 'u' || (\"start\" % 3) AS text, string_agg('[' || \"start\" || ',' || \"end\" || ']', ',' ORDER BY \"start\", \"end\") AS s FROM strict GROUP BY ALL), y AS (SELECT user_id, type, '{{' || string_agg('\\\"' || text || '\\\":[' || s || ']', ',' ORDER BY text) || '}}' AS t FROM x GROUP BY ALL) SELECT user_id, '{{' || string_agg('\"' || type || '\":\"' || t || '\"', ',' ORDER BY type) || '}}' AS label FROM y GROUP BY user_id")
def entity_submission(spark, sf_dir):
    e = decode_bios(spark, sf_dir).withColumn("text", F.concat(F.lit("u"), (F.col("start") % 3).cast("string")))
    return D.entity_submission(e, ["user_id"])


@query("prediction_diff", f"WITH {SEQ}, a AS (SELECT user_id, string_agg(label, ' ' ORDER BY pos) AS a, string_agg(CASE WHEN label = 'S-LOC' AND user_id % 2 = 0 THEN 'O' ELSE label END, ' ' ORDER BY pos) AS b FROM seq GROUP BY user_id) SELECT user_id, a, b FROM a WHERE a <> b")
def prediction_diff(spark, sf_dir):
    rows = labels(spark, sf_dir)
    line = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("l")))), lambda x: x["l"]), " ").alias("seq")
    a = rows.groupBy("user_id").agg(line(F.col("label")))
    b = rows.groupBy("user_id").agg(line(F.when((F.col("label") == "S-LOC") & (F.col("user_id") % 2 == 0), "O").otherwise(F.col("label"))))
    return D.prediction_diff(a, b, ["user_id"], "seq")


#: The first sub-characters (three letters) of a document's words, the word of each, one in two or three without; and the best
#: candidate in them, moved back by the query's length.
TWO = f"""{CAND}, w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1:200] AS w FROM documents),
sb AS (SELECT doc_id, w, list_transform(range(len(w)), lambda j: length(array_to_string(w[1:j], ''))) AS starts, regexp_extract_all(lower(array_to_string(w, '')), '(?s).{{1,3}}')[1:64] AS subs FROM w),
ow AS (SELECT *, list_transform(range(len(subs)), lambda i: CASE WHEN (i * 7 + doc_id) % 5 < 3 THEN len(list_filter(starts, lambda x: x <= 3 * i)) - 1 END) AS m FROM sb),
b AS (SELECT vec_id, s - 2 - vec_id % 3 AS s, e - 2 - vec_id % 3 AS e, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, s, e) AS n FROM cand) WHERE n = 1),
x AS (SELECT vec_id, s, e, score, w, subs, m[s + 1] AS ms, m[e + 1] AS me, list_filter(m[1:s + 1], lambda v: v IS NOT NULL)[-1] AS sl, list_filter(m[s + 1:], lambda v: v IS NOT NULL)[1] AS sr,
  list_filter(m[1:e + 1], lambda v: v IS NOT NULL)[-1] AS el, list_filter(m[e + 1:], lambda v: v IS NOT NULL)[1] AS er FROM b JOIN ow ON vec_id = doc_id WHERE e < len(subs)),
y AS (SELECT *, CASE WHEN ms IS NOT NULL THEN ms WHEN sl IS NULL THEN CASE WHEN sr >= 1 THEN 0 ELSE sr END WHEN sr IS NULL THEN sl WHEN sr > sl + 1 THEN sl + 1 ELSE sr END AS first,
  CASE WHEN me IS NOT NULL THEN me WHEN el IS NULL THEN CASE WHEN er >= 1 THEN er - 1 ELSE er END WHEN er IS NULL THEN el WHEN er > el + 1 THEN er - 1 ELSE el END AS last0 FROM x),
o AS (SELECT *, greatest(first, last0) AS last, array_to_string(w[first + 1:greatest(first, last0) + 1], ' ') AS o, replace(array_to_string(subs[s + 1:e + 1], ''), '##', '') AS said FROM y WHERE first IS NOT NULL),
z AS (SELECT *, array_to_string({PLAIN}, '') AS tok, list_filter(range(1, length(o) + 1), lambda i: o[i] <> ' ') AS c FROM o)"""


@query("span_two_level", f"WITH {TWO} SELECT vec_id, s, e, first, last, CASE WHEN said <> '' AND instr(tok, said) > 0 AND len(c) = length(tok) THEN o[c[instr(tok, said)]:c[instr(tok, said) + length(said) - 1]] ELSE o END AS answer, round(score, 6) AS score FROM z")
def span_two_level(spark, sf_dir):
    """Scores of sub-characters of three letters; some have no word of their own."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.slice(T.words("text"), 1, 200).alias("tokens"))
    docs = docs.join(vectors(spark, sf_dir).select("vec_id"), "vec_id").withColumn("subs", F.slice(F.regexp_extract_all(F.lower(F.array_join("tokens", "")), F.lit("(?s).{1,3}"), 0), 1, 64))
    f = Y.owners(docs, ["vec_id"], "subs", "tokens", "own")
    holes = F.transform("own", lambda x, i: F.when((i * 7 + F.col("vec_id")) % 5 < 3, x))
    moved = [(F.col(c) - 2 - F.col("vec_id") % 3).alias(c) for c in ("s", "e")]
    out = D.span_two_level(candidates(spark, sf_dir).select("vec_id", *moved, "score"), ["vec_id"], f.select("vec_id", "subs", holes.alias("owner"), "tokens"))
    return out.select("vec_id", "s", "e", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "answer", F.round("score", 6).alias("score"))
