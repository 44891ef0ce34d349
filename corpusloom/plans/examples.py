"""Queries of examples. Turns of conversations and lines of documents stand in for dataset records."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import examples as E
from corpusloom.plans.base import HANZI, LATIN, query, table
from corpusloom.plans.codebooks import PHRASES, simplified, simplified_sql, transducer

TURN = "conversations"


def turns(spark, sf_dir):
    return table(spark, sf_dir, TURN)


def simple(name, cols, sql):
    query(name, sql)(lambda s, d: turns(s, d).select(*cols()))


W_SQL = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"
WT = W_SQL.format("text")
words = lambda c="text": T.words(c)
simple("ex_single", lambda: [F.concat(F.lit("train-"), "conv_id", F.lit("-"), "turn").alias("guid"), F.col("text").alias("text_a"), F.col("role").alias("label")], "SELECT 'train-' || conv_id || '-' || turn AS guid, text AS text_a, role AS label FROM conversations")
simple("ex_with_keywords", lambda: ["conv_id", "turn", F.col("text").alias("text_a"), F.array_join(F.slice(words(), 1, 3), "，").alias("text_b"), F.col("role").alias("label")], f"SELECT conv_id, turn, text AS text_a, array_to_string(({WT})[1:3], '，') AS text_b, role AS label FROM conversations")
simple("ex_keywords_first", lambda: ["conv_id", "turn", F.array_join(F.slice(words(), 1, 3), "，").alias("text_a"), F.col("text").alias("text_b")], f"SELECT conv_id, turn, array_to_string(({WT})[1:3], '，') AS text_a, text AS text_b FROM conversations")


@query("ex_pair_json", "SELECT a.conv_id, a.text AS text_a, b.text AS text_b, (length(a.text) > length(b.text))::INTEGER AS label FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1")
def ex_pair_json(spark, sf_dir):
    """Records are packed as JSON and read from it."""
    t = turns(spark, sf_dir)
    both = t.where("turn = 0").select("conv_id", F.col("text").alias("sentence1")).join(t.where("turn = 1").select("conv_id", F.col("text").alias("sentence2")), "conv_id")
    packed = both.select("conv_id", F.to_json(F.struct("sentence1", "sentence2", (F.length("sentence1") > F.length("sentence2")).cast("int").alias("label"))).alias("value"))
    r = packed.select("conv_id", F.from_json("value", "sentence1 string, sentence2 string, label int").alias("r"))
    return r.select("conv_id", F.col("r.sentence1").alias("text_a"), F.col("r.sentence2").alias("text_b"), "r.label")


@query("ex_pair_tsv", "SELECT doc_id, string_split(line, chr(9))[1] AS text_a, string_split(line, chr(9))[2] AS text_b, string_split(line, chr(9))[3] AS label FROM (SELECT doc_id, replace(replace(text, chr(10), ' '), chr(9), ' ') || chr(9) || lang || chr(9) || source AS line FROM documents)")
def ex_pair_tsv(spark, sf_dir):
    line = F.concat_ws("\t", F.translate("text", "\n\t", "  "), "lang", "source")
    c = F.from_csv(line, "text_a string, text_b string, label string", {"sep": "\t", "quote": "\x00"})
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.*")


simple("ex_title_content", lambda: ["conv_id", "turn", F.array_join(F.slice(words(), 1, 5), " ").alias("text_a"), F.col("text").alias("text_b"), F.col("role").alias("label")], f"SELECT conv_id, turn, array_to_string(({WT})[1:5], ' ') AS text_a, text AS text_b, role AS label FROM conversations")
SPAN = f"m AS (SELECT conv_id, turn, text, w[1] AS a, 0 AS i, w[len(w)] AS b, length(rtrim(text)) - length(w[len(w)]) AS j FROM (SELECT *, {WT} AS w FROM conversations) WHERE len(w) >= 2 AND regexp_matches(text, '^\\S'))"


@query("ex_span_marked", f"WITH {SPAN} SELECT conv_id, turn, CASE WHEN text[j + 1:j + length(b)] = b THEN '_' || a || '_' || text[length(a) + 1:j] || '[' || b || ']' || text[j + length(b) + 1:] END AS text_a FROM m")
def ex_span_marked(spark, sf_dir):
    """A turn's first word is the first span, its last word the second."""
    t = turns(spark, sf_dir).withColumn("w", words()).where("size(w) >= 2").where(F.col("text").rlike(r"^\S"))
    a, b = F.get("w", F.lit(0)), F.element_at("w", -1)
    j = F.length(F.regexp_replace("text", r"\s+$", "")) - F.length(b)
    return t.select("conv_id", "turn", E.span_marked(F.col("text"), a, F.lit(0), b, j).alias("text_a"))


@query("ex_column_layouts", "SELECT doc_id, 'a' AS layout, text AS text_a, lang AS text_b, source AS label FROM documents UNION ALL SELECT doc_id, 'b', lang, text, source FROM documents UNION ALL SELECT doc_id, 'c', source, NULL, lang FROM documents")
def ex_column_layouts(spark, sf_dir):
    """Tasks that name their columns by position: the position of each role is data."""
    cols = F.array("text", "lang", "source")
    layouts = F.array(*[F.struct(F.lit(n).alias("layout"), F.lit(a).alias("a"), F.lit(b).cast("int").alias("b"), F.lit(c).alias("c")) for n, a, b, c in (("a", 0, 1, 2), ("b", 1, 0, 2), ("c", 2, None, 1))])
    rows = table(spark, sf_dir, "documents").select("doc_id", cols.alias("cols"), F.explode(layouts).alias("l"))
    return rows.select("doc_id", "l.layout", F.get("cols", F.col("l.a")).alias("text_a"), F.get("cols", F.col("l.b")).alias("text_b"), F.get("cols", F.col("l.c")).alias("label"))


@query("ex_labels_bmes", "SELECT user_id, string_agg(regexp_replace((['B-X', 'M-X', 'E-X', 'S-X', 'O'])[event_id % 5 + 1], '^[ME]-', 'I-'), ' ' ORDER BY ts, event_id) AS labels FROM events WHERE user_id > (SELECT min(user_id) FROM events) GROUP BY user_id")
def ex_labels_bmes(spark, sf_dir):
    label = F.get(F.split(F.lit("B-X M-X E-X S-X O"), " "), (F.col("event_id") % 5).cast("int"))
    seq = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", label.alias("l")))), lambda x: x["l"]).alias("labels"))
    return E.without_first(seq, "user_id").select("user_id", F.array_join(E.labels_bmes(F.col("labels")), " ").alias("labels"))


@query("ex_spans", "WITH d AS (SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id % 7 AS k FROM events)) SELECT user_id, string_agg(pos || ':' || pos, ' ' ORDER BY pos) AS spans FROM d WHERE k = 4 GROUP BY user_id")
def ex_spans(spark, sf_dir):
    from corpusloom.plans.decoding import decode_bios, labels

    at = labels(spark, sf_dir).where("label = 'S-LOC'").select("user_id", F.col("pos").alias("start"))
    s_only = decode_bios(spark, sf_dir).where("start = `end`").join(at, ["user_id", "start"], "left_semi")
    return s_only.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("start")), lambda p: F.concat_ws(":", p, p)), " ").alias("spans"))


CHOICES = f"q AS (SELECT conv_id, turn, {WT} AS w FROM conversations), c AS (SELECT conv_id, turn, w[1] AS question, list_concat(w[1:2 + turn % 3], ['{E.FILLER}', '{E.FILLER}', '{E.FILLER}', '{E.FILLER}'])[1:4] AS choices, w[2] AS answer FROM q WHERE len(w) >= 5)"


def choices(spark, sf_dir):
    q = turns(spark, sf_dir).withColumn("w", words()).where("size(w) >= 5")
    some = E.padded_choices(F.slice("w", F.lit(1), (2 + F.col("turn") % 3).cast("int")))
    return q.select("conv_id", "turn", F.get("w", F.lit(0)).alias("question"), some.alias("choices"), F.get("w", F.lit(1)).alias("answer"))


@query("ex_choices", f"WITH {CHOICES} SELECT conv_id, turn, question, unnest(range(4)) AS k, unnest(choices) AS choice, list_max(list_transform(range(4), lambda i: CASE WHEN choices[i + 1] = answer THEN i END)) AS label FROM c")
def ex_choices(spark, sf_dir):
    c = choices(spark, sf_dir).withColumn("label", E.choice_label(F.col("choices"), F.col("answer")).cast("long"))
    return c.select("conv_id", "turn", "question", F.posexplode("choices").alias("k", "choice"), "label").withColumn("k", F.col("k").cast("long"))


@query("ex_swag", f"WITH {CHOICES} SELECT conv_id, turn, question AS context, choices[1] AS e0, choices[2] AS e1, choices[3] AS e2, choices[4] AS e3 FROM c")
def ex_swag(spark, sf_dir):
    return choices(spark, sf_dir).select("conv_id", "turn", F.col("question").alias("context"), *[F.get("choices", F.lit(k)).alias(f"e{k}") for k in range(4)])


#: The ends of sentences stand in for blanks, the first four words of a turn for its options.
CLOZE = f"cz AS (SELECT conv_id, turn, w[1:4] AS options, p, list_transform(range(len(p) - 1), lambda i: '#idiom' || lpad(((conv_id * 1000 + i) % 1000000)::VARCHAR, 6, '0') || '#') AS tags FROM (SELECT conv_id, turn, string_split(text, '.') AS p, {WT} AS w FROM conversations)), ct AS (SELECT conv_id, turn, options, tags, regexp_extract_all(array_to_string(list_transform(range(len(p)), lambda i: p[i + 1] || coalesce(tags[i + 1], '')), ''), '#idiom\\d{{6}}#|[{T.CJK}{T.PUNCT}]|[^\\s{T.CJK}{T.PUNCT}]+') AS tokens FROM cz), cb AS (SELECT conv_id, turn, options, tokens, unnest(range(len(tags))) AS blank, unnest(tags) AS tag FROM ct)"


def cloze(spark, sf_dir):
    """One blank in five has no label."""
    number = lambda i: F.lpad(((F.col("conv_id") * 1000 + i) % 1000000).cast("string"), 6, "0")
    p = turns(spark, sf_dir).select("conv_id", "turn", F.slice(words(), 1, 4).alias("options"), F.split("text", r"\.").alias("p"))
    tags = F.transform("p", lambda _, i: F.concat(F.lit("#idiom"), number(i), F.lit("#")))
    p = p.withColumn("tags", F.slice(tags, F.lit(1), F.size("p") - 1))
    text = F.array_join(F.transform("p", lambda s, i: F.concat(s, F.coalesce(F.get("tags", i), F.lit("")))), "")
    labels = p.select("conv_id", "turn", F.posexplode("tags").alias("i", "tag")).where("i % 5 != 4").withColumn("answer", (F.col("conv_id") + F.col("i")) % 4)
    return E.cloze_examples(p.withColumn("text", text), ["conv_id", "turn"], "text", "options", labels)


@query("ex_cloze", f"WITH {CLOZE} SELECT conv_id, turn, blank, tag, list_position(tokens, tag) - 1 AS place, array_to_string(options, '|') AS options, CASE WHEN blank % 5 <> 4 THEN (conv_id + blank) % 4 END AS answer FROM cb")
def ex_cloze(spark, sf_dir):
    rows = cloze(spark, sf_dir)
    return rows.select("conv_id", "turn", F.col("blank").cast("long").alias("blank"), "tag", (F.array_position("tokens", F.col("tag")) - 1).alias("place"), F.array_join("options", "|").alias("options"), F.col("answer").cast("long").alias("answer"))


READ = f"r AS (SELECT conv_id, turn, text, w[2] AS answer, greatest(instr(text, w[2]) - 1 + conv_id % 9 - 4, 0) AS given FROM (SELECT *, {WT} AS w FROM conversations) WHERE len(w) >= 2), s AS (SELECT *, list_filter([given - 3, given - 2, given - 1, given, given + 1, given + 2, given + 3], lambda p: p >= 0 AND text[p + 1:p + length(answer)] = answer) AS hit FROM r)"


def reading(spark, sf_dir):
    """Answers whose given start is off by up to four characters."""
    r = turns(spark, sf_dir).withColumn("w", words()).where("size(w) >= 2").withColumn("answer", F.get("w", F.lit(1)))
    return r.withColumn("given", F.greatest(F.instr("text", F.col("answer")) - 1 + F.col("conv_id") % 9 - 4, F.lit(0)).cast("int"))


@query("ex_reading_shift", f"WITH {READ} SELECT conv_id, turn, coalesce(hit[1], given) AS \"start\" FROM s")
def ex_reading_shift(spark, sf_dir):
    return reading(spark, sf_dir).select("conv_id", "turn", E.answer_shift(F.col("text"), F.col("given"), F.col("answer")).cast("long").alias("start"))


H_SQL = f"translate(text, '{LATIN}', '{HANZI}')"
TOKEN_SQL = f"list_filter(string_split_regex(regexp_replace({{0}}, '([{T.CJK}{T.PUNCT}])', ' \\1 ', 'g'), '\\s+'), lambda x: x <> '')".replace("{0}", "@")
tokens_sql = lambda c: TOKEN_SQL.replace("@", c)
SPANS = f"h AS (SELECT conv_id, turn, {H_SQL} AS text, {W_SQL.format(H_SQL)} AS w FROM conversations), a AS (SELECT *, CASE WHEN conv_id % 4 = 1 AND contains(text, '。') THEN text[instr(text, '。'):instr(text, '。') + 5] WHEN conv_id % 4 = 2 THEN ' ' || w[2] ELSE w[2] || coalesce(' ' || w[3], '') END AS answer FROM h WHERE len(w) >= 2), g AS (SELECT *, greatest(instr(text, answer) - 2 + (conv_id // 4) % 5, 0) AS given FROM a), b AS (SELECT *, given - coalesce(list_filter(range(0, least(3, given) + 1), lambda d: text[given - d + 1:given - d + length(answer)] = answer)[1], least(3, given)) AS begin FROM g), f AS (SELECT *, begin + length(regexp_extract(text[begin + 1:], '^[ \\t\\r\\n]*')) AS first, {tokens_sql('text')} AS tokens FROM b), p AS (SELECT *, len({tokens_sql('text[1:first + 1]')}) - 1 AS tok, len({tokens_sql('text[1:begin + length(answer)]')}) - 1 AS stop FROM f), s AS (SELECT *, tok + (coalesce(tokens[tok + 1], '') IN ('。', '，', '：', ':', '.', ','))::INTEGER AS start FROM p)"


@query("ex_reading", f"WITH {SPANS} SELECT conv_id, turn, answer, start::BIGINT AS \"start\", stop::BIGINT AS stop, array_to_string(tokens[start + 1:stop + 1], '') = regexp_replace(answer, '\\s', '', 'g') AS matches FROM s")
def ex_reading(spark, sf_dir):
    """Answers of two words, after a space, or from a full stop on, in texts with marks and characters; their given start is
    up to one character early and three late."""
    h = turns(spark, sf_dir).select("conv_id", "turn", F.translate("text", LATIN, HANZI).alias("text")).withColumn("w", words()).where("size(w) >= 2")
    second, third, stop = F.get("w", F.lit(1)), F.get("w", F.lit(2)), F.instr("text", "。")
    plain = F.concat(second, F.coalesce(F.concat(F.lit(" "), third), F.lit("")))
    kind = F.col("conv_id") % 4
    h = h.withColumn("answer", F.when((kind == 1) & (stop > 0), F.substring(F.col("text"), stop, F.lit(6))).when(kind == 2, F.concat(F.lit(" "), second)).otherwise(plain))
    h = h.withColumn("given", F.greatest(F.instr("text", F.col("answer")) - 2 + F.floor(F.col("conv_id") / 4) % 5, F.lit(0)).cast("int"))
    at = h.select("conv_id", "turn", "answer", E.reading_span(F.col("text"), F.col("given"), F.col("answer")).alias("at"))
    return at.select("conv_id", "turn", "answer", F.col("at.start").cast("long").alias("start"), F.col("at.stop").cast("long").alias("stop"), "at.matches")


@query("ex_reading_negative", f"WITH {READ} SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN -1 ELSE hit[1] END AS \"start\" FROM s WHERE turn % 3 = 0 OR len(hit) > 0")
def ex_reading_negative(spark, sf_dir):
    """One in three questions has no answer; answers that cannot be found are left out."""
    r = reading(spark, sf_dir).withColumn("at", E.answer_shift(F.col("text"), F.col("given"), F.col("answer")))
    found = F.substring("text", F.col("at") + 1, F.length("answer")) == F.col("answer")
    return r.where((F.col("turn") % 3 == 0) | found).select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, -1).otherwise(F.col("at")).cast("long").alias("start"))


@query("label_index", "SELECT doc_id, lang, (list_position(['de', 'en', 'es', 'fr'], CASE lang WHEN '-' THEN 'en' ELSE lang END) - 1)::INTEGER AS label_id FROM documents")
def label_index(spark, sf_dir):
    return E.label_index(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["de", "en", "es", "fr"], neutral="en")


SIZES = f"z AS (SELECT conv_id, turn, len({WT}) AS a, length(role) + turn AS b, (conv_id % 23)::BIGINT AS c FROM conversations)"
#: A recursion that takes one token at a time.
STEP_PAIR = "RECURSIVE {z}, s AS (SELECT conv_id, turn, a, b FROM z UNION ALL SELECT conv_id, turn, CASE WHEN a > b THEN a - 1 ELSE a END, CASE WHEN a > b THEN b ELSE b - 1 END FROM s WHERE a + b > 20)"
STEP_TRIPLE = "RECURSIVE {z}, s AS (SELECT conv_id, turn, a, b, c FROM z UNION ALL SELECT conv_id, turn, CASE WHEN a >= b AND a >= c THEN a - 1 ELSE a END, CASE WHEN NOT (a >= b AND a >= c) AND b >= c THEN b - 1 ELSE b END, CASE WHEN NOT (a >= b AND a >= c) AND NOT b >= c THEN c - 1 ELSE c END FROM s WHERE a + b + c > 20)"


def sizes(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.size(words()).alias("a"), (F.length("role") + F.col("turn")).cast("int").alias("b"), (F.col("conv_id") % 23).cast("int").alias("c"))


@query("truncate_pair", f"WITH {STEP_PAIR.format(z=SIZES)} SELECT conv_id, turn, a::INTEGER AS a, b::INTEGER AS b FROM s WHERE a + b <= 20")
def truncate_pair(spark, sf_dir):
    a, b = E.truncate_pair(F.col("a"), F.col("b"), 20)
    return sizes(spark, sf_dir).select("conv_id", "turn", a.alias("a"), b.alias("b"))


@query("truncate_triple", f"WITH {STEP_TRIPLE.format(z=SIZES)} SELECT conv_id, turn, a::INTEGER AS a, b::INTEGER AS b, c::INTEGER AS c FROM s WHERE a + b + c <= 20")
def truncate_triple(spark, sf_dir):
    a, b, c = E.truncate_triple(F.col("a"), F.col("b"), F.col("c"), 20)
    return sizes(spark, sf_dir).select("conv_id", "turn", a.alias("a"), b.alias("b"), c.alias("c"))


#: Pieces of a text from the left, the longest phrase first.
PIECES = "|".join([*sorted(PHRASES, key=len, reverse=True), "(?s:.)"])
SIMPLE = f"q AS (SELECT conv_id, turn, text AS old, instr(text, w[2]) - 1 AS given, w[2] || coalesce(' ' || w[3], '') AS ans, regexp_extract_all(text, '{PIECES}') AS pcs FROM (SELECT *, {WT} AS w FROM conversations) WHERE len(w) >= 2), u AS (SELECT conv_id, turn, given, given + length(ans) - 1 AS final, unnest(range(len(pcs))) AS j, unnest(pcs) AS piece FROM q), v AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, turn ORDER BY j) AS upto FROM u), c AS (SELECT conv_id, turn, coalesce(sum(length({simplified_sql('piece')})) FILTER (upto <= given), 0)::BIGINT AS begin, sum(length({simplified_sql('piece')})) FILTER (upto - length(piece) <= final)::BIGINT - 1 AS last FROM v GROUP BY conv_id, turn), i AS (SELECT *, {simplified_sql('old')} AS text, {simplified_sql('ans')} AS answer FROM q JOIN c USING (conv_id, turn) WHERE given + length(ans) <= length(old)), f AS (SELECT *, begin + length(regexp_extract(text[begin + 1:], '^[ \\t\\r\\n]*')) AS first, {tokens_sql('text')} AS tokens FROM i), p AS (SELECT *, len({tokens_sql('text[1:first + 1]')}) - 1 AS tok, len({tokens_sql('text[1:last + 1]')}) - 1 AS stop FROM f), s AS (SELECT *, tok + (coalesce(tokens[tok + 1], '') IN ('。', '，', '：', ':', '.', ','))::INTEGER AS start FROM p)"


@query("ex_reading_simplified", f"WITH {SIMPLE} SELECT conv_id, turn, answer, start::BIGINT AS \"start\", stop::BIGINT AS stop, array_to_string(tokens[start + 1:stop + 1], '') = regexp_replace(answer, '\\s', '', 'g') AS matches FROM s")
def ex_reading_simplified(spark, sf_dir):
    """Answers of two words: passage and answer are made simple, and the answer's place is carried over."""
    r = turns(spark, sf_dir).withColumn("w", words()).where("size(w) >= 2")
    answer = F.concat(F.get("w", F.lit(1)), F.coalesce(F.concat(F.lit(" "), F.get("w", F.lit(2))), F.lit("")))
    r = r.select("conv_id", "turn", "text", answer.alias("old"), (F.instr("text", F.get("w", F.lit(1))) - 1).alias("given"))
    r = r.withColumns({"made": transducer(spark)("text"), "answer": simplified(spark, "old")})
    at = r.select("conv_id", "turn", "answer", E.reading_span_in_converted(F.col("made"), F.col("given"), F.length("old"), F.col("answer")).alias("at")).where("at is not null")
    return at.select("conv_id", "turn", "answer", F.col("at.start").cast("long").alias("start"), F.col("at.stop").cast("long").alias("stop"), "at.matches")
