"""Queries of readers and sinks: files are written from the tables, then read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.examples import FILLER
from corpusloom.plans.base import LINES, query, table
from corpusloom.plans.codebooks import WORDS
from corpusloom.plans.decoding import VEC, vectors
from corpusloom.plans.examples import WT, turns, words
from corpusloom.plans.pretraining import SHARD, shards
from corpusloom.plans.vocabularies import vocab_sql, word_vocab
from corpusloom.sources import readers as R
from corpusloom.sources import sinks as S


def written(rows: DataFrame, name: str, *, sep: str = "\n") -> str:
    """A folder of text files of the column ``value``."""
    path = S.scratch(rows.sparkSession, name)
    rows.select("value").write.option("lineSep", sep).text(path)
    return path


#: Turns of a conversation in one JSON record.
TURNS = 64


def chunk() -> list[Column]:
    """Keys of records that hold at most ``TURNS`` turns, however long a conversation is."""
    return [F.col("conv_id"), F.floor(F.col("turn") / TURNS).alias("_chunk")]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("read_doc_lines", f"WITH {LINES} SELECT rtrim(line) AS text, count(*) AS n FROM lines WHERE trim(line) <> '' GROUP BY 1")
def read_doc_lines(spark, sf_dir):
    path = written(docs(spark, sf_dir).select(F.col("text").alias("value")), "lines")
    return R.doc_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("read_sentence_docs", "WITH d AS (SELECT DISTINCT text FROM documents), l AS (SELECT text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM d) SELECT sentence, sent_no, count(*) AS n FROM (SELECT unnest(range(len(s))) AS sent_no, unnest(s) AS sentence FROM l) GROUP BY ALL")
def read_sentence_docs(spark, sf_dir):
    path = written(docs(spark, sf_dir).select(F.col("text").alias("value")).distinct(), "sentences", sep="\n\n")
    return R.sentence_docs(spark, path).groupBy("sentence", F.col("sent_no").cast("long").alias("sent_no")).agg(F.count("*").alias("n"))


#: Documents of a book.
BOOK = 1024


@query("read_books", f"SELECT source, doc_id // {BOOK} AS book, array_to_string(list_filter(list_transform(string_split(string_agg(text, chr(10) ORDER BY doc_id), chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS text FROM documents GROUP BY ALL")
def read_books(spark, sf_dir):
    """A book, and so a file, of at most ``BOOK`` documents of a source in order, however many a source has."""
    path = S.scratch(spark, "books")
    rows = docs(spark, sf_dir).select("source", F.floor(F.col("doc_id") / BOOK).alias("book"), "doc_id", F.col("text").alias("value"))
    rows.repartition("source", "book").sortWithinPartitions("source", "book", "doc_id").drop("doc_id").write.partitionBy("source", "book").text(path)
    part = lambda name: F.regexp_extract("file", f"{name}=([^/]+)", 1)
    return R.books(spark, path).select(part("source").alias("source"), part("book").cast("long").alias("book"), "text")


@query("read_wiki_extract", "SELECT array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(x)), lambda x: x <> ''), ' ') AS text, count(*) AS n FROM documents GROUP BY 1")
def read_wiki_extract(spark, sf_dir):
    article = F.concat(F.lit('<doc id="'), F.col("doc_id"), F.lit('">\nTitle\n\n'), "text", F.lit("\n</doc>"))
    path = written(docs(spark, sf_dir).select(article.alias("value")), "wiki")
    return R.wiki_extract(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("read_jsonl", "SELECT doc_id, lang, text FROM documents")
def read_jsonl(spark, sf_dir):
    path = S.scratch(spark, "json")
    S.jsonl(docs(spark, sf_dir).select("doc_id", "lang", "text"), path)
    return R.jsonl(spark, path, "doc_id bigint, lang string, text string")


@query("read_tsv", "SELECT doc_id, lang, replace(replace(text, chr(10), ' '), chr(9), ' ') AS text FROM documents")
def read_tsv(spark, sf_dir):
    flat = F.translate("text", "\n\t", "  ")
    path = written(docs(spark, sf_dir).select(F.concat_ws("\t", "doc_id", "lang", flat).alias("value")), "tsv")
    return R.tsv(spark, path, "doc_id bigint, lang string, text string")


@query("read_choice_csv", f"WITH q AS (SELECT conv_id, turn, {WT} AS w FROM conversations) SELECT conv_id || '-' || turn AS id, w[1] AS \"start\", array_to_string(w[2:5], '|') AS endings, (turn % 4)::INTEGER AS label FROM q WHERE len(w) >= 5")
def read_choice_csv(spark, sf_dir):
    q = turns(spark, sf_dir).withColumn("w", words()).where("size(w) >= 5")
    at = lambda k: F.get("w", F.lit(k))
    blank = F.lit("-")
    cols = [blank, blank, F.concat_ws("-", "conv_id", "turn"), blank, F.lit("context"), at(0), blank, at(1), at(2), at(3), at(4), (F.col("turn") % 4).cast("string")]
    path = S.scratch(spark, "choices")
    q.select(*[c.alias(n) for c, n in zip(cols, [*(f"c{k}" for k in range(11)), "label"])]).write.csv(path, header=True)
    return R.choice_csv(spark, path).select("id", "start", F.array_join("endings", "|").alias("endings"), "label")


@query("read_nested_qa", f"WITH q AS (SELECT conv_id, turn, text, {WT} AS w FROM conversations) SELECT conv_id || '-' || turn AS id, text AS context, w[1] AS question, w[2] AS answer, instr(text, w[2])::INTEGER AS answer_start, turn % 2 = 1 AS is_impossible FROM q WHERE len(w) >= 2")
def read_nested_qa(spark, sf_dir):
    q = turns(spark, sf_dir).withColumn("w", words()).where("size(w) >= 2")
    answer = F.struct(F.get("w", F.lit(1)).alias("text"), F.instr("text", F.get("w", F.lit(1))).alias("answer_start"))
    qa = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.get("w", F.lit(0)).alias("question"), F.array(answer).alias("answers"), (F.col("turn") % 2 == 1).alias("is_impossible"))
    paragraph = F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))
    path = S.scratch(spark, "qa")
    q.groupBy(*chunk()).agg(F.array(F.struct(F.collect_list(paragraph).alias("paragraphs"))).alias("data")).select("data").write.json(path)
    out = R.nested_qa(spark, path, whole_files=False)
    return out.select("id", "context", "question", F.get("answers", F.lit(0))["text"].alias("answer"), F.get("answers", F.lit(0))["answer_start"].alias("answer_start"), "is_impossible")


@query("read_dialog_choice", f"WITH q AS (SELECT text, role, {WT} AS w FROM conversations) SELECT lower(role) || chr(10) || 'end' AS dialog, lower(w[1]) AS question, lower(w[1]) || '|' || lower(w[2]) || '|{FILLER}|{FILLER}' AS choices, lower(w[2]) AS answer, count(*) AS n FROM q WHERE len(w) >= 2 GROUP BY ALL")
def read_dialog_choice(spark, sf_dir):
    q = turns(spark, sf_dir).withColumn("w", words()).where("size(w) >= 2")
    one, two = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    question = F.to_json(F.array(F.struct(one.alias("question"), F.array(one, two).alias("choice"), two.alias("answer"))))
    path = written(q.select(F.concat(F.lit("["), F.to_json(F.array("role", F.lit("End"))), F.lit(","), question, F.lit("]")).alias("value")), "dialog")
    got = R.dialog_choice(spark.read.text(path))
    return got.select("dialog", "question", F.array_join("choices", "|").alias("choices"), "answer").groupBy("dialog", "question", "choices", "answer").agg(F.count("*").alias("n"))


@query("read_cloze", "WITH t AS (SELECT '#idiom' || lpad(((conv_id * 100 + turn) % 1000000)::VARCHAR, 6, '0') || '#' AS tag, role, turn FROM conversations) SELECT tag, 'a ' || tag || ' b' AS passage, role || '|x' AS candidates, max(turn % 2) OVER (PARTITION BY tag)::INTEGER AS answer FROM t")
def read_cloze(spark, sf_dir):
    tag = F.concat(F.lit("#idiom"), F.lpad(((F.col("conv_id") * 100 + F.col("turn")) % 1000000).cast("string"), 6, "0"), F.lit("#"))
    t = turns(spark, sf_dir).select(tag.alias("tag"), "role", "turn")
    path = S.scratch(spark, "cloze")
    t.select(F.array(F.concat(F.lit("a "), "tag", F.lit(" b"))).alias("content"), F.array("role", F.lit("x")).alias("candidates")).write.json(path)
    answers = t.groupBy("tag").agg(F.max(F.col("turn") % 2).cast("int").alias("answer"))
    return R.cloze(spark, path, answers).select("tag", "passage", F.array_join("candidates", "|").alias("candidates"), "answer")


LAB = "(['B-X', 'I-X', 'O'])"


@query("read_token_labels", f"WITH q AS (SELECT conv_id, turn, {WT} AS w FROM conversations), u AS (SELECT conv_id, turn, unnest(range(len(w))) AS i, unnest(w) AS x FROM q), s AS (SELECT string_agg(x, ' ' ORDER BY i) AS words, string_agg(CASE WHEN i % 4 = 3 THEN 'O' ELSE {LAB}[i % 3 + 1] END, ' ' ORDER BY i) AS labels FROM u GROUP BY conv_id, turn) SELECT words, labels, count(*) AS n FROM s GROUP BY ALL")
def read_token_labels(spark, sf_dir):
    """One label in four is missing."""
    names = F.split(F.lit("B-X I-X O"), " ")
    line = lambda x, i: F.when(i % 4 == 3, x).otherwise(F.concat(x, F.lit(" "), F.get(names, i % 3)))
    q = turns(spark, sf_dir).select(F.array_join(F.transform(words(), line), "\n").alias("value")).where("value != ''")
    got = R.token_labels(spark, written(q, "labels", sep="\n\n"))
    return got.select(F.array_join("words", " ").alias("words"), F.array_join("labels", " ").alias("labels")).groupBy("words", "labels").agg(F.count("*").alias("n"))


@query("read_entity_json", f"WITH q AS (SELECT conv_id, turn, array_to_string({WT}, ' ') AS text, length(({WT})[1]) AS k FROM conversations), c AS (SELECT conv_id, turn, text, k, unnest(range(length(text))) AS i FROM q WHERE turn % 5 <> 4) SELECT conv_id, turn, string_agg(CASE WHEN i >= k THEN 'O' WHEN k = 1 THEN 'S-N' WHEN i = 0 THEN 'B-N' ELSE 'I-N' END, ' ' ORDER BY i) AS labels FROM c GROUP BY conv_id, turn")
def read_entity_json(spark, sf_dir):
    """The first word is an entity; in one of five turns it is given a wrong place and rejected."""
    q = turns(spark, sf_dir).select("conv_id", "turn", F.array_join(words(), " ").alias("t"), F.get(words(), F.lit(0)).alias("w"))
    n = F.length("w")
    bad = (F.col("turn") % 5 == 4).cast("int")
    span = F.array(F.array(bad, n - 1 + bad))
    value = F.to_json(F.struct(F.concat_ws("|", F.col("t")).alias("text"), F.create_map(F.lit("N"), F.create_map("w", span)).alias("label")))
    good, _ = R.entity_json(q.select(value.alias("value")).distinct())
    keyed = q.where("turn % 5 != 4").select("conv_id", "turn", F.col("t").alias("text"))
    return keyed.join(good, "text").select("conv_id", "turn", F.array_join("labels", " ").alias("labels"))


@query("read_paired_text", "SELECT text_a, text_b, count(*) AS n FROM (SELECT CASE WHEN turn % 2 = 0 THEN role END AS text_b, trim(replace(text, chr(10), ' ')) AS text_a FROM conversations) GROUP BY text_a, text_b")
def read_paired_text(spark, sf_dir):
    first = F.trim(F.translate("text", "\n", " "))
    value = F.when(F.col("turn") % 2 == 0, F.concat(first, F.lit(" ||| "), "role")).otherwise(first)
    path = written(turns(spark, sf_dir).select(value.alias("value")), "pairs")
    return R.paired_text(spark, path).groupBy("text_a", "text_b").agg(F.count("*").alias("n"))


def vocab_file(spark, sf_dir) -> str:
    path = S.scratch(spark, "vocab")
    S.vocab(word_vocab(spark, sf_dir), path)
    return path


@query("read_vocab_scored", f"WITH {WORDS}, {vocab_sql()} SELECT id::INTEGER AS id, token, n::DOUBLE AS score FROM vocab")
def read_vocab_scored(spark, sf_dir):
    return R.vocab_scored(spark, vocab_file(spark, sf_dir))


@query("write_vocab", f"WITH {WORDS}, {vocab_sql()} SELECT token || ' ' || n AS line FROM vocab")
def write_vocab(spark, sf_dir):
    return spark.read.text(vocab_file(spark, sf_dir)).select(F.col("value").alias("line"))


@query("read_vocab_plain", f"WITH {WORDS}, {vocab_sql()} SELECT id::INTEGER AS id, token FROM vocab")
def read_vocab_plain(spark, sf_dir):
    path = S.scratch(spark, "vocab")
    word_vocab(spark, sf_dir).orderBy("id").select(F.col("token").alias("value")).coalesce(1).write.text(path)
    return R.vocab_plain(spark, path)


@query("read_codebook", f"WITH {WORDS} SELECT DISTINCT 'w' || (length(w) % 2) AS scheme, w AS ch, w[1:2] || length(w) AS code FROM words WHERE length(w) % 2 = 1")
def read_codebook(spark, sf_dir):
    from corpusloom.operators.codebook import of_scheme
    from corpusloom.plans.codebooks import corpus_words

    w = corpus_words(spark, sf_dir).distinct()
    line = F.concat_ws("\t", F.concat(F.lit("w"), F.length("w") % 2), "w", F.concat(F.substring("w", 1, 2), F.length("w")))
    book = R.codebook(spark, written(w.select(line.alias("value")), "book"))
    return of_scheme(book, "w1").select(F.lit("w1").alias("scheme"), "ch", "code")


@query("read_definitions", "SELECT conv_id || '-' || turn AS word, text AS definition FROM conversations")
def read_definitions(spark, sf_dir):
    one = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "conv_id", "turn"), "text"))))
    path = written(turns(spark, sf_dir).groupBy(*chunk()).agg(one.alias("value")), "definitions")
    return R.definitions(spark.read.text(path))


@query("read_char_stats", f"WITH {WORDS} SELECT w AS token, count(*) AS n FROM words GROUP BY w")
def read_char_stats(spark, sf_dir):
    from corpusloom.plans.vocabularies import word_counts

    return R.char_stats(spark, written(word_counts(spark, sf_dir).select(F.concat_ws(" ", "token", "n").alias("value")), "stats"))


@query("read_model_scores", f"WITH {VEC} SELECT vec_id AS unique_id, len(a)::INTEGER AS n, round(a[1], 6) AS first FROM vec")
def read_model_scores(spark, sf_dir):
    path = S.scratch(spark, "scores")
    vectors(spark, sf_dir).select(F.col("vec_id").alias("unique_id"), F.col("a").alias("start_logits"), F.col("b").alias("end_logits")).write.parquet(path)
    return R.model_scores(spark, path).select("unique_id", F.size("start_logits").alias("n"), F.round(F.get("start_logits", F.lit(0)), 6).alias("first"))


@query("write_shards_text", f"WITH {SHARD} SELECT split, shard, array_to_string(list_transform(s, lambda x: replace(x, chr(10), ' ')), chr(10)) AS text, count(*) AS n FROM sh JOIN sent USING (doc_id) GROUP BY ALL")
def write_shards_text(spark, sf_dir):
    """Documents as they are read back, their sentences in order."""
    path = S.scratch(spark, "shards")
    flat = docs(spark, sf_dir).select("doc_id", F.transform(T.sentence_split("text"), lambda s: F.translate(s, "\n", " ")).alias("sentences"))
    S.shards_text(flat.join(shards(spark, sf_dir).select("doc_id", "split", "shard"), "doc_id"), path, per_file=20)
    back = spark.read.option("lineSep", "\n\n").text(path)
    return back.groupBy("split", F.col("shard").cast("long").alias("shard"), F.col("value").alias("text")).agg(F.count("*").alias("n"))


@query("write_examples", f"WITH {SHARD} SELECT split, shard, doc_id || ' ' || n AS ids FROM sh")
def write_examples(spark, sf_dir):
    path = S.scratch(spark, "examples")
    S.examples(shards(spark, sf_dir).select("split", "shard", F.array("doc_id", "n").alias("input_ids")), path, per_file=20)
    return spark.read.parquet(path).select("split", F.col("shard").cast("long").alias("shard"), F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"))


@query("write_jsonl", "SELECT conv_id, turn, text FROM conversations")
def write_jsonl(spark, sf_dir):
    path = S.scratch(spark, "jsonl")
    S.jsonl(turns(spark, sf_dir).select("conv_id", "turn", "text"), path)
    return R.jsonl(spark, path, f"conv_id bigint, turn {dict(turns(spark, sf_dir).dtypes)['turn']}, text string")


@query("write_predictions", "SELECT conv_id::VARCHAR AS id, arg_max(role, turn) AS prediction FROM conversations GROUP BY conv_id")
def write_predictions(spark, sf_dir):
    path = S.scratch(spark, "predictions")
    rows = turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("prediction"), "turn")
    S.jsonl(S.last_predictions(rows, "turn"), path)
    return R.jsonl(spark, path, "id string, prediction string")


@query("write_first_column", "SELECT lang || doc_id AS line FROM documents")
def write_first_column(spark, sf_dir):
    """The first column of a table with a header becomes a text corpus."""
    tsv = S.scratch(spark, "table")
    docs(spark, sf_dir).select(F.concat("lang", "doc_id").alias("a"), "source").write.csv(tsv, sep="\t", header=True)
    rows = R.tsv(spark, tsv, "a string, source string", header=True)
    return spark.read.text(written(rows.select(F.col("a").alias("value")), "first")).select(F.col("value").alias("line"))


@query("write_logits", f"WITH {VEC} SELECT vec_id, array_to_string(list_transform(a, lambda s: printf('%.4f', s)), ' ') AS value, (list_position(a, list_max(a)) - 1)::INTEGER AS class FROM vec")
def write_logits(spark, sf_dir):
    path = S.scratch(spark, "logits")
    S.logits_lines(vectors(spark, sf_dir), "vec_id", "a").write.json(path)
    return R.jsonl(spark, path, "vec_id bigint, value string, class int")


@query("write_scores", "SELECT event_type AS run, count(*) AS epoch, round(avg(value), 6) AS score FROM events GROUP BY event_type")
def write_scores(spark, sf_dir):
    path = S.scratch(spark, "runs")
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("epoch"), F.round(F.avg("value"), 6).alias("score"))
    S.scores(rows, path)
    return R.tsv(spark, path, "run string, epoch bigint, score double", header=True)
