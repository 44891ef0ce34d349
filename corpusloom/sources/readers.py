"""Readers of corpus and dataset files. All return DataFrames; rows that break a rule go to a reject table, never away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.examples import FILLER, padded_choices


def _place() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file")]


def doc_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): a document a line, without trailing white space; blank lines are none. The id is a hash of the text, so
    it does not depend on how files are split."""
    rows = spark.read.text(path).select(F.rtrim(F.regexp_replace("value", r"\s+$", "")).alias("text")).where("trim(text) != ''")
    return rows.select(F.xxhash64("text").alias("doc_id"), "text")


def sentence_docs(spark: SparkSession, path: str) -> DataFrame:
    """(doc, sent_no, sentence): a sentence a line, a blank line ends a document."""
    docs = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) != ''")
    parts = docs.select(F.xxhash64("value").alias("doc"), F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda s: s != "").alias("s"))
    return parts.select("doc", F.posexplode("s").alias("sent_no", "sentence"))


def books(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): a book a file, its non-blank lines joined by spaces."""
    rows = spark.read.text(path, wholetext=True).select(*_place(), "value")
    return rows.select("file", F.array_join(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ").alias("text"))


def wiki_extract(spark: SparkSession, path: str) -> DataFrame:
    """(text): articles between <doc id=..> and </doc>, without their title line and blank lines."""
    rows = spark.read.option("lineSep", "</doc>").text(path).where("value LIKE '%<doc id=%'")
    body = F.split(F.regexp_extract("value", r"(?s)<doc id=[^>]*>\n?(.*)", 1), "\n")
    lines = F.filter(F.transform(F.slice(body, F.lit(2), F.greatest(F.size(body) - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    return rows.select(F.array_join(lines, " ").alias("text"))


def jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    return rows if limit is None else rows.limit(limit)


def tsv(spark: SparkSession, path: str, schema: str, *, header: bool = False, quote: str | None = None) -> DataFrame:
    """A byte-order mark at the start of the first column is dropped."""
    rows = spark.read.schema(schema).csv(path, sep="\t", header=header, quote=quote or "\x00")
    first = rows.columns[0]
    return rows.withColumn(first, F.regexp_replace(first, "^﻿", "")) if dict(rows.dtypes)[first] == "string" else rows


def choice_csv(spark: SparkSession, path: str, *, training: bool = True) -> DataFrame:
    """(id, context, start, endings, label) of columns 2, 4, 5, 7-10 and 11; training files must end in ``label``."""
    rows = spark.read.csv(path, header=True)
    if training and rows.columns[-1] != "label":
        raise ValueError("the last column of a training file is 'label'")
    c = [F.col(f"`{x}`") for x in rows.columns]
    return rows.select(c[2].alias("id"), c[4].alias("context"), c[5].alias("start"), F.array(*c[7:11]).alias("endings"), c[11].cast("int").alias("label") if len(c) > 11 else F.lit(None).cast("int").alias("label"))


QA = "data array<struct<paragraphs:array<struct<context:string,text:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>,is_impossible:boolean>>>>>>"


def nested_qa(spark: SparkSession, path: str, *, whole_files: bool = True) -> DataFrame:
    """(id, context, question, answers, is_impossible) of one document a file, or one a line."""
    p = spark.read.schema(QA).json(path, multiLine=whole_files).select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    q = p.select(F.coalesce("p.context", "p.text").alias("context"), F.explode("p.qas").alias("q"))
    return q.select("q.id", "context", "q.question", "q.answers", F.coalesce("q.is_impossible", F.lit(False)).alias("is_impossible"))


def dialog_choice(rows: DataFrame, value: str = "value") -> DataFrame:
    """(dialog, question, choices, answer), lower-cased, of records [[lines], [{question, choice, answer}], ..]. A record is
    taken apart by position."""
    parts = F.from_json(F.lower(value), "array<string>")
    q = rows.select(parts.alias("r")).select(
        F.array_join(F.from_json(F.get("r", F.lit(0)), "array<string>"), "\n").alias("dialog"),
        F.explode(F.from_json(F.get("r", F.lit(1)), "array<struct<question:string,choice:array<string>,answer:string>>")).alias("q"),
    )
    return q.select("dialog", "q.question", padded_choices(F.col("q.choice"), 4, FILLER).alias("choices"), "q.answer")


def cloze(spark: SparkSession, path: str, answers: DataFrame) -> DataFrame:
    """(tag, passage, candidates, answer): a row for each blank. Records are parsed as JSON only."""
    r = spark.read.schema("content array<string>, candidates array<string>").json(path).select(F.explode("content").alias("passage"), "candidates")
    tags = r.select("passage", "candidates", F.explode(F.regexp_extract_all("passage", F.lit(r"#idiom\d{6}#"), 0)).alias("tag"))
    return tags.join(answers, "tag", "left")


def token_labels(spark: SparkSession, path: str) -> DataFrame:
    """(words, labels): ``token label`` a line, blank lines or -DOCSTART- between sentences; a missing label is O."""
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    lines = F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("-DOCSTART-"))
    parts = blocks.select(F.transform(lines, lambda x: F.split(F.trim(x), " ")).alias("p")).where("size(p) > 0")
    return parts.select(F.transform("p", lambda x: F.get(x, F.lit(0))).alias("words"), F.transform("p", lambda x: F.when(F.size(x) > 1, F.element_at(x, -1)).otherwise("O")).alias("labels"))


def entity_json(rows: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """((text, labels), rejects) of {text, label: {type: {name: [[s, e]]}}}: labels S, B, I, O by character. A span whose text
    is not its name puts the record among the rejects."""
    r = rows.select(F.from_json(value, "text string, label map<string,map<string,array<array<int>>>>").alias("r"), F.col(value).alias("value"))
    spans = r.select("value", "r.text", F.flatten(F.transform(F.map_entries(F.coalesce("r.label", F.expr("map()").cast("map<string,map<string,array<array<int>>>>"))), lambda t: F.flatten(F.transform(F.map_entries(t["value"]), lambda n: F.transform(n["value"], lambda s: F.struct(t["key"].alias("type"), n["key"].alias("name"), F.get(s, F.lit(0)).alias("s"), F.get(s, F.lit(1)).alias("e"))))))).alias("spans"))
    wrong = F.exists("spans", lambda s: F.substring(F.col("text"), s["s"] + 1, s["e"] - s["s"] + 1) != s["name"])
    chars = F.filter(F.split("text", ""), lambda c: c != "")

    def label(i: Column) -> Column:
        hit = F.get(F.filter("spans", lambda s: (s["s"] <= i) & (i <= s["e"])), F.lit(0))
        tag = F.when(hit["s"] == hit["e"], "S-").when(hit["s"] == i, "B-").otherwise("I-")
        return F.coalesce(F.concat(tag, hit["type"]), F.lit("O"))

    good = spans.where(~wrong).select("text", F.transform(chars, lambda c, i: label(i)).alias("labels"))
    return good, spans.where(wrong).select("value")


def paired_text(spark: SparkSession, path: str) -> DataFrame:
    """(text_a, text_b): two texts with `` ||| `` between them, or one."""
    two = F.split(F.trim("value"), r" \|\|\| ", 2)
    return spark.read.text(path).select(F.get(two, F.lit(0)).alias("text_a"), F.get(two, F.lit(1)).alias("text_b"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(id, value) of a file of lines, in order. A vocabulary is one small file, read whole by one task."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\n$", "").alias("value"))
    return rows.select(F.posexplode(F.split("value", "\n")).alias("id", "value"))


def vocab_scored(spark: SparkSession, path: str) -> DataFrame:
    """(id, token, score): the first field is the token; of repeated tokens the last counts."""
    p = F.split("value", r"\s+")
    rows = _numbered(spark, path).select("id", F.get(p, F.lit(0)).alias("token"), F.get(p, F.lit(1)).cast("double").alias("score"))
    return rows.groupBy("token").agg(F.max("id").alias("id"), F.max_by("score", "id").alias("score")).select("id", "token", "score")


def vocab_plain(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark, path).select(F.trim("value").alias("token"), "id").groupBy("token").agg(F.max("id").alias("id")).select("id", "token")


def codebook(spark: SparkSession, path: str) -> DataFrame:
    """(scheme, ch, code) of tab-separated lines."""
    return tsv(spark, path, "scheme string, ch string, code string")


def definitions(rows: DataFrame, value: str = "value") -> DataFrame:
    """(word, definition) of a JSON map."""
    return rows.select(F.explode(F.from_json(value, "map<string,string>")).alias("word", "definition"))


def char_stats(spark: SparkSession, path: str) -> DataFrame:
    """(token, n) of lines ``token count``."""
    p = F.split("value", " ")
    return spark.read.text(path).select(F.get(p, F.lit(0)).alias("token"), F.get(p, F.lit(1)).cast("long").alias("n"))


def model_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
