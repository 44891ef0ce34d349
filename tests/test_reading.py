"""Answers in texts and back: examples, cloze and window features, against plain versions and values written by hand."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import codebook as C
from corpusloom.operators import decode as D
from corpusloom.operators import examples as E
from corpusloom.operators import features as X


def plain_span(text, given, answer):
    """One character at a time."""
    tokens, owner, inside = [], [], False
    for ch in text:
        if ch.isspace():
            inside = False
        elif T._single(ch):
            tokens.append(ch)
            inside = False
        elif inside:
            tokens[-1] += ch
        else:
            tokens.append(ch)
            inside = True
        owner.append(len(tokens) - 1)
    start, n = given, 0
    while text[start : start + len(answer)] != answer and n < 3 and start > 0:
        start, n = start - 1, n + 1
    stop = owner[start + len(answer) - 1]
    while text[start] in " \t\r\n":
        start += 1
    first = owner[start]
    first += tokens[first] in E.LEADING_MARKS
    return first, stop, "".join(tokens[first : stop + 1]) == "".join(answer.split())


def test_reading_span(spark):
    rng, rows = random.Random(4), []
    for k in range(200):
        text = "".join(rng.choice("ab 今，.") for _ in range(40)) + "end"
        a = rng.randint(0, 30)
        answer = text[a : a + rng.randint(1, 8)]
        rows.append((k, text, min(max(a + rng.randint(-1, 4), 0), 40 - len(answer)), answer))
    df = spark.createDataFrame(rows, "k int, text string, given int, answer string")
    got = {r["k"]: tuple(r["x"]) for r in df.select("k", E.reading_span(F.col("text"), F.col("given"), F.col("answer")).alias("x")).collect()}
    assert got == {k: plain_span(t, g, a) for k, t, g, a in rows}


def test_cloze(spark):
    text = "a #idiom000001# b c #idiom000002# d"
    rows = spark.createDataFrame([(1, text, ["x", "y"])], "k int, text string, options array<string>")
    labels = spark.createDataFrame([(1, "#idiom000002#", 1)], "k int, tag string, answer int")
    got = E.cloze_examples(rows, ["k"], "text", "options", labels).orderBy("blank")
    assert [(r["blank"], r["tag"], r["answer"]) for r in got.collect()] == [(0, "#idiom000001#", None), (1, "#idiom000002#", 1)]
    line = lambda most: [" ".join(r["t"]) for r in got.select(E.cloze_tokens(F.array(F.lit("x")), F.col("tokens"), F.col("tag"), most).alias("t")).collect()]
    assert line(10) == ["[CLS] x [SEP] a [unused1] b c [MASK] [MASK] [SEP]", "[CLS] x [SEP] [MASK] [MASK] b c [unused1] d [SEP]"]
    opt = rows.select(E.option_tokens(F.array(F.lit("x")), F.array(*map(F.lit, "abc")), 3).alias("o")).first()["o"]
    assert opt == ["x", "：", "a"]


def test_final_text(spark):
    cases = [
        (["steve", "smith"], "Steve Smith's", "Steve Smith"),
        (["cafe"], "Café, bar", "Café"),
        (["un", "##able"], "was Unable to", "Unable"),
        (["nothing"], "Steve", "Steve"),
        ([], "Steve", "Steve"),
        (["##ab"], "", ""),
    ]
    df = spark.createDataFrame(cases, "p array<string>, s string, want string")
    for r in df.select(D.final_text(F.col("p"), F.col("s")).alias("got"), "want").collect():
        assert r["got"] == r["want"]


def test_span_candidates_leave_out_what_no_answer_can_be(spark):
    df = spark.createDataFrame([(1, [9.0, 8.0, 7.0, 1.0], [0.0, 5.0, 6.0, 9.0])], "k int, a array<double>, b array<double>")
    arr = lambda *x: F.array(*map(F.lit, x))
    none = F.lit(None).cast("int")
    pairs = lambda **kw: {(r["s"], r["e"]) for r in D.span_candidates(df, ["k"], "a", "b", 3, 3, **kw).collect()}
    assert pairs() == {(0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3)}
    assert pairs(n_tokens=F.lit(3)) == {(0, 1), (0, 2), (1, 1), (1, 2), (2, 2)}
    assert pairs(source=F.array(none, F.lit(0), F.lit(1), none)) == {(1, 1), (1, 2), (2, 2)}
    assert pairs(max_context=arr(True, False, True)) == {(0, 1), (0, 2), (2, 2), (2, 3)}


def test_reading_features(spark):
    df = spark.createDataFrame([(1, ["q", "r", "s"], ["abcd", "e", "fgh"])], "k int, q array<string>, w array<string>")
    df = df.withColumn("p", X.pieces_of(F.col("w"), lambda w: F.regexp_extract_all(w, F.lit(".{1,2}"), 0)))
    got = X.reading_features(df, "q", "p", most=8, most_query=2, stride=2).orderBy("window").collect()
    assert [" ".join(r["tokens"]) for r in got] == ["[CLS] q r [SEP] ab cd e [SEP]", "[CLS] q r [SEP] e fg h [SEP]"]
    assert [[tuple(x) for x in r["source"]] for r in got] == [[(4, 0), (5, 0), (6, 1)], [(4, 1), (5, 2), (6, 2)]]


def plain_convert(text, book):
    """The longest phrase at each place, and where each character read went."""
    out, starts, ends, at = "", [], [], 0
    while at < len(text):
        found = max((k for k in book if text.startswith(k, at)), key=len, default=text[at])
        starts += [len(out)] * len(found)
        out += book.get(found, found)
        ends += [len(out)] * len(found)
        at += len(found)
    return out, starts, ends


def test_transducer(spark):
    rng = random.Random(8)
    book = {"a": "xyz", "ab": "", "abc": "Q", "bca": "long one", "c": "c", "ddd": "d"}
    texts = ["", None, "abcabca", "ddddd", "abab", *("".join(rng.choice("abcd e") for _ in range(rng.randint(1, 40))) for _ in range(80))]
    table = spark.createDataFrame(list(book.items()), "ch string, out string")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", C.phrase_transducer(table)("t").alias("m"), C.phrase_translator(table)("t").alias("s")).collect()
    for r in got:
        if r["t"] is None:
            assert r["s"] is None and r["m"]["text"] is None
            continue
        assert (r["m"]["text"], r["m"]["starts"], r["m"]["ends"]) == plain_convert(r["t"], book) and r["s"] == r["m"]["text"]


def test_reading_span_in_converted_text(spark):
    """Spans survive phrases that grow or shrink before and inside of them."""
    table = spark.createDataFrame([("裏", "里面"), ("乾隆", "乾"), ("計程車", "出租车")], "ch string, out string")
    rows = [("他在裏，乾隆來計程車。", 4, "乾隆"), ("他在裏，乾隆來計程車。", 7, "計程車"), ("裏 ab，x", 1, " ab"), ("裏", 0, "裏"), ("裏", 3, "no"), ("乾隆", 1, "隆")]
    df = spark.createDataFrame(rows, "text string, given int, answer string")
    df = df.withColumns({"m": C.phrase_transducer(table)("text"), "new": C.phrase_translator(table)("answer")})
    got = df.select("answer", E.reading_span_in_converted(F.col("m"), F.col("given"), F.length("answer"), F.col("new")).alias("at"), T.reader_tokens(F.col("m.text")).alias("tokens")).collect()
    said = [r["at"] and ("".join(r["tokens"][r["at"]["start"] : r["at"]["stop"] + 1]), r["at"]["matches"]) for r in got]
    assert said == [("乾", True), ("出租车", True), ("ab", True), ("里面", True), None, ("乾", False)]
