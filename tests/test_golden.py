"""Golden rows, and invariants of what SQL does not express."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import align as A
from corpusloom.operators import codebook as C
from corpusloom.operators import decode as D
from corpusloom.operators import examples as E
from corpusloom.operators import features as X
from corpusloom.operators import metrics as M
from corpusloom.operators import noise as N
from corpusloom.operators import pretrain as P
from corpusloom.operators import tokens as K
from corpusloom.operators import vocab as V
from corpusloom.sources import readers as R

S = T.SEP
TOY = [("今", "jin1"), ("天", "tian1"), ("气", "qi4"), ("很", "hen3"), ("好", "hao3")]
KEY = ["k"]


def one(spark, col, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return rows.select(col.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame(TOY, "ch string, code string")


def test_encode_common(spark, book):
    up = {c: chr(ord(c) + 50000) for c in "ab1"}
    assert one(spark, C.encode("t", book), t="今 天Ab1，") == f"jin1{S}tian1{S}{up['a']}{up['b']}{up['1']},"
    assert one(spark, C.encode("t", book, index=False), t="今天") == f"jin{S}tian{S}"


def test_both_forms_agree(spark, book):
    rows = spark.createDataFrame([(1, "今天x好"), (2, ""), (3, "abc 1"), (4, "好好")], "k int, t string")
    table = C.replacements(book)
    a = {r["k"]: r["out"] for r in C.translate_by_join(rows, KEY, "t", table).collect()}
    b = {r["k"]: r["o"] for r in rows.select("k", C.translator(table)("t").alias("o")).collect()}
    assert a == b


def test_encode_bytes(spark):
    symbols = [chr(0x100 + k) for k in range(256)]
    assert one(spark, C.encode_bytes("t", symbols), t="我") == "".join(symbols[b] for b in "我".encode()) + S


def test_sentence_split(spark):
    assert one(spark, T.sentence_split("t"), t="今天好！明天？x.y") == ["今天好！", "明天？", "x.", "y"]
    assert one(spark, T.sentence_split("t"), t="好！！") == ["好！"]


def test_token_of_char(spark):
    assert one(spark, T.token_of_char("t"), t="ab c,d") == [0, 0, 0, 1, 2, 3]


def test_wordpiece_and_unigram():
    vocab = {"un", "##aff", "##able"}
    assert K.wordpiece("unaffable", vocab) == ["un", "##aff", "##able"]
    assert K.wordpiece("x" * 101, {"x", "##x"}) == ["[UNK]"]
    assert K.wordpiece("q", vocab) == ["[UNK]"]
    assert K.unigram("abc", {"a": -1.0, "b": -1.0, "c": -1.0, "ab": -1.5}, 2) == ["ab", "c"]
    assert K.unigram("az", {"a": -1.0}, 1) == ["a", "[UNK]"]


def split(spark, *sides):
    rows = spark.createDataFrame([(1, *sides)], "k int, " + ", ".join(f"s{i} array<string>" for i in range(len(sides))))
    return rows, [A.positions(rows, KEY, f"s{i}") for i in range(len(sides))]


def values(df, col):
    return [r[col] for r in df.orderBy("pos").collect()]


def test_alignment(spark):
    subs = ["jin+", "ti", "an+", "ti", "an+", "qi+", "hen+", "hao+"]
    _, (s, t) = split(spark, subs, ["jin", "+", "tian+", "tian+qi", "+", "hen+hao+"])
    assert values(A.subchar_to_token(s, t, KEY), "owner") == [0, 2, 2, 3, 3, 3, 5, 5]
    _, (s, t) = split(spark, subs, ["jin+", "tian+", "tian+qi+", "hen+hao+"])
    assert values(A.token_to_subchar(s, t, KEY), "first") == [0, 1, 3, 6]
    assert values(A.owner(s, t, KEY), "owner") == [0, 1, 1, 2, 2, 2, 3, 3]


def test_inverse_text_index(spark):
    rows = spark.createDataFrame([(1, "今天天气很好", ["今天", "天气", "很", "好"])], "k int, t string, w array<string>")
    assert values(A.inverse_text_index(rows, KEY, "t", A.positions(rows, KEY, "w")), "text_pos") == [0, 2, 4, 5, 6]


def test_labels_to_tokens(spark):
    _, (t,) = split(spark, ["这是", "北京的", "清华", "大学"])
    spans = spark.createDataFrame([(1, "X", 2, 4), (1, "X", 5, 9)], "k int, type string, start int, stop int")
    assert values(A.labels_to_tokens(spans, t, KEY), "label") == ["O", "S-X", "B-X", "I-X"]


def seq(spark, labels):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(labels)], "k int, pos int, label string")


def test_decode_bios(spark):
    got = D.decode_bios(seq(spark, ["B-PER", "I-PER", "O", "S-LOC"]), KEY).collect()
    assert sorted((r["type"], r["start"], r["end"]) for r in got) == [("LOC", 3, 3), ("PER", 0, 1)]
    assert D.decode_bios(seq(spark, ["B-PER", "O"]), KEY, strict=False).count() == 0
    assert D.decode_bios(seq(spark, ["B-PER", "O"]), KEY).count() == 1


def test_entity_prf(spark):
    rows = lambda a, b: seq(spark, a).withColumn("s", F.lit(0)).unionByName(seq(spark, b).withColumn("s", F.lit(1)))
    gold = rows("O O O B-MISC I-MISC I-MISC O".split(), "B-PER I-PER O".split())
    pred = rows("O O B-MISC I-MISC I-MISC I-MISC O".split(), "B-PER I-PER O".split())
    keys = ["k", "s"]
    got = {r["type"]: r for r in M.prf(D.decode_bios(gold, keys), D.decode_bios(pred, keys), ["s", "type", "start", "end"]).collect()}
    assert (got[None]["precision"], got[None]["recall"], got[None]["f1"]) == (0.5, 0.5, 0.5)
    assert got["MISC"]["f1"] == 0 and got["PER"]["f1"] == 1


def test_lcs(spark):
    rows = spark.createDataFrame([(1, list("北京大学"), list("在北京大"))], "k int, a array<string>, b array<string>")
    assert M.lcs(rows, KEY, "a", "b").first()["lcs"] == 3
    assert one(spark, M.f1_of(F.lit(3), F.lit(4), F.lit(4)), t="x") == 0.75


def test_truncation(spark):
    def step(sizes, most):
        s = list(sizes)
        while sum(s) > most:
            s[-1 if len(s) == 2 and s[0] <= s[1] else s.index(max(s))] -= 1
        return tuple(s)

    random.seed(5)
    cases = [tuple(random.randint(0, 30) for _ in range(3)) + (random.randint(0, 60),) for _ in range(400)] + [(10, 3, 0, 8), (5, 5, 0, 7), (5, 5, 5, 10)]
    rows = spark.createDataFrame(cases, "a int, b int, c int, m int")
    pair, triple = E.truncate_pair(F.col("a"), F.col("b"), F.col("m")), E.truncate_triple(F.col("a"), F.col("b"), F.col("c"), F.col("m"))
    for r in rows.select("*", F.array(*pair).alias("p"), F.array(*triple).alias("t")).collect():
        assert tuple(r["p"]) == step((r["a"], r["b"]), r["m"])
        assert tuple(r["t"]) == step((r["a"], r["b"], r["c"]), r["m"])


def test_masked_count(spark):
    assert [one(spark, P.masked_count(F.lit(n), 150, 20), t="x") for n in (20, 30)] == [3, 4]


def test_windows(spark):
    assert one(spark, X.window_starts(F.lit(10), F.lit(4), 2), t="x") == [0, 2, 4, 6]
    parts = spark.createDataFrame([(1, w, 2 * w, 4) for w in range(4)], "k int, window int, start int, size int")
    assert X.max_context(parts, KEY).where("pos = 3").first()["window"] == 1


def test_assignment(spark):
    rows = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 1, 4.0), (1, 1, 0, 4.5), (1, 1, 1, 1.0)], "p int, blank int, choice int, score double")
    assert sorted((r["blank"], r["choice"]) for r in D.assign_greedy(rows, "p", "blank").collect()) == [(0, 0), (1, 1)]
    assert sorted((r["blank"], r["choice"]) for r in D.assign_argmax(rows, ["p", "blank"]).collect()) == [(0, 0), (1, 0)]


def test_choices_padding(spark):
    got = one(spark, E.padded_choices(F.col("c")), c=["a", "b"])
    assert got == ["a", "b", E.FILLER, E.FILLER]


def test_improve_span(spark):
    got = one(spark, A.improve_span(F.col("w"), F.lit(0), F.lit(3), F.lit("b c")), w=["a", "b", "c", "d"])
    assert (got["start"], got["end"]) == (1, 2)


def test_noise(spark):
    book = spark.createDataFrame([("a", "x1"), ("b", "x2"), ("c", "y1")], "ch string, code string")
    rows = spark.createDataFrame([(1, "abcabc" * 20), (2, "")], "k int, t string")
    same = N.groups(book)
    none = {r["k"]: r["t"] for r in N.noisy(rows, KEY, "t", same, 0, 1).collect()}
    assert none == {1: "abcabc" * 20, 2: ""}
    all_ = {r["k"]: r["t"] for r in N.noisy(rows, KEY, "t", same, 1000, 1).collect()}
    assert all_[1] == "bacbac" * 20
    again = {r["k"]: r["t"] for r in N.noisy(rows.repartition(3), KEY, "t", same, 500, 1).collect()}
    assert again == {r["k"]: r["t"] for r in N.noisy(rows, KEY, "t", same, 500, 1).collect()}


def test_shards_hold_every_document_once(spark):
    docs = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 13 + 1).cast("int").alias("n"))
    out = P.shard_balance(docs, "n", "k", 4)
    assert out.count() == 200 and out.select("k").distinct().count() == 200
    sizes = [r["s"] for r in out.where("split = 'training'").groupBy("shard").agg(F.sum("n").alias("s")).collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 26


def test_bpe_and_unigram(spark):
    words = spark.createDataFrame([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)], "word string, n bigint")
    merges = [(r["left"], r["right"]) for r in V.train_bpe(words, 3, batch=1).orderBy("rank").collect()]
    assert merges == [("e", "s"), ("es", "t"), ("l", "o")]
    pieces = V.train_unigram(words, 14).collect()
    assert {"l", "o", "w"} <= {r["token"] for r in pieces}


def test_readers(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.write_text(text)
        return str(p)

    assert [(r["text"]) for r in R.doc_lines(spark, put("a", "one \n\n two\n")).collect()] == ["one", " two"]
    got = R.sentence_docs(spark, put("b", "s1\ns2\n\nt1\n\n\n")).collect()
    assert sorted((r["sent_no"], r["sentence"]) for r in got) == [(0, "s1"), (0, "t1"), (1, "s2")]
    assert R.wiki_extract(spark, put("c", '<doc id="1">\nTitle\n\na\nb\n</doc>\n<doc id="2">\nT\nc\n</doc>')).orderBy("text").collect()[0]["text"] == "a b"
    assert [tuple(r) for r in R.paired_text(spark, put("d", "x ||| y\nz")).collect()] == [("x", "y"), ("z", None)]
    got = R.token_labels(spark, put("e", "-DOCSTART- O\n\na B-X\nb\n\nc O\n")).collect()
    assert sorted((tuple(r["words"]), tuple(r["labels"])) for r in got) == [(("a", "b"), ("B-X", "O")), (("c",), ("O",))]
    rows = spark.createDataFrame([('{"text": "abc", "label": {"P": {"ab": [[0, 1]]}}}',), ('{"text": "abc", "label": {"P": {"zz": [[0, 1]]}}}',)], "value string")
    good, bad = R.entity_json(rows)
    assert good.first()["labels"] == ["B-P", "I-P", "O"] and bad.count() == 1
    assert R.nested_qa(spark, put("f", '{"data": [{"paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q", "answers": [{"text": "c", "answer_start": 0}]}]}]}]}')).first()["is_impossible"] is False


def test_stream(spark, tmp_path):
    from corpusloom.streaming.encode import code_counts, coded

    book = spark.createDataFrame([("a", "x1")], "ch string, code string")
    rows = spark.createDataFrame([("aab", "2024-01-01 00:00:01"), ("a", "2024-01-01 00:07:00")], "text string, ts string").withColumn("ts", F.to_timestamp("ts"))
    path = str(tmp_path / "in")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    for name, df, mode in (("coded", coded(stream, book), "append"), ("counts", code_counts(stream, book), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["coded"] for r in spark.table("coded").collect()) == [f"x1{S}", f"x1{S}x1{S}" + chr(ord("b") + 50000)]
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 2]
