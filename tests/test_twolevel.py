"""Features of two levels, decoding over sub-characters and labels back to characters, against plain versions."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import align as A
from corpusloom.operators import decode as D
from corpusloom.operators import twolevel as Y

KEYS = ["k", "j"]
VOCAB = "id int, token string"


def cut(text, rng, longest):
    out, at = [], 0
    while at < len(text):
        n = rng.randint(1, longest)
        out.append(text[at : at + n])
        at += n
    return out


def plain_owner(subs, tokens):
    owner = [i for i, t in enumerate(tokens) for _ in t]
    at, out = 0, []
    for s in subs:
        out.append(owner[at])
        at += len(s)
    return out


def plain_features(sa, ta, oa, sb, tb, ob, subs_id, token_id, most):
    subs, tokens = ["[CLS]", *sa, "[SEP]", *sb, "[SEP]"], ["[CLS]", *ta, "[SEP]", *tb, "[SEP]"]
    place = [0, *(o + 1 for o in oa), len(ta) + 1, *(o + len(ta) + 2 for o in ob), len(tokens) - 1]
    nxt = place[1:] + [len(tokens)]
    pad = lambda x, fill=0: (x + [fill] * most)[:most]
    return (
        pad([subs_id.get(s, 0) for s in subs]), pad([1] * len(subs)), pad([0] * (len(sa) + 2) + [1] * (len(sb) + 1)), pad([token_id.get(t, 0) for t in tokens]),
        pad(place, -1), pad([max(b, a + 1) for a, b in zip(place, nxt)], -1),
    )


NAMES = ("input_ids", "input_mask", "segments", "token_ids", "pos_left", "pos_right")


def rows_of(rng, n):
    out = []
    for i in range(n):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(2))
        out.append((i // 3, str(i), cut(a, rng, 3), cut(a, rng, 5), cut(b, rng, 3), cut(b, rng, 5)))
    return out


def vocabularies(spark, rows):
    subs, tokens = sorted({s for r in rows for s in r[2] + r[4]})[::2], sorted({t for r in rows for t in r[3] + r[5]})[::2]
    made = [{t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", *x])} for x in (subs, tokens)]
    return made, [spark.createDataFrame([(i, t) for t, i in m.items()], VOCAB) for m in made]


def lengths(n, m, most):
    while n + m > most:
        n, m = (n - 1, m) if n > m else (n, m - 1)
    return n, m


def test_two_level_pairs(spark):
    rng = random.Random(1)
    rows = rows_of(rng, 60)
    (sid, tid), (sv, tv) = vocabularies(spark, rows)
    df = spark.createDataFrame(rows, "k int, j string, sa array<string>, ta array<string>, sb array<string>, tb array<string>")
    got = {r["j"]: tuple(r[n] for n in NAMES) for r in Y.two_level(df, KEYS, ("sa", "ta"), ("sb", "tb"), sv, tv, 20).collect()}
    assert len(got) == len(rows)
    for _, j, sa, ta, sb, tb in rows:
        ka, kb = lengths(len(sa), len(sb), 17)
        oa, ob = plain_owner(sa, ta)[:ka], plain_owner(sb, tb)[:kb]
        left = lambda o, t: t[: o[-1] + 1] if o else []
        assert got[j] == plain_features(sa[:ka], left(oa, ta), oa, sb[:kb], left(ob, tb), ob, sid, tid, 20)
        ends = [r for r in got[j][5] if r >= 0]
        assert ends[-1] == len([x for x in ["[CLS]", *left(oa, ta), "[SEP]", *left(ob, tb), "[SEP]"]])


def test_two_level_single(spark):
    rows = rows_of(random.Random(2), 30)
    (sid, tid), (sv, tv) = vocabularies(spark, rows)
    df = spark.createDataFrame([r[:4] for r in rows], "k int, j string, sa array<string>, ta array<string>")
    got = {r["j"]: tuple(r[n] for n in NAMES) for r in Y.two_level(df, KEYS, ("sa", "ta"), None, sv, tv, 12).collect()}
    for _, j, sa, ta, _, _ in rows:
        oa = plain_owner(sa, ta)[:10]
        want = plain_features(sa[:10], ta[: oa[-1] + 1] if oa else [], oa, [], [], [], sid, tid, 40)
        n = len(oa) + 2  # a second, empty part is no part
        assert got[j][0] == (want[0][:n] + [0] * 12)[:12] and got[j][4] == (want[4][:n] + [-1] * 12)[:12] and sum(got[j][1]) == n


def test_two_level_windows(spark):
    rng = random.Random(3)
    rows = rows_of(rng, 30)
    (sid, tid), (sv, tv) = vocabularies(spark, rows)
    df = spark.createDataFrame(rows, "k int, j string, sa array<string>, ta array<string>, sb array<string>, tb array<string>")
    made = Y.two_level_windows(df, KEYS, ("sa", "ta"), ("sb", "tb"), sv, tv, most=14, most_query=4, stride=3).collect()
    got = {(r["j"], r["window"]): r for r in made}
    want = 0
    for _, j, sa, ta, sb, tb in rows:
        sa = sa[:4]
        oa, ob = plain_owner(sa, ta), plain_owner(sb, tb)
        room, start, window = 14 - len(sa) - 3, 0, 0
        while True:
            own = ob[start : start + room]
            first = own[0] if own else 0
            r = got[j, window]
            assert (r["start"], r["first"]) == (start, first)
            part = plain_features(sa, ta[: oa[-1] + 1] if oa else [], oa, sb[start : start + room], tb[first : own[-1] + 1] if own else [], [o - first for o in own], sid, tid, 14)
            assert tuple(r[n] for n in NAMES) == part
            want += 1
            if start + room >= len(sb):
                break
            start, window = start + 3, window + 1
    assert want == len(made)


def test_filled_at_is_nearest_filled(spark):
    rng = random.Random(4)
    rows = [(k, p, rng.choice([None, p // 2])) for k in range(40) for p in range(9)]
    df = spark.createDataFrame(rows, "k int, pos int, value int")
    arrays = df.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("value").alias("v")))), lambda x: x["v"]["value"]).alias("values"))
    for is_start in (True, False):
        near = {(r["k"], r["pos"]): r["value"] for r in A.nearest_filled(df, ["k"], is_start=is_start).collect()}
        at = arrays.select("k", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("pos"), "values").select("k", "pos", D.filled_at(F.col("values"), F.col("pos"), is_start=is_start).alias("value"))
        assert {(r["k"], r["pos"]): r["value"] for r in at.collect()} == near


def test_span_two_level(spark):
    """The answer comes back as the source has it, from tokens on both sides of places without one."""
    features = [(1, ["be", "ij", "ing", "c", "it", "y"], [0, None, None, 1, None, 1], ["Beijing", "City"]), (2, ["a"], [None], ["A"]), (3, ["x", "y"], [0, 0], ["XY"])]
    f = spark.createDataFrame(features, "k int, subs array<string>, owner array<int>, tokens array<string>")
    c = spark.createDataFrame([(1, 1, 4, 2.0), (1, 0, 1, 1.0), (2, 0, 0, 5.0), (3, 0, 5, 9.0)], "k int, s int, e int, score double")
    got = [tuple(r) for r in D.span_two_level(c, ["k"], f).collect()]
    assert got == [(1, 1, 4, 1, 1, "City", 2.0)]  # a prediction that its tokens do not hold gives all of them
    c = spark.createDataFrame([(1, 0, 3, 1.0), (1, 3, 5, 0.5), (3, 1, 1, 9.0)], "k int, s int, e int, score double")
    got = sorted(tuple(r) for r in D.span_two_level(c, ["k"], f).collect())
    assert got == [(1, 0, 3, 0, 1, "Beijing C", 1.0), (3, 1, 1, 0, 0, "Y", 9.0)]


def plain_chars(labels, sizes):
    """Token by token."""
    out, i = [], 0
    while i < len(labels):
        tag, kind, j = labels[i][0], labels[i][2:], i + 1
        if tag == "B":
            while j < len(labels) and labels[j] == "I-" + kind:
                j += 1
        n = sum(sizes[i:j])
        if tag in "OI":
            out += [labels[i]] * n
        else:
            out += [f"S-{kind}"] if n == 1 else [f"B-{kind}"] * (n > 0) + [f"I-{kind}"] * (n - 1)
        i = j
    return out


def test_labels_back_to_characters(spark):
    rng, rows, want = random.Random(5), [], {}
    names = ["O", "B-X", "I-X", "S-X", "B-Y", "I-Y", "S-Y"]
    for k in range(80):
        labels, sizes = [rng.choice(names) for _ in range(rng.randint(0, 12))], []
        at = 0
        for pos, label in enumerate(labels):
            sizes.append(rng.choice([0, 1, 1, 2, 3]))
            rows.append((k, pos, at, at + sizes[-1], label))
            at += sizes[-1]
        want[k] = [9, *(names.index(x) + 1 for x in plain_chars(labels, sizes)), 9]
        want[k] += [0] * (10 - len(want[k]))
    df = spark.createDataFrame(rows, "k int, pos int, start int, stop int, label string")
    got = A.label_ids(spark.range(80).select(F.col("id").cast("int").alias("k")), A.labels_to_chars(df, ["k"]), ["k"], names, 10, edge=9)
    assert {r["k"]: r["ids"] for r in got.collect()} == want


def test_windows_are_cut_in_one_pass(spark):
    """One Python node between the texts and the windows, so that a task holds a batch once; and it works slice by slice."""
    df = spark.createDataFrame(rows_of(random.Random(5), 3), "k int, j string, sa array<string>, ta array<string>, sb array<string>, tb array<string>")
    _, (sv, tv) = vocabularies(spark, rows_of(random.Random(5), 3))
    plan = Y.two_level_windows(df, KEYS, ("sa", "ta"), ("sb", "tb"), sv, tv, most=14, most_query=4, stride=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_slices_of_a_batch(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(Y, "PIECES", 10)
    rows = [["a"] * n for n in (3, 4, 0, 25, 1, 1, 9, 2)] + [None]
    parts = list(Y._by_pieces(pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["sb"]), "sb"))
    assert [r for x in parts for r in x.column("sb").to_pylist()] == rows
    assert len(parts) > 2 and all(sum(len(r or []) for r in x.column("sb").to_pylist()) < 10 or x.num_rows == 1 or max(len(r or []) for r in x.column("sb").to_pylist()) > 8 for x in parts)
