"""Sentence pairs whose unused sentences are put back, and masks from a whole vocabulary."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import pretrain as P


def plain_pairs(docs, most, seed):
    """The rule read sentence by sentence, with a pushed-back index."""
    full = {k: [n for n in s if n > 0] for k, s in docs.items()}
    full = {k: s for k, s in full.items() if s}
    out = {}
    for k, s in full.items():
        i, chunk, held, total = 0, 0, [], 0
        while i < len(s):
            held.append(i)
            total += s[i]
            if i == len(s) - 1 or total >= most:
                cut = 1 if len(held) == 1 else 1 + P._draw(seed, len(held) - 1, k, chunk, "cut")
                follows = len(held) > 1 and P._draw(seed, 2, k, chunk, "next") == 0
                out[k, chunk] = (held[0], held[-1], cut, follows, sum(s[j] for j in held[:cut]))
                if not follows:
                    i -= len(held) - cut
                held, total, chunk = [], 0, chunk + 1
            i += 1
    return full, out


def test_pairs_with_sentences_put_back(spark):
    rng = random.Random(3)
    docs = {k: [rng.choice([0, 1, 3, 9, 40]) for _ in range(rng.randint(0, 30))] for k in range(40)}
    df = spark.createDataFrame(list(docs.items()), "k bigint, sizes array<int>")
    full, want = plain_pairs(docs, 25, 7)
    got = {(r["k"], r["chunk"]): r for r in P.next_sentence(df, "k", "sizes", 25, 7).collect()}
    assert set(got) == set(want)
    for key, r in got.items():
        first, last, cut, follows, a = want[key]
        assert (r["first"], r["last"], r["cut"], r["is_next"]) == (first, last, cut, follows)
        if follows:
            assert (r["b_doc"], r["b_first"], r["b_last"]) == (key[0], first + cut, last)
            continue
        other, taken = full[r["b_doc"]], 0
        assert r["b_doc"] != key[0]
        for j in range(r["b_first"], len(other)):
            taken += other[j]
            if taken >= 25 - a:
                break
        assert r["b_last"] == j
    for k, s in full.items():  # every sentence is in a part A or follows one
        used = set()
        for (doc, _), r in got.items():
            if doc == k:
                used |= set(range(r["first"], r["last"] + 1 if r["is_next"] else r["first"] + r["cut"]))
        assert used == set(range(len(s)))
    assert {r["is_next"] for r in got.values()} == {True, False}


def test_pairs_of_one_document(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(s):
        read.add(1)
        return s

    docs = spark.createDataFrame([(k, [3, 4, 5, 6]) for k in range(40)], "k int, sizes array<int>").withColumn("sizes", F.udf(counted, "array<int>")("sizes"))
    P.next_sentence(docs, "k", "sizes", 9, 3).collect()
    assert 40 <= read.value <= 80  # written once; a filter may ask a second time
    rows = P.next_sentence(spark.createDataFrame([("only", [5, 5, 5])], "k string, sizes array<int>"), "k", "sizes", 100, 1).collect()
    assert rows and all(r["b_doc"] == "only" and 0 <= r["b_first"] <= r["b_last"] <= 2 for r in rows)
    assert P.next_sentence(spark.createDataFrame([("none", [0])], "k string, sizes array<int>"), "k", "sizes", 9, 1).count() == 0


def test_mask_draws_from_the_whole_vocabulary(spark):
    vocab = spark.range(500).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("token"))
    rows = [(k, None if k % 7 == 0 else str(k), ["[CLS]"] + [f"t{i}" for i in range(60)] + ["[SEP]"]) for k in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, tokens array<string>")
    out = P.mask(df, ["a", "b"], "tokens", F.lit(20), vocab, 4).collect()
    assert len(out) == 300
    masks = kept = 0
    others = set()
    for r in out:
        old = ["[CLS]"] + [f"t{i}" for i in range(60)] + ["[SEP]"]
        assert len(r["places"]) == 20 and r["labels"] == [old[i] for i in r["places"]] and r["tokens"][0] == "[CLS]" and r["tokens"][-1] == "[SEP]"
        assert all(r["tokens"][i] == old[i] for i in range(62) if i not in r["places"])
        now = [r["tokens"][i] for i in r["places"]]
        masks += now.count("[MASK]")
        kept += sum(r["tokens"][i] == old[i] for i in r["places"])
        others |= {t for t in now if t.startswith("v")}
    assert abs(masks / 6000 - 0.8) < 0.03 and abs(kept / 6000 - 0.1) < 0.02
    assert len(others) > 300


def test_mask_with_an_empty_vocabulary(spark):
    df = spark.createDataFrame([(1, ["[CLS]", "a", "b", "[SEP]"])], "a int, tokens array<string>")
    row = P.mask(df, ["a"], "tokens", F.lit(2), spark.createDataFrame([], "id int, token string"), 1).first()
    assert all(t in ("[MASK]", old) for t, old in zip(row["tokens"], ["[CLS]", "a", "b", "[SEP]"]))


def plain_pack(sizes, budgets):
    """One document after the other."""
    room, docs, out = list(budgets), [0] * len(budgets), {}
    every = sorted((z for z, n in sizes for _ in range(n)), reverse=True)
    for k, z in enumerate(every):
        empty = [i for i, c in enumerate(docs) if not c]
        among = empty if len(every) - k <= len(empty) else range(len(room))
        i = max(among, key=lambda j: (room[j], -j))
        room[i] -= max(z, 1)
        docs[i] += 1
        out[z, i] = out.get((z, i), 0) + 1
    return out, docs


def test_pack_is_one_document_at_a_time():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [(z, rng.choice([1, 2, 7, 60])) for z in sorted(rng.sample(range(40), rng.randint(1, 12)))]
        budgets = [rng.randint(0, 400) for _ in range(rng.randint(1, 9))]
        want, docs = plain_pack(sizes, budgets)
        got = P.pack(sizes, budgets)
        assert {(z, i): b - a for z, i, a, b in got} == want
        assert min(docs) > 0 or sum(n for _, n in sizes) < len(budgets)
        for z, n in sizes:  # places of a size without gaps
            ends = sorted((a, b) for y, _, a, b in got if y == z)
            assert [a for a, _ in ends] == [0] + [b for _, b in ends[:-1]] and ends[-1][1] == n


def test_pack_of_many_documents():
    """The work is that of the sizes, not of the documents."""
    got = P.pack([(1, 10**12), (30, 10**9), (7, 5 * 10**10)], [10**9] * 500)
    load = [0] * 500
    for z, i, a, b in got:
        load[i] += z * (b - a)
    assert max(load) - min(load) <= 1


def test_shard_balance(spark):
    """Every document once, no empty shard, and shards of a split within one small document of each other; no worse than the
    spread of a deal to and fro."""
    rng = random.Random(6)
    rows = [(k, min(int(rng.paretovariate(1.1)), 300), "x") for k in range(1500)] + [(1500 + k, 0, "x") for k in range(40)] + [(9000, None, "x")]
    out = P.shard_balance(spark.createDataFrame(rows, "k int, size int, shardx string"), "size", "k", 6, test_shards=3).collect()
    assert sorted(r["k"] for r in out) == sorted(r[0] for r in rows)
    load = {}
    for r in out:
        load.setdefault(r["split"], {}).setdefault(r["shard"], []).append(r["size"] or 0)
    assert {s: sorted(x) for s, x in load.items()} == {"training": list(range(6)), "test": [0, 1, 2]}
    for shards in load.values():
        sums = [sum(max(z, 1) for z in x) for x in shards.values()]
        assert max(sums) - min(sums) <= 2
    assert abs(sum(sum(x) for x in load["test"].values()) / sum(r[1] or 0 for r in rows) - 0.1) < 0.02


def test_fewer_documents_than_shards(spark):
    out = P.shard_balance(spark.createDataFrame([(1, 5), (2, 9)], "k int, size int"), "size", "k", 4).collect()
    assert len({(r["split"], r["shard"]) for r in out}) == 2
    assert P.shard_balance(spark.createDataFrame([], "k int, size int"), "size", "k", 4).count() == 0
