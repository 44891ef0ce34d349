"""Subword learning against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import bpe as B
from corpusloom.operators import tokens as K
from corpusloom.operators import vocab as V


def plain_bpe(words, merges):
    rows, out = [(list(w), n) for w, n in words], []
    for _ in range(merges):
        counts = {}
        for s, n in rows:
            for p in zip(s, s[1:]):
                counts[p] = counts.get(p, 0) + n
        if not counts or max(counts.values()) < 2:
            break
        a, b = min(counts, key=lambda p: (-counts[p], p))
        out.append((a, b, counts[a, b]))
        for s, _n in rows:
            i = 0
            while i < len(s) - 1:
                if s[i] == a and s[i + 1] == b:
                    s[i : i + 2] = [a + b]
                i += 1
    return out


def corpus(seed, letters, n, longest=9):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)}
    return [(w, rng.randint(1, 4)) for w in sorted(words)]


def test_bpe_takes_the_order_of_single_merges(spark):
    for seed, letters in ((1, "abcdefgh"), (2, "aab")):
        words = corpus(seed, letters, 120)
        got = V.train_bpe(spark.createDataFrame(words, "word string, n bigint"), 20).orderBy("rank").collect()
        assert [(r["left"], r["right"], r["n"]) for r in got] == plain_bpe(words, 20)


@pytest.mark.parametrize("batch, most", [(1, 50_000), (64, 50_000), (64, 40), (4, 0)])
def test_bpe_order_at_any_width(spark, batch, most):
    """Whatever a round looks at, and also where it can look at nothing but the best pair."""
    for seed, letters in ((5, "abcdefghijkl"), (6, "aaab")):
        words = corpus(seed, letters, 150, 14)
        got = B.train_bpe(spark.createDataFrame(words, "word string, n bigint"), 10, batch=batch, most_stretches=most).orderBy("rank").collect()
        assert [(r["left"], r["right"], r["n"]) for r in got] == plain_bpe(words, 10)


def test_bpe_to_the_end(spark):
    """More merges than there are, with rewritten tables on the way."""
    words = corpus(8, "abcde", 60)
    got = B.train_bpe(spark.createDataFrame(words, "word string, n bigint"), 10_000, batch=8, most_stretches=200).orderBy("rank").collect()
    assert [(r["left"], r["right"], r["n"]) for r in got] == plain_bpe(words, 10_000) and len(got) > 50


def test_certain_merges_are_the_next_ones():
    """Stretches of the best pairs alone tell the next merges of the corpus; and more than one of them."""
    rng, taken = random.Random(9), 0
    for _ in range(120):
        words = corpus(rng.random(), rng.choice(["abc", "abcdef", "aab"]), 40, 12)
        counts = Counter()
        for w, n in words:
            for p in zip(w, w[1:]):
                counts[p] += n
        keys = sorted((-n, p) for p, n in counts.items())
        k = rng.randint(1, len(keys))
        pairs = {p for _, p in keys[:k]}
        rows = [(s, n) for w, n in words for s in B.stretches(list(w), pairs)]
        got = B.certain_merges(rows, pairs, keys[k] if k < len(keys) else None, 30)
        assert got == plain_bpe(words, 30)[: len(got)] and (got or keys[0][0] == -1)
        taken += len(got)
    assert taken > 500


def test_stretches_with_nothing_around_them_tell_the_next_merges():
    """Runs of the pairs above the floor alone, a few different ones, tell the next merges down to the floor."""
    rng, taken, bare, whole = random.Random(10), 0, 0, 0
    for _ in range(120):
        words = [(w, rng.randint(1, 60)) for w, _ in corpus(rng.random(), rng.choice(["abc", "abcdef", "aab"]), 60, 12)]
        counts = Counter()
        for w, n in words:
            for p in zip(w, w[1:]):
                counts[p] += n
        keys = sorted((-n, p) for p, n in counts.items())
        least = rng.choice([1, *(-n for n, _ in keys)])
        pairs = {p for n, p in keys if -n > least}
        weights = Counter()
        for w, n in words:
            for s in B.stretches(list(w), pairs, False):
                weights[tuple(s)] += n
        got = B.certain_merges([(list(s), n) for s, n in weights.items()], pairs, (-least, ("", "")), 60)
        want = plain_bpe(words, 60)
        assert got == want[: len(got)] and (len(got) == len(want) or want[len(got)][2] <= least)
        taken, bare, whole = taken + len(got), bare + len(weights), whole + len({tuple(s) for w, _ in words for s in B.stretches(list(w), pairs)})
    assert taken > 1000 and bare < whole


def test_bpe_takes_few_rounds(spark):
    """Words that frequent pairs cover in many ways: 300 stretches are enough for many merges."""
    rng = random.Random(41)
    words = [("".join(rng.choice("abcdefghijklmnopqrst"[: rng.randint(2, 20)]) for _ in range(rng.randint(4, 10))), rng.randint(1, 9)) for _ in range(1500)]
    words = sorted(dict(words).items())
    rounds, staged = [], B._staged
    B._staged = lambda rows: rounds.append(1) or staged(rows)
    try:
        got = B.train_bpe(spark.createDataFrame(words, "word string, n bigint"), 300, batch=8, most_stretches=300).orderBy("rank").collect()
    finally:
        B._staged = staged
    assert [(r["left"], r["right"], r["n"]) for r in got] == plain_bpe(words, 300)
    assert len(rounds) < 15, len(rounds)


def numbered(words, names):
    return [[ord(x) if len(x) == 1 else B.FIRST + names.index(x) for x in s] for s in words]


def test_bpe_rounds_without_spark():
    """Rounds of stretches, certain merges and merging of many words at once."""
    rng = random.Random(21)
    for _ in range(40):
        words = corpus(rng.random(), rng.choice(["ab", "abc", "aab", "abcd"]), 60, 14)
        want, out, names = plain_bpe(words, 400), [], []
        state, weights = [list(w) for w, _ in words], [n for _, n in words]
        while True:
            counts = Counter()
            for s, n in zip(state, weights):
                for p in zip(s, s[1:]):
                    counts[p] += n
            keys = sorted((-n, p) for p, n in counts.items() if n > 1)
            if not keys:
                break
            k = rng.randint(1, 12)
            pairs = {p for _, p in keys[:k]}
            rows = [(s, n) for w, n in zip(state, weights) for s in B.stretches(w, pairs)]
            new = B.certain_merges(rows, pairs, keys[k] if k < len(keys) else None, 400) or [(*keys[0][1], -keys[0][0])]
            out += new
            made = []
            for a, b, _ in new:
                sides = [numbered([[x]], names)[0][0] for x in (a, b)]
                assert a + b not in names
                names.append(a + b)
                made.append((*sides, B.FIRST + len(names) - 1))
            flat = [x for s in numbered(state, names) for x in s]
            groups = B._merged(np.array(flat, np.int32), np.array([len(s) for s in state]), np.array(weights), *B._in_order(made))
            state, weights = [], []
            for s, size, n in groups:
                ends = np.cumsum(size)
                state += [[B._name(x, names) for x in s[e - z : e].tolist()] for e, z in zip(ends, size)]
                weights += n.tolist()
        assert out == want


def test_bpe_coverage(spark):
    words = spark.createDataFrame([("abab", 10), ("abzab", 5), ("z", 1), ("qab", 1)], "word string, n bigint")
    cut = {r["word"]: r["n"] for r in B.covered(words, 0.85).collect()}
    assert cut == {"abab": 10, "ab": 11}
    assert {r["word"] for r in B.covered(words, 1.0).collect()} == {"abab", "abzab", "z", "qab"}
    assert [r["left"] + r["right"] for r in B.train_bpe(words, 9, coverage=0.85).orderBy("rank").collect()] == ["ab", "abab"]


def test_bpe_of_nothing(spark):
    assert V.train_bpe(spark.createDataFrame([("", 3), ("a", 2)], "word string, n bigint"), 5).count() == 0


def test_unigram_held_and_joined_pieces_are_the_same(spark):
    words = spark.createDataFrame([*corpus(3, "abcde", 60), ("", 4), ("internationalisation", 9), ("internationalisations", 2)], "word string, n bigint")
    learn = lambda held: {r["token"]: round(r["score"], 6) for r in V.train_unigram(words, 60, specials=V.SPECIALS, held=held).collect()}
    a, b = learn(1000), learn(0)
    assert a == b and len(a) == 60 and set(V.SPECIALS) <= set(a)
    assert set("abcdeilnorst") <= set(a)
    assert any(len(t) > 8 and t not in V.SPECIALS for t in a)


def test_unigram_expected_uses_are_those_of_all_ways():
    scores = {"a": -1.0, "b": -2.0, "ab": -2.5, "ba": -1.5, "aba": -4.0}
    word = "abab"
    arcs = [(a, b, scores[word[a:b]]) for a in range(4) for b in range(a + 1, 5) if word[a:b] in scores]

    def ways(at):
        if at == len(word):
            yield []
        for arc in arcs:
            if arc[0] == at:
                yield from ([arc, *rest] for rest in ways(arc[1]))

    import math

    every = [(math.exp(sum(s for _, _, s in w)), w) for w in ways(0)]
    total = sum(p for p, _ in every)
    for arc, p in zip(arcs, V._expected(4, arcs)):
        assert abs(p - sum(q for q, w in every if arc in w) / total) < 1e-9


def best_way(word, scores):
    best = [0.0] + [-1e18] * len(word)
    for b in range(1, len(word) + 1):
        best[b] = max(best[a] + scores[word[a:b]] if word[a:b] in scores else -1e18 for a in range(b))
    return best[-1]


def test_losses_are_those_of_the_second_way(spark):
    scores = {"a": -1.0, "b": -2.0, "c": -9.0, "ab": -2.5, "abc": -3.0, "bc": -20.0, "aba": -4.0}
    uses = {"ab": 10.0, "abc": 4.0, "bc": 3.0, "aba": 1.0}
    frame = lambda d, n: spark.createDataFrame(list(d.items()), f"token string, {n} double")
    want = {t: n * (scores[t] - best_way(t, {k: v for k, v in scores.items() if k != t})) for t, n in uses.items()}
    for held in (100, 0):
        got = {r["token"]: r["loss"] for r in V.losses(frame(uses, "n"), frame(scores, "score"), 16, held).collect()}
        assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    assert want["bc"] < 0 < want["abc"]  # a piece that another way beats goes first



def test_pieces_that_cost_nothing_go_alone(spark):
    """Where more than half of the pieces cost nothing, they go, and not all beyond the wanted ones with them."""
    rows = [(f"p{k}", 1.0, float(max(0, k - 30))) for k in range(41)]
    pieces = spark.createDataFrame(rows, "token string, n double, loss double")
    assert {r["token"] for r in V._dearest(pieces, 20, 5).collect()} == {f"p{k}" for k in range(31, 41)}
    assert {r["token"] for r in V._dearest(pieces, 20, 12).collect()} > {f"p{k}" for k in range(31, 41)}


def test_substrings_are_counted_as_one_by_one(spark):
    """Also over batches of a few rows, whose neighbours share beginnings."""
    words = [*corpus(14, "abé😀", 150, 12), ("aaaaaaa", 1), ("xyz", 1), ("x\0y", 1)]
    want = Counter()
    for w, n in words:
        for a in range(len(w)):
            for b in range(a + 1, min(len(w), a + 5) + 1):
                want[w[a:b]] += n
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["token"]: r["n"] for r in V._substrings(spark.createDataFrame(words, "word string, n bigint"), 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {t: n for t, n in want.items() if n > 1 or len(t) == 1}


def test_unigram_parts_hold_their_own_pieces(spark, monkeypatch):
    """More pieces than a task holds: each part of the words has those that occur in it, and nothing is joined to substrings."""
    monkeypatch.setattr(V, "PART", 300)
    monkeypatch.setattr(V, "_joined", None)
    rng = random.Random(33)
    words = [*corpus(15, "abcé", 300, 20), ("zz", 5), ("ab" * 60, 2)]
    pieces = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))): -9 * rng.random() for _ in range(150)} | dict.fromkeys("abcé", -3.0)
    df = spark.createDataFrame(words, "word string, n bigint")
    scored = spark.createDataFrame(list(pieces.items()), "token string, score double")
    a, b = ({r["token"]: r["n"] for r in V._estimate(df, scored, 6, held).collect()} for held in (1000, 3))
    assert a.keys() == b.keys() and len(a) > 50 and all(abs(a[t] - b[t]) < 1e-9 * max(1, a[t]) for t in a)
    uses = spark.createDataFrame([(t, 2.0) for t in pieces] + [("zab", 1.0)], "token string, n double")
    a, b = ({r["token"]: r["loss"] for r in V.losses(uses, scored, 6, held).collect()} for held in (1000, 3))
    assert a == b and a.keys() == pieces.keys()


def test_unigram_pieces_of_one_hash_are_joined(spark, monkeypatch):
    words = spark.createDataFrame(corpus(16, "abc", 40), "word string, n bigint")
    scored = spark.createDataFrame([("a", -1.0), ("b", -2.0), ("c", -2.0), ("ab", -2.5), ("bca", -3.0)], "token string, score double")
    want = {r["token"]: r["n"] for r in V._estimate(words, scored, 4, 100).collect()}
    monkeypatch.setattr(V, "_hashed", lambda pieces: pieces.withColumn("h", F.lit(1).cast("long")))
    got = {r["token"]: r["n"] for r in V._estimate(words, scored, 4, 100).collect()}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-6 for t in want)


def test_unigram_drops_what_the_likelihood_misses_least(spark):
    """At the same size the words are likelier than with the least used pieces dropped; and rounds do not lower it."""
    words = corpus(12, "abcd", 200, 12)
    df = spark.createDataFrame(words, "word string, n bigint")
    total = lambda rows: sum(n * best_way(w, rows) for w, n in words)
    learn = lambda **k: total({r["token"]: r["score"] for r in V.train_unigram(df, 60, **k).collect()})
    by_loss = learn(keep=0.8)
    uses = V.losses
    V.losses = lambda pieces, *a: pieces.select("token", "n", F.col("n").alias("loss"))
    try:
        by_use = learn(keep=0.8)
    finally:
        V.losses = uses
    assert by_loss > by_use
    assert learn(keep=0.8, rounds=4) >= by_loss * 1.02  # both are negative


def test_unigram_many_words_at_once_are_as_one_by_one(spark):
    """Words of all lengths, also longer than any piece and such that no way leads through, and letters beyond 16 bits."""
    rng = random.Random(31)
    words = [*corpus(4, "abcé😀", 300, 40), ("", 2), ("zz", 5), ("ab" * 300, 2)]
    pieces = {"".join(rng.choice("abcé😀") for _ in range(rng.randint(1, 6))): -9 * rng.random() for _ in range(150)} | dict.fromkeys("abcé😀", -3.0)
    df = spark.createDataFrame(words, "word string, n bigint").where("word != ''")
    scored = spark.createDataFrame(list(pieces.items()), "token string, score double")
    uses = {}
    for w, n in words:
        arcs = [(a, b, pieces[w[a:b]]) for a in range(len(w)) for b in range(a + 1, min(len(w), a + 5) + 1) if w[a:b] in pieces]
        for (a, b, _), p in zip(arcs, V._expected(len(w), arcs)):
            uses[w[a:b]] = uses.get(w[a:b], 0.0) + (n * p if p > 1e-9 else 0)
    got = {r["token"]: r["n"] for r in V._estimate(df, scored, 5, 1000).collect()}
    assert len(got) > 50 and all(abs(got.get(t, 0.0) - n) < 1e-6 for t, n in uses.items()) and got.keys() <= uses.keys()


def test_unigram_user_symbols_and_coverage(spark):
    words = spark.createDataFrame([("ab<x>ab", 10), ("abab", 8), ("zab", 1)], "word string, n bigint")
    got = {r["token"]: r["score"] for r in V.train_unigram(words, 8, user=("<x>",), coverage=0.97).collect()}
    assert got["<x>"] == 0 and "ab" in got and not any(c in t for t in got if t != "<x>" for c in "<x>z")


def test_unigram_of_nothing(spark):
    assert V.train_unigram(spark.createDataFrame([], "word string, n bigint"), 10).count() == 0


def test_words_first(spark):
    """Words of the list, listed characters, literals, coded characters cut into pieces, and characters without a code."""
    sep, up = T.SEP, lambda x: "".join(chr(ord(c) + 50_000) for c in x)
    listed = spark.createDataFrame([(0, "[UNK]"), (1, "天气"), (2, "好")], "id int, token string")
    book = spark.createDataFrame([("今", "jin1"), ("天", "tian1"), ("很", "hen3")], "ch string, code string")
    scored = spark.createDataFrame([("jin", -1.0), ("1", -1.0), ("tian1", -1.5), ("tian", -1.0), ("hen", -2.0), ("h", -0.5), ("en", -1.0)], "token string, score double")
    rows = spark.createDataFrame([(1, ["天气", "今天", "很好", "a9", "氣"]), (2, []), (3, None)], "k int, w array<string>")
    got = {r["k"]: r["tokens"] for r in K.words_first(rows, ["k"], "w", listed, book, scored).collect()}
    want = ["天气", "jin", "1", "tian1", "h", "en", "3", "好", up("a"), up("9"), "氣"]
    assert got == {1: [t if t in ("天气", "好") else sep + t for t in want], 2: [], 3: []}
    pieces = K.marked(scored.select(F.row_number().over(Window.orderBy("token")).alias("id"), "token"))
    ids = K.to_ids_two(spark.createDataFrame([(1, got[1])], "k int, t array<string>"), ["k"], "t", listed, pieces).first()["ids"]
    order = sorted(["jin", "1", "tian1", "tian", "hen", "h", "en"])
    assert ids == [1] + [3 + order.index(t) + 1 if t in order else 3 for t in ["jin", "1", "tian1", "h", "en", "3"]] + [2, 3, 3, 3]


def test_segmentation_below_and_above_what_tasks_hold(spark):
    """Vocabularies that are held and those that are joined give the same tokens, which are those of the plain rules."""
    rng = random.Random(13)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.random() * 9 for _ in range(40)}
    pieces.pop("c", None)
    words = ["".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 14))) for _ in range(80)] + ["a" * 101, "", "d"]
    rows = [(k, words[k : k + 5]) for k in range(0, len(words), 5)] + [(1000, []), (1001, None)]
    df = spark.createDataFrame(rows, "k int, w array<string>")
    scored = spark.createDataFrame(list(pieces.items()), "token string, score double")
    both = [*pieces, *("##" + p for p in pieces)]
    vocab = spark.createDataFrame([(p,) for p in both], "token string")
    flat = lambda f: {k: [p for x in (w or []) if x for p in f(x)] for k, w in rows}
    longest = max(map(len, pieces))
    for held in (1000, 3):
        got = {r["k"]: r["tokens"] for r in K.tokenize_unigram(df, ["k"], "w", scored, held=held).collect()}
        assert got == flat(lambda x: K.unigram(x, pieces, longest))
        got = {r["k"]: r["tokens"] for r in K.tokenize_wordpiece(df, ["k"], "w", vocab, held=held).collect()}
        assert got == flat(lambda x: K.wordpiece(x, set(both)))
