"""Vocabularies: counting, ranking, learning and reports. A vocabulary is a table (id, token[, n])."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.bpe import covered, train_bpe
from corpusloom.sources.sinks import scratch

SPECIALS = ("[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]")
ALPHABET = T.LITERALS + "❁❄❂❃❅"
#: Pieces that tasks hold at most, as two numbers each.
MAX_HELD = 12_000_000
#: Letters of words that are worked on at once, about: of words of several lengths, of words of one, and of a part of the words.
LETTERS, EVEN, PART = 200_000, 1 << 15, 400_000
#: Longest words whose ways are added up as they are, not as logarithms, and by what a letter is made likelier for that.
SHORT, LIFT = 64, 2.5

__all__ = ["train_bpe", "train_unigram"]


def ranked(counts: DataFrame, size: int, *, token: str = "token", n: str = "n", specials: tuple[str, ...] = SPECIALS) -> DataFrame:
    """(id, token, n): the specials with 0, then the most frequent tokens, ``size`` in all; ties by token."""
    top = counts.orderBy(F.desc(n), token).limit(max(0, size - len(specials)))
    order = Window.orderBy(F.desc("n"), "token")
    rest = top.select(F.col(token).alias("token"), F.col(n).cast("long").alias("n")).withColumn("id", F.row_number().over(order) + (len(specials) - 1))
    head = counts.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, specials))).alias("id", "token"), F.lit(0).cast("long").alias("n"))
    return head.unionByName(rest).select("id", "token", "n")


def char_vocab(docs: DataFrame, size: int = 30_000, *, text: str = "text") -> DataFrame:
    chars = docs.select(F.explode(F.split(T.lower_strip(text), "")).alias("token")).where("token != ''")
    return ranked(chars.groupBy("token").agg(F.count("*").alias("n")), size)


def merge_token_stats(stats: DataFrame, vocab: DataFrame, unk: str = "[UNK]") -> DataFrame:
    """Sums counters (token, n); tokens outside the vocabulary are folded into ``unk``."""
    summed = stats.groupBy("token").agg(F.sum("n").alias("n"))
    found = summed.join(vocab.select("token", F.lit(True).alias("_in")), "token", "left")
    return found.groupBy(F.when(F.col("_in"), F.col("token")).otherwise(unk).alias("token")).agg(F.sum("n").alias("n"))


def makeup(vocab: DataFrame, sep: str = T.SEP) -> DataFrame:
    """(class, n): special, punctuation, letter, character, sub-character or phrase."""
    t = F.col("token")
    seps = F.length(t) - F.length(F.replace(t, F.lit(sep), F.lit("")))
    kind = (
        F.when(t.isin(*SPECIALS), "special").when((F.length(t) == 1) & t.rlike(f"^[{T.PUNCT}￥]$"), "punctuation").when(t.rlike("^[a-z]$"), "letter")
        .when(T.is_cjk(t), "character").when(seps == 0, "sub-character").when(seps == 1, "character").otherwise("phrase")
    )
    return vocab.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def composition(vocab: DataFrame, codes: DataFrame, sep: str = T.SEP, skip: int = 5) -> DataFrame:
    """(class, n, share): single characters and whole codes, parts of codes, and composites. ``codes``: (code)."""
    body = F.regexp_replace("token", f"{sep}$", "")
    t = vocab.where(F.col("id") >= skip).withColumn("_body", body).join(codes.select(F.col("code").alias("_body"), F.lit(True).alias("_code")).distinct(), "_body", "left")
    lower = F.lower("_body")
    parts = F.length(F.translate(lower, ALPHABET, "")) == 0
    kind = (
        F.when((F.length("token") == 1) & ~F.lower("token").rlike("^[0-9a-z]$"), "char").when(F.col("_code"), "char")
        .when(parts & ~F.col("_body").contains(sep), "sub-char").otherwise("composite")
    )
    counted = t.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def decode_overlap(vocab: DataFrame, book: DataFrame, raw: DataFrame, sep: str = T.SEP) -> DataFrame:
    """(tokens, decodable, in_raw): tokens whose pieces all are codes, and those whose text is in a raw vocabulary. A code of
    several characters stands for the first of them."""
    first = book.groupBy("code").agg(F.min("ch").alias("ch"))
    pieces = vocab.select("token", F.posexplode(F.filter(F.split("token", sep), lambda p: p != "")).alias("k", "code"))
    whole = pieces.join(first, "code", "left").groupBy("token").agg(F.count("*").alias("n"), F.count("ch").alias("m"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "ch"))), lambda x: x["ch"]), "").alias("word"))
    good = whole.where("n = m").join(raw.select(F.col("token").alias("word"), F.lit(1).alias("raw")).distinct(), "word", "left")
    return vocab.agg(F.count("*").alias("tokens")).join(good.agg(F.count("*").alias("decodable"), F.coalesce(F.sum("raw"), F.lit(0)).alias("in_raw")), F.lit(True))


def _staged(rows: DataFrame, name: str) -> DataFrame:
    """The rows from a written table in the shared folder: plans do not grow with the rounds, and lost executors cost no round."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _dealt(words: DataFrame) -> DataFrame:
    """The words as a written table, dealt over as many files as a shuffle has parts: work on them is far more than reading."""
    spark = words.sparkSession
    return _staged(words.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))), "words")


def _expected(n: int, arcs: list[tuple[int, int, float]]) -> list[float]:
    """The probability of each arc (start, stop, score), sorted by start, over all ways from 0 to ``n``; none if there is none."""
    low = -math.inf
    fwd, bwd = [0.0] + [low] * n, [low] * n + [0.0]

    def add(x: float, y: float) -> float:
        return max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > low else max(x, y)

    for a, b, s in arcs:
        fwd[b] = add(fwd[b], fwd[a] + s)
    for a, b, s in reversed(arcs):
        bwd[a] = add(bwd[a], s + bwd[b])
    return [math.exp(fwd[a] + s + bwd[b] - fwd[n]) for a, b, s in arcs] if fwd[n] > low else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which, size, letters) of words of about the same length: their numbers and lengths, and a column of hashed letters for
    each; about ``LETTERS`` letters at once."""
    words = words.to_pylist()
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size) - size
    code = _mixed(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64))
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    while len(order):
        longest = int(size[order[0]])
        which, order = np.split(order, [max(1, LETTERS // longest)])
        at = np.arange(longest)[:, None]
        inside = at < size[which]
        yield which, size[which], np.where(inside, code[np.where(inside, first[which] + at, 0)], np.uint64(0))


def _even(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, letters) of words of one length: their numbers, and a column of hashed letters for each."""
    words = words.to_pylist()
    size = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(size) - size
    code = _mixed(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64))
    order = np.argsort(size, kind="stable")
    for k in np.unique(size[size > 0]).tolist():
        of = order[np.searchsorted(size[order], k) : np.searchsorted(size[order], k, "right")]
        for i in range(0, len(of), max(1, EVEN // k)):
            which = of[i : i + max(1, EVEN // k)]
            yield which, code[first[which] + np.arange(k)[:, None]]


def _hashes(letters: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For each length from 1 on the 64-bit hashes of what begins at each letter."""
    h = np.zeros_like(letters)
    for k in range(min(longest, len(letters))):
        h = h[: len(letters) - k] * np.uint64(0xD6E8FEB86659FD93) + letters[k:]
        yield h


def _hashed(pieces: DataFrame, token: str = "token") -> DataFrame:
    """The pieces with the hash ``h`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.zeros(b.num_rows, np.uint64)
            for which, size, letters in _blocks(b.column(token)):
                for k, x in enumerate(_hashes(letters, len(letters))):
                    h[which[size == k + 1]] = x[0, size == k + 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h.view(np.int64))], names=[*b.schema.names, "h"])

    return pieces.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", h bigint")


class _Numbers:
    """Finds hashes among sorted ones, by a table of their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, np.uint64(64 - max(1, len(keys).bit_length()))
        first = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.first = np.concatenate([[0], np.cumsum(first)]).astype(np.int32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        bits = (x >> self.shift).astype(np.int64)
        at, end, out = self.first[bits], self.first[bits + 1], np.full(len(x), -1, np.int32)
        live = np.flatnonzero(at < end)
        at, end, x = at[live], end[live], x[live]
        while len(live):
            key = self.keys[at]
            same = key == x
            out[live[same]] = at[same]
            on = (key < x) & (at + 1 < end)
            live, at, end, x = live[on], at[on] + 1, end[on], x[on]
        return out


def _found(letters: np.ndarray, size: np.ndarray, longest: int, numbers: _Numbers) -> np.ndarray:
    """The number of the piece of each length (from 1) that begins at each letter of each word, or -1."""
    found = np.full((min(longest, len(letters)), *letters.shape), -1, np.int32)
    for k, h in enumerate(_hashes(letters, longest)):
        inside = np.arange(len(h))[:, None] + k < size
        found[k, : len(h)][inside] = numbers(h[inside])
    return found


def _ending(letters: np.ndarray, longest: int, numbers: _Numbers) -> np.ndarray:
    """The number of the piece that ends before each place of each word of one length, or -1, by (place, start, word): the
    starts are those of the ``longest`` places before."""
    many = min(longest, len(letters))
    found = np.full((len(letters) + 1, many, letters.shape[1]), -1, np.int32)
    hashes = list(_hashes(letters, longest))
    at = numbers(np.concatenate([h.ravel() for h in hashes]))
    done = 0
    for k, h in enumerate(hashes):
        found[k + 1 :, many - 1 - k] = at[done : done + h.size].reshape(h.shape)
        done += h.size
    return found


def _add_uses(words: pa.Array, weight: np.ndarray, longest: int, numbers: _Numbers, score: np.ndarray, uses: np.ndarray) -> None:
    """Adds the expected uses of pieces in the words to ``uses``. Ways of words of up to ``SHORT`` letters are added up as they
    are; where that leaves the numbers, and for longer words, by logarithms."""
    chance, rest = np.append(np.exp(score), 0.0), []
    with np.errstate(all="ignore"):
        for which, letters in _even(words):
            size = len(letters)
            if size > SHORT:
                rest.append(which)
                continue
            found = _ending(letters, longest, numbers)
            many = found.shape[1]
            arcs = chance[found]
            arcs *= np.exp(LIFT * np.arange(many, 0, -1))[:, None]
            fwd, bwd = np.zeros((2, size + 1, letters.shape[1]))
            fwd[0] = bwd[size] = 1
            for j in range(1, size + 1):
                k = min(many, j)
                fwd[j] = np.einsum("kw,kw->w", fwd[j - k : j], arcs[j, many - k :])
            for j in range(size, 0, -1):
                k = min(many, j)
                arcs[j, many - k :] *= bwd[j]  # bwd[j] has all ways on from here by now
                bwd[j - k : j] += arcs[j, many - k :]
                arcs[j, many - k :] *= fwd[j - k : j]
            total = fwd[size]
            good = np.isfinite(total) & (total > 1e-200)
            if not good.all():
                rest.append(which[~good])
            arcs /= np.where(good, total, np.inf)
            hit = arcs > 1e-9
            np.add.at(uses, found[hit], arcs[hit] * np.broadcast_to(weight[which], arcs.shape)[hit])
        if rest:
            rest = np.concatenate(rest)
            _add_uses_by_logs(words.take(pa.array(rest)), weight[rest], longest, numbers, score, uses)


def _add_uses_by_logs(words: pa.Array, weight: np.ndarray, longest: int, numbers: _Numbers, score: np.ndarray, uses: np.ndarray) -> None:
    for which, size, letters in _blocks(words):
        found = _found(letters, size, longest, numbers)
        arcs = _arcs(found, score)
        fwd, bwd = _forward(arcs, _log_sum), _backward(arcs, size)
        total = fwd[size, np.arange(len(size))]
        for k, arc in enumerate(arcs):
            n = len(arc) - k
            p = np.exp(fwd[:n] + arc[:n] + bwd[k + 1 :] - total)
            hit = p > 1e-9  # not so where there is no way, which makes it no number
            np.add.at(uses, found[k, :n][hit], (p * weight[which])[hit])


def _losses_of(words: pa.Array, n: np.ndarray, longest: int, numbers: _Numbers, score: np.ndarray) -> np.ndarray:
    """What is lost with each of the words, as pieces that are used ``n`` times; no number for those that are no pieces."""
    loss, scores = np.full(len(n), np.nan), np.append(score, -np.inf)
    with np.errstate(all="ignore"):
        for which, letters in _even(words):
            arcs, size = scores[_ending(letters, longest, numbers)], len(letters)
            many = arcs.shape[1]
            own = arcs[size, 0].copy() if many == size else np.full(len(which), -np.inf)
            if many == size:
                arcs[size, 0] = -np.inf
            best = np.full((size + 1, len(which)), -np.inf)
            best[0] = 0
            for j in range(1, size + 1):
                k = min(many, j)
                best[j] = (best[j - k : j] + arcs[j, many - k :]).max(0)
            loss[which] = np.where(own > -np.inf, n[which] * (own - best[size]), np.nan)
    return loss


def _log_sum(x: np.ndarray) -> np.ndarray:
    most = x.max(0)
    most = np.where(most > -np.inf, most, 0.0)
    return np.log(np.exp(x - most).sum(0)) + most


def _forward(arcs: np.ndarray, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What ``add`` makes of all ways to each place, by arcs (length, start, word)."""
    fwd = np.full((arcs.shape[1] + 1, arcs.shape[2]), -np.inf)
    fwd[0] = 0
    for j in range(1, len(fwd)):
        k = np.arange(min(len(arcs), j))
        fwd[j] = add(fwd[j - 1 - k] + arcs[k, j - 1 - k])
    return fwd


def _backward(arcs: np.ndarray, size: np.ndarray) -> np.ndarray:
    bwd = np.full((arcs.shape[1] + 1, arcs.shape[2]), -np.inf)
    for j in range(len(bwd) - 1, -1, -1):
        k = min(len(arcs), len(bwd) - 1 - j)
        bwd[j] = np.where(size == j, 0.0, _log_sum(arcs[:k, j] + bwd[j + 1 : j + 1 + k]) if k else -np.inf)
    return bwd


def _held(pieces: DataFrame, most: int):
    """The hashes and scores of up to ``most`` pieces, sorted, as a broadcast; None if there are more, or two of one hash."""
    rows = _hashed(pieces.select("token", "score")).select("h", "score").limit(most + 1).toArrow()
    keys, order = np.unique(rows.column("h").to_numpy().view(np.uint64), return_index=True)
    if len(keys) < rows.num_rows or rows.num_rows > most:
        return None
    return pieces.sparkSession.sparkContext.broadcast((keys, rows.column("score").to_numpy()[order]))


def _arcs(found: np.ndarray, score: np.ndarray) -> np.ndarray:
    return np.where(found >= 0, score[found], -np.inf) if len(score) else np.full(found.shape, -np.inf)


def _joined(words: DataFrame, pieces: DataFrame, longest: int, per_word, out: str) -> DataFrame:
    """``per_word`` over (word, n, arcs) of batches of words, arcs being the pieces (token, score) in a word as (start, stop, score);
    pieces are joined to the substrings of the words."""
    cuts = _cuts(words, longest).join(pieces.select("token", "score"), "token")
    packed = cuts.groupBy("word").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("a", "b", "score"))).alias("arcs"))
    flat = packed.select("word", "n", "arcs.a", "arcs.b", "arcs.score")

    def run(batches):
        for pdf in batches:
            yield per_word((word, weight, list(zip(*(x.tolist() for x in arcs)))) for word, weight, *arcs in zip(pdf["word"], pdf["n"], pdf["a"], pdf["b"], pdf["score"]))

    return flat.mapInPandas(run, out)


def _uses(words) -> pd.DataFrame:
    """(token, n): expected uses of pieces in words."""
    out: dict[str, float] = {}
    for word, weight, arcs in words:
        for (a, b, _), p in zip(arcs, _expected(len(word), arcs)):
            if p > 1e-9:
                out[word[a:b]] = out.get(word[a:b], 0.0) + weight * p
    return pd.DataFrame({"token": list(out), "n": list(out.values())}, columns=["token", "n"])


def _by_part(words: DataFrame, pieces: DataFrame, longest: int, run: Callable[[pa.Table, _Numbers, np.ndarray], pa.Table], out: str) -> DataFrame | None:
    """``run`` over parts of the words (word, n), each with the pieces (token, score) that occur in it: their hashes, and scores in
    the order of these. No task holds more than a part of ``PART`` letters, about, however many pieces there are. None if two
    pieces have one hash."""
    hashed = _staged(_hashed(pieces.select("token", "score")).select("h", "score"), "hashes")
    if hashed.count() != hashed.select("h").distinct().count():
        return None
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    parted = words.select("word", F.col("n").cast("double").alias("n"), F.pmod(F.xxhash64("word"), F.lit(letters // PART + 1)).cast("int").alias("part"))

    def parts_of(part: pa.Table) -> pa.Table:
        h = [np.unique(np.concatenate([x.ravel() for x in _hashes(letters, longest)])) for _, letters in _even(part.column("word").combine_chunks())]
        h = np.unique(np.concatenate(h)) if h else np.zeros(0, np.uint64)
        return pa.table({"part": pa.array(np.full(len(h), part.column("part")[0].as_py()), pa.int32()), "h": h.view(np.int64)})

    def with_pieces(part: pa.Table, held: pa.Table) -> pa.Table:
        h = held.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        return run(part, _Numbers(h[order]), held.column("score").to_numpy()[order])

    held = parted.groupBy("part").applyInArrow(parts_of, "part int, h bigint").join(hashed, "h")
    return parted.groupBy("part").cogroup(held.groupBy("part")).applyInArrow(with_pieces, out)


def _estimate(words: DataFrame, pieces: DataFrame, longest: int, held: int) -> DataFrame:
    """(token, n): expected uses of ``pieces`` (token, score) over weighted words. Up to ``held`` pieces are held by tasks, by
    their hashes; of more, each part of the words has its own (:func:`_by_part`). Pieces of one hash are joined to the
    substrings. All give the same rows."""
    table = _held(pieces, held)

    def summed(numbers: _Numbers, uses: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(uses)
        for k in range(0, len(some), 1 << 18):
            part = some[k : k + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers.keys[part].view(np.int64)), pa.array(uses[part])], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, score = table.value
        numbers, uses = _Numbers(keys), np.zeros(len(keys))
        for batch in batches:
            _add_uses(batch.column(0), batch.column(1).to_numpy(), longest, numbers, score, uses)
        yield from summed(numbers, uses)

    def of_part(part: pa.Table, numbers: _Numbers, score: np.ndarray) -> pa.Table:
        uses = np.zeros(len(score))
        _add_uses(part.column("word").combine_chunks(), part.column("n").to_numpy(), longest, numbers, score, uses)
        return pa.Table.from_batches(summed(numbers, uses), pa.schema([("h", pa.int64()), ("n", pa.float64())]))

    sums = words.select("word", "n").mapInArrow(run, "h bigint, n double") if table is not None else _by_part(words, pieces, longest, of_part, "h bigint, n double")
    if sums is None:
        return _joined(words, pieces, longest, _uses, "token string, n double").groupBy("token").agg(F.sum("n").alias("n"))
    return sums.groupBy("h").agg(F.sum("n").alias("n")).join(_hashed(pieces.select("token")), "h").select("token", "n")


def _without(n: int, arcs: list[tuple[int, int, float]]) -> float:
    """The score of the best way from 0 to ``n`` by arcs sorted by start, but for the one that goes all the way."""
    best = [0.0] + [-math.inf] * n
    for a, b, s in arcs:
        if b - a < n and best[a] + s > best[b]:
            best[b] = best[a] + s
    return best[n]


def _lost(words) -> pd.DataFrame:
    """(token, n, loss) of pieces, as words whose weight is their number of uses."""
    out = []
    for word, weight, arcs in words:
        own = next((s for a, b, s in arcs if b - a == len(word)), None)
        if own is not None:
            out.append((word, weight, weight * (own - _without(len(word), arcs))))
    return pd.DataFrame(out, columns=["token", "n", "loss"])


def losses(pieces: DataFrame, scored: DataFrame, longest: int, held: int = MAX_HELD) -> DataFrame:
    """(token, n, loss): what the likelihood loses if one of ``pieces`` (token, n) goes and its ``n`` uses are written in the best
    other way by pieces of ``scored`` (token, score). It is nought or less where another way is as good."""
    words = pieces.select(F.col("token").alias("word"), "n")
    table = _held(scored, held)
    out = "token string, n double, loss double"

    def lost(words: pa.Array, n: np.ndarray, numbers: _Numbers, score: np.ndarray) -> pa.RecordBatch:
        loss = _losses_of(words, n, longest, numbers, score)
        return pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(loss)], names=["token", "n", "loss"]).filter(pa.array(~np.isnan(loss)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, score = table.value
        numbers = _Numbers(keys)
        for batch in batches:
            yield lost(batch.column(0), batch.column(1).to_numpy(), numbers, score)

    def of_part(part: pa.Table, numbers: _Numbers, score: np.ndarray) -> pa.Table:
        return pa.Table.from_batches([lost(part.column("word").combine_chunks(), part.column("n").to_numpy(), numbers, score)])

    if table is not None:
        return words.mapInArrow(run, out)
    found = _by_part(words, scored, longest, of_part, out)
    return _joined(words, scored, longest, _lost, out) if found is None else found


def _substrings(words: DataFrame, longest: int) -> DataFrame:
    """(token, n): every substring of up to ``longest`` characters that occurs twice or more, and every letter, with the number
    of its occurrences. All ends of words are sorted, and equal beginnings stand together; what a batch may share with its
    neighbours goes out whatever its number."""
    starts = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("a"))
    ends = starts.select(F.substring(F.col("word"), F.col("a"), F.lit(longest)).alias("s"), F.col("n").cast("long").alias("n")).orderBy("s")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, n = batch.column(0), batch.column(1).to_numpy()
            ends = s.to_pylist()
            size = np.array([len(x) for x in ends], np.int64)
            letters = np.zeros((len(ends), longest), np.uint32)
            letters[np.arange(longest) < size[:, None]] = np.frombuffer("".join(ends).encode("utf-32-le"), np.uint32) + np.uint32(1)
            same = np.logical_and.accumulate((letters[1:] == letters[:-1]) & (letters[1:] > 0), axis=1).sum(1)
            shared = np.concatenate([[0], same])
            for k in range(1, min(longest, int(size.max())) + 1):
                first = np.flatnonzero((size >= k) & (shared < k))
                total = np.add.reduceat(np.where(size >= k, n, 0), first)
                out = (total > 1) | (k == 1)
                out[[0, -1]] = True
                tokens = pc.utf8_slice_codeunits(s.take(pa.array(first[out])), 0, k)
                yield pa.RecordBatch.from_arrays([tokens, pa.array(total[out])], names=["token", "n"])

    summed = ends.mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").cast("double").alias("n"))
    return summed.where((F.col("n") > 1) | (F.length("token") == 1))


def _cuts(words: DataFrame, longest: int) -> DataFrame:
    """(word, n, a, b, token): the substrings of up to ``longest`` characters."""
    starts = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("a"))
    stops = F.sequence(F.col("a") + 1, F.least(F.length("word"), F.col("a") + longest))
    return starts.select("word", "n", "a", F.explode(stops).alias("b")).withColumn("token", F.substring(F.col("word"), F.col("a") + 1, F.col("b") - F.col("a")))


def _dearest(pieces: DataFrame, least: int, size: int) -> DataFrame:
    """The pieces whose ``loss`` is greatest: at least ``least`` of them and all that cost as much as these, on a scale of 64
    steps to an octave that is counted as a whole; all but those that cost least, where these would make it all; exactly
    ``size`` where that many are wanted or the scale tells nothing apart."""
    if least > size:
        step = pieces.withColumn("_step", F.floor(F.log2(F.greatest("loss", F.lit(1e-9))) * 64))
        kept, cut, before = 0, None, None
        counts = step.groupBy("_step").agg(F.count("*").alias("n")).orderBy(F.desc("_step")).collect()
        for r in counts:
            kept, cut, before = kept + r["n"], r["_step"], cut
            if kept >= least:
                break
        if kept == sum(r["n"] for r in counts) and kept - r["n"] >= size:
            kept, cut = kept - r["n"], before
        if kept < sum(r["n"] for r in counts):
            return step.where(F.col("_step") >= cut).drop("_step")
    return pieces.orderBy(F.desc(F.round("loss", 6)), "token").limit(size)


def train_unigram(
    words: DataFrame, size: int, *, longest: int = 16, rounds: int = 2, keep: float = 0.5, specials: tuple[str, ...] = (), user: tuple[str, ...] = (), coverage: float = 1.0, held: int = MAX_HELD
) -> DataFrame:
    """(token, score): ``size`` pieces of a unigram model and their log-probabilities, all letters and ``specials`` (score 0)
    among them; fewer if the words have fewer, more only if there are more letters. ``words``: (word, n), distinct; empty ones
    do not count.

    Seeds are the letters and every substring of up to ``longest`` characters that occurs twice or more; none is left out
    for its number. A round estimates expected uses over the distinct words ``rounds`` times and then drops the pieces that the
    likelihood misses least (:func:`losses`), keeping ``keep`` of them, until ``size`` are left. ``user`` symbols are pieces of
    their own (score 0) at which words are cut; so are letters beyond the most frequent ones that make up ``coverage``, which
    are no pieces. Pieces are a written table; what comes to the driver is a histogram of
    their frequencies, and what tasks hold is at most ``held`` pieces, or those of a part of the words.
    """
    words = words.where("word != ''").select("word", "n")
    if user:
        parts = F.split("word", "|".join(map(re.escape, sorted(user, key=len, reverse=True))))
        words = words.select(F.explode(parts).alias("word"), "n").where("word != ''").groupBy("word").agg(F.sum("n").alias("n"))
    words = _dealt(covered(words, coverage))
    specials = (*specials, *(u for u in user if u not in specials))
    tall = F.length("token") > 1
    freq = _staged(_substrings(words, longest), "pieces")
    letters = freq.where(~tall).select("token")
    n_letters = letters.count()
    wanted = max(size - len(specials) - n_letters, 0)

    def scored(f: DataFrame) -> DataFrame:
        total = f.agg(F.sum("n").alias("_total")).first()["_total"] or 1.0
        return f.select("token", F.log(F.greatest("n", F.lit(1e-3)) / total).alias("score"))

    while True:
        for _ in range(rounds):
            new = _estimate(words, scored(freq), longest, held).select("token", F.round("n", 6).alias("n")).where("n > 0")
            more = letters.join(new, "token", "left_anti").withColumn("n", F.lit(1e-3))
            freq = _staged(new.unionByName(more), "pieces")
        n_others = freq.where(tall).count()
        if n_others <= wanted:
            break
        least = int(keep * n_others)
        others = _staged(losses(freq.where(tall), scored(freq), longest, held), "losses")
        freq = _staged(freq.where(~tall).unionByName(_dearest(others, least, wanted).select("token", "n")), "pieces")
        if least <= wanted:
            break
    head = words.sparkSession.createDataFrame([(s, 0.0) for s in specials], "token string, score double")
    return head.unionByName(scored(freq))
