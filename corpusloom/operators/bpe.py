"""Learning of byte-pair merges in the exact order of one merge a round, with few passes.

The state is a written table of the distinct words as they are after the merges so far: numbers of symbols, and how often the
word occurs. A round

1. counts all pairs of neighbouring symbols and takes those of the ``k`` most frequent ones that are more frequent than the
   next one, the floor,
2. cuts out the stretches that such pairs cover in words; equal stretches are counted together,
3. merges the stretches on the driver, best pair first, for as long as a pair is more frequent than the floor,
4. applies the merges to the words, all words of a batch at once, and writes them; words of one symbol go.

What stands around a stretch need not be known. A pair that merges make across its edge is there at most as often as the pair
that stood at this edge before, which is not above the floor, or the stretch would have gone on. So distinct stretches are few,
and many pairs fit a round. Only where the ``k`` best pairs and the next one are equally frequent, the order of the symbols
decides, and there stretches have a symbol on both sides and merges end where a pair that is not known in full may come first.

So a round is three passes over words that get shorter and fewer, whatever the number of its merges, and merges that follow
from each other, or that lie side by side, need no round of their own. The driver sees at most ``k + 1`` pairs and
``most_stretches`` stretches, whatever the corpus; ``k`` grows and shrinks with the number of stretches. Where even those of
one pair are too many, that pair is merged alone.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.sinks import scratch

Pair = tuple[str, str]
Merge = tuple[str, str, int]
#: Pairs of a round at most.
MOST_PAIRS = 1 << 16
#: Symbols that are counted at once, about.
SYMBOLS = 1 << 20
#: A letter's number is its code point, that of a merged symbol comes after all of these. What stands for the rest of a word.
FIRST, REST = 0x110000, -1


def merged(symbols: list, a: str, b: str) -> list:
    """The symbols with every ``a`` before a ``b`` merged with it, from the left."""
    out, at = [], 0
    while at < len(symbols):
        both = at + 1 < len(symbols) and symbols[at] == a and symbols[at + 1] == b
        out.append(a + b if both else symbols[at])
        at += 1 + both
    return out


def stretches(s: list[str], pairs: set[Pair], around: bool = True) -> Iterator[list[str | None]]:
    """What the pairs cover in a word; with ``around`` a symbol on both sides, too, and None where the word goes on. Stretches
    that would share a symbol are one."""
    hits = [i for i in range(len(s) - 1) if (s[i], s[i + 1]) in pairs]
    if not around:
        yield from (s[run[0] : run[-1] + 2] for run in _runs(hits))
        return
    spans: list[list[int]] = []
    for i in hits:
        start, stop = max(0, i - 1), min(len(s), i + 3)
        if spans and start < spans[-1][1]:
            spans[-1][1] = stop
        else:
            spans.append([start, stop])
    for start, stop in spans:
        yield [None] * (start > 0) + s[start:stop] + [None] * (stop < len(s))


def _runs(hits: list[int]) -> Iterator[list[int]]:
    """Numbers that follow each other, together."""
    for i, h in enumerate(hits):
        if not i or hits[i - 1] != h - 1:
            run = [h]
        else:
            run.append(h)
        if i + 1 == len(hits) or hits[i + 1] != h + 1:
            yield run


class _Stretches:
    """Counts of the pairs that are known in full: the given ones and those with a symbol that was made since.

    A made symbol beside a None is in a pair whose other symbol is not seen. ``hidden`` counts such places by (symbol, side);
    a pair with that symbol may have as many more, and some unseen pair may have all of them.
    """

    def __init__(self, rows: Iterable[tuple[list[str | None], int]], pairs: set[Pair]):
        self.rows = [(list(s), n) for s, n in rows]
        self.given, self.made = pairs, set()
        self.counts: Counter[Pair] = Counter()
        self.hidden: Counter[tuple[str, int]] = Counter()
        self.where: dict[Pair, set[int]] = defaultdict(set)
        self.beside: dict[tuple[str, int], set[Pair]] = defaultdict(set)
        for i in range(len(self.rows)):
            self._count(i, 1)
        self.queue = [(-n, p) for p, n in self.counts.items()]
        heapq.heapify(self.queue)
        #: Bounds of what is not known in full, none too low: (-bound, side or pair). Only bounds that rise are added.
        self.bounds: list[tuple[int, int, tuple]] = []

    def _count(self, i: int, sign: int) -> set[Pair]:
        """Adds a stretch to the counts, or takes it away; returns the pairs whose count that changes."""
        s, n = self.rows[i]
        changed = set()
        for p in zip(s, s[1:]):
            a, b = p
            if a is None or b is None:
                lone = (b, 0) if a is None else (a, 1)
                if lone[0] in self.made:
                    self.hidden[lone] += sign * n
                continue
            self.where[p].add(i)
            if p in self.given or a in self.made or b in self.made:
                self.counts[p] += sign * n
                changed.add(p)
                self.beside[b, 0].add(p)
                self.beside[a, 1].add(p)
        return changed

    def _bound(self, is_pair: int, x: tuple) -> int:
        """What a pair beside hidden places, or an unseen one at them, can have at most."""
        if not is_pair:
            return self.hidden[x]
        more = self.hidden[x[1], 0] + self.hidden[x[0], 1]
        return self.counts[x] + more if more else 0

    def _rises(self, is_pair: int, x: tuple) -> None:
        bound = self._bound(is_pair, x)
        if bound > 0:
            heapq.heappush(self.bounds, (-bound, is_pair, x))

    def unsure(self) -> int:
        """No pair that is not known in full is more frequent than this."""
        while self.bounds:
            n, is_pair, x = self.bounds[0]
            now = self._bound(is_pair, x)
            if now == -n:
                return now
            heapq.heappop(self.bounds)
            if now > 0:
                heapq.heappush(self.bounds, (-now, is_pair, x))
        return 0

    def best(self, floor: tuple[int, Pair] | None) -> Merge | None:
        """The next merge, if it is certain: it comes before ``floor`` and before every pair that is not known in full."""
        while self.queue:
            n, p = -self.queue[0][0], self.queue[0][1]
            if self.counts[p] == n:
                certain = n > 1 and (floor is None or (-n, p) < floor) and n > self.unsure()
                return (*p, n) if certain else None
            heapq.heappop(self.queue)
        return None

    def merge(self, a: str, b: str) -> None:
        self.made.add(a + b)
        changed: set[Pair] = set()
        before = {side: self.hidden[side] for i in self.where[a, b] for side in self._edges(i)}
        for i in self.where.pop((a, b)):
            s, n = self.rows[i]
            changed |= self._count(i, -1)
            self.rows[i] = (merged(s, a, b), n)
            changed |= self._count(i, 1)
            for side in self._edges(i):
                before.setdefault(side, 0)
        self.where.pop((a, b), None)
        for p in changed:
            if self.counts[p] > 0:
                heapq.heappush(self.queue, (-self.counts[p], p))
                self._rises(1, p)
            else:
                del self.counts[p]
                for side in ((p[1], 0), (p[0], 1)):
                    self.beside[side].discard(p)
        for side, n in before.items():
            if self.hidden[side] > n:
                self._rises(0, side)
                for p in self.beside[side]:
                    self._rises(1, p)

    def _edges(self, i: int) -> list[tuple[str, int]]:
        """The sides of a stretch at which the word goes on."""
        s = self.rows[i][0]
        front, back = [(s[1], 0)] if s[0] is None else [], [(s[-2], 1)] if s[-1] is None else []
        return front + back


def certain_merges(rows: Iterable[tuple[list[str | None], int]], pairs: set[Pair], floor: tuple[int, Pair] | None, most: int) -> list[Merge]:
    """The next merges of a corpus of which ``rows`` are the stretches of ``pairs``, its most frequent ones; ``floor`` is the
    key (-n, pair) of the next one. Stretches with nothing around them need a floor before all pairs of its frequency."""
    state, out = _Stretches(rows, pairs), []
    while len(out) < most:
        found = state.best(floor)
        if not found:
            break
        out.append(found)
        state.merge(*found[:2])
    return out


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of a batch of words in one array, the number of each word's symbols, and how often it occurs."""
    s = batch.column(0)
    return s.flatten().to_numpy(), np.diff(s.offsets.to_numpy()), batch.column(1).to_numpy()


def _packed(s: np.ndarray, size: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(s, pa.int32())), pa.array(n, pa.int64())], names=["s", "n"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`_flat` of several batches at once, of about ``SYMBOLS`` symbols: what is counted shrinks with it."""
    parts: list[tuple] = []
    for batch in batches:
        if batch.num_rows:
            parts.append(_flat(batch))
        if sum(len(s) for s, _, _ in parts) >= SYMBOLS:
            yield tuple(map(np.concatenate, zip(*parts)))
            parts = []
    if parts:
        yield tuple(map(np.concatenate, zip(*parts)))


def _keys(s: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pair that begins at each symbol as one number; -1 at the last symbol of a word."""
    keys = np.full(len(s), -1, np.int64)
    keys[:-1] = s[:-1].astype(np.int64) << 32 | s[1:]
    keys[np.cumsum(size) - 1] = -1
    return keys


def _places(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key is in ``sorted_keys``, or -1."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _in_order(merges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges (left, right, made) as sorted keys, their ranks, and what a rank makes. What is inside a symbol was merged as if it
    stood alone, so a symbol is made in one way and at one rank, and no pair is merged twice."""
    keys = np.array([a << 32 | b for a, b, _ in merges], np.int64)
    order = np.argsort(keys)
    return keys[order], order, np.array([ab for _, _, ab in merges], np.int32)


def _merged(s: np.ndarray, size: np.ndarray, n: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> list[tuple]:
    """Words (s, size, n) after these merges in their order, as several such groups of words. In a step every word makes the
    first merge that it holds, everywhere in it, and words that hold none are done."""
    done = []
    while len(size):
        at = _places(keys, _keys(s, size))
        rank = np.where(at < 0, len(made), ranks[at])
        least = np.minimum.reduceat(rank, np.cumsum(size) - size)
        going = least < len(made)
        if not going.all():
            symbols = np.repeat(going, size)
            done.append((s[~symbols], size[~going], n[~going]))
            s, rank, size, n, least = s[symbols], rank[symbols], size[going], n[going], least[going]
        if not len(size):
            break
        hit = rank == np.repeat(least, size)
        where = np.arange(len(s))
        begin = hit & ~np.r_[False, hit[:-1]]
        hit &= (where - np.maximum.accumulate(np.where(begin, where, 0))) % 2 == 0  # of overlapping places the first
        s = np.where(hit, np.repeat(made[least], size), s)
        stays = ~np.r_[False, hit[:-1]]
        word = np.repeat(np.arange(len(size)), size)
        s, size = s[stays], np.bincount(word[stays], minlength=len(size))
    return done


def _applied(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """Words (s, n) after the merges (left, right, made), but for those that are one symbol."""
    held = words.sparkSession.sparkContext.broadcast(_in_order(merges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for s, size, n in _merged(*_flat(batch), *held.value):
                several = size > 1
                if several.any():
                    yield _packed(s[np.repeat(several, size)], size[several], n[several])

    return words.mapInArrow(run, "s array<int>, n bigint")


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of ``n`` for each."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _pair_counts(words: DataFrame) -> DataFrame:
    """(p, n): pairs of neighbouring symbols that occur twice or more, as one number each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, size, n in _gathered(batches):
            keys = _keys(s, size)
            p, total = _summed(keys[keys >= 0], np.repeat(n, size)[keys >= 0])
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(total)], names=["p", "n"])

    return words.mapInArrow(count, "p bigint, n bigint").groupBy("p").agg(F.sum("n").alias("n")).where("n > 1")


def _named(counts: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, n): the pairs by what their symbols are; ``names`` of the merged ones."""
    held = counts.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_numpy()
            sides = ([_name(x, held.value) for x in side.tolist()] for side in (p >> 32, p & 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([*(pa.array(side, pa.string()) for side in sides), batch.column(1)], names=["a", "b", "n"])

    return counts.mapInArrow(run, "a string, b string, n bigint")


def _name(symbol: int, names: list[str]) -> str:
    return chr(symbol) if symbol < FIRST else names[symbol - FIRST]


def _cut(s: np.ndarray, start: np.ndarray, length: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(s, n): the parts of ``s``, equal ones together, a length at a time. They are compared by a hash, and then whole."""
    for k in np.unique(length):
        of = length == k
        rows, weight = s[start[of][:, None] + np.arange(k)], n[of]
        h = np.zeros(len(rows), np.uint64)
        for x in rows.T:
            h = (h ^ x.astype(np.uint32)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        _, first, at = np.unique(h, return_index=True, return_inverse=True)
        if (rows[first][at] == rows).all():
            total = np.zeros(len(first), np.int64)
            np.add.at(total, at, weight)
            rows, weight = rows[first], total
        yield _packed(rows.ravel(), np.full(len(rows), k), weight)


def _stretches_of(words: DataFrame, pairs: list[int], around: bool) -> DataFrame:
    """(s, n): the stretches (see :func:`stretches`) of words (s, n), equal ones together; ``REST`` stands for None."""
    held = words.sparkSession.sparkContext.broadcast(np.sort(np.array(pairs, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, size, n in _gathered(batches):
            hit = np.flatnonzero(_places(held.value, _keys(s, size)) >= 0)
            if not len(hit):
                continue
            end = np.cumsum(size)
            word = np.repeat(np.arange(len(size)), size)[hit]
            if not around:
                new = np.r_[True, hit[1:] != hit[:-1] + 1]
                start = hit[new]
                yield from _cut(s, start, hit[np.r_[new[1:], True]] + 2 - start, n[word[new]])
                continue
            start, stop = np.maximum(hit - 1, (end - size)[word]), np.minimum(hit + 3, end[word])
            new = np.r_[True, (word[1:] != word[:-1]) | (start[1:] >= stop[:-1])]
            start, stop, word = start[new], stop[np.r_[new[1:], True]], word[new]
            front, back = start > (end - size)[word], stop < end[word]
            length = stop - start + front + back
            first = np.cumsum(length) - length
            at = np.repeat(start - front - first, length) + np.arange(length.sum())
            out = s[np.clip(at, 0, len(s) - 1)]
            out[first[front]] = REST
            out[(first + length - 1)[back]] = REST
            yield from _cut(out, first, length, n[word])

    return words.mapInArrow(run, "s array<int>, n bigint").groupBy("s").agg(F.sum("n").alias("n"))


def covered(words: DataFrame, coverage: float) -> DataFrame:
    """The words (word, n) cut at letters that the most frequent letters, with ``coverage`` of all occurrences among them, leave
    out. What comes to the driver is one number for each letter of the script."""
    if coverage >= 1:
        return words
    letters = words.select(F.explode(F.split("word", "")).alias("c"), "n").where("c != ''").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").collect()
    total, seen, rare = sum(r["n"] for r in letters), 0, []
    for r in letters:
        if seen >= coverage * total:
            rare.append(r["c"])
        seen += r["n"]
    if not rare:
        return words
    parts = words.select(F.explode(F.split("word", "[" + "".join(map(re.escape, rare)) + "]")).alias("word"), "n").where("word != ''")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def train_bpe(words: DataFrame, merges: int, *, coverage: float = 1.0, batch: int = 64, most_stretches: int = 50_000) -> DataFrame:
    """(rank, left, right, n): merges of neighbouring pairs in order of their frequency, ties by symbols, as if one were made a
    round; no pair that occurs once. ``words``: (word, n), distinct; null and empty ones don't count. ``batch``: with how many
    pairs the first round begins."""
    spark = words.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    letters = covered(words.where("length(word) > 1").select("word", F.col("n").cast("long").alias("n")), coverage).repartition(parts)
    state = _staged(letters.mapInArrow(_letters, "s array<int>, n bigint"))
    out: list[Merge] = []
    names: list[str] = []  # a merged symbol is what it spells, whatever it was merged from
    number: dict[str, int] = {}
    of = lambda x: number[x] if x in number else ord(x)
    spelt = lambda p: (_name(p >> 32, names), _name(p & 0xFFFFFFFF, names))
    k = batch
    while len(out) < merges:
        counts = _pair_counts(state)
        rows = [(r["n"], r["p"]) for r in counts.orderBy(F.desc("n")).limit(k + 1).collect()]
        if not rows:
            break
        equal = None  # the best pairs by name, where more than ``k`` of them are equally frequent
        while True:
            least = rows[k][0] if len(rows) > k else 1
            wanted = [p for n, p in rows[:k] if n > least]
            floor = (-least, ("", ""))
            around = not wanted
            if around:
                equal = equal or [((r["a"], r["b"]), r["n"]) for r in _named(counts, names).orderBy(F.desc("n"), "a", "b").limit(k + 1).collect()]
                wanted = [of(a) << 32 | of(b) for (a, b), _ in equal[:k]]
                floor = (-equal[k][1], equal[k][0])
            found = _stretches_of(state, wanted, around).limit(most_stretches + 1).collect()
            if len(found) <= most_stretches or k == 1:
                break
            k = max(1, k // 2)
        new: list[Merge] = []
        if len(found) <= most_stretches:
            in_words = (([None if x == REST else _name(x, names) for x in r["s"]], r["n"]) for r in found)
            new = certain_merges(in_words, set(map(spelt, wanted)), floor, merges - len(out))
        new = new or [(*spelt(wanted[0]), rows[0][0])]  # the best pair is always certain
        made = []
        for a, b, _ in new:
            if a + b not in number:
                number[a + b] = FIRST + len(names)
                names.append(a + b)
            made.append((of(a), of(b), number[a + b]))
        out += new
        if len(out) < merges:
            state = _staged(_applied(state, made))
        if 2 * len(found) <= most_stretches:
            k = min((8 if 16 * len(found) <= most_stretches else 2) * k, MOST_PAIRS)
    return spark.createDataFrame([(r, *m) for r, m in enumerate(out)], "rank int, left string, right string, n bigint")


def _staged(rows: DataFrame) -> DataFrame:
    path = scratch(rows.sparkSession, "symbols")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, n): the code points of words (word, n) of two letters or more."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        size = np.array([len(w) for w in words], np.int64)
        if len(words):
            yield _packed(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int32), size, batch.column(1).to_numpy())
