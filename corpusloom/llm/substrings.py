"""Removal of repeated passages by fixed-block anchors.

A window is a run of ``window`` words of one document. Of any window at least one block of ``window // 2`` words lies at a
multiple of that length in its document, so it is enough to index these non-overlapping blocks and to probe the index with
every rolling run of that length: two documents share a window only if both have, inside it, a run that is an indexed block
of the other. Hits are extended to all windows around them; the windows that are repeats are then told exactly by the
smallest document that has the same words, and maximal runs of them are cut.

Documents are dealt into segments by a hash, keys of runs and windows into parts. What travels from a segment to the parts are
compact sorted blocks of hashes, in which a hash occurs once however many documents hold it; back go the hits, by segment. A
segment sends at most ``ROUTES`` blocks, however many parts there are: where there are more, a route's blocks are read as a
stream, gathered up to ``SPLIT`` hashes at a time, and passed on by part. So messages grow with the input, not with the product
of segments and parts. Three passes read the segments; they share one shuffle of the texts.

Windows are the same if two independent 64-bit hashes of their words are (for 10^12 repeated windows the chance of any error
is below 10^-14); hashes of runs only find candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Bytes of text in a segment, about, and rolling runs in a part of the index, about.
SEGMENT_BYTES, PART_RUNS = 4_000_000, 2_000_000
#: Blocks that a segment sends at most, and hashes gathered by a route at once.
ROUTES, SPLIT = 512, 4_000_000
MULT = np.uint64(0x9E3779B97F4A7C15)
MULT2 = np.uint64(0xD6E8FEB86659FD93)
#: Hashes on their way to a part: keys, and by kind of block what else is known of each. ``seg`` is -1 where it is in ``segs``.
OUT = "part int, seg int, kind int, keys binary, other binary, docs binary, segs binary"
#: Hashes on their way back to a segment.
BACK = "seg int, kind int, keys binary, other binary"
BLOCKS, RUNS, HITS, WINDOWS, LATER = range(5)


def _pack(x: np.ndarray) -> bytes:
    """A sorted array of unsigned numbers: differences, byte planes, zstd."""
    d = np.diff(x, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _rolling(w: np.ndarray, size: int, mult: np.uint64) -> np.ndarray:
    """Polynomials of each run of ``size`` words of one segment; runs over a document's end are cut out by the caller."""
    if len(w) < size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        out *= mult
        out += w[k : k + len(out)]
    return out


class _Segment:
    """The words of a segment's documents, as hashes in one array."""

    def __init__(self, table: pa.Table, window: int):
        self.window, self.block = window, window // 2
        self.rows = table
        self.doc = table.column("doc").to_numpy(zero_copy_only=False)  # floats if an id is null
        self.words = [(t.as_py() or "").encode().split() for t in table.column("text")]
        known = np.array([d.is_valid for d in table.column("doc")], bool)
        # shorter documents and those without an id take no part in matching
        self.length = np.array([len(w) if k and len(w) >= window else 0 for w, k in zip(self.words, known)], np.int64)
        self.doc = np.where(known, table.column("doc").fill_null(0).to_numpy(), 0).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.hash = np.fromiter((_first(x) for w, n in zip(self.words, self.length) if n for x in w), np.uint64, int(self.length.sum()))
        self.owner = np.repeat(np.arange(len(self.length)), self.length)
        self.place = np.arange(len(self.hash)) - np.repeat(self.start, self.length)
        self.left = np.repeat(self.length, self.length) - self.place  # words from here to the document's end

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rolling runs of a block's length: mixed hash, and where they are whole."""
        h = _mix(_rolling(self.hash, self.block, MULT))
        return h, self.left[: len(h)] >= self.block

    def windows(self, where: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows that start at ``where``."""
        second = np.zeros(len(self.hash), np.uint64)
        for d in np.unique(self.owner[where]):
            a, n = self.start[d], self.length[d]
            second[a : a + n] = np.fromiter((_second(x) for x in self.words[d]), np.uint64, n)
        out = []
        for word, mult in ((self.hash, MULT), (second, MULT2)):
            h = np.zeros(len(where), np.uint64)
            for k in range(self.window):
                h *= mult
                h += word[where + k]
            out.append(_mix(h))
        return out[0] >> np.uint64(64 - bits), out[1]

    def candidates(self, keys: np.ndarray, parts: int) -> np.ndarray:
        """Starts of the windows that hold a run whose key is in the sorted ``keys``."""
        h, whole = self.runs()
        if not len(keys) or not len(h):
            return np.empty(0, np.int64)
        k = _key(h, parts)
        hit = whole & (keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k)
        total = np.r_[0, np.cumsum(hit)]
        at = np.flatnonzero(self.left >= self.window)
        return at[total[at + self.window - self.block + 1] > total[at]]


def _first(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _second(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, 1)


def _key(h: np.ndarray, parts: int) -> np.ndarray:
    """40 bits of a run's hash, and its part in the low bits."""
    return ((h >> np.uint64(24)) << np.uint64(24)) | (h & np.uint64(parts - 1))


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    types = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array(c, types[t]) for (n, t), c in zip(fields, zip(*rows) if rows else [()] * len(fields))})


def _numbers(x: np.ndarray) -> bytes:
    """Numbers in any order: differences from the least, byte planes, zstd."""
    base = x.min() if len(x) else np.int64(0)
    gap = (x - base).astype(np.uint64)
    return np.int64(base).tobytes() + zstandard.compress(np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _read_numbers(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b[8:]), np.uint8).reshape(8, -1)
    return np.frombuffer(b[:8], np.int64)[0] + np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64).astype(np.int64)


class _Hashes:
    """Hashes of one kind on their way: key, second hash, document and segment of each, as far as the kind has them."""

    def __init__(self, keys, other=None, docs=None, segs=None):
        self.columns = (keys, other, docs, segs)

    def take(self, at: np.ndarray) -> _Hashes:
        return _Hashes(*(None if c is None else c[at] for c in self.columns))

    def by(self, label: np.ndarray) -> Iterator[tuple[int, _Hashes]]:
        """The hashes of each label, sorted by key."""
        order = np.lexsort((self.columns[0], label))
        label = label[order]
        for at in np.split(order, np.flatnonzero(label[1:] != label[:-1]) + 1) if len(order) else ():
            got = self.take(at)
            yield at[0], got

    def out(self, part: int, seg: int, kind: int) -> tuple:
        keys, other, docs, segs = self.columns
        return (part, seg, kind, _pack(keys), None if other is None else other.tobytes(), None if docs is None else _numbers(docs), None if seg >= 0 else _numbers(segs))

    def back(self, seg: int, kind: int) -> tuple:
        keys, other, _, _ = self.columns
        return (seg, kind, _pack(keys), None if other is None else other.tobytes())

    @staticmethod
    def read(rows: list[dict]) -> _Hashes:
        """All hashes of some messages of one kind."""
        keys = [_unpack(r["keys"]) for r in rows]
        other = [np.frombuffer(r["other"], np.uint64) for r in rows if r["other"] is not None]
        docs = [_read_numbers(r["docs"]) for r in rows if r.get("docs") is not None]
        segs = [_read_numbers(r["segs"]) if r.get("segs") is not None else np.full(len(k), r["seg"], np.int64) for r, k in zip(rows, keys)]
        whole = lambda x, t=np.uint64: np.concatenate(x) if x else np.empty(0, t)
        return _Hashes(whole(keys), whole(other) if other or not rows else None, whole(docs, np.int64) if docs or not rows else None, whole(segs, np.int64))


def _sent(hashes: _Hashes, seg: int, kind: int, parts: int, routes: int, where: int) -> list[tuple]:
    """A segment's messages, one for each route that gets any. ``where``: the column whose low bits tell the part."""
    route = (hashes.columns[where] & np.uint64(min(parts, routes) - 1)).astype(np.int64)
    return [got.out(int(route[k]), seg, kind) for k, got in hashes.by(route)]


def _split(parts: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages by route, passed on by part."""
    held: dict[int, list[dict]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = []
        for kind, messages in held.items():
            hashes = _Hashes.read(messages)
            part = (hashes.columns[1 if kind == WINDOWS else 0] & np.uint64(parts - 1)).astype(np.int64)
            rows += [got.out(int(part[k]), -1, kind) for k, got in hashes.by(part)]
        held.clear()
        return _table(OUT, rows).combine_chunks().to_batches()

    for b in batches:
        for r in b.to_pylist():
            held.setdefault(r["kind"], []).append(r)
            size += len(r["keys"]) // 3
            if size >= most:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def _dealt(messages: DataFrame, parts: int, routes: int, split: int) -> GroupedData:
    """Messages grouped by their part."""
    if parts > routes:
        messages = messages.repartition("part").mapInArrow(partial(_split, parts, split), OUT)
    return messages.groupBy("part")


def _power(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def two_of_each(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key with its least and its greatest document only (one, if it stands once)."""
    order = np.lexsort((docs, keys))
    if not len(order):
        return keys, docs
    ends = np.flatnonzero(np.diff(keys[order]))
    two = order[np.unique(np.r_[0, ends, ends + 1, len(order) - 1])]
    return keys[two], docs[two]


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 50, least_parts: int = 64, routes: int = ROUTES, split: int = SPLIT, bits: int = 64) -> DataFrame:
    """(key, n_words, n_removed, kept): the words of each document without those covered by a window whose words also start
    in a document with a smaller key; ``kept`` has them joined by one space. Windows are judged on the input.

    Words are runs of characters other than space and U+0009 to U+000D, unchanged. Null and empty texts have no words. A
    row with a null key loses nothing and makes no other row lose anything; rows of equal key don't count as each other's
    earlier document. Keys are whole numbers. ``window`` is even, ``least_parts`` and ``routes`` are powers of two, and ``bits`` of the
    windows' first hash are used. Empty tables give empty results; other columns are not read.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be a column of whole numbers, as they tell which document is earlier")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    segments = max(least_parts, int(size // SEGMENT_BYTES) + 1)
    parts = _power(max(least_parts, size / 6 / PART_RUNS))
    seg = F.pmod(F.xxhash64(docs[key], docs[text]), F.lit(segments)).cast("int")
    rows = docs.select(seg.alias("seg"), docs[key].cast("long").alias("doc"), docs[text].alias("text"))

    def index(key: tuple, group: pa.Table) -> pa.Table:
        """Blocks, each with the least and the greatest document of the segment that has it, and rolling runs: whether a
        block has several documents shows from these two."""
        seg, s = key[0].as_py(), _Segment(group, window)
        h, whole = s.runs()
        k = _key(h, parts)
        fixed = np.flatnonzero(whole & (s.place[: len(h)] % s.block == 0))
        rolling = np.unique(k[whole & (s.place[: len(h)] % s.block != 0)])
        blocks, doc = two_of_each(k[fixed], s.doc[s.owner[fixed]])
        return _table(OUT, _sent(_Hashes(blocks, None, doc), seg, BLOCKS, parts, routes, 0) + _sent(_Hashes(rolling), seg, RUNS, parts, routes, 0))

    def read(group: pa.Table, kind: int) -> _Hashes:
        return _Hashes.read([r for r in group.to_pylist() if r["kind"] == kind])

    def probe(group: pa.Table) -> pa.Table:
        """Keys of each segment's runs that are blocks of some other document (or of the same one, elsewhere)."""
        keys, _, doc, seg = read(group, BLOCKS).columns
        if not len(keys):
            return _table(BACK, [])
        order = np.argsort(keys, kind="stable")
        sorted_keys, doc = keys[order], doc[order]
        first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
        known, shared = sorted_keys[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        runs, _, _, run_seg = read(group, RUNS).columns
        found = lambda x: np.minimum(np.searchsorted(known, x), len(known) - 1)
        own, hit = shared[found(keys)], known[found(runs)] == runs
        keys, seg = np.concatenate([keys[own], runs[hit]]), np.concatenate([seg[own], run_seg[hit]])
        return _table(BACK, [_Hashes(np.unique(got.columns[0])).back(int(seg[k]), HITS) for k, got in _Hashes(keys).by(seg)])

    def extend(key: tuple, group: pa.Table, hits: pa.Table) -> pa.Table:
        """All windows around hits, each with the smallest document of the segment that has it."""
        if not group.num_rows:
            return _table(OUT, [])
        seg, s = key[0].as_py(), _Segment(group, window)
        at = s.candidates(np.unique(read(hits, HITS).columns[0]), parts)
        h, other = s.windows(at, bits)
        doc = s.doc[s.owner[at]]
        order = np.lexsort((doc, other, h))
        h, other, doc = h[order], other[order], doc[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (other[1:] != other[:-1])]) if len(h) else order
        return _table(OUT, _sent(_Hashes(h, other, doc).take(first), seg, WINDOWS, parts, routes, 1))

    def judge(group: pa.Table) -> pa.Table:
        """For each segment the windows that start in a smaller document of another segment."""
        windows = read(group, WINDOWS)
        h, other, doc, seg = windows.columns
        order = np.lexsort((other, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])]
        least = np.empty(len(h), np.int64)
        least[order] = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        later = np.flatnonzero(least < doc)
        return _table(BACK, [got.back(int(seg[later[k]]), LATER) for k, got in windows.take(later).by(seg[later])])

    def cut(key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
        """The words that are left. A window is a repeat if a smaller document of another segment has it, or one of this."""
        if not group.num_rows:
            return pa.table({"doc": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        s = _Segment(group, window)
        at = s.candidates(np.unique(read(found, HITS).columns[0]), parts)
        covered = np.zeros(len(s.hash) + 1, np.int64)
        if len(at):
            h, other = s.windows(at, bits)
            far, far_other, _, _ = read(found, LATER).columns
            doc = s.doc[s.owner[at]]
            # the windows of this segment, and those that a smaller document elsewhere has as the smallest of all
            every = np.concatenate([h, far])
            order = np.lexsort((np.concatenate([other, far_other]), every))
            a, b = every[order], np.concatenate([other, far_other])[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            least = np.minimum.reduceat(np.concatenate([doc, np.full(len(far), np.iinfo(np.int64).min)])[order], np.flatnonzero(new))
            least_of = np.empty(len(every), np.int64)
            least_of[order] = least[np.cumsum(new) - 1]
            repeat = least_of[: len(h)] < doc
            np.add.at(covered, at[repeat], 1)
            np.add.at(covered, at[repeat] + window, -1)
        gone = np.cumsum(covered[:-1]) > 0
        removed, kept = np.zeros(len(s.words), np.int64), []
        for k, (w, n, a) in enumerate(zip(s.words, s.length, s.start)):
            mark = gone[a : a + n]
            removed[k] = mark.sum()
            kept.append(b" ".join([x for x, g in zip(w, mark.tolist()) if not g] if removed[k] else w))
        return pa.table({"doc": group.column("doc"), "n_words": pa.array([len(w) for w in s.words], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array([x.decode() for x in kept], pa.string())})

    by_seg = rows.groupBy("seg")
    hits = _dealt(by_seg.applyInArrow(index, OUT), parts, routes, split).applyInArrow(probe, BACK)
    later = _dealt(by_seg.cogroup(hits.groupBy("seg")).applyInArrow(extend, OUT), parts, routes, split).applyInArrow(judge, BACK)
    out = by_seg.cogroup(hits.unionAll(later).groupBy("seg")).applyInArrow(cut, "doc bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.col("doc").cast(docs.schema[key].dataType).alias(key), "n_words", "n_removed", "kept")
