"""Alignment of two segmentations that lie in one row, as arrays: the rules of ``align`` without its rows.

A row is done where it is read. Functions work on the flat arrays of an Arrow batch, in a pass or a binary search over all of its
rows at once, so nothing is exploded before its result, and nothing is sorted or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of ``(?U)\s``, by code point; all others count as the last entry.
_WHITE = np.zeros(0x3002, bool)
_WHITE[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


#: Rows of a batch that are done at a time, which bounds the flat arrays.
ROWS = 500


def by_rows(run: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """``run`` of ``ROWS`` rows at a time, for functions that do each row alone."""

    @wraps(run)
    def apply(*arrays: pa.Array) -> pa.Array:
        if len(arrays[0]) <= ROWS:
            return run(*arrays)
        return pa.concat_arrays([run(*(a.slice(i, ROWS) for a in arrays)) for i in range(0, len(arrays[0]), ROWS)])

    return apply


def sizes_of(x: pa.Array) -> np.ndarray:
    """Sizes of the lists, 0 for a null."""
    return np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64)


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets_of(sizes).astype(np.int32)), values)


def ints(values: np.ndarray, ok: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.astype(np.int32), pa.int32(), mask=None if ok is None else ~ok)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` of each i, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def _lengths(x: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.utf8_length(x.flatten()), 0)).astype(np.int64)


def _starts(sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each piece begins in its row."""
    before = offsets_of(lengths)
    return before[:-1] - np.repeat(before[offsets_of(sizes)[:-1]], sizes)


def _holder(sizes: np.ndarray, points: np.ndarray, outer_sizes: np.ndarray, outer_starts: np.ndarray) -> np.ndarray:
    """For each point the number, in its row, of the last unit that starts there or before; -1 where there is none."""
    n = len(sizes)
    row, outer_row = np.repeat(np.arange(n), sizes), np.repeat(np.arange(n), outer_sizes)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, row, points)
    np.maximum.at(most, outer_row, outer_starts)
    place = offsets_of(most + 1)[:-1]
    at = np.searchsorted(outer_starts + place[outer_row], np.maximum(points, 0) + place[row], "right") - 1 - offsets_of(outer_sizes)[row]
    return np.where(points < 0, -1, np.maximum(at, -1))


def owners_of(a: pa.Array, b: pa.Array) -> pa.Array:
    """For each piece of the lists ``a`` the piece of those of ``b`` that holds its start; null where there is none."""
    n, m = sizes_of(a), sizes_of(b)
    at = _holder(n, _starts(n, _lengths(a)), m, _starts(m, _lengths(b)))
    return lists(n, ints(at, at >= 0))


def owner(inner: Column | str, outer: Column | str) -> Column:
    """array<int>: :func:`owners_of` columns."""
    return F.arrow_udf("array<int>")(by_rows(owners_of))(inner, outer)


def heads_of(x: pa.Array, most: np.ndarray | int) -> pa.Array:
    """The first ``most`` of each list; an empty one for a null."""
    n = sizes_of(x)
    size = np.minimum(n, most)
    return lists(size, x.flatten().take(pa.array(ranges(offsets_of(n)[:-1], size))))


def text_index(text: Column | str, tokens: Column | str) -> Column:
    """array<int>: the place in ``text`` of each token's first character, null beyond its end, and the text's length behind
    them. White space in the text belongs to no token. Empty where there is no token."""

    @F.arrow_udf("array<int>")
    @by_rows
    def run(texts: pa.Array, b: pa.Array) -> pa.Array:
        size = np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64)
        codes = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        black = np.flatnonzero(~_WHITE[np.minimum(codes, 0x3001)])
        first = offsets_of(size)
        begin = np.searchsorted(black, first)
        m = sizes_of(b)
        row = np.repeat(np.arange(len(m)), m)
        at = begin[row] + _starts(m, _lengths(b))
        ok = at < begin[row + 1]
        place = np.where(ok, black[np.where(ok, at, 0)] if len(black) else 0, 0) - first[row]
        more = (m > 0).astype(np.int64)
        ends = offsets_of(m + more)[1:][m > 0] - 1
        out, good = np.zeros((m + more).sum(), np.int64), np.ones((m + more).sum(), bool)
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner], good[inner], out[ends] = place, ok, size[m > 0]
        return lists(m + more, ints(out, good))

    return run(text, tokens)


def token_labels(spans: Column | str, tokens: Column | str) -> Column:
    """array<string>: the label of each token by ``spans`` (array<struct<type, start, stop>>), as ``align.labels_to_tokens``; an
    empty span touches nothing."""

    @F.arrow_udf("array<string>")
    @by_rows
    def run(s: pa.Array, b: pa.Array) -> pa.Array:
        n, m = sizes_of(s), sizes_of(b)
        flat = s.flatten()
        start, stop = (np.asarray(flat.field(c)).astype(np.int64) for c in ("start", "stop"))
        types = flat.field("type").dictionary_encode()
        starts = _starts(m, _lengths(b))
        a, z = _holder(n, start, m, starts), _holder(n, stop - 1, m, starts)
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((start, row))
        order = order[((a >= 0) & (z >= a))[order]]
        a, z, base = a[order], z[order], offsets_of(m)[row[order]]
        at = ranges(base + a, z - a + 1)
        first, last = np.repeat(base + a, z - a + 1), np.repeat(base + z, z - a + 1)
        tag = np.where(first == last, 0, np.where(at == first, 1, 2))
        names = ["O", *(f"{x}-{t}" for t in types.dictionary.to_pylist() for x in "SBI")]
        label = np.zeros(m.sum(), np.int64)
        # of several spans on a token the later one counts, as it is written later
        label[at] = np.repeat(np.asarray(types.indices)[order].astype(np.int64) * 3 + 1, z - a + 1) + tag
        return lists(m, pa.array(names, pa.string()).take(pa.array(label)))

    return run(spans, tokens)


def _variants(labels: pa.Array) -> tuple[np.ndarray, list[str], pa.Array]:
    """(number of each label, distinct labels, these and then their S-, B- and I- forms)."""
    enc = labels.dictionary_encode()
    names = enc.dictionary.to_pylist()
    every = names + [f"{x}-{n[2:]}" for x in "SBI" for n in names]
    return np.asarray(enc.indices).astype(np.int64), names, pa.array(every, pa.string())


def piece_labels(labels: Column | str, tokens: Column | str, pieces: Column | str) -> Column:
    """array<string>: labels of tokens on the pieces that start in them, as ``align.labels_to_pieces``; null outside."""

    @F.arrow_udf("array<string>")
    @by_rows
    def run(x: pa.Array, b: pa.Array, p: pa.Array) -> pa.Array:
        m, n = sizes_of(b), sizes_of(p)
        of, names, every = _variants(x.flatten())
        at = _holder(n, _starts(n, _lengths(p)), m, _starts(m, _lengths(b)))
        ok = at >= 0
        unit = np.where(ok, at, 0) + offsets_of(m)[np.repeat(np.arange(len(n)), n)]
        i = np.arange(len(unit))
        new = np.ones(len(unit), bool)
        new[1:] = (unit[1:] != unit[:-1]) | (ok[1:] != ok[:-1])
        begin = np.flatnonzero(new)
        run_of = np.cumsum(new) - 1
        nth, size = i - begin[run_of], np.diff(np.append(begin, len(unit)))[run_of]
        d = of[np.where(ok, unit, 0)] if len(of) else np.zeros(len(unit), np.int64)
        same = np.array([t == "O" or t.startswith("I-") for t in names], bool)
        k = len(names)
        code = np.where((same[d] if k else False) | (size == 1), d, np.where(nth == 0, d + 2 * k, d + 3 * k))
        return lists(n, every.take(pa.array(code, pa.int64(), mask=~ok)))

    return run(labels, tokens, pieces)


def char_labels(labels: Column | str, tokens: Column | str) -> Column:
    """array<string>: labels of tokens on the characters that they cover, as ``align.labels_to_chars``."""

    @F.arrow_udf("array<string>")
    @by_rows
    def run(x: pa.Array, b: pa.Array) -> pa.Array:
        m, length = sizes_of(b), _lengths(b)
        of, names, every = _variants(x.flatten())
        k = len(names)
        kind_of = np.array([t[2:] for t in names], object)
        kind = np.unique(kind_of.astype(str), return_inverse=True)[1][of] if k else of
        o, i, begins = (np.array([f(t) for t in names], bool)[of] for f in (lambda t: t == "O", lambda t: t.startswith("I-"), lambda t: t.startswith("B-")))
        new = np.ones(len(of), bool)
        new[1:] = ~(i[1:] & (kind[1:] == kind[:-1]) & ~o[:-1])
        new[offsets_of(m)[:-1][m > 0]] = True
        first = np.flatnonzero(new)
        run_of = np.cumsum(new) - 1
        start = offsets_of(length)[:-1]
        whole = begins[first][run_of]
        total = np.add.reduceat(length, first)[run_of] if len(first) else length
        begin, size = np.where(whole, start[first][run_of], start), np.where(whole, total, length)
        unit = np.repeat(np.arange(len(of)), length)
        at = np.arange(len(unit))
        d = of[unit]
        as_it_is = (o | (i & ~whole))[unit]
        code = np.where(as_it_is, d, np.where(size[unit] == 1, d + k, np.where(at == begin[unit], d + 2 * k, d + 3 * k)))
        return lists(np.add.reduceat(np.append(length, 0), offsets_of(m)[:-1]) * (m > 0) if len(m) else m, every.take(pa.array(code)))

    return run(labels, tokens)


def label_ids(labels: Column | str, names: list[str], most: int, *, edge: int, fill: int = 0) -> Column:
    """array<int>: numbers of the labels (``names`` from 1 on, 0 for others) between two ``edge``, filled up to ``most``."""

    @F.arrow_udf("array<int>")
    @by_rows
    def run(x: pa.Array) -> pa.Array:
        n = sizes_of(x)
        number = np.asarray(pc.fill_null(pc.index_in(x.flatten(), value_set=pa.array(names, pa.string())), -1)).astype(np.int64) + 1
        full = np.maximum(n + 2, most)
        first = offsets_of(full)[:-1]
        out = np.full(full.sum(), fill, np.int64)
        out[first] = edge
        out[first + n + 1] = edge
        out[ranges(first + 1, n)] = number
        return lists(full, ints(out))

    return run(labels)


def nearest_filled(values: Column | str, *, is_start: bool) -> Column:
    """array<int>: the values, and for a null one between its nearest filled neighbours, as ``align.nearest_filled``."""

    @F.arrow_udf("array<int>")
    @by_rows
    def run(x: pa.Array) -> pa.Array:
        n, flat = sizes_of(x), x.flatten()
        ok, v = np.asarray(flat.is_valid()), np.asarray(pc.fill_null(flat, 0)).astype(np.int64)
        i = np.arange(len(v))
        first, end = np.repeat(offsets_of(n)[:-1], n), np.repeat(offsets_of(n)[1:], n)
        left = np.maximum.accumulate(np.where(ok, i, -1))
        right = np.minimum.accumulate(np.where(ok, i, len(v))[::-1])[::-1]
        has_l, has_r = left >= first, right < end
        lo, hi = v[np.where(has_l, left, 0)], v[np.where(has_r, right, 0)]
        only_right = np.where(hi >= 1, 0 if is_start else hi - 1, hi)
        between = np.where(hi > lo + 1, lo + 1 if is_start else hi - 1, hi if is_start else lo)
        out = np.where(ok, v, np.where(~has_l, only_right, np.where(~has_r, lo, between)))
        return lists(n, ints(out, ok | has_l | has_r))

    return run(values)
