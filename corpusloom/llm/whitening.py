"""Whitening of embeddings on the strongest components of their covariance, from an exact scatter matrix.

Entries become integers: floor(``SCALE`` * c). The fit list holds every distinct integer vector once. Its scatter is bit-sliced:
entries are shifted by the smallest one so that none is negative, each dimension's bits are packed across rows into words, and
the numbers of bits that two planes have in common, weighted by their places, are the cross-products. Tasks add such numbers
for their rows; sums and products stay exact integers until they are centred, n * sum(x y) - sum(x) * sum(y), and only then
become a covariance for the eigenvectors. What reaches the driver is one number (in parts of 31 bits) for each pair of
dimensions, whatever the number of rows.

Rows whose vector is null or has a null, NaN or infinite entry are dropped, and those whose length is not that of most rows (of
two equally frequent lengths: the greater). An entry whose integer is beyond 64 bits counts as the nearest one. Repeated rows
are whitened each, and counted once in the fit. A component whose variance is nought beside the first one's, to double
precision, is left out; so a table with fewer than two different vectors, or an empty one, gives no rows. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stage_table

SCALE = 256
#: Rows that are packed at once; bits of a part of a number.
BLOCK, PART = 4096, 31


class Scatter(NamedTuple):
    """Exact sums over the fit list."""

    n: int
    sums: list[int]
    centred: list[list[int]]  # n * sum(x y) - sum(x) * sum(y)


class Model(NamedTuple):
    """Components in the columns of ``vectors``, by falling ``variances``."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float


def usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def integers(v: Column) -> Column:
    return F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Words of [bit, dimension, 64 rows]; ``y``: unsigned entries of rows by dimensions."""
    padded = np.zeros((-len(y) % 64 + len(y), y.shape[1]), np.uint64)
    padded[: len(y)] = y
    turned = np.ascontiguousarray(padded.T)
    return np.stack([np.packbits((turned >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(bits)])


def common_bits(p: np.ndarray, into: np.ndarray) -> None:
    """Adds to ``into`` [weight, i, j], j >= i, how many rows have a bit of i and a bit of j whose places add up to the weight."""
    bits, dim, _ = p.shape
    for i in range(dim):
        for a in range(bits):
            into[a : a + bits, i, i:] += np.bitwise_count(p[a, i] & p[:, i:]).sum(axis=2, dtype=np.int64)


def scatter(fit: DataFrame, dim: int, low: int, high: int) -> Scatter:
    """Sums over the rows of ``fit`` (x), whose entries lie between ``low`` and ``high``."""
    bits = max((high - low).bit_length(), 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, ones, n = np.zeros((2 * bits - 1, dim, dim), np.int64), np.zeros((bits, dim), np.int64), 0
        for batch in batches:
            y = _matrix(batch.column(0), dim).astype(np.int64).view(np.uint64) - np.uint64(low % 2**64)  # modulo 2^64
            for at in range(0, len(y), BLOCK):
                p = planes(y[at : at + BLOCK], bits)
                common_bits(p, pairs)
                ones += np.bitwise_count(p).sum(axis=2, dtype=np.int64)
            n += len(y)
        if not n:
            return
        found = [(-1, -1, n)] + [(i, -1, int(v)) for i, v in enumerate(sum(ones[b].astype(object) << b for b in range(bits)))]
        weighted = sum(pairs[w].astype(object) << w for w in range(2 * bits - 1))
        found += [(i, j, int(weighted[i, j])) for i in range(dim) for j in range(i, dim)]
        rows = [(i, j, k, v >> PART * k & (1 << PART) - 1) for i, j, v in found for k in range(-(-v.bit_length() // PART))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "part", "value"])

    total: dict[tuple[int, int], int] = defaultdict(int)
    parts = fit.select("x").mapInArrow(add, "i int, j int, part int, value bigint").groupBy("i", "j", "part").agg(F.sum("value").alias("value"))
    for r in parts.toLocalIterator():
        total[r["i"], r["j"]] += r["value"] << PART * r["part"]
    n, s = total[-1, -1], [total[i, -1] for i in range(dim)]
    pair = lambda i, j: n * total[min(i, j), max(i, j)] - s[i] * s[j]  # noqa: E731  the shift cancels
    return Scatter(n, [v + n * low for v in s], [[pair(i, j) for j in range(dim)] for i in range(dim)])


def components(s: Scatter, most: int) -> Model:
    """At most ``most`` components with a variance."""
    dim = len(s.sums)
    v = np.array([[c / (s.n * s.n) for c in row] for row in s.centred])
    values, vectors = np.linalg.eigh(v)
    order = [k for k in np.argsort(-values, kind="stable") if values[k] > values.max() * dim * np.finfo(float).eps][:most]
    return Model(s.n, s.sums, vectors[:, order], values[order], float(np.trace(v)))


def project(x: np.ndarray, model: Model) -> tuple[np.ndarray, list[int]]:
    """(whitened, deviations) of integer vectors."""
    largest = max((abs(int(f(x))) for f in (np.min, np.max)), default=0) * model.n + max(map(abs, model.sums)) if len(x) else 0
    exact = np.int64 if largest * largest * x.shape[1] < 2**63 else object
    off = x.astype(exact) * model.n - np.array(model.sums, exact)
    centred = off / model.n if exact is np.int64 else np.array([[v / model.n for v in row] for row in off], float).reshape(x.shape)
    return centred @ model.vectors / np.sqrt(model.variances), (off * off).sum(axis=1).tolist()


def projected(rows: DataFrame, kind: str, dim: int, model: Model) -> DataFrame:
    """(k, z, short, long) of rows (k, x): the whitened entries and the deviation, as a number where it has 64 bits, else as
    text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, deviations = project(_matrix(b.column(1), dim), model)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            short = pa.array([d if d < 2**63 else None for d in deviations], pa.int64())
            long = pa.array([None if d < 2**63 else str(d) for d in deviations], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), lists, short, long], names=["k", "z", "short", "long"])

    return rows.select("k", "x").mapInArrow(run, f"k {kind}, z array<double>, short bigint, long string")


def identity_error(fit: DataFrame, dim: int, model: Model) -> float:
    """The largest entry by which the covariance of the whitened fit list departs from the identity."""
    z = projected(fit.select(F.lit(0).alias("k"), "x"), "int", dim, model).select("z")
    k = len(model.variances)
    got = z.agg(*[F.covar_pop(F.col("z")[i], F.col("z")[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", most: int = 4) -> DataFrame:
    """(key, component, n, deviation, deviation_text, whitened, explained, identity_error) of each usable row and component.
    ``deviation`` is null, and ``deviation_text`` has its digits, where it takes more than 64 bits."""
    x = rows.select(rows[key].alias("k"), rows[vector].alias("v")).where(usable(F.col("v"))).select("k", integers(F.col("v")).alias("x"))
    kind = dict(x.dtypes)["k"]
    lengths = x.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("rows"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"))
    common = lengths.orderBy(F.desc("rows"), F.desc("dim")).first()
    model = None
    if common and common["dim"]:
        x = x.where(F.size("x") == common["dim"])
        fit = stage_table(x.select("x").distinct(), "fit")
        model = components(scatter(fit, *(common[c] for c in ("dim", "low", "high"))), most)
    if model is None or not len(model.variances):
        none = x.select("k").where("false").withColumns({"z": F.array().cast("array<double>"), "short": F.lit(None).cast("long"), "long": F.lit(None).cast("string")})
        return _shaped(none, key, 0, [], 0.0)
    shares = [float(e / model.trace) for e in model.variances]
    return _shaped(projected(x, kind, common["dim"], model), key, model.n, shares, identity_error(fit, common["dim"], model))


def _shaped(found: DataFrame, key: str, n: int, shares: list[float], error: float) -> DataFrame:
    each = found.select("k", "short", "long", F.posexplode("z").alias("at", "whitened"))
    explained = F.get(F.array(*[F.lit(s) for s in shares]).cast("array<double>"), F.col("at"))
    return each.select(
        F.col("k").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("short").alias("deviation"), F.col("long").alias("deviation_text"),
        "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"),
    )
