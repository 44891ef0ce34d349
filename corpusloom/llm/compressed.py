"""A quality classifier by compression: zstandard dictionaries of good and of bad text, and the sizes that a text has with each.

A text is compressed in blocks of ``BLOCK`` bytes, each for itself, once with the dictionary of the good and once with that of
the bad texts. The difference of both sizes over the text's bytes is its margin: greater where good text predicts it better,
whatever its length. A logistic curve turns margins into probabilities of the label 1.

Both are fitted on labelled rows only, and on bounded samples of them, chosen by hash: ``ROWS`` rows of each label for the
dictionaries, of whose whole texts the ``BLOCKS`` blocks with the smallest hashes stay, and ``MARGINS`` rows for the curve. A
hash of the text decides which of both a row may serve, so the curve sees texts that the dictionaries don't hold, and copies
stay together. Keys, labels and hashes are joined; texts are not shuffled. Every text is scored whole.

Null texts count as empty; an empty text has the margin 0 and so the curve's value there. Labels other than 0 and 1, labels of
no document and documents of no label are not learnt from; a document with several labels is learnt with each. Equal texts have
equal scores. Without blocks of both labels every margin is 0; without labels every score is 0.5. An empty table gives no rows.
Other columns of the documents are kept; a column ``score`` gives way to the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stage_table

BLOCK, LEVEL = 512, 3
#: Bytes of a dictionary; rows of a label that it is made from, and blocks of these rows; rows that the curve is fitted on.
DICTIONARY, ROWS, BLOCKS, MARGINS = 112_640, 8192, 8192, 20_000
#: Fewer blocks than this become a dictionary as they are; the trainer needs some.
FEW = 64


class Model(NamedTuple):
    """Dictionaries of label 0 and 1, and the curve's slope and offset."""

    dictionaries: tuple[bytes, bytes]
    trained: tuple[bool, bool]
    slope: float
    offset: float


def remainder(key: Column, by: int) -> Column:
    """Checksum of the key's text modulo ``by``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % by


def blocks(data: bytes) -> Iterator[bytes]:
    for at in range(0, len(data), BLOCK):
        yield data[at : at + BLOCK]


def _samples(labelled: DataFrame) -> dict[int, list[bytes]]:
    """For each label the blocks with the smallest hashes of all blocks of at most ``ROWS`` rows (label, text), each block
    once."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, bytes]] = {0: {}, 1: {}}
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1)):
                mine = held[label]
                for block in blocks(text.as_buffer().to_pybytes() if text.is_valid else b""):
                    mine[xxhash.xxh64_intdigest(block, 13) >> 1] = block
                if len(mine) > 4 * BLOCKS:
                    held[label] = {h: mine[h] for h in heapq.nsmallest(BLOCKS, mine)}
        rows = [(label, h, mine[h]) for label, mine in held.items() for h in heapq.nsmallest(BLOCKS, mine)]
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4096]), (pa.int32(), pa.int64(), pa.binary()))], names=["label", "h", "block"])

    found = labelled.select("label", "text").mapInArrow(least, "label int, h bigint, block binary")
    found = stage_table(found.groupBy("label", "h").agg(F.first("block").alias("block")), "blocks")
    return {label: [bytes(r["block"]) for r in found.where(F.col("label") == label).orderBy("h").limit(BLOCKS).collect()] for label in (0, 1)}


def dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """(bytes, whether they are a trained dictionary and not plain text)."""
    if len(samples) >= FEW:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples, k=64, d=8).as_bytes(), True
        except zstandard.ZstdError:  # the blocks have nothing in common
            pass
    return b"".join(samples)[-DICTIONARY:], False


class _Sizer:
    """Compressed sizes under both dictionaries."""

    def __init__(self, model: Model):
        kinds = [zstandard.DICT_TYPE_FULLDICT if t else zstandard.DICT_TYPE_RAWCONTENT for t in model.trained]
        self.able = all(model.dictionaries)
        self.by = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=k), write_content_size=False, write_checksum=False, write_dict_id=False)
            for d, k in zip(model.dictionaries, kinds)
        ] if self.able else []

    def margin(self, data: bytes) -> float:
        if not self.able or not data:
            return 0.0
        bad, good = (sum(len(c.compress(b)) for b in blocks(data)) for c in self.by)
        return (bad - good) / len(data)


def margins(texts: DataFrame, kind: str, model: Model) -> DataFrame:
    """(k, margin) of rows (k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = _Sizer(model)
        for b in batches:
            found = [sizer.margin(t.as_buffer().to_pybytes()) if t.is_valid else 0.0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=["k", "margin"])

    return texts.select("k", "text").mapInArrow(run, f"k {kind}, margin double")


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the most likely logistic curve, with a slight pull to zero. Newton's steps, halved while they don't
    help."""
    scale = float(np.std(x)) or 1.0
    design, w, pull = np.c_[x / scale, np.ones(len(x))], np.zeros(2), 1e-3

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * y - 1) * (design @ v)).sum() + pull / 2 * v @ v)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + pull * np.eye(2), design.T @ (p - y) + pull * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, *, label: str, key: str = "doc_id", text: str = "text") -> Model:
    """Learns from those of ``docs`` that have a label."""
    known = labels.select(labels[key].alias("k"), labels[label].cast("int").alias("label")).where("label in (0, 1)").distinct()
    texts = docs.select(docs[key].alias("k"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("text"))
    ids = stage_table(texts.select("k", "h").distinct().join(known, "k"), "labelled").withColumn("tie", F.xxhash64("h", "k"))
    part = F.pmod("h", F.lit(4))

    def some(rows: DataFrame, use: str, most: int) -> DataFrame:
        return rows.orderBy("tie", "k", "h", "label").limit(most).select("k", "h", "label", F.lit(use).alias("use"))

    chosen = some(ids.where((part != 0) & (F.col("label") == 0)), "text", ROWS).union(some(ids.where((part != 0) & (F.col("label") == 1)), "text", ROWS))
    chosen = stage_table(chosen.union(some(ids.where(part == 0), "margin", MARGINS)), "chosen")
    rows = texts.join(F.broadcast(chosen), ["k", "h"])  # at most 2 * ROWS + MARGINS rows
    samples = _samples(rows.where("use = 'text'"))
    (bad, bad_trained), (good, good_trained) = dictionary(samples[0]), dictionary(samples[1])
    model = Model((bad, good), (bad_trained, good_trained), 0.0, 0.0)
    kind = "struct<" + ",".join(f"{n}:{t}" for n, t in rows.select("k", "h", "label").dtypes) + ">"
    found = margins(rows.where("use = 'margin'").select(F.struct("k", "h", "label").alias("k"), "text"), kind, model).distinct()
    seen = found.select("margin", "k.label").collect()
    if not seen:
        return model
    slope, offset = curve(np.array([r[0] for r in seen]), np.array([r[1] for r in seen], float))
    return model._replace(slope=max(slope, 0.0), offset=offset)


def score(docs: DataFrame, model: Model, *, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The rows with ``score``, the probability of the label 1; of their own columns all or those named."""
    kept = [c for c in (docs.columns if columns is None else columns) if c != "score"]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("k"), docs[text].alias("text"))
    found = margins(row, row.schema["k"].dataType.simpleString(), model)
    return found.select("k.*", (1 / (1 + F.exp(-(F.col("margin") * model.slope + model.offset)))).alias("score"))
