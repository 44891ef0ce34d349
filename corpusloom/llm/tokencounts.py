"""Token counts of documents in flat token files, by a scan for separators.

A flat token file is nothing but ids of fixed width, each document's followed by an end-of-document id; there is no index.
Files are read as blocks in parallel. A block finds its separators by one vectorised comparison and returns the lengths of
the documents that lie wholly inside it, the part before its first separator and the part after its last one. A prefix scan
over the blocks of a file joins parts across any number of blocks and numbers the documents.

An id sequence without a separator at a file's end counts as a last, open document. Empty files hold none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import new_path, stage_table
from corpusloom.llm.sharedfiles import ranges, read_range, write_whole

BLOCK_BYTES = 4 << 20
#: Tokens held before they are written, about.
BUFFER = 1 << 20


def scan_block(ids: np.ndarray, separator: int) -> tuple[int, int, int, np.ndarray]:
    """(separators, tokens before the first, tokens after the last, lengths between neighbours) of one block."""
    at = np.flatnonzero(ids == separator)
    if not len(at):
        return 0, len(ids), 0, np.empty(0, np.int64)
    return len(at), int(at[0]), int(len(ids) - at[-1] - 1), np.diff(at) - 1


def count_tokens(spark: SparkSession, paths: str | list[str], separator: int, *, dtype: str = "uint16", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, n_tokens, closed): one row for each document of each file, in the file's order from 0."""
    width = np.dtype(dtype).itemsize
    block_bytes -= block_bytes % width

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                data = read_range(path, start, min(block_bytes, size - start))
                n, head, tail, inner = scan_block(np.frombuffer(data, dtype, len(data) // width), separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([size], pa.int64()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([inner.tolist()], pa.list_(pa.int32()))],
                    names=["path", "size", "start", "n", "head", "tail", "inner"],
                )

    blocks = ranges(spark, paths, block_bytes)
    # a file's blocks lie far apart, so reading is dealt out evenly
    blocks = blocks.repartition(F.xxhash64("path", "start"))
    found = stage_table(blocks.mapInArrow(scan, "path string, size bigint, start bigint, n bigint, head bigint, tail bigint, inner array<int>"), "separators")
    # the scan: documents before a block, and tokens of the document that is open where it starts
    in_file = Window.partitionBy("path").orderBy("start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    small = found.select("path", "size", "start", "n", "head", "tail")
    state = small.withColumns({
        "ordinal": F.coalesce(F.sum("n").over(before), F.lit(0)),
        "all": F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("head")).otherwise(0)).over(before), F.lit(0)),
    })
    # at each block with a separator: its tail, less the separator-free tokens up to it
    base = F.last(F.when(F.col("n") > 0, F.col("tail") - F.col("all")), ignorenulls=True).over(before)
    state = state.withColumn("open", F.col("all") + F.coalesce(base, F.lit(0)))
    ending = F.col("start") + block_bytes >= F.col("size")
    last = F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("open") + F.col("head"))
    joined = state.select("path", "start", "ordinal", "n", (F.col("open") + F.col("head")).alias("first"), F.when(ending & (last > 0), last).alias("rest"))
    heads = joined.where("n > 0").select("path", "ordinal", F.col("first").alias("n_tokens"), F.lit(True).alias("closed"))
    rests = joined.where("rest is not null").select("path", (F.col("ordinal") + F.col("n")).alias("ordinal"), F.col("rest").alias("n_tokens"), F.lit(False).alias("closed"))
    inner = found.where("n > 1").select("path", "start", "inner").join(joined.select("path", "start", "ordinal"), ["path", "start"])
    inner = inner.select("path", "ordinal", F.posexplode("inner").alias("k", "n_tokens")).select("path", (F.col("ordinal") + F.col("k") + 1).alias("ordinal"), F.col("n_tokens").cast("long").alias("n_tokens"), F.lit(True).alias("closed"))
    return heads.unionAll(inner).unionAll(rests)


def encoder(ranks_path: str):
    """A byte-level BPE of a public rank file, and the first id that is free for a separator."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def pack(docs: DataFrame, ranks_path: str, *, key: str = "doc_id", text: str = "text", dtype: str = "uint16") -> tuple[str, DataFrame, int]:
    """Writes flat token files, one for each task, in the shared folder. Returns their folder, a table
    (key, path, ordinal) of which document is where, and the separator's id.

    A task that is done again writes a file of another name, and the table names those of the tasks that counted.
    """
    folder = new_path(docs.sparkSession, "tokens")
    kind = dict(docs.dtypes)[key]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, separator = encoder(ranks_path)
        if separator > np.iinfo(dtype).max:
            raise ValueError(f"{dtype} is too narrow")
        path, ordinal = f"{folder}/{uuid.uuid4().hex}.bin", 0
        batch = next(batches, None)
        if batch is None:
            return
        with write_whole(path) as f:
            while batch is not None:
                held, size = [], 0
                for t in batch.column(1):
                    ids = encode.encode_ordinary(t.as_py() or "")
                    held += [np.array(ids, dtype), np.array([separator], dtype)]
                    size += len(ids)
                    if size > BUFFER:
                        f.write(np.concatenate(held).tobytes())
                        held, size = [], 0
                if held:
                    f.write(np.concatenate(held).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([path] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64())], names=["k", "path", "ordinal"])
                ordinal += n
                batch = next(batches, None)

    where = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(write, f"k {kind}, path string, ordinal bigint")
    where = stage_table(where.withColumnRenamed("k", key), "token-places")
    return folder, where, encoder(ranks_path)[1]


def tokens_per_document(docs: DataFrame, ranks_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens): flat files are written from the documents and counted by their separators. Null texts have none."""
    spark = docs.sparkSession
    _, where, separator = pack(docs, ranks_path, key=key, text=text)
    paths = [r[0] for r in where.select("path").distinct().collect()]  # as many as tasks wrote
    if not paths:
        return where.select(key, F.lit(0).cast("long").alias("n_tokens"))
    name = lambda c: F.regexp_extract(c, "([^/]+)$", 1)  # noqa: E731  the same file has several spellings as a URI
    counted = count_tokens(spark, paths, separator).select(name("path").alias("file"), "ordinal", "n_tokens")
    return where.withColumn("file", name("path")).join(counted, ["file", "ordinal"]).select(key, "n_tokens")
