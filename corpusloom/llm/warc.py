"""WARC files of web pages, and a Merkle audit of their fixity.

Records are written as ``.warc.gz`` files in the shared folder: every record is a gzip member of its own, so a reader can
start at any record's offset. They are read back member by member; where one is damaged, reading goes on at the next.
A replica is a table of records (file, offset, length, sha256), all of the stored bytes. Over it stands a tree for each
file: a leaf covers a fixed range of byte offsets and hashes the records that begin there in order; a node hashes its
``FAN`` children in order; the last level has the file's root. Two replicas are compared by their roots; only below roots
that differ are children compared, level by level, down to the ranges and records that are altered, missing or extra.

Null pages and addresses give records with an empty payload or address; an empty table gives no files. Rows that agree in
all of key, address and page are interchangeable. Only the columns named are read; a long page is one record like any other.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import new_path, stage_table
from corpusloom.llm.sharedfiles import filesystem, write_whole

FAN, RANGE_BYTES = 16, 64 << 10
#: Pages in a file, about: a file is written by one task, as a stream.
RECORDS_A_FILE = 4000
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
LEAF = "file bigint, offset bigint, length bigint, sha256 string"
LEVEL, GZIP, READ = 3, 31, 1 << 20  # of compression; zlib's name for gzip; bytes read at once
MAGIC = b"\x1f\x8b\x08"


def records(pages: DataFrame, files: int, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(k, file, url, record): each page as a WARC record, dealt over ``files`` files by a hash of its key, address and page;
    ``k`` is the key."""
    body, address = F.coalesce(pages[html], F.lit("")), F.regexp_replace(F.coalesce(pages[url], F.lit("")), r"[\r\n]", " ")
    digest = F.sha1(F.concat_ws(" ", F.coalesce(pages[key].cast("string"), F.lit("")), address))
    uid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uid, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), address,
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END),
    )
    file = F.pmod(F.xxhash64(pages[key], pages[url], pages[html]), F.lit(files)).cast("long")
    return pages.select(pages[key].alias("k"), file.alias("file"), address.alias("url"), F.concat(head, body, F.lit(END)).alias("record"))


def number_of_files(pages: DataFrame) -> int:
    return pages.count() // RECORDS_A_FILE + 1


def members(rows: DataFrame) -> DataFrame:
    """(k, file, url, tie, data) of ``records``: the stored bytes of each. Equal records give equal bytes."""
    kind = dict(rows.dtypes)["k"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for r in b.column(4):
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                data.append(squeeze.compress(r.as_py().encode()) + squeeze.flush())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(data, pa.binary())], names=["k", "file", "url", "tie", "data"])

    return rows.select("k", "file", "url", F.xxhash64("record").alias("tie"), "record").mapInArrow(pack, f"k {kind}, file bigint, url string, tie bigint, data binary")


def write(stored: DataFrame, files: int) -> str:
    """Writes ``members`` as one file each in a new folder, in the order of their keys; returns the folder.

    A file's name does not depend on the attempt and it appears whole, so a task that is done again replaces it by the same
    bytes.
    """
    folder = new_path(stored.sparkSession, "warc")
    where, inner = filesystem(folder)
    where.create_dir(inner, recursive=True)  # it is there even if there are no rows

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, f, out = None, ExitStack(), None, []
        with held:
            for b in batches:
                for file, data in zip(b.column(0).to_pylist(), b.column(1)):
                    if file != now:  # rows come sorted by file
                        held.close()
                        now, f = file, held.enter_context(write_whole(f"{folder}/file={file}/records.warc.gz"))
                        out.append(file)
                    f.write(data.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["file"])

    dealt = stored.repartition(files, "file").sortWithinPartitions("file", "k", "url", "tie").select("file", "data")
    dealt.mapInArrow(put, "file bigint").agg(F.count("*")).collect()
    return folder


def expected(stored: DataFrame) -> DataFrame:
    """(k, file, offset, length, sha256) that files written from ``members`` must have. Only lengths and hashes move."""
    narrow = stored.select("k", "file", "url", "tie", F.octet_length("data").cast("long").alias("length"), F.sha2("data", 256).alias("sha256"))
    order = Window.partitionBy("file").orderBy("k", "url", "tie")
    return narrow.select("k", "file", (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "sha256")


class _Bytes:
    """An open file of ``size`` bytes, read in blocks."""

    def __init__(self, f, size: int):
        self.f, self.size, self.base, self.block = f, size, 0, b""

    def at(self, pos: int, least: int = 1) -> memoryview:
        """What is held from ``pos`` on: ``least`` bytes or more, unless the file ends."""
        end = self.base + len(self.block)
        if not self.base <= pos < end or (end - pos < least and end < self.size):
            self.base, self.block = pos, self.f.read_at(min(READ, self.size - pos), pos)
        return memoryview(self.block)[pos - self.base :]


def _member(b: _Bytes, pos: int, payload: bool) -> tuple[int, str, bytes] | None:
    """(end, sha256, record if wanted) of the whole record that is stored at ``pos``; None if there is none."""
    expand, digest, out, head = zlib.decompressobj(GZIP), hashlib.sha256(), [], b""
    if bytes(b.at(pos, len(MAGIC))[: len(MAGIC)]) != MAGIC:
        return None
    while pos < b.size:
        chunk = b.at(pos)[: 1 << 16]
        try:
            got = expand.decompress(chunk)
        except zlib.error:
            return None
        if len(head) < 7:
            head += got[:7]
            if not b"WARC/1.".startswith(head[:7]):
                return None
        if payload:
            out.append(got)
        used = len(chunk) - len(expand.unused_data)
        digest.update(chunk[:used])
        pos += used
        if expand.eof:
            return (pos, digest.hexdigest(), b"".join(out)) if len(head) >= 7 else None
    return None


def _begins(b: _Bytes, pos: int) -> bool:
    """Whether a record begins at ``pos``."""
    try:
        return zlib.decompressobj(GZIP).decompress(b.at(pos, 4096)[:4096], 7) == b"WARC/1."
    except zlib.error:
        return False


def _next(b: _Bytes, pos: int) -> int:
    """Where the next record after ``pos`` begins, or the file's end."""
    pos += 1
    while pos < b.size:
        some = bytes(b.at(pos, len(MAGIC)))
        k = some.find(MAGIC)
        if k < 0:
            pos += max(1, len(some) - len(MAGIC) + 1)
        elif _begins(b, pos + k):
            return pos + k
        else:
            pos += k + 1
    return b.size


def walk(f, size: int, payload: bool = False) -> Iterator[tuple[int, int, str, bytes]]:
    """(offset, length, sha256, record if wanted) of each stored record of an open file. Bytes that are no record up to the
    next one come as one, with an empty record."""
    b, at = _Bytes(f, size), 0
    while at < size:
        found = _member(b, at, payload)
        if not found:
            end, digest, pos = _next(b, at), hashlib.sha256(), at
            while pos < end:
                some = b.at(pos)[: end - pos]
                digest.update(some)
                pos += len(some)
            found = (end, digest.hexdigest(), b"")
        yield at, found[0] - at, found[1], found[2]
        at = found[0]


def read(spark: SparkSession, folder: str, *, payload: bool = False) -> DataFrame:
    """(file, offset, length, sha256[, uri, payload]) of every record below ``folder``. Spark deals
    the files out by their sizes; each is read as a stream of records."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns)):
                where, inner = filesystem(path)
                file, held = int(re.findall(r"/file=(-?\d+)/", path)[-1]), []  # the folder's own name may hold such words
                with where.open_input_file(inner) as f:
                    for offset, length, digest, data in walk(f, size, payload):
                        row = (file, offset, length, digest)
                        if payload:
                            head, _, body = data.partition(b"\r\n\r\n")
                            uri = re.search(rb"\r\nWARC-Target-URI: ([^\r\n]*)", head)
                            row += (uri[1].decode(errors="replace") if uri else None, body.removesuffix(END.encode()))
                        held.append(row)
                        if len(held) == 256:
                            yield made(held)
                            held = []
                if held:
                    yield made(held)

    types = [("file", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())] + [("uri", pa.string()), ("payload", pa.binary())] * payload

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    return files.mapInArrow(scan, LEAF + (", uri string, payload binary" if payload else ""))


def tree(replica: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (file, node, hash) of each level, leaves first. A node has at most ``FAN`` children. Each level is written, so
    none is made twice."""
    leaf = replica.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES).cast("long"))
    part = F.struct("offset", "length", "sha256")
    level = leaf.groupBy("file", "node").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: F.concat_ws(" ", x["offset"], x["length"], x["sha256"])), "\n"), 256).alias("hash"))
    out = [stage_table(level, "level")]
    for _ in range(levels):
        child = out[-1].select("file", F.col("node").alias("child"), F.floor(F.col("node") / FAN).cast("long").alias("node"), "hash")
        kids = F.array_sort(F.collect_list(F.struct("child", "hash")))
        level = child.groupBy("file", "node").agg(F.sha2(F.array_join(F.transform(kids, lambda x: F.concat_ws(" ", x["child"], x["hash"])), "\n"), 256).alias("hash"))
        out.append(stage_table(level, "level"))
    return out


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file, offset, length, status) of records that differ: 'altered', 'missing' in theirs, or 'extra' there."""
    ours, theirs = ours.select("file", "offset", "length", "sha256"), theirs.select("file", "offset", "length", "sha256")
    most = max(r.agg(F.max("offset")).first()[0] or 0 for r in (ours, theirs)) // RANGE_BYTES
    levels = 0
    while most >= FAN**levels:
        levels += 1
    suspects = None
    for x, y in reversed(list(zip(tree(ours, levels), tree(theirs, levels)))):
        if suspects is not None:  # only the children of nodes that differ
            up = F.floor(F.col("node") / FAN).cast("long")
            x, y = (t.withColumn("up", up).join(suspects, ["file", "up"], "left_semi").drop("up") for t in (x, y))
        both = x.withColumnRenamed("hash", "ha").join(y.withColumnRenamed("hash", "hb"), ["file", "node"], "full")
        suspects = stage_table(both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", F.col("node").alias("up")), "suspects")
    below = F.floor(F.col("offset") / RANGE_BYTES).cast("long")
    x, y = (t.withColumn("up", below).join(suspects, ["file", "up"], "left_semi").drop("up") for t in (ours, theirs))
    both = x.select("file", "offset", F.struct("length", "sha256").alias("a")).join(y.select("file", "offset", F.struct("length", "sha256").alias("b")), ["file", "offset"], "full")
    differs = both.where(~F.col("a").eqNullSafe(F.col("b")))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("altered")
    return differs.select("file", "offset", F.coalesce("a.length", "b.length").alias("length"), status.alias("status"))


def replicas(pages: DataFrame, damage: Callable[[Column, Column], Column] | None = None, *, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """What files of ``pages`` must hold, with keys, and what such files do hold once they are written; both as stage tables.
    ``damage`` changes stored bytes on their way to the files, given a page's key and its bytes. The files go once they are
    read."""
    files = number_of_files(pages)
    stored = members(records(pages, files, key=key))
    folder = write(stored.withColumn("data", damage(F.col("k"), F.col("data"))) if damage else stored, files)
    theirs = stage_table(read(pages.sparkSession, folder), "replica")
    where, inner = filesystem(folder)
    where.delete_dir(inner)
    return stage_table(expected(stored).withColumnRenamed("k", key), "replica"), theirs
