"""Byte ranges of files in the shared folder, for tasks: flat files that Spark's own readers do not split."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def filesystem(path: str):
    """(file system, path in it) of a path or URI; a plain path is a local or mounted one."""
    from pyarrow import fs

    if ":/" in path:
        scheme, rest = path.split(":", 1)
        if scheme == "file":
            return fs.LocalFileSystem(), "/" + rest.lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def read_range(path: str, start: int, length: int) -> bytes:
    where, inner = filesystem(path)
    with where.open_input_file(inner) as f:
        return f.read_at(length, start)


@contextmanager
def write_whole(path: str) -> Iterator:
    """A new file that has its name only once it is complete: if the block raises, or the task dies, no file of that name is
    left."""
    where, inner = filesystem(path)
    where.create_dir(inner.rpartition("/")[0], recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part) as f:
        yield f
    from pyarrow import fs

    if where.get_file_info(inner).type != fs.FileType.NotFound:  # an earlier attempt was whole as well
        where.delete_file(inner)
    where.move(part, inner)


def ranges(spark: SparkSession, paths: str | list[str], block: int, *, glob: str = "*") -> DataFrame:
    """(path, size, start) of every block of the files below ``paths``. Spark lists them; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)
    listed = files.select("path", F.col("length").alias("size")).where("size > 0")
    return listed.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("start"))
