"""Coding of a stream of texts, and running counts of its codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import codebook as C


def coded(stream: DataFrame, book: DataFrame, *, text: str = "text") -> DataFrame:
    """The stream with ``coded``. ``book`` is a static table; it is held by every task, so no state is kept."""
    return stream.withColumn("coded", C.encode(text, book))


def code_counts(stream: DataFrame, book: DataFrame, *, text: str = "text", ts: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, code, n): codes counted in windows of event time; a watermark bounds the state and drops what is later."""
    codes = coded(stream, book, text=text).select(ts, F.explode(F.regexp_extract_all("coded", F.lit(f"[^{T.SEP}]+{T.SEP}"), 0)).alias("code"))
    return codes.withWatermark(ts, late).groupBy(F.window(ts, window), "code").agg(F.count("*").alias("n"))
