"""Benchmark decontamination by pigeonhole edit matching.

A test item with a budget of k errors is cut into k + 1 pieces. If it occurs in a text with k edits or fewer, at least one
piece occurs there unchanged. All pieces of all items are found at once by one automaton over the text; around each hit the
item is verified with Myers' bit-parallel edit distance.

Texts and items are compared in lower case with runs of white space as one space. An item that is too short for an error must
stand there as whole words: no letter or digit may touch it. Documents are read whole and in place; nothing is shuffled.
Items are a stated query set: they are written to the shared folder in blocks of about ``BLOCK_CHARS`` characters, tasks read
them from there, and the documents are read once for each block. Items never pass through the driver, and a task never holds
more than one block.

Null and empty texts hold nothing; null and empty items are no items; repeated rows give repeated results; empty tables
give empty results. Keys may be of any type, null too, and other columns of any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from corpusloom.llm.common import new_path, stage_table
from corpusloom.llm.sharedfiles import filesystem

#: One error for so many characters of an item.
CHARS_PER_ERROR = 12
BLOCK_CHARS = 8_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, chars_per_error: int = CHARS_PER_ERROR) -> int:
    return len(item) // chars_per_error


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``errors + 1`` pieces of nearly equal length."""
    edge = [round(len(item) * k / (errors + 1)) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edge, edge[1:])]


class Pattern:
    """An item as bit masks, for Myers' algorithm."""

    def __init__(self, item: str):
        self.item, self.m = item, len(item)
        self.masks: dict[str, int] = defaultdict(int)
        for k, ch in enumerate(item):
            self.masks[ch] |= 1 << k
        self.masks = dict(self.masks)

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the best occurrence in ``text`` within ``most`` edits, the first of equals."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, found = full, 0, self.m, None
        get = self.masks.get
        for at, ch in enumerate(text):
            eq = get(ch, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = (ph << 1) & full, (mh << 1) & full  # a match may begin anywhere
            pv = mh | (full & ~(xv | ph))
            mv = ph & xv
            if score <= most and (found is None or score < found[0]):
                found = (score, at + 1)
        return found


class Matcher:
    """Finds all items in a text."""

    def __init__(self, items: list[tuple], chars_per_error: int = CHARS_PER_ERROR):
        import ahocorasick

        self.ids, self.patterns, self.errors = [], [], []
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            item = normal(text)
            if not item:
                continue
            errors = budget(item, chars_per_error)
            for offset, piece in pieces(item, errors):
                where[piece].append((len(self.ids), offset))
            self.ids.append(item_id)
            self.patterns.append(Pattern(item))
            self.errors.append(errors)
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.verify = lru_cache(200_000)(self._verify)

    def _verify(self, k: int, window: str) -> tuple[int, int] | None:
        return self.patterns[k].best(window, self.errors[k])

    def find(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item id, distance, end in the normalised text) of the best occurrence of each item that is there."""
        if not self.ids:
            return []
        text = normal(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (length, places) in self.automaton.iter(text):
            for k, offset in places:
                starts[k].add(end + 1 - length - offset)
        out = []
        for k, found in starts.items():
            p, errors, best = self.patterns[k], self.errors[k], None
            for start in found:
                if start >= 0 and text.startswith(p.item, start) and (errors or _whole(text, start, start + p.m)):
                    if best is None or (0, start + p.m) < best:
                        best = (0, start + p.m)
            if best is None and errors:
                upto = -1
                for start in sorted(found):  # places close to each other share a window
                    lo = max(0, start - errors)
                    if upto >= start + p.m + errors:
                        continue
                    upto = start + p.m + 2 * errors
                    got = self.verify(k, text[lo:upto])
                    if got and (best is None or (got[0], lo + got[1]) < best):
                        best = (got[0], lo + got[1])
            if best is not None:
                out.append((self.ids[k], *best))
        return out


def _whole(text: str, a: int, b: int) -> bool:
    """Whether no letter or digit inside ``text[a:b]`` has one next to it outside."""
    return not (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


def _blocks(items: DataFrame, key: str, text: str) -> list[str]:
    """Folders in the shared folder that hold the items, each a block of about ``BLOCK_CHARS`` characters."""
    chars = items.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    n = int(chars // BLOCK_CHARS) + 1
    folder = new_path(items.sparkSession, "items")
    rows = items.select(items[key].alias("k"), items[text].alias("t")).where("trim(t) != ''").distinct()
    out = []
    for k in range(n):
        out.append(f"{folder}/block-{k}")
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == k)
        part.write.parquet(out[-1])
    return out


@lru_cache(1)
def _matcher(folder: str, chars_per_error: int) -> tuple[Matcher, pa.Array]:
    """The matcher of a block, whose ids are places in the array of keys. A worker keeps the last one."""
    import pyarrow.parquet as pq

    where, inner = filesystem(folder)
    rows = pq.read_table(inner, filesystem=where)
    return Matcher(list(enumerate(rows.column("t").to_pylist())), chars_per_error), rows.column("k").combine_chunks()


def find(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """(key, item_id, distance, end): one row for each document and item that it contains; end: a place in the normalised
    text."""
    schema = StructType().add("k", docs.schema[key].dataType).add("i", items.schema[item_key].dataType).add("distance", IntegerType()).add("end", IntegerType())

    def over(folder: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matcher, keys = _matcher(folder, chars_per_error)
                hits = [(n, *h) for n, t in enumerate(batch.column(1)) for h in matcher.find(t.as_py())]
                at, ids, distance, end = zip(*hits) if hits else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), keys.take(pa.array(ids, pa.int64())), pa.array(distance, pa.int32()), pa.array(end, pa.int32())], names=["k", "i", "distance", "end"])

        return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, map(over, _blocks(items, item_key, item_text))).toDF(key, item_key, "distance", "end")


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """The documents that contain no item, with all their columns. What a block of items leaves is written before the next
    block reads it, so a stage has one automaton."""
    at = docs.columns.index(text)

    def without(folder: str, rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                matcher, _ = _matcher(folder, chars_per_error)
                yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column(at)], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    first, *rest = _blocks(items, item_key, item_text)
    rows = without(first, docs)
    for folder in rest:
        rows = without(folder, stage_table(rows, "clean"))
    return rows
