"""Codebooks (scheme, ch, code) and transliteration of texts.

A codebook is looked up in one of two ways that give the same rows: characters joined to the table, which knows no bound,
or a vectorised function that holds the table, for books of at most ``MAX_HELD`` rows (their number is checked first).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.order import numbered
from corpusloom.operators.rowwise import ints, offsets_of

MAX_HELD = 500_000
#: Texts of a batch that are Python strings at a time; the others are in Arrow's buffers.
ROWS = 64
SCHEMES = ("cangjie", "stroke", "zhengma", "wubi", "pinyin", "zhuyin")


def of_scheme(codebook: DataFrame, scheme: str) -> DataFrame:
    """(ch, code) of one scheme."""
    return codebook.where(F.col("scheme") == scheme).select("ch", "code")


def prepared(x: Column | str, *, lower: bool = True, all_space: bool = True, fold: bool = True) -> Column:
    y = F.col(x) if isinstance(x, str) else x
    y = F.lower(y) if lower else y
    y = F.regexp_replace(y, r"(?U)\s", "") if all_space else y
    return T.fold_punct(y) if fold else y


def replacements(book: DataFrame, *, sep: str = T.SEP, index: bool = True, shift: bool = True) -> DataFrame:
    """(ch, out): what each coded character becomes, and each literal that must be moved away."""
    code = F.col("code") if index else T.drop_digits("code")
    coded = book.select("ch", F.concat(code, F.lit(sep)).alias("out"))
    if not shift:
        return coded
    literal = book.sparkSession.range(1).select(F.explode(F.split(F.lit(T.LITERALS), "")).alias("ch")).where("ch != ''")
    return coded.unionAll(literal.join(book.select("ch"), "ch", "left_anti").select("ch", T.shift_literals("ch").alias("out")))


def translate_by_join(rows: DataFrame, keys: list[str], text: str, table: DataFrame, out: str = "out") -> DataFrame:
    """(keys, out): each character replaced by its row in ``table`` (ch, out), others kept. Keys name a row."""
    chars = rows.select(*keys, F.posexplode_outer(F.filter(F.split(text, ""), lambda c: c != "")).alias("_pos", "ch"))
    found = chars.join(table.withColumnRenamed("out", "_out"), "ch", "left")
    piece = F.struct("_pos", F.coalesce("_out", "ch", F.lit("")).alias("s"))
    return found.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["s"]), "").alias(out))


def translate(rows: DataFrame, keys: list[str], text: str, table: DataFrame, out: str = "out", *, held: int = MAX_HELD) -> DataFrame:
    """The same rows: where the texts are, if tasks hold the table, else by the join."""
    if table.limit(held + 1).count() > held:
        return translate_by_join(rows, keys, text, table, out)
    return rows.select(*keys, F.coalesce(translator(table.where("out is not null"))(F.col(text)), F.lit("")).alias(out))


def _by_parts(texts: pa.Array, one) -> pa.Array:
    """``one`` of each text, ``ROWS`` at a time."""
    parts = [pa.array([None if t is None else one(t) for t in texts.slice(i, ROWS).to_pylist()], pa.string()) for i in range(0, len(texts), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def translator(table: DataFrame):
    """The same as a column function, from a table of checked size."""
    rows = table.limit(MAX_HELD + 1).collect()
    if len(rows) > MAX_HELD:
        raise ValueError("the table is too large to be held; use translate_by_join")
    held = table.sparkSession.sparkContext.broadcast({ord(r["ch"]): r["out"] for r in rows if r["ch"] and len(r["ch"]) == 1})

    @F.arrow_udf("string")
    def apply(texts: pa.Array) -> pa.Array:
        book = held.value
        return _by_parts(texts, lambda t: t.translate(book))

    return apply


def encode(x: Column | str, book: DataFrame, *, index: bool = True, **prepare) -> Column:
    """Run-time coding: each coded character becomes its code and a separator, literals are shifted."""
    return translator(replacements(book, index=index))(prepared(x, **prepare))


def count_codes(rows: DataFrame, text: str, book: DataFrame, *, sep: str = T.SEP, **prepare) -> DataFrame:
    """(code, n): how often each code stands in the coded texts, that is what lies between two separators: a character's code
    behind the uncoded characters before it. Characters are counted first; only distinct ones are coded."""
    coded = book.groupBy("ch").agg(F.max("code").alias("code"))
    chars = [r["ch"] for r in coded.select("ch").limit(MAX_HELD + 1).collect() if r["ch"] and len(r["ch"]) == 1]
    if len(chars) > MAX_HELD:
        raise ValueError("the book is too large to be held")
    every = "".join("\\" + c if c in "\\[]^-&~|" else c for c in sorted(chars))
    found = rows.select(F.explode(F.regexp_extract_all(prepared(text, **prepare), F.lit(f"[^{every}]*[{every}]"), 0)).alias("piece"))
    counts = found.groupBy("piece").agg(F.count("*").alias("n")).withColumn("ch", F.right("piece", F.lit(1)))
    before = T.shift_literals(F.expr("left(piece, length(piece) - 1)"))
    return counts.join(coded, "ch").groupBy(F.concat(before, "code", F.lit(sep)).alias("code")).agg(F.sum("n").alias("n"))


def encode_concat(x: Column | str, first: DataFrame, second: DataFrame) -> Column:
    """Both codes of a character without digits, one after the other; one of them may be missing."""
    both = first.select("ch", T.drop_digits("code").alias("a")).join(second.select("ch", T.drop_digits("code").alias("b")), "ch", "full")
    return encode(x, both.select("ch", F.concat(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))).alias("code")))


def encode_shuffled(x: Column | str, book: DataFrame, permutation: DataFrame) -> Column:
    """Characters are exchanged by ``permutation`` (ch, to) first; case is kept."""
    moved = permutation.join(book.withColumnRenamed("ch", "to"), "to").select("ch", "code")
    rest = book.join(permutation, "ch", "left_anti")
    return encode(x, moved.unionByName(rest), lower=False)


def encode_bytes(x: Column | str, symbols: list[str], sep: str = T.SEP) -> Column:
    """Each UTF-8 byte as one symbol and a separator after each character."""
    table = F.array(*map(F.lit, symbols))
    byte = lambda h: F.element_at(table, F.conv(h, 16, 10).cast("int") + 1)
    of_char = lambda c: F.concat(F.array_join(F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("..")  , 0), byte), ""), F.lit(sep))
    y = F.col(x) if isinstance(x, str) else x
    return F.array_join(F.transform(F.filter(F.split(F.regexp_replace(y, r"(?U)\s", ""), ""), lambda c: c != ""), of_char), "")


def encode_random_index(x: Column | str, index: DataFrame) -> Column:
    """Each character's number (or itself) with a separator after every character. ``index``: (ch, n)."""
    marked = F.regexp_replace(prepared(x), "(?s)(.)", "$1" + T.SEP)
    return translator(index.select("ch", F.col("n").cast("string").alias("out")))(marked)


def seeded(seed: int, *cols: str) -> Column:
    """A repeatable random order: it depends on the seed and the values only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def build_random_index(chars: DataFrame, seed: int, first: int = 10_000) -> DataFrame:
    """(ch, n): distinct characters numbered in random order. The table is an alphabet, small beside any corpus."""
    return chars.select("ch").distinct().withColumn("n", F.row_number().over(Window.orderBy(seeded(seed, "ch"), "ch")) + (first - 1))


def build_permutation(book: DataFrame, seed: int, within: Column | None = None) -> DataFrame:
    """(ch, to): a permutation of the distinct characters, inside groups of equal ``within``."""
    rows = book.withColumn("_g", F.lit(0) if within is None else within).select("ch", "_g").distinct()
    plain = numbered(rows, ["ch"], by=["_g"], name="_n")
    mixed = numbered(rows, [seeded(seed, "ch"), "ch"], by=["_g"], name="_n")
    return plain.join(mixed.withColumnRenamed("ch", "to"), ["_g", "_n"]).select("ch", "to")


def invert(book: DataFrame, *, index: bool = True) -> DataFrame:
    """(code, chars): all characters of a code, in order."""
    code = F.col("code") if index else T.drop_digits("code")
    return book.groupBy(code.alias("code")).agg(F.sort_array(F.collect_set("ch")).alias("chars"))


def collisions(book: DataFrame) -> DataFrame:
    """(size, codes): how many digit-free codes stand for so many characters."""
    return invert(book, index=False).groupBy(F.size("chars").alias("size")).agg(F.count("*").alias("codes"))


class _Phrases:
    """Phrases by their first character, longer ones first: a leftmost-longest transducer over a table of any key length."""

    def __init__(self, book: dict[str, str]):
        self.book, self.by_first = book, {}
        for k in sorted(book, key=len, reverse=True):
            lengths = self.by_first.setdefault(k[0], [])
            if len(k) not in lengths:
                lengths.append(len(k))

    def pieces(self, text: str) -> Iterator[tuple[int, str]]:
        """(characters read, characters written) from left to right."""
        at = 0
        while at < len(text):
            size = next((n for n in self.by_first.get(text[at], ()) if at + n <= len(text) and text[at : at + n] in self.book), 0)
            yield (size, self.book[text[at : at + size]]) if size else (1, text[at])
            at += size or 1

    def offsets(self, text: str) -> tuple[str, list[int], list[int]]:
        """The text, and for each character read where what it became begins and ends; all of a phrase have the same."""
        out, starts, ends, size = [], [], [], 0
        for n, new in self.pieces(text):
            starts += [size] * n
            size += len(new)
            ends += [size] * n
            out.append(new)
        return "".join(out), starts, ends


def _held_phrases(table: DataFrame):
    rows = table.limit(MAX_HELD + 1).collect()
    if len(rows) > MAX_HELD:
        raise ValueError("the table is too large to be held")
    return table.sparkSession.sparkContext.broadcast({r["ch"]: r["out"] for r in rows if r["ch"]})


def phrase_translator(table: DataFrame):
    """A column function that replaces the longest phrase of ``table`` (ch, out) at each place, from left to right."""
    held = _held_phrases(table)

    @F.arrow_udf("string")
    def apply(texts: pa.Array) -> pa.Array:
        book = held.value
        if all(len(k) == 1 for k in book):
            single = {ord(k): v for k, v in book.items()}
            return _by_parts(texts, lambda t: t.translate(single))
        phrases = _Phrases(book)
        return _by_parts(texts, lambda t: "".join(new for _, new in phrases.pieces(t)))

    return apply


def phrase_transducer(table: DataFrame):
    """The same with where things went: a struct (text, starts, ends), by which spans of the old text are found in the new
    one though phrases change their length. Null for a null."""
    held = _held_phrases(table)

    @F.arrow_udf("struct<text:string,starts:array<int>,ends:array<int>>")
    def apply(texts: pa.Array) -> pa.Array:
        phrases = _Phrases(held.value)
        parts = []
        for i in range(0, len(texts), ROWS):
            part = texts.slice(i, ROWS).to_pylist()
            new = [("", [], []) if t is None else phrases.offsets(t) for t in part]
            upto, null = ints(offsets_of(np.array([len(x[1]) for x in new]))), pa.array([t is None for t in part])
            places = [pa.ListArray.from_arrays(upto, ints(np.array([n for x in new for n in x[k]], np.int64)), mask=null) for k in (1, 2)]
            made = pa.array([None if t is None else x[0] for t, x in zip(part, new)], pa.string())
            parts.append(pa.StructArray.from_arrays([made, *places], ["text", "starts", "ends"]))
        kind = pa.struct([("text", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return apply
