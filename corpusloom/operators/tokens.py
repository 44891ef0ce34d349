"""Tokenising and id mapping. Where tasks hold the vocabulary, arrays are done where they are read, each distinct word of a batch
once, and nothing is shuffled; a larger vocabulary is joined to the distinct words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.rowwise import by_rows, lists, offsets_of, ranges, sizes_of

#: Pieces that tasks hold at most; larger vocabularies are joined.
MAX_HELD = 500_000
#: Words whose pieces a task remembers at most.
MAX_SEEN = 200_000


def held_table(vocab: DataFrame, key: str, value: str, held: int = MAX_HELD) -> dict | None:
    """``value`` by ``key``, the greatest of several; None beyond ``held`` rows."""
    rows = vocab.select(key, value).limit(held + 1).collect()
    if len(rows) > held:
        return None
    table: dict = {}
    for k, v in rows:
        if k is not None and (table.get(k) is None or (v is not None and v > table[k])):
            table[k] = v
    return table


def id_lookup(spark, table: dict[str, int], unk: int = 0) -> Callable[[Column | str], Column]:
    """A column function: the ids of an array of tokens, unknown ones as ``unk``; empty for a null."""
    return F.arrow_udf("array<int>")(by_rows(ids_of(spark, table, unk)))


def ids_of(spark, table: dict[str, int], unk: int = 0) -> Callable[[pa.Array], pa.Array]:
    """The same for arrays, in tasks."""
    known = [(t, i) for t, i in table.items() if i is not None]
    sent = spark.sparkContext.broadcast(([t for t, _ in known], [i for _, i in known]))

    def run(x: pa.Array) -> pa.Array:
        tokens, ids = sent.value
        at = np.asarray(pc.fill_null(pc.index_in(x.flatten(), value_set=pa.array(tokens, pa.string()), skip_nulls=True), -1))
        return lists(sizes_of(x), pa.array(np.append(np.array(ids, np.int64), unk)[at].astype(np.int32)))

    return run


def by_word(cut: Callable[[str], list[str]]) -> Callable[[Column | str], Column]:
    """A column function: an array of words as the pieces that ``cut`` makes of them, one word's after the other. A distinct word
    of a batch is cut once, and a task remembers ``MAX_SEEN`` of them; empty words and nulls have no pieces."""
    seen: dict[str, list[str]] = {}

    @F.arrow_udf("array<string>")
    def run(x: pa.Array) -> pa.Array:
        enc = x.flatten().dictionary_encode()
        words = enc.dictionary.to_pylist()
        if len(seen) > MAX_SEEN:
            seen.clear()
        made = []
        for w in words:
            if w not in seen:
                seen[w] = cut(w) if w else []
            made.append(seen[w])
        counts = np.array([*map(len, made), 0], np.int64)
        at = np.asarray(pc.fill_null(enc.indices, len(words))).astype(np.int64)
        pieces = pa.array([p for m in made for p in m], pa.string()).take(pa.array(ranges(offsets_of(counts[:-1])[at], counts[at])))
        upto = offsets_of(counts[at])[offsets_of(sizes_of(x))]
        return lists(np.diff(upto), pieces)

    return run


def tokenize_chars(x: Column | str) -> Column:
    return F.filter(F.split(F.replace(F.lower(x), F.lit(" "), F.lit("")), ""), lambda c: c != "")


def to_ids(rows: DataFrame, keys: list[str], tokens: str, vocab: DataFrame, *, unk: int = 0, max_len: int | None = None, held: int = MAX_HELD) -> tuple[DataFrame, DataFrame]:
    """((keys, ids), (keys, size)): ids of token arrays, unknown ones as ``unk``, and the rows that are longer than
    ``max_len``, which are kept apart instead of failing. Keys name a row."""
    good, bad = rows, rows.where(F.lit(False))
    if max_len is not None:
        good, bad = rows.where(F.size(tokens) <= max_len), rows.where(F.size(tokens) > max_len)
    apart = bad.select(*keys, F.size(tokens).alias("size"))
    table = held_table(vocab, "token", "id", held) if dict(vocab.dtypes)["id"] == "int" else None
    if table is not None:
        return good.select(*keys, id_lookup(rows.sparkSession, table, unk)(tokens).alias("ids")), apart
    flat = good.select(*keys, F.posexplode_outer(tokens).alias("_pos", "token"))
    ids = flat.join(vocab.groupBy("token").agg(F.max("id").alias("id")), "token", "left")
    one = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("id", F.lit(unk)).alias("id")))
    out = ids.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(one)), lambda p: p["id"]).alias("ids"))
    return out, apart


def to_ids_two(rows: DataFrame, keys: list[str], tokens: str, words: DataFrame, pieces: DataFrame, *, unk: int = 0, offset_unk: bool = True) -> DataFrame:
    """(keys, ids): word ids first; pieces follow at the size of the word list. An unknown piece is the pieces' ``unk``, at
    its own place (or, with ``offset_unk=False``, at that of word ``unk``)."""
    size = words.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("_size"))
    both = words.select("token", "id", F.lit(0).alias("_kind")).unionAll(pieces.select("token", "id", F.lit(1).alias("_kind")))
    best = both.groupBy("token").agg(F.min_by(F.struct("id", "_kind"), "_kind").alias("b"))
    at = size.first()["_size"]
    placed = best.select("token", (F.col("b.id") + F.col("b._kind") * at).alias("id"))
    return to_ids(rows, keys, tokens, placed, unk=unk + (at if offset_unk else 0))[0]


def to_tokens(rows: DataFrame, keys: list[str], ids: str, vocab: DataFrame, *, held: int = MAX_HELD) -> DataFrame:
    """(keys, tokens): null for an id that ``vocab`` (id, token) does not have."""
    listed = vocab.select("id", "token").limit(held + 1).collect()
    if len(listed) <= held and len({r["id"] for r in listed}) == len(listed):
        known = sorted((r["id"], r["token"]) for r in listed if r["id"] is not None)
        sent = rows.sparkSession.sparkContext.broadcast(([i for i, _ in known], [t for _, t in known]))

        @F.arrow_udf("array<string>")
        def run(x: pa.Array) -> pa.Array:
            numbers, names = sent.value
            at = pc.index_in(x.flatten().cast(pa.int64()), value_set=pa.array(numbers, pa.int64()), skip_nulls=True)
            return lists(sizes_of(x), pa.array(names, pa.string()).take(at))

        return rows.select(*keys, run(ids).alias("tokens"))
    flat = rows.select(*keys, F.posexplode_outer(ids).alias("_pos", "id")).join(vocab.select("id", "token"), "id", "left")
    one = F.when(F.col("_pos").isNotNull(), F.struct("_pos", "token"))
    return flat.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(one)), lambda p: p["token"]).alias("tokens"))


def oov_rate(rows: DataFrame, by: list[str], tokens: str, vocab: DataFrame) -> DataFrame:
    """(by, n, oov): counted by token first, so the vocabulary meets each distinct token once a group."""
    counts = rows.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))
    known = counts.join(vocab.select("token", F.lit(1).alias("_in")).distinct(), "token", "left")
    return known.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("_in").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("oov"))


def wordpiece(word: str, vocab, unk: str = "[UNK]", longest: int = 100) -> list[str]:
    """Greedy longest match; continuations start with ##. ``vocab`` holds pieces."""
    if len(word) > longest:
        return [unk]
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab), None)
        if end is None:
            return [unk]
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out


def unigram(word: str, scores: dict[str, float], longest: int, unk: str | None = "[UNK]", worst: float | None = None) -> list[str]:
    """The segmentation of the highest total score; a character without a piece is unknown (or itself, if ``unk`` is None), and
    counts as ``worst``, ten below the least score."""
    worst = min(scores.values(), default=0.0) - 10.0 if worst is None else worst
    best: list[tuple[float, int, bool]] = [(0.0, 0, True)]
    for end in range(1, len(word) + 1):
        cell = (best[end - 1][0] + worst, end - 1, False)
        for start in range(max(0, end - longest), end):
            s = scores.get(word[start:end])
            if s is not None and best[start][0] + s > cell[0]:
                cell = (best[start][0] + s, start, True)
        best.append(cell)
    out, end = [], len(word)
    while end:
        _, start, known = best[end]
        out.append(word[start:end] if known or unk is None else unk)
        end = start
    return out[::-1]


def _segmented(words: DataFrame, vocab: DataFrame, segment, marks: bool, held: int) -> DataFrame:
    """The rows (word, ...) with ``pieces``: ``segment(word, table, longest)`` of each, over a table of (token, score) that holds
    at least the pieces in the word. Up to ``held`` pieces are held by tasks; of a larger vocabulary a word gets those that
    its substrings join to (with ``marks`` those inside it are joined by their ## form). Both give the same rows."""
    size = F.length(F.regexp_replace("token", "^##", "")) if marks else F.length("token")
    longest = vocab.agg(F.max(size)).first()[0] or 1
    rows = vocab.select("token", "score").limit(held + 1).collect()
    fields = ", ".join(f"`{n}` {t}" for n, t in words.dtypes)
    if len(rows) <= held:
        table = vocab.sparkSession.sparkContext.broadcast({r["token"]: r["score"] for r in rows})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["pieces"] = [segment(w, table.value, longest) for w in b["word"]]
                yield b

        return words.mapInPandas(run, f"{fields}, pieces array<string>")
    starts = words.select("word").distinct().select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("a"))
    cuts = starts.select("word", "a", F.explode(F.sequence(F.col("a") + 1, F.least(F.length("word"), F.col("a") + longest))).alias("b"))
    piece = F.substring(F.col("word"), F.col("a") + 1, F.col("b") - F.col("a"))
    cuts = cuts.select("word", (F.when(F.col("a") > 0, F.concat(F.lit("##"), piece)).otherwise(piece) if marks else piece).alias("token")).distinct()
    own = cuts.join(vocab.select("token", "score"), "token").groupBy("word").agg(F.collect_list("token").alias("_t"), F.collect_list(F.coalesce("score", F.lit(0.0))).alias("_s"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["pieces"] = [segment(w, {} if t is None else dict(zip(t, s)), longest) for w, t, s in zip(b["word"], b.pop("_t"), b.pop("_s"))]
            yield b

    return words.join(own, "word", "left").select(*words.columns, "_t", "_s").mapInPandas(joined, f"{fields}, pieces array<string>")


def segment_words(rows: DataFrame, keys: list[str], words: str, vocab: DataFrame, segment, marks: bool, held: int) -> DataFrame:
    """(keys, tokens): each distinct word of the arrays segmented once, joined back in order."""
    flat = rows.select(*keys, F.posexplode_outer(words).alias("_pos", "word"))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct = flat.where("word != ''").select("word").repartition(parts, "word").distinct()
    pieces = _segmented(distinct, vocab, segment, marks, held)
    one = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("pieces", F.array().cast("array<string>")).alias("pieces")))
    return flat.join(pieces, "word", "left").groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda p: p["pieces"])).alias("tokens"))


def tokenize_wordpiece(rows: DataFrame, keys: list[str], words: str, vocab: DataFrame, *, unk: str = "[UNK]", longest: int = 100, held: int = MAX_HELD) -> DataFrame:
    """``vocab``: (token), distinct; of any size."""
    scored = vocab.select("token", F.lit(0.0).alias("score"))
    table = held_table(scored, "token", "score", held)
    if table is not None:
        sent = rows.sparkSession.sparkContext.broadcast(set(table))
        return rows.select(*keys, by_word(lambda w: wordpiece(w, sent.value, unk, longest))(words).alias("tokens"))
    return segment_words(rows, keys, words, scored, lambda w, v, _: wordpiece(w, v, unk, longest), True, held)


def tokenize_unigram(rows: DataFrame, keys: list[str], words: str, scored: DataFrame, *, unk: str = "[UNK]", held: int = MAX_HELD) -> DataFrame:
    """``scored``: (token, score), tokens distinct; of any size."""
    table = held_table(scored, "token", "score", held)
    if table is not None:
        least, most = min(table.values(), default=0.0) - 10.0, max(map(len, table), default=1)
        sent = rows.sparkSession.sparkContext.broadcast(table)
        return rows.select(*keys, by_word(lambda w: unigram(w, sent.value, most, unk, least))(words).alias("tokens"))
    worst = (scored.agg(F.min("score")).first()[0] or 0.0) - 10.0
    return segment_words(rows, keys, words, scored, lambda w, v, n: unigram(w, v, n, unk, worst), False, held)


def words_first(rows: DataFrame, keys: list[str], words: str, listed: DataFrame, book: DataFrame, scored: DataFrame, sep: str = T.SEP, *, held: int = MAX_HELD) -> DataFrame:
    """(keys, tokens): a word of the list (token) stays whole; any other is taken apart. Of its characters those of the list
    stay as they are, literals are shifted, and others become their code in ``book`` (ch, code), or stay without one, and are
    cut into the likeliest pieces of ``scored`` (token, score); what is not of the list has a separator before every piece.
    A character without a piece is a piece of its own.

    Only distinct characters are coded and cut: an alphabet, whatever the corpus. :func:`to_ids_two` gives the tokens' ids, with
    :func:`marked` pieces behind the words.
    """
    tables = held_table(listed.select("token", F.lit(1).alias("n")), "token", "n", held), held_table(book, "ch", "code", held), held_table(scored, "token", "score", held)
    if all(t is not None for t in tables):
        sent = rows.sparkSession.sparkContext.broadcast(tables)
        least, most = min(tables[2].values(), default=0.0) - 10.0, max(map(len, tables[2]), default=1)

        def cut(word: str) -> list[str]:
            whole, codes, scores = sent.value
            if word in whole:
                return [word]
            out = []
            for c in word:
                if c in whole:
                    out.append(c)
                elif c in T.LITERALS:
                    out.append(sep + chr(ord(c) + T.SHIFT))
                else:
                    code = codes.get(c)
                    out += [sep + p for p in unigram(c if code is None else code, scores, most, None, least)]
            return out

        return rows.select(*keys, by_word(cut)(words).alias("tokens"))
    flat = rows.select(*keys, F.posexplode_outer(words).alias("_w", "word"))
    known = listed.select(F.col("token").alias("word"), F.lit(True).alias("_whole")).distinct()
    split = flat.join(known, "word", "left").select(*keys, "_w", F.posexplode_outer(F.when(F.col("_whole"), F.array("word")).otherwise(F.filter(F.split("word", ""), lambda c: c != ""))).alias("_c", "token"), "_whole")
    found = split.join(listed.select("token", F.lit(True).alias("_in")).distinct(), "token", "left")
    whole, literal = F.coalesce("_whole", "_in", F.lit(False)), F.col("token").isin(list(T.LITERALS))
    found = found.withColumn("_cut", F.when(~whole & ~literal, F.col("token")))
    codes = found.where(F.col("_cut").isNotNull()).select(F.col("_cut").alias("ch")).distinct().join(book.groupBy("ch").agg(F.max("code").alias("code")), "ch", "left")
    pieces = segmented(codes.select("ch", F.coalesce("code", "ch").alias("word")).where("word != ''"), scored).select(F.col("ch").alias("_cut"), F.transform("pieces", lambda p: F.concat(F.lit(sep), p)).alias("_pieces"))
    moved = F.array(F.concat(F.lit(sep), T.shift_literals("token")))
    token = F.when(whole, F.array("token")).when(literal, moved).otherwise(F.coalesce("_pieces", F.array().cast("array<string>")))
    one = F.when(F.col("token").isNotNull(), F.struct("_w", "_c", token.alias("t")))
    return found.join(pieces, "_cut", "left").groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda p: p["t"])).alias("tokens"))


def segmented(words: DataFrame, scored: DataFrame, *, held: int = MAX_HELD) -> DataFrame:
    """The rows with ``pieces``: the likeliest of their ``word``, a character without a piece as it is."""
    worst = (scored.agg(F.min("score")).first()[0] or 0.0) - 10.0
    return _segmented(words, scored, lambda w, v, n: unigram(w, v, n, None, worst), False, held)


def marked(pieces: DataFrame, sep: str = T.SEP) -> DataFrame:
    """A piece vocabulary (id, token) as :func:`words_first` writes its pieces."""
    return pieces.withColumn("token", F.concat(F.lit(sep), F.col("token")))
