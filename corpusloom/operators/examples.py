"""Examples of benchmark datasets, truncation in closed form, and fixed-length arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Fixed values.
FILLER = "无效答案，仅作填充"
LEADING_MARKS = ("。", "，", "：", ":", ".", ",")
BLANK, BLANK_SIZE = "[unused1]", 4


def truncate_pair(a: Column, b: Column, most: Column | int) -> tuple[Column, Column]:
    """Sizes left of two sequences when the last element of the longer is dropped (of the second, if equal) until both fit."""
    m = most if isinstance(most, Column) else F.lit(most)
    up, down = F.ceil(m / 2), F.floor(m / 2)
    fits = a + b <= m
    keep_a = F.when(fits, a).when(a <= up, a).when(b <= down, m - b).otherwise(up)
    keep_b = F.when(fits, b).when(a <= up, m - a).when(b <= down, b).otherwise(down)
    return keep_a.cast("int"), keep_b.cast("int")


def truncate_triple(a: Column, b: Column, c: Column, most: Column | int) -> tuple[Column, Column, Column]:
    """The same for three: the longest loses its last, of equal ones the first named. All end at one level; what the level
    leaves over goes back to the last named ones."""
    m = most if isinstance(most, Column) else F.lit(most)
    lo = F.array_sort(F.array(a, b, c))
    x, y = F.get(lo, F.lit(0)), F.get(lo, F.lit(1))
    level = F.when(a + b + c <= m, F.greatest(a, b, c)).when(x * 3 >= m, F.floor(m / 3)).when(x + 2 * y >= m, F.floor((m - x) / 2)).otherwise(m - x - y).cast("int")
    left = m - F.least(a, level) - F.least(b, level) - F.least(c, level)
    more = lambda s: (s > level).cast("int")
    add_c = F.when(left >= 1, more(c)).otherwise(0)
    add_b = F.when(left - add_c >= 1, more(b)).otherwise(0)
    add_a = F.when(left - add_c - add_b >= 1, more(a)).otherwise(0)
    return F.least(a, level) + add_a, F.least(b, level) + add_b, F.least(c, level) + add_c


def assemble(first: Column, second: Column | None = None, *, cls: str = "[CLS]", sep: str = "[SEP]", third: Column | None = None) -> tuple[Column, Column]:
    """([CLS] A [SEP] B [SEP], segments 0 and 1). With three parts, the second and third share segment 1."""
    c, s = F.array(F.lit(cls)), F.array(F.lit(sep))
    tokens, segments = F.concat(c, first, s), F.array_repeat(F.lit(0), F.size(first) + 2)
    for part in (second, third):
        if part is not None:
            tokens = F.concat(tokens, part, s)
            segments = F.concat(segments, F.array_repeat(F.lit(1), F.size(part) + 1))
    return tokens, segments


def padded(x: Column, size: int, value=0, *, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(size) - F.size(x), F.lit(0)))
    return F.concat(fill, x) if left else F.slice(F.concat(x, fill), 1, size)


def mask_of(x: Column, size: int) -> Column:
    return padded(F.array_repeat(F.lit(1), F.least(F.size(x), F.lit(size))), size)


def span_marked(text: Column, s1: Column, i1: Column, s2: Column, i2: Column) -> Column:
    """The text with ``_`` round the first span and ``[ ]`` round the second; null where a span is not in its place."""
    ok = (F.substring(text, i1 + 1, F.length(s1)) == s1) & (F.substring(text, i2 + 1, F.length(s2)) == s2)
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    e1, e2, n = i1 + F.length(s1), i2 + F.length(s2), F.length(text)
    first = F.concat(cut(F.lit(0), i1), F.lit("_"), s1, F.lit("_"), cut(e1, i2), F.lit("["), s2, F.lit("]"), cut(e2, n))
    second = F.concat(cut(F.lit(0), i2), F.lit("["), s2, F.lit("]"), cut(e2, i1), F.lit("_"), s1, F.lit("_"), cut(e1, n))
    return F.when(ok, F.when(i2 > i1, first).otherwise(second))


def choice_label(choices: Column, answer: Column) -> Column:
    """Index of the last choice that equals the answer."""
    return F.array_max(F.transform(choices, lambda c, i: F.when(c == answer, i)))


def padded_choices(choices: Column, n: int = 4, filler: str = FILLER) -> Column:
    return padded(choices, n, filler)


def answer_shift(text: Column, start: Column, answer: Column, reach: int = 3) -> Column:
    """The start moved by the first of -reach .. +reach at which the answer stands; the start itself where there is none."""
    hit = F.filter(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: (start + d >= 0) & (F.substring(text, start + d + 1, F.length(answer)) == answer))
    return start + F.coalesce(F.get(hit, F.lit(0)), F.lit(0))


def reading_span(text: Column, given: Column, answer: Column) -> Column:
    """struct(start, stop, matches): first and last token (:func:`T.reader_tokens`) of an answer whose start is given in
    characters. While the text there is not the answer the start goes back by a character, three times at most; white space
    and then one mark at the start are left out. ``matches`` tells whether the tokens are the answer, white space apart."""
    size, most = F.length(answer), F.least(F.lit(3), given)
    hit = F.filter(F.sequence(F.lit(0), most), lambda d: F.substring(text, given - d + 1, size) == answer)
    begin = (given - F.coalesce(F.get(hit, F.lit(0)), most)).cast("int")
    return _token_span(text, begin, begin + size - 1, answer)


def reading_span_in_converted(converted: Column, given: Column, size: Column, answer: Column) -> Column:
    """The same for a text that :func:`codebook.phrase_transducer` has converted: ``given`` and ``size`` are the answer's start
    and length in the old text, ``answer`` is the converted answer. Both ends are carried over by the transducer's offsets, a
    phrase as a whole; the start does not go back. Null where the answer does not lie in the old text."""
    begin, end = F.get(converted["starts"], given.cast("int")), F.get(converted["ends"], (given + size - 1).cast("int"))
    inside = (given >= 0) & (size > 0) & (given + size <= F.size(converted["starts"]))
    return F.when(inside, _token_span(converted["text"], begin, end - 1, answer))


def _token_span(text: Column, begin: Column, last: Column, answer: Column) -> Column:
    """struct(start, stop, matches) of the characters ``begin`` to ``last``."""
    rest = F.substring(text, begin + 1, F.length(text))
    first = begin + F.length(F.regexp_extract(rest, "^[ \t\r\n]*", 0))
    token_at = lambda p: F.size(T.reader_tokens(F.substring(text, F.lit(1), p + 1))) - 1
    tokens, at, stop = T.reader_tokens(text), token_at(first), token_at(last)
    start = at + F.coalesce(F.get(tokens, at).isin(*LEADING_MARKS), F.lit(False)).cast("int")
    said = F.array_join(F.slice(tokens, start + 1, F.greatest(stop - start + 1, F.lit(0))), "")
    return F.struct(start.alias("start"), stop.alias("stop"), (said == F.regexp_replace(answer, r"(?U)\s", "")).alias("matches"))


def cloze_examples(rows: DataFrame, keys: list[str], text: str, options: str, labels: DataFrame) -> DataFrame:
    """(keys, blank, tag, tokens, options, answer): a row for each idiom blank of a record, with the record's options and the
    answer of its tag, null where ``labels`` (keys, tag, answer) have none."""
    # a record meets its labels once, before it becomes a row for each blank
    known = labels.where(F.col("tag").isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct("tag", "answer")).alias("_known"))
    r = rows.select(*keys, F.col(options).alias("options"), F.col(text).alias("_text")).join(known, keys, "left")
    cut = r.select(*keys, "options", "_known", T.blank_tokens("_text").alias("tokens"))
    tags = F.filter("tokens", lambda t: t.rlike(f"^{T.IDIOM}$"))
    own = lambda tag: F.transform(F.filter(F.coalesce("_known", F.array()), lambda x: x["tag"] == tag), lambda x: x["answer"])
    blanks = cut.select("*", F.posexplode(tags).alias("blank", "tag"))
    return blanks.select(*keys, "blank", "tag", "tokens", "options", F.explode_outer(own(F.col("tag"))).alias("answer"))


def option_tokens(option: Column, definition: Column, most: int = 32) -> Column:
    """An option's tokens and, after a colon, those of its definition, ``most`` in all."""
    return F.slice(F.concat(option, F.array(F.lit("：")), definition), 1, most)


def cloze_tokens(option: Column, tokens: Column, tag: Column, most: int) -> Column:
    """[CLS] option [SEP] left [unused1] right [SEP], at most ``most`` tokens: the window round the blank, in which other
    blanks are masks of ``BLANK_SIZE``; what these take too much is cut at the far ends."""
    left, right = around(tokens, (F.array_position(tokens, tag) - 1).cast("int"), F.lit(most) - F.size(option) - 4)
    mask = F.array_repeat(F.lit("[MASK]"), BLANK_SIZE)
    masked = lambda side: F.flatten(F.transform(side, lambda t: F.when(t.rlike(f"^{T.IDIOM}$"), mask).otherwise(F.array(t))))
    m_left = masked(left)
    near = F.slice(m_left, F.size(m_left) - F.size(left) + 1, F.size(left))
    one = lambda t: F.array(F.lit(t))
    return F.concat(one("[CLS]"), option, one("[SEP]"), near, one(BLANK), F.slice(masked(right), F.lit(1), F.size(right)), one("[SEP]"))


def around(tokens: Column, pos: Column, n: Column | int) -> tuple[Column, Column]:
    """(left, right) tokens of a window of ``n`` round a place; where one side is short the other gets more."""
    n = n if isinstance(n, Column) else F.lit(n)
    size, half = F.size(tokens), F.floor(n / 2).cast("int")
    right = n - half
    after = size - 1 - pos
    left_n = F.when((pos >= half) & (after >= right), half).when(pos <= half, pos).otherwise(F.least(pos, n - after))
    right_n = F.when((pos >= half) & (after >= right), right).when(pos <= half, F.least(after, n - pos)).otherwise(after)
    return F.slice(tokens, pos - left_n + 1, left_n), F.slice(tokens, pos + 2, right_n)


def labels_bmes(labels: Column) -> Column:
    """M- and E- as I-."""
    return F.transform(labels, lambda x: F.regexp_replace(x, "^[ME]-", "I-"))


def without_first(rows: DataFrame, key: str) -> DataFrame:
    """The records without the first, as the formats that are read this way begin with one that is no example."""
    first = rows.agg(F.min(key).alias("_first"))
    return rows.join(F.broadcast(first), F.col(key) > F.col("_first")).drop("_first")


def label_index(rows: DataFrame, label: str, names: list[str], neutral: str | None = None) -> DataFrame:
    """The rows with ``label_id``; ``-`` counts as ``neutral``."""
    value = F.when(F.col(label) == "-", neutral).otherwise(F.col(label)) if neutral else F.col(label)
    return rows.withColumn("label_id", F.array_position(F.array(*map(F.lit, names)), value).cast("int") - 1)
