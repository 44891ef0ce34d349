"""Decoding of model scores and label sequences into answers and entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def top_n(rows: DataFrame, keys: list[str], scores: str, n: int) -> DataFrame:
    """(keys, idx, score, rank): the ``n`` largest scores of an array, ties by place; inside the row, without a shuffle."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("idx")))
    best = F.slice(F.array_sort(pairs), 1, n)
    return rows.select(*keys, F.posexplode(best).alias("k", "b")).select(*keys, F.col("b.idx").alias("idx"), (-F.col("b.neg")).alias("score"), (F.col("k") + 1).alias("rank"))


def argmax_class(scores: Column | str) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def match_results(features: DataFrame, scores: DataFrame, key: str = "unique_id") -> DataFrame:
    """Features that have scores. Positions are joined by an explicit key, never by order."""
    return features.join(scores, key)


def span_candidates(rows: DataFrame, keys: list[str], starts: str, ends: str, n: int, longest: int, *, n_tokens: Column | None = None, source: Column | None = None, max_context: Column | None = None) -> DataFrame:
    """(keys, s, e, score): pairs of the ``n`` best starts and ends with s <= e < s + longest. At most n * n a row, made
    inside it, without a shuffle. Of the best, places from ``n_tokens`` on, places without a source token (``source``: array,
    null for none) and starts that have their most context in another window (``max_context``: array of booleans) do not count."""

    def best(scores: str, is_start: bool) -> Column:
        def good(p: Column) -> Column:
            out = F.lit(True)
            if n_tokens is not None:
                out = out & (p["idx"] < n_tokens)
            if source is not None:
                out = out & F.get(source, p["idx"]).isNotNull()
            if max_context is not None and is_start:
                out = out & F.coalesce(F.get(max_context, p["idx"]), F.lit(False))
            return out

        pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("idx")))
        return F.filter(F.slice(F.array_sort(pairs), 1, n), good)

    found = rows.select(*keys, F.explode(best(starts, True)).alias("_a"), best(ends, False).alias("_ends")).select(*keys, "_a", F.explode("_ends").alias("_b"))
    out = found.select(*keys, F.col("_a.idx").alias("s"), F.col("_b.idx").alias("e"), (-F.col("_a.neg") - F.col("_b.neg")).alias("score"))
    return out.where(f"e >= s AND e < s + {longest}")


def span_beam(
    rows: DataFrame, keys: list[str], start_idx: str, start_score: str, end_idx: str, end_score: str, k: int, longest: int,
    *, n_tokens: Column | None = None, max_context: Column | None = None, text: Column | None = None, first_char: Column | None = None, last_char: Column | None = None,
) -> DataFrame:
    """The same on given lists: the ends of start i stand at i * k to i * k + k - 1. The last of ``n_tokens`` places, and
    places after it, are none of the passage's; starts that have their most context in another window do not count. With the
    passage's ``text`` and the first and last character of each place there are also ``char_start``, ``char_end`` and
    ``answer``, cut from the text by character."""
    s = rows.select("*", F.posexplode(start_idx).alias("_i", "s"))
    both = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_j")).withColumn("_at", F.col("_i") * k + F.col("_j"))
    both = both.withColumns({"e": F.get(end_idx, F.col("_at")), "score": F.get(start_score, F.col("_i")) + F.get(end_score, F.col("_at"))}).where(f"e >= s AND e < s + {longest}")
    if n_tokens is not None:
        both = both.where((F.col("s") < n_tokens - 1) & (F.col("e") < n_tokens - 1))
    if max_context is not None:
        both = both.where(F.coalesce(F.get(max_context, F.col("s").cast("int")), F.lit(False)))
    made = ["s", "e", "score"]
    if text is not None:
        both = both.withColumns({"char_start": F.get(first_char, F.col("s").cast("int")), "char_end": F.get(last_char, F.col("e").cast("int"))})
        both = both.withColumn("answer", F.substring(text, F.col("char_start") + 1, F.col("char_end") - F.col("char_start") + 1))
        made += ["char_start", "char_end", "answer"]
    return both.select(*keys, *made)


def nbest(candidates: DataFrame, question: list[str], text: str, n: int, *, questions: DataFrame | None = None) -> DataFrame:
    """(question, rank, text, score): each text once with its best score, the ``n`` best; questions without any get 'empty'."""
    once = candidates.groupBy(*question, text).agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(*question).orderBy(F.desc("score"), text))).where(F.col("rank") <= n)
    out = ranked.select(*question, "rank", F.col(text).alias("text"), "score")
    if questions is None:
        return out
    none = questions.join(out.select(*question).distinct(), question, "left_anti")
    return out.unionByName(none.select(*question, F.lit(1).alias("rank"), F.lit("empty").alias("text"), F.lit(0.0).alias("score")))


def softmax(rows: DataFrame, group: list[str], score: str) -> DataFrame:
    """The rows with ``prob``, shifted by the group's maximum."""
    w = Window.partitionBy(*group)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return rows.withColumn("_e", e).withColumn("prob", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def null_answer(best: DataFrame, nulls: DataFrame, question: list[str], threshold: float) -> DataFrame:
    """(question, text): empty where the smallest null score of a question's windows is above the best one by more than the
    threshold. ``best``: (question, text, score); ``nulls``: (question, null_score)."""
    least = nulls.groupBy(*question).agg(F.min("null_score").alias("_null"))
    both = best.join(least, question, "left")
    return both.select(*question, F.when(F.col("_null") - F.col("score") > threshold, "").otherwise(F.col("text")).alias("text"))


def span_text(tokens: Column, start: Column, end: Column, sep: str = " ") -> Column:
    """The source tokens of a span, joined."""
    return F.array_join(F.slice(tokens, start + 1, end - start + 1), sep)


def final_text(pieces: Column, source: Column) -> Column:
    """The part of ``source`` that predicted pieces (``##`` before those that go on) stand for, in its own letter case and
    spaces. The source is tokenised, the prediction is found in it, and characters are matched one to one, spaces apart; where
    that fails the whole source is the answer (so, too, where the source itself has ``##``)."""
    said = F.replace(F.array_join(pieces, ""), F.lit("##"), F.lit(""))
    plain = F.array_join(T.basic_tokenize(source), "")
    places = F.filter(F.transform(F.split(source, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: ~x["c"].isin("", " "))
    at = F.instr(plain, said) - 1
    first, last = F.get(places, at)["i"], F.get(places, at + F.length(said) - 1)["i"]
    good = (F.length(said) > 0) & (at >= 0) & (F.size(places) == F.length(plain))
    return F.when(good, F.substring(source, first + 1, last - first + 1)).otherwise(source)


def filled_at(values: Column, at: Column, *, is_start: bool) -> Column:
    """What :func:`align.nearest_filled` puts at place ``at`` of an array with nulls; null if all are null."""
    some = lambda x: F.filter(x, lambda v: v.isNotNull())
    lo = F.try_element_at(some(F.slice(values, F.lit(1), at + 1)), F.lit(-1))
    hi = F.get(some(F.slice(values, at + 1, F.greatest(F.size(values) - at, F.lit(0)))), F.lit(0))
    only_right = F.when(hi >= 1, F.lit(0) if is_start else hi - 1).otherwise(hi)
    between = F.when(hi > lo + 1, lo + 1 if is_start else hi - 1).otherwise(hi if is_start else lo)
    here = F.get(values, at)
    return F.when(here.isNotNull(), here).when(lo.isNull(), only_right).when(hi.isNull(), lo).otherwise(between)


def span_two_level(candidates: DataFrame, keys: list[str], features: DataFrame) -> DataFrame:
    """(keys, s, e, first, last, answer, score): the best span of each row in sub-characters, the tokens it reaches and the
    answer in the source text.

    ``candidates``: (keys, s, e, score), see :func:`span_candidates`, over the sub-characters of a feature. ``features``: (keys,
    subs, owner, tokens): owner is the token of each sub-character, null where there is none; an end without a token goes to
    the nearest filled place inside the span's side. The predicted sub-characters are then found in the tokens' own text
    (:func:`final_text`), so letters come back in their case. Of equal spans the first counts; a row has none if no
    sub-character has a token.
    """
    best = candidates.groupBy(*keys).agg(F.min_by(F.struct("s", "e", "score"), F.struct(-F.col("score"), F.col("s"), F.col("e"))).alias("b")).select(*keys, "b.*")
    at = best.join(features, keys).where((F.col("s") >= 0) & (F.col("e") < F.size("subs")))
    s, e = F.col("s").cast("int"), F.col("e").cast("int")
    at = at.withColumns({"first": filled_at(F.col("owner"), s, is_start=True), "last": filled_at(F.col("owner"), e, is_start=False)}).where("first is not null")
    at = at.withColumn("last", F.greatest("first", "last"))
    source = F.array_join(F.slice("tokens", F.col("first") + 1, F.col("last") - F.col("first") + 1), " ")
    said = F.slice("subs", s + 1, e - s + 1)
    return at.select(*keys, "s", "e", "first", "last", final_text(said, source).alias("answer"), "score")


def assign_argmax(scores: DataFrame, blank: list[str]) -> DataFrame:
    """(blank, choice): each blank's best choice, the first of equals. ``scores``: (blank, choice, score)."""
    return scores.groupBy(*blank).agg(F.min_by("choice", F.struct(-F.col("score"), F.col("choice"))).alias("choice"))


def assign_greedy(scores: DataFrame, passage: str, blank: str) -> DataFrame:
    """(passage, blank, choice): within a passage the best free pair of blank and choice is taken again and again."""
    kinds = dict(scores.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, free, out = set(), set(), []
        for r in pdf.sort_values(["score", blank, "choice"], ascending=[False, True, True]).itertuples(index=False):
            b, c = getattr(r, blank), r.choice
            if b not in taken and c not in free:
                taken.add(b)
                free.add(c)
                out.append((getattr(r, passage), b, c))
        return pd.DataFrame(out, columns=[passage, blank, "choice"])

    return scores.select(passage, blank, "choice", "score").groupBy(passage).applyInPandas(one, f"{passage} {kinds[passage]}, {blank} {kinds[blank]}, choice {kinds['choice']}")


def _islands(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Each label with its kind, type and island: a label that is no I begins one."""
    kind, type_ = F.substring("label", 1, 1), F.substring_index("label", "-", -1)
    starts = F.when(~F.col("label").startswith("I-"), 1).otherwise(0)
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return labels.select(*keys, "pos", "label", kind.alias("kind"), type_.alias("type"), F.sum(starts).over(order).alias("island"))


def _entities(labels: DataFrame, keys: list[str], *, strict: bool, single: bool) -> DataFrame:
    rows = _islands(labels, keys)
    head = Window.partitionBy(*keys, "island").orderBy("pos")
    rows = rows.withColumns({"_kind": F.first("kind").over(head), "_type": F.first("type").over(head), "_at": F.first("pos").over(head), "_n": F.row_number().over(head)})
    same = F.col("type") == F.col("_type")
    if strict:  # a change of type ends the entity
        whole = F.min(same.cast("int")).over(head.rowsBetween(Window.unboundedPreceding, 0)) == 1
        rows = rows.withColumn("_ok", whole)
    else:
        rows = rows.withColumn("_ok", same)
    b = rows.where("_kind = 'B' AND _ok AND label != 'O'").groupBy(*keys, "island").agg(F.first("_type").alias("type"), F.min("_at").alias("start"), F.max("pos").alias("end"), F.max("_n").alias("_n"))
    b = b if single else b.where("_n > 1")
    return b.select(*keys, "type", "start", "end")


def decode_bios(labels: DataFrame, keys: list[str], *, strict: bool = True) -> DataFrame:
    """(keys, type, start, end), end inclusive, of labels (keys, pos, label). ``strict=False`` drops entities of a lone B and
    lets an entity go on past pieces of another type."""
    s = labels.where("label LIKE 'S-%'").select(*keys, F.substring_index("label", "-", -1).alias("type"), F.col("pos").alias("start"), F.col("pos").alias("end"))
    return s.unionByName(_entities(labels, keys, strict=strict, single=strict))


def decode_bio(labels: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`decode_bios` without S; a lone B is an entity."""
    return _entities(labels, keys, strict=False, single=True)


def decode_start_end(marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, type, start, end): for each start mark the first end mark of its type at its place or later. ``marks``:
    (keys, pos, s, e), null or 'O' for none."""
    order = Window.partitionBy(*keys, "type").orderBy(F.desc("pos"), F.desc("_end")).rowsBetween(Window.unboundedPreceding, 0)
    ends = marks.where("e IS NOT NULL AND e != 'O'").select(*keys, F.col("e").alias("type"), "pos", F.lit(1).alias("_end"))
    starts = marks.where("s IS NOT NULL AND s != 'O'").select(*keys, F.col("s").alias("type"), "pos", F.lit(0).alias("_end"))
    near = starts.unionByName(ends).withColumn("end", F.last(F.when(F.col("_end") == 1, F.col("pos")), ignorenulls=True).over(order))
    return near.where("_end = 0 AND end IS NOT NULL").select(*keys, "type", F.col("pos").alias("start"), "end")


def entity_submission(entities: DataFrame, key: list[str]) -> DataFrame:
    """(key, label): JSON of type -> text -> spans. ``entities``: (key, type, text, start, end)."""
    spans = entities.groupBy(*key, "type", "text").agg(F.array_sort(F.collect_list(F.array("start", "end"))).alias("spans"))
    texts = spans.groupBy(*key, "type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("text", "spans")))).alias("texts"))
    return texts.groupBy(*key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", F.to_json("texts").alias("t")))))).alias("label"))


def prediction_diff(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows whose values differ, both given."""
    return a.select(*key, F.col(value).alias("a")).join(b.select(*key, F.col(value).alias("b")), key).where("NOT a <=> b")
