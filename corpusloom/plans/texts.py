"""Queries of text normalisation, on the lines of the documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.plans.base import HANZI, LATIN, LINES, lines, query

H_SQL = f"translate(line, '{LATIN}', '{HANZI}')"
WS = r"[\t\n\x0B\f\r\p{Z}\x85\x1C-\x1F]"


def hanzi() -> Column:
    return F.translate("line", LATIN, HANZI)


def of_lines(name: str, make, sql: str) -> None:
    """A query (doc_id, line_no, out) of one expression."""
    query(name, f"WITH {LINES} SELECT doc_id, line_no, {sql} AS out FROM lines")(lambda s, d: lines(s, d).select("doc_id", "line_no", make().alias("out")))


TOKENS_SQL = "list_filter(string_split_regex(%s, '\\s+'), lambda w: w <> '')"
joined = lambda c: F.array_join(c, "|")
of_lines("fold_punct", lambda: T.fold_punct(hanzi()), f"translate({H_SQL}, '{T.WIDE_MARKS}', '{T.ASCII_MARKS}')")
of_lines("shift_literals", lambda: T.shift_literals(F.lower("line")), f"translate(lower(line), '{T.LITERALS}', '{T.SHIFTED}')")
of_lines("shift_letters", lambda: T.shift_letters(F.lower("line"), "abc"), "array_to_string(list_transform(string_split(lower(line), ''), lambda c: CASE WHEN regexp_matches(c, '^\\p{L}$') AND c NOT IN ('a', 'b', 'c') THEN chr(unicode(c) + 50000) ELSE c END), '')")
of_lines("lower_strip", lambda: T.lower_strip("line"), "regexp_replace(lower(line), '\\s', '', 'g')")
of_lines("drop_digits", lambda: T.drop_digits("line"), "regexp_replace(line, '[0-9]', '', 'g')")
of_lines("normalise_quotes", lambda: T.normalise_quotes(F.translate("line", "aeou", "“’—…")), "replace(translate(replace(translate(line, 'aeou', '“’—…'), '……', '......'), '“”‘’—―', '\"\"''''--'), '…', '...')")
of_lines("drop_zero_width", lambda: T.drop_zero_width(F.translate("line", "ae", "\u200b\u00a0")), "replace(replace(translate(line, 'ae', chr(8203) || chr(160)), chr(8203), ''), chr(160), '')")
of_lines("clean_text", lambda: T.clean_text(F.translate("line", "aeo", "\u200b\t\u00a0")), "regexp_replace(regexp_replace(translate(line, 'aeo', chr(8203) || chr(9) || chr(160)), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\x{FFFD}\\p{Cf}\\p{Co}]', '', 'g'), '[\\t\\n\\r\\p{Zs}]', ' ', 'g')")
of_lines("space_cjk", lambda: T.space_cjk(hanzi()), f"regexp_replace({H_SQL}, '([{T.CJK}])', ' \\1 ', 'g')")
of_lines("strip_accents", lambda: T.strip_accents("line"), "array_to_string(list_transform(string_split(line, ''), lambda c: CASE WHEN c = 'ß' THEN c ELSE strip_accents(c) END), '')")
of_lines("split_on_punct", lambda: joined(T.split_on_punct(hanzi())), f"array_to_string({TOKENS_SQL % f'''regexp_replace({H_SQL}, '([{T.PUNCT}])', ' {chr(92)}1 ', 'g')'''}, '|')")
of_lines("basic_tokenize", lambda: joined(T.basic_tokenize(hanzi())), "array_to_string(" + TOKENS_SQL % f"regexp_replace(array_to_string(list_transform(string_split(lower(regexp_replace({H_SQL}, '([{T.CJK}])', ' \\1 ', 'g')), ''), lambda c: CASE WHEN c = 'ß' THEN c ELSE strip_accents(c) END), ''), '([{T.PUNCT}])', ' \\1 ', 'g')" + ", '|')")
of_lines("remove_scored_punct", lambda: T.remove_scored_punct(hanzi()), f"array_to_string(list_filter(string_split(lower(trim({H_SQL})), ''), lambda c: NOT contains('{T.SCORED_MARKS}', c)), '')")
of_lines("scored_segments", lambda: joined(T.scored_segments(hanzi())), f"array_to_string(regexp_extract_all(lower(trim({H_SQL})), '[\\x{{4E00}}-\\x{{9FA5}}{T._class(T.SCORED_MARKS)}]|[a-zßà-ÿ0-9]+|[^\\s\\p{{L}}\\p{{N}}]'), '|')")
of_lines("reader_tokens", lambda: joined(T.reader_tokens(hanzi())), "array_to_string(" + TOKENS_SQL % f"regexp_replace({H_SQL}, '([{T.CJK}{T.PUNCT}])', ' \\1 ', 'g')" + ", '|')")
of_lines("blank_tokens", lambda: joined(T.blank_tokens(F.concat(F.lit("#idiom000123#"), hanzi()))), f"array_to_string(regexp_extract_all('#idiom000123#' || {H_SQL}, '#idiom\\d{{6}}#|[{T.CJK}{T.PUNCT}]|[^\\s{T.CJK}{T.PUNCT}]+'), '|')")
for _name, _test, _re in (("is_cjk", T.is_cjk, T.CJK), ("is_punct", T.is_punct, T.PUNCT), ("is_space_or_control", lambda c: T.is_space(c) | T.is_control(c), r"\s\p{Zs}\p{Cc}\p{Cf}")):
    query(_name, f"WITH {LINES} SELECT c, count(*) AS n, bool_and(regexp_matches(c, '^[{_re}]$')) AS out FROM (SELECT unnest(string_split({H_SQL}, '')) AS c FROM lines) WHERE c <> '' GROUP BY c")(
        lambda s, d, t=_test: lines(s, d).select(F.explode(F.split(hanzi(), "")).alias("c")).where("c != ''").groupBy("c").agg(F.count("*").alias("n")).select("c", "n", t("c").alias("out"))
    )


@query("min_length_filter", f"WITH {LINES} SELECT doc_id, line_no, length(trim(line))::INTEGER AS n FROM lines WHERE length(trim(line)) > 3")
def min_length_filter(spark, sf_dir):
    return lines(spark, sf_dir).where(F.length(F.trim("line")) > 3).select("doc_id", "line_no", F.length(F.trim("line")).alias("n"))


@query("sentence_split", f"WITH {LINES}, s AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^!?？！。.]+[!?？！。.]?') AS s FROM lines) SELECT doc_id, line_no, unnest(range(len(s))) AS sent_no, unnest(s) AS sentence FROM s")
def sentence_split(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", F.posexplode(T.sentence_split("line")).alias("sent_no", "sentence")).withColumn("sent_no", F.col("sent_no").cast("long"))
