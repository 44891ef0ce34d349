"""Queries of alignments: the words of a line against pieces of three characters of the same line."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import align as A
from corpusloom.operators import rowwise as R
from corpusloom.plans.base import LINES, lines, query

KEYS = ["doc_id", "line_no"]
SIDES = (
    f"{LINES}, w AS (SELECT doc_id, line_no, line, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS w FROM lines), "
    "tok AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS stop, stop - length(piece) AS start FROM (SELECT doc_id, line_no, unnest(range(len(w))) AS pos, unnest(w) AS piece FROM w)), "
    "sub AS (SELECT doc_id, line_no, n // 3 AS pos, n AS start, least(n + 3, size) AS stop, whole[n + 1] AS head FROM (SELECT doc_id, line_no, array_to_string(w, '') AS whole, length(array_to_string(w, '')) AS size, unnest(range(0, length(array_to_string(w, '')), 3)) AS n FROM w)), "
    "own AS (SELECT s.doc_id, s.line_no, s.pos, t.pos AS owner FROM sub s ASOF JOIN tok t ON s.doc_id = t.doc_id AND s.line_no = t.line_no AND s.start >= t.start)"
)


def sides(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("words", T.words("line"))
    pieces = F.regexp_extract_all(F.array_join("words", ""), F.lit("(?s).{1,3}"), 0)
    return rows.withColumn("subchars", pieces)


def each(rows, values, name):
    """(doc_id, line_no, pos, name): a row for each of ``values`` that is not null."""
    return rows.select(*KEYS, F.posexplode(values).alias("pos", name)).where(F.col(name).isNotNull())


def longs(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


@query("subchar_to_token_pos", f"WITH {SIDES} SELECT doc_id, line_no, pos, owner FROM own")
def subchar_to_token_pos(spark, sf_dir):
    return longs(each(sides(spark, sf_dir), R.owner("subchars", "words"), "owner"), "pos", "owner")


@query("token_to_subchar_pos", f"WITH {SIDES} SELECT t.doc_id, t.line_no, t.pos, s.pos AS first FROM tok t ASOF JOIN sub s ON s.doc_id = t.doc_id AND s.line_no = t.line_no AND t.start >= s.start")
def token_to_subchar_pos(spark, sf_dir):
    return longs(each(sides(spark, sf_dir), R.owner("words", "subchars"), "first"), "pos", "first")


@query("subchar_owner", f"WITH {SIDES} SELECT doc_id, line_no, string_agg(owner::VARCHAR, ' ' ORDER BY pos) AS owners FROM own GROUP BY doc_id, line_no")
def subchar_owner(spark, sf_dir):
    own = sides(spark, sf_dir).where("size(subchars) > 0").select(*KEYS, R.owner("subchars", "words").alias("own"))
    return own.select(*KEYS, F.array_join(F.col("own").cast("array<string>"), " ").alias("owners"))


@query("inverse_text_index", f"WITH {SIDES}, c AS (SELECT doc_id, line_no, text_pos, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY text_pos) - 1 AS start FROM (SELECT doc_id, line_no, unnest(range(length(line))) AS text_pos, unnest(list_filter(string_split(line, ''), lambda x: x <> '')) AS ch FROM lines) WHERE ch <> ' ') SELECT t.doc_id, t.line_no, t.pos, c.text_pos FROM tok t JOIN c USING (doc_id, line_no, start) UNION ALL SELECT doc_id, line_no, len(w), length(line) FROM w WHERE len(w) > 0")
def inverse_text_index(spark, sf_dir):
    return longs(each(sides(spark, sf_dir), R.text_index("line", "words"), "text_pos"), "pos", "text_pos")


SPANS = "spans AS (SELECT doc_id, line_no, 'T' || (pos % 3) AS type, start, least(start + 2 * (pos % 4) + 1, size) AS stop FROM (SELECT sub.*, max(stop) OVER (PARTITION BY doc_id, line_no) AS size FROM sub) WHERE head = 'h')"


def labelled(spark, sf_dir):
    """The lines with ``labels`` of their words: stretches of a line that begin with a certain letter."""
    rows = sides(spark, sf_dir).withColumn("size", F.length(F.array_join("words", "")))
    stretch = lambda p, i: F.when(p.startswith("h"), F.struct(F.concat(F.lit("T"), (i % 3).cast("string")).alias("type"), (3 * i).alias("start"), F.least(3 * i + 2 * (i % 4) + 1, F.col("size")).alias("stop")))
    spans = F.filter(F.transform("subchars", stretch), lambda x: x.isNotNull())
    return rows.withColumn("labels", R.token_labels(spans, F.col("words")))


#: The tokens of a span lie between those that hold its first and its last character.
LABELLED = "sa AS (SELECT s.*, t.pos AS first FROM spans s ASOF JOIN tok t ON s.doc_id = t.doc_id AND s.line_no = t.line_no AND s.start >= t.start), sb AS (SELECT s.doc_id, s.line_no, s.type, s.start AS s_start, s.first, t.pos AS final FROM (SELECT *, stop - 1 AS inner_stop FROM sa) s ASOF JOIN tok t ON s.doc_id = t.doc_id AND s.line_no = t.line_no AND s.inner_stop >= t.start), h AS (SELECT *, final - first + 1 AS n, unnest(range(first, final + 1)) AS pos FROM sb), lab AS (SELECT t.*, coalesce(l.label, 'O') AS label FROM tok t LEFT JOIN (SELECT doc_id, line_no, pos, arg_max(CASE WHEN n = 1 THEN 'S' WHEN pos = first THEN 'B' ELSE 'I' END || '-' || type, s_start) AS label FROM h GROUP BY ALL) l USING (doc_id, line_no, pos))"


@query("labels_char_to_token", f"WITH {SIDES}, {SPANS}, {LABELLED} SELECT doc_id, line_no, pos, label FROM lab")
def labels_char_to_token(spark, sf_dir):
    return longs(each(labelled(spark, sf_dir), F.col("labels"), "label"), "pos")


def spread_sql(pieces: str) -> str:
    return (
        f"WITH {SIDES}, {SPANS}, {LABELLED}, ch AS (SELECT doc_id, line_no, unnest(range(start, stop)) AS start, start AS pos FROM sub WHERE false), chars AS (SELECT doc_id, line_no, pos + k AS pos, start + k AS start FROM (SELECT doc_id, line_no, start AS pos, start, unnest(range(length(piece))) AS k FROM tok)), "
        f"x AS (SELECT p.doc_id, p.line_no, p.pos, l.label, row_number() OVER (PARTITION BY l.doc_id, l.line_no, l.pos ORDER BY p.pos) AS nth, count(*) OVER (PARTITION BY l.doc_id, l.line_no, l.pos) AS n FROM {pieces} p ASOF JOIN lab l ON p.doc_id = l.doc_id AND p.line_no = l.line_no AND p.start >= l.start) "
        "SELECT doc_id, line_no, pos::BIGINT AS pos, CASE WHEN label = 'O' OR n = 1 OR label LIKE 'I-%' THEN label WHEN nth = 1 THEN 'B-' || label[3:] ELSE 'I-' || label[3:] END AS label FROM x"
    ).replace("ch AS (SELECT doc_id, line_no, unnest(range(start, stop)) AS start, start AS pos FROM sub WHERE false), ", "")


@query("labels_char_to_subchar", spread_sql("sub"))
def labels_char_to_subchar(spark, sf_dir):
    """Words stand in for characters, pieces for sub-characters."""
    return longs(each(labelled(spark, sf_dir), R.piece_labels("labels", "words", "subchars"), "label"), "pos")


NAMES = ["O", *(f"{x}-T{k}" for k in range(3) for x in "BIS")]
EDGE, ROOM = 31, 64
BY = "PARTITION BY doc_id, line_no"
CHARS = f"{SIDES}, {SPANS}, {LABELLED}, r AS (SELECT *, label[3:] AS kind, CASE WHEN label LIKE 'I-%' AND lag(label) OVER ({BY} ORDER BY pos) <> 'O' AND lag(label[3:]) OVER ({BY} ORDER BY pos) = label[3:] THEN 0 ELSE 1 END AS fresh FROM lab), g AS (SELECT *, sum(fresh) OVER ({BY} ORDER BY pos) AS run FROM r), k AS (SELECT *, first_value(label) OVER ({BY}, run ORDER BY pos) LIKE 'B-%' AS whole, sum(stop - start) OVER ({BY}, run) AS total, min(start) OVER ({BY}, run) AS begin FROM g), c AS (SELECT *, unnest(range(start::BIGINT, stop::BIGINT)) AS c FROM k), l AS (SELECT doc_id, line_no, c, CASE WHEN label = 'O' OR (label LIKE 'I-%' AND NOT whole) THEN label WHEN CASE WHEN whole THEN total ELSE stop - start END = 1 THEN 'S-' || kind WHEN c = CASE WHEN whole THEN begin ELSE start END THEN 'B-' || kind ELSE 'I-' || kind END AS label FROM c), s AS (SELECT doc_id, line_no, count(*) AS n, string_agg(list_position({NAMES}, label)::VARCHAR, ' ' ORDER BY c) || ' ' AS ids FROM l GROUP BY ALL)"


@query("labels_token_to_char", f"WITH {CHARS} SELECT doc_id, line_no, '{EDGE} ' || coalesce(ids, '') || '{EDGE}' || repeat(' 0', greatest({ROOM} - 2 - coalesce(n, 0), 0)::INTEGER) AS ids FROM lines LEFT JOIN s USING (doc_id, line_no)")
def labels_token_to_char(spark, sf_dir):
    out = labelled(spark, sf_dir).select(*KEYS, R.label_ids(R.char_labels("labels", "words"), NAMES, ROOM, edge=EDGE).alias("ids"))
    return out.select(*KEYS, F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("pos_left_right", f"WITH {SIDES}, n AS (SELECT doc_id, line_no, len(w) AS n FROM w) SELECT doc_id, line_no, pos, owner AS \"left\", greatest(coalesce(lead(owner) OVER (PARTITION BY doc_id, line_no ORDER BY pos), n), owner + 1) AS \"right\" FROM own JOIN n USING (doc_id, line_no)")
def pos_left_right(spark, sf_dir):
    own = sides(spark, sf_dir).select(*KEYS, F.size("words").alias("n"), R.owner("subchars", "words").alias("own"))
    both = F.transform("own", lambda x, i: F.struct(x.alias("left"), F.greatest(F.coalesce(F.get("own", i + 1), F.col("n")), x + 1).alias("right")))
    return longs(each(own, both, "p").select(*KEYS, "pos", "p.left", "p.right"), "pos", "left", "right")


FILLED = "m AS (SELECT doc_id, line_no, pos, CASE WHEN (pos * 7 + doc_id) % 5 < 2 THEN owner END AS value FROM own), f AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY doc_id, line_no ORDER BY pos ROWS UNBOUNDED PRECEDING) AS l, first_value(value IGNORE NULLS) OVER (PARTITION BY doc_id, line_no ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM m)"


@query("nearest_filled", f"WITH {SIDES}, {FILLED} SELECT doc_id, line_no, pos, CASE WHEN value IS NOT NULL THEN value WHEN l IS NULL THEN CASE WHEN r >= 1 THEN 0 ELSE r END WHEN r IS NULL THEN l WHEN r > l + 1 THEN l + 1 ELSE r END AS s, CASE WHEN value IS NOT NULL THEN value WHEN l IS NULL THEN CASE WHEN r >= 1 THEN r - 1 ELSE r END WHEN r IS NULL THEN l WHEN r > l + 1 THEN r - 1 ELSE l END AS e FROM f")
def nearest_filled(spark, sf_dir):
    own = sides(spark, sf_dir).select(*KEYS, R.owner("subchars", "words").alias("own"))
    m = own.select(*KEYS, F.transform("own", lambda x, i: F.when((i * 7 + F.col("doc_id")) % 5 < 2, x)).alias("value"))
    both = m.select(*KEYS, R.nearest_filled("value", is_start=True).alias("s"), R.nearest_filled("value", is_start=False).alias("e"))
    return longs(each(both, F.arrays_zip("s", "e"), "p").select(*KEYS, "pos", "p.s", "p.e"), "pos", "s", "e")


@query("improve_span", f"WITH {SIDES}, u AS (SELECT doc_id, line_no, pos, piece, lead(piece) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS nxt FROM tok), a AS (SELECT doc_id, line_no, w[2] AS one, w[3] AS two, len(w) - 1 AS e FROM w WHERE len(w) >= 2), g AS (SELECT a.doc_id, a.line_no, min(pos) AS s FROM a JOIN u ON a.doc_id = u.doc_id AND a.line_no = u.line_no AND u.piece = a.one AND (a.two IS NULL OR u.nxt = a.two) GROUP BY ALL) SELECT a.doc_id, a.line_no, coalesce(g.s, 0)::BIGINT AS \"start\", coalesce(g.s + (a.two IS NOT NULL)::INT, a.e)::BIGINT AS \"end\" FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.line_no = g.line_no")
def improve_span(spark, sf_dir):
    """A whole line holds the answer that its second and third words are."""
    rows = lines(spark, sf_dir).withColumn("w", T.words("line")).where("size(w) >= 2")
    got = A.improve_span(F.col("w"), F.lit(0), F.size("w") - 1, F.array_join(F.slice("w", 2, 2), " "))
    return longs(rows.select(*KEYS, got.alias("g")).select(*KEYS, "g.start", "g.end"), "start", "end")
