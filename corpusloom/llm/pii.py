"""Keyed surrogates for personal data, in DataFrame functions only.

Entities are found by patterns (e-mail and IP addresses, telephone, card and social-security numbers, secrets after their
name, names after a form of address), and names that a text has after a form of address are found elsewhere in it, too. Each
is replaced by a surrogate that depends on a secret key and the entity's canonical form alone, so the same entity gets the
same surrogate wherever it occurs (coreference): a telephone number with or without its country code, a given name with any
form of address. Surrogates keep type and format: a number keeps its punctuation and length, a card its first digit and a
valid check digit, a telephone number its country code, an address its private range, a secret its letters' case and kind, an
e-mail address its shape and top-level domain, a name its capitals, script and about its length. A given name keeps the gender
that most of its forms of address in the whole table tell, or else the one of its ending.

Distinct entities must get distinct surrogates, none of which is a real entity: a job over the distinct entities finds
collisions and gives all but one of each an attempt number that enters the hash, until none is left. Few entities have an
attempt number or a gender that their ending doesn't tell; up to ``MAX_EXCEPTIONS`` of them go into the rewriting expression,
more are joined to the rows that hold them. Texts are not shuffled otherwise.

Null texts stay null, and empty ones empty; every row gives one row, repeated or not; an empty table gives an empty one. Only
``text`` is read (and ``length`` if it is named); columns of any other name, null keys among them, stay as they are, but for
names that begin with ``__pii_``. Texts may be of any length.

Not found: names without a form of address anywhere in the text, street addresses, dates of birth, numbers of other documents,
telephone numbers without a country code that are not of ten digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stage_table

FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Госпожа|Κυρία"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος"
EITHER = "Dr|Prof|Professor"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
SECRET = r"(?i:token|secret|password|passwd|api_?key)\s*[=:]\s*(?:\"[0-9A-Za-z_+/.-]{16,}\"|(?=[A-Za-z_+/.-]*[0-9])[0-9A-Za-z_+/-]{16,})"
NAME = rf"\b(?:{FEMALE}|{MALE}|{EITHER})\b\.?[ ]\p{{Lu}}[\p{{L}}'-]+(?:[ ]\p{{Lu}}[\p{{L}}'-]+)?"
IP = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
IP6 = r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"
CARD = r"(?<![\d+-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)|(?<![\d+-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (
    r"(?<![\d\w])(?:\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d\w])\+\d{1,3}(?:[ .-]\(?\d{1,4}\)?){3,6}(?!\d)"
    r"|(?<![\d\w-])1[ .-]\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}(?![\d-])|(?<![\d\w])\(\d{3}\)[ ]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
)
PATTERNS = {"email": EMAIL, "secret": SECRET, "name": NAME, "ip": IP, "ip6": IP6, "card": CARD, "ssn": SSN, "phone": PHONE}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Rows without these cannot hold an entity; a cheap test spares them the patterns.
HINT = rf"[0-9@\"]|\b(?:{FEMALE}|{MALE}|{EITHER})\b"
MAX_EXCEPTIONS = 5_000
MAX_ROUNDS = 20
#: Syllables of surrogate names (fixed values), sixteen a script.
SYLLABLES = {
    "latin": "ba da fe go ka li me no pa ri sa to ve wi xa zu".split(),
    "cyrillic": "ба да фе го ка ли ме но па ри са то ве ви ха зу".split(),
    "greek": "βα δα φε γο κα λι με νο πα ρι σα το βε θι χα ζυ".split(),
}
ENDINGS = {"latin": ("a", "en", "is"), "cyrillic": ("ова", "ов", "ен"), "greek": ("α", "ος", "ις")}


def _digest(secret: str, kind: Column, canon: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(secret), kind, attempt.cast("string"), canon), 256)


def _digits(d: Column) -> Column:
    """28 digits of a digest."""
    part = [F.lpad(F.substring(F.conv(F.substring(d, k, 15), 16, 10), -14, 14), 14, "0") for k in (1, 16)]
    return F.concat(*part)


def _letters(d: Column) -> Column:
    return F.translate(d, "0123456789abcdef", "bcdfghjklmnpqrst")


def _classed(shape: Column, letters: Column, digits: Column) -> Column:
    """``shape`` with its letters and digits replaced, each by one of its class and case."""
    at = lambda source, i: F.substring(source, F.pmod(i, F.length(source)) + 1, F.lit(1))
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    new = lambda c, i: F.when(c.rlike("[a-z]"), at(letters, i)).when(c.rlike("[A-Z]"), F.upper(at(letters, i))).when(c.rlike("[0-9]"), at(digits, i)).otherwise(c)
    return F.array_join(F.transform(chars, new), "")


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits, in order, taken from ``digits``."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    at = lambda i: F.length(_only_digits(F.substring(shape, F.lit(1), i + 1)))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(c)), "")


def _luhn(body: Column) -> Column:
    """The check digit of the digits before it."""

    def worth(i: Column) -> Column:
        d = F.substring(body, i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(F.length(body) - i, F.lit(2)) == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), lambda a, i: a + worth(i))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def kind_of(match: Column) -> Column:
    """The type of a match: 'bare' for a name without its form of address; a number that only looks like a card or telephone
    number is 'other' and stays as it is."""
    kinds = [(k, match.rlike(f"^(?:{p})$")) for k, p in PATTERNS.items()]
    digits = _only_digits(match)
    short = F.substring(digits, F.lit(1), F.length(digits) - 1)
    sound = {"card": F.when(match.rlike("^[0-9]"), _luhn(short) == F.substring(digits, -1, 1)).otherwise(False), "phone": F.length(digits).between(8, 15)}
    out = F.when(match.rlike(r"^\p{Lu}"), "bare").otherwise("other")
    for kind, is_kind in reversed(kinds):
        out = F.when(is_kind & sound[kind] if kind in sound else is_kind, kind).otherwise(out)
    return out


def _script(token: Column) -> Column:
    return F.when(token.rlike(r"\p{IsCyrillic}"), "cyrillic").when(token.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _female(canon: Column) -> Column:
    """The gender of a given name by its ending, where no form of address tells."""
    return canon.rlike("[aàáâαηάήаяь]$")


def _national(match: Column) -> Column:
    """The digits of a telephone number without its country code."""
    digits = _only_digits(match)
    code = F.length(F.regexp_extract(match, r"^\+(\d{1,3})[ .(-]", 1))
    drop = F.when(code > 0, code).when(match.startswith("+") | (digits.startswith("1") & (F.length(digits) == 11)), F.greatest(F.length(digits) - 10, F.lit(1))).otherwise(0)
    return F.substring(digits, drop + 1, F.length(digits))


def parts_of(match: Column, kind: Column) -> Column:
    """The entities of a match, as structs of type, canonical form and gender told (1 female, -1 male, 0 none). A name has a
    surname and perhaps a given name, an e-mail address has a domain; each of them is an entity of its own, so a surname met
    alone is the same surname."""
    title = F.when(kind == "name", F.regexp_extract(match, rf"^({FEMALE}|{MALE}|{EITHER})\b", 1)).otherwise("")
    told = F.when(title.rlike(f"^({FEMALE})$"), 1).when(title.rlike(f"^({MALE})$"), -1).otherwise(0)
    tokens = F.slice(F.split(match, " "), F.when(kind == "name", 2).otherwise(1), 2)
    ent = lambda k, c, g=0: F.struct(F.lit(k).alias("type") if isinstance(k, str) else k.alias("type"), c.alias("canon"), (F.lit(g) if isinstance(g, int) else g).alias("told"))
    names = F.when(F.size(tokens) == 2, F.array(ent("given", F.lower(F.get(tokens, F.lit(0))), told), ent("surname", F.lower(F.get(tokens, F.lit(1))))))
    names = names.otherwise(F.array(ent("surname", F.lower(F.get(tokens, F.lit(0))))))
    domain = F.lower(F.substring_index(match, "@", -1))
    return (
        F.when(kind.isin("name", "bare"), names)
        .when(kind == "email", F.array(ent("email", F.lower(match)), ent("domain", domain)))
        .when(kind == "phone", F.array(ent(kind, _national(match))))
        .when(kind.isin("card", "ssn"), F.array(ent(kind, _only_digits(match))))
        .when(kind.isin("ip", "ip6"), F.array(ent(kind, F.lower(match))))
        .when(kind == "secret", F.array(ent(kind, _secret_of(match))))
        .otherwise(F.array().cast("array<struct<type:string,canon:string,told:int>>"))
    )


def _secret_of(match: Column) -> Column:
    return F.regexp_extract(match, r"[=:]\s*\"?([^\"\s]+)\"?$", 1)


def value_of(secret: str, type_: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of an entity's surrogate."""
    d = _digest(secret, type_, canon, attempt)
    digits, letters = _digits(d), _letters(d)
    body = F.concat(F.substring(canon, 1, 1), F.substring(digits, F.lit(1), F.length(canon) - 2))
    byte = lambda k: F.conv(F.substring(d, 2 * k + 1, 2), 16, 10).cast("int")
    public = F.when(byte(0) < 126, F.pmod(byte(0), F.lit(115)) + 11).otherwise(F.pmod(byte(0), F.lit(30)) + 193)  # 11 to 125, 193 to 222
    ip = (
        F.when(canon.startswith("10."), F.concat_ws(".", F.lit("10"), byte(1), byte(2), byte(3)))
        .when(canon.startswith("127."), F.concat_ws(".", F.lit("127"), byte(1), byte(2), byte(3)))
        .when(canon.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), byte(2), byte(3)))
        .when(canon.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), F.concat_ws(".", F.lit("172"), F.pmod(byte(1), F.lit(16)) + 16, byte(2), byte(3)))
        .otherwise(F.concat_ws(".", public, byte(1), byte(2), byte(3)))
    )
    ip6 = F.concat_ws(":", F.regexp_extract(canon, "^([^:]*)", 1), *[F.substring(d, 4 * k + 1, 4) for k in range(7)])
    local = F.substring_index(canon, "@", 1)
    # short addresses leave little room, and so do those that have been tried before
    email = F.concat(F.substring(letters, F.lit(41), F.greatest(F.lit(0), 6 - F.length(local)) + attempt), _classed(local, letters, digits))
    domain = F.concat(F.substring(letters, 1, 10), F.lit("."), F.element_at(F.split(canon, r"\."), -1))
    long = F.concat(d, F.sha2(d, 256), F.sha2(F.concat(d, d), 256), F.sha2(F.concat(d, d, d), 256))
    hexa = F.rpad(F.substring(long, F.lit(1), F.length(canon)), F.length(canon), "0")
    secret_value = F.when(canon.rlike("^[0-9a-f]+$"), hexa).when(canon.rlike("^[0-9A-F]+$"), F.upper(hexa)).otherwise(_classed(canon, _letters(long), F.concat(digits, _digits(F.sha2(d, 256)))))
    script = _script(canon)
    size = F.least(F.greatest(F.floor(F.length(canon) / 2), F.lit(2)), F.lit(6)) + attempt  # syllables; more once it was tried
    female = F.when(type_ == "surname", (script == "cyrillic") & _female(canon)).otherwise(type_ == "given f")
    name = F.lit(None).cast("string")
    for s, syllables in SYLLABLES.items():
        table = F.array(*map(F.lit, syllables))
        word = F.array_join(F.transform(F.sequence(F.lit(1), size.cast("int")), lambda k: F.element_at(table, F.conv(F.substring(d, k, F.lit(1)), 16, 10).cast("int") + 1)), "")
        f, m, other = (F.lit(e) for e in ENDINGS[s])
        end = F.when(female, f).when((type_ == "given m") | (script == "cyrillic"), m).otherwise(other)
        name = F.when(script == s, F.concat(word, end)).otherwise(name)
    return (
        F.when(type_ == "email", email)
        .when(type_ == "domain", domain)
        .when(type_ == "card", F.concat(body, _luhn(body)))
        .when(type_ == "ip", ip)
        .when(type_ == "ip6", ip6)
        .when(type_ == "secret", secret_value)
        .when(type_.isin("phone", "ssn"), F.substring(digits, F.lit(1), F.length(canon)))
        .otherwise(name)
    )


def _typed(type_: Column, canon: Column, female: Column) -> Column:
    """The type that ``value_of`` takes: given names with their gender."""
    return F.when(type_ == "given", F.when(female, "given f").otherwise("given m")).otherwise(type_)


def _surrogate(secret: str, match: Column, known) -> Column:
    """The text that replaces a match. ``known``: the number that is kept for a key, or null."""

    def value(e: Column) -> Column:
        told = known(F.concat_ws("|", F.lit("gender"), e["canon"]))
        type_ = _typed(e["type"], e["canon"], F.when(told.isNull(), _female(e["canon"])).otherwise(told == 1))
        one = F.array(F.struct(type_.alias("type"), e["canon"].alias("canon")))
        return F.transform(one, lambda x: value_of(secret, x["type"], x["canon"], F.coalesce(known(F.concat_ws("|", x["type"], x["canon"])), F.lit(0))))[0]

    def by_kind(k: Column) -> Column:
        v = F.transform(parts_of(match, k), value)
        cased = lambda x, like: F.when(F.upper(like) == like, F.upper(x)).otherwise(F.initcap(x))
        words = F.split(match, " ")
        title = F.when(k == "name", 1).otherwise(0)
        code = F.length(_only_digits(match)) - F.length(F.get(v, F.lit(0)))
        return (
            F.when(k == "other", match)
            .when(k == "email", F.concat(F.get(v, F.lit(0)), F.lit("@"), F.get(v, F.lit(1))))
            .when(k == "phone", _fill(match, F.concat(F.substring(_only_digits(match), F.lit(1), code), F.get(v, F.lit(0)))))
            .when(k.isin("card", "ssn"), _fill(match, F.get(v, F.lit(0))))
            .when(k.isin("ip", "ip6"), F.get(v, F.lit(0)))
            .when(k == "secret", F.concat(F.regexp_extract(match, r"^([^=:]*[=:]\s*\"?)", 1), F.get(v, F.lit(0)), F.when(match.endswith('"'), '"').otherwise("")))
            .otherwise(F.concat(F.when(k == "name", F.concat(F.get(words, F.lit(0)), F.lit(" "))).otherwise(""), F.array_join(F.transform(v, lambda x, i: cased(x, F.get(words, i + title))), " ")))
        )

    return F.transform(F.array(kind_of(match)), by_kind)[0]


def pattern_of(text: Column) -> Column:
    """The pattern of all entities of a text: the common ones, and the names that stand after a form of address somewhere in
    it, wherever they stand."""
    names = F.transform(F.regexp_extract_all(text, F.lit(NAME), 0), lambda m: F.slice(F.split(m, " "), 2, 2))
    full = F.transform(F.filter(names, lambda x: F.size(x) == 2), lambda x: F.array_join(x, " "))
    bare = F.array_distinct(F.concat(full, F.transform(names, lambda x: F.element_at(x, -1))))
    more = F.transform(F.array(bare), lambda b: F.when(F.size(b) > 0, F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}\p{{N}}])(?:"), F.array_join(b, "|"), F.lit(r")(?![\p{L}\p{N}])"))))[0]
    return F.coalesce(F.when(text.rlike(NAME), more), F.lit(ANY))


def matches(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(type, canon, n, odd): every distinct entity, how often it occurs in full, and of given names whether their gender is
    not that of their ending."""
    found = docs.where(docs[text].rlike(HINT)).select(F.explode(F.regexp_extract_all(docs[text], F.lit(ANY), 0)).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    parts = found.select(F.explode(parts_of(F.col("m"), kind_of(F.col("m")))).alias("e"), "n")
    every = parts.groupBy("e.type", "e.canon").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("e.told")).alias("lean"))
    female = F.when(F.col("lean") == 0, _female(F.col("canon"))).otherwise(F.col("lean") > 0)
    return every.select(_typed(F.col("type"), F.col("canon"), female).alias("type"), "canon", "n", ((F.col("type") == "given") & (female != _female(F.col("canon")))).alias("odd"))


def attempts(found: DataFrame, secret: str) -> DataFrame:
    """(key, attempt) of the entities whose first surrogate collides with another's or with a real entity."""
    assigned = stage_table(found.select("type", "canon", F.lit(0).alias("attempt")), "surrogates")
    for _ in range(MAX_ROUNDS):
        value = assigned.withColumn("value", value_of(secret, F.col("type"), F.col("canon"), F.col("attempt")))
        # a value's holders, and the real entity of the same form if there is one
        shown = value.select("type", "value", F.struct("attempt", "canon").alias("who"), F.lit(0).alias("real"))
        real = found.select("type", F.col("canon").alias("value"), F.lit(None).cast(shown.schema["who"].dataType).alias("who"), F.lit(1).alias("real"))
        clash = shown.unionByName(real).groupBy("type", "value").agg(F.min("who").alias("keeps"), F.count("who").alias("holders"), F.max("real").alias("real"))
        clash = stage_table(clash.where("holders > 1 or holders = 1 and real = 1"), "clashes")
        if clash.isEmpty():
            return assigned.where("attempt > 0").select(F.concat_ws("|", "type", "canon").alias("key"), "attempt")
        again = (F.col("holders").isNotNull()) & ((F.col("real") == 1) | (F.col("keeps.canon") != F.col("canon")))
        value = value.join(clash, ["type", "value"], "left")
        assigned = stage_table(value.select("type", "canon", (F.col("attempt") + F.when(again, 1).otherwise(0)).alias("attempt")), "surrogates")
    raise RuntimeError("surrogates still collide; the formats leave too little room")


def replace(docs: DataFrame, secret: str, *, text: str = "text", length: str | None = None, max_exceptions: int = MAX_EXCEPTIONS) -> DataFrame:
    """The rows with every entity in ``text`` replaced. ``length`` names a column that holds the text's length, set anew
    where the text changes."""
    found = stage_table(entities(docs, text=text), "entities")
    gender = found.where("odd").select(F.concat_ws("|", F.lit("gender"), "canon").alias("key"), F.when(F.col("type") == "given f", 1).otherwise(0).alias("value"))
    odd = attempts(found, secret).select("key", F.col("attempt").alias("value")).union(gender)
    few = odd.limit(max_exceptions + 1).collect()
    if len(few) <= max_exceptions:
        held = F.map_from_arrays(F.array(*[F.lit(r["key"]) for r in few]), F.array(*[F.lit(r["value"]) for r in few])) if few else None
        known = (lambda key: F.element_at(held, key)) if few else (lambda key: F.lit(None).cast("int"))
        rows = docs
    else:
        body = docs.where(docs[text].rlike(HINT)).select(docs[text].alias("t")).distinct()
        parts = F.flatten(F.transform(matches(F.col("t")), lambda m: parts_of(m, kind_of(m))))
        types = F.when(F.col("e.type") == "given", F.array(*map(F.lit, ("gender", "given f", "given m")))).otherwise(F.array("e.type"))
        keys = body.select(F.sha2("t", 256).alias("h"), F.explode(parts).alias("e")).select("h", "e", F.explode(types).alias("type"))
        keys = keys.select("h", F.concat_ws("|", "type", "e.canon").alias("key")).distinct()
        of_text = keys.join(odd, "key").groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("__pii_known"))
        rows = docs.withColumn("__pii_h", F.sha2(docs[text], 256)).join(of_text.withColumnRenamed("h", "__pii_h"), "__pii_h", "left").drop("__pii_h")
        known = lambda key: F.element_at(F.col("__pii_known"), key)
    t = F.col(text)
    out = rows.withColumn("__pii_new", F.when(t.rlike(HINT), _replaced(t, lambda m: _surrogate(secret, m, known))))
    columns = {text: F.coalesce("__pii_new", t)}
    if length:
        columns[length] = F.when(F.col("__pii_new").isNotNull(), F.length("__pii_new")).otherwise(F.col(length)).cast(dict(docs.dtypes)[length])
    return out.withColumns(columns).select(*[F.col(f"`{c}`") for c in docs.columns])


def _replaced(t: Column, surrogate) -> Column:
    """The text with its matches replaced; null if there are none. Steps are elements of one-element arrays, so that each is
    made once."""
    found = F.transform(F.array(pattern_of(t)), lambda p: F.struct(p.alias("p"), F.regexp_extract_all(t, p, F.lit(0)).alias("m")))
    pair = F.transform(found, lambda x: F.when(F.size(x["m"]) > 0, F.struct(F.split(t, x["p"], -1).alias("between"), F.transform(x["m"], surrogate).alias("new"))))
    return F.transform(pair, lambda p: F.when(p.isNotNull(), F.array_join(F.transform(p["between"], lambda b, i: F.concat(b, F.coalesce(F.get(p["new"], i), F.lit("")))), "")))[0]
