"""Text normalisation as column expressions. All of them are built-in functions and work on streams."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WIDE_MARKS = "，。！？【】（）％＃＠＆１２３４５６７８９０；："
ASCII_MARKS = ",.!?[]()%#@&1234567890;:"
LITERALS = "0123456789abcdefghijklmnopqrstuvwxyz"
SHIFT = 50000
SEP = chr(ord("_") + SHIFT)
SHIFTED = "".join(chr(ord(c) + SHIFT) for c in LITERALS)
SCORED_MARKS = "-:_*^/\\~`+=，。：？！“”；’《》·、「」（）－～『』"
CJK_RANGES = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
CJK = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_RANGES)
PUNCT = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\p{P}"
SENTENCE = r"[^!?？！。.]+[!?？！。.]?"
IDIOM = r"#idiom\d{6}#"


def _accents() -> tuple[str, str]:
    """Letters that are a base letter with combining marks, and their bases."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = [c for c in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(c) != "Mn"]
        if len(parts) == 1 and parts[0] != chr(cp):
            pairs.append((chr(cp), parts[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


ACCENTED, BASES = _accents()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_punct(x: Column | str) -> Column:
    """Full-width marks and digits as ASCII."""
    return F.translate(_c(x), WIDE_MARKS, ASCII_MARKS)


def shift_literals(x: Column | str) -> Column:
    """0-9 and a-z moved out of the way of codes."""
    return F.translate(_c(x), LITERALS, SHIFTED)


def unshift_literals(x: Column | str) -> Column:
    return F.translate(_c(x), SHIFTED, LITERALS)


def shift_letters(x: Column | str, coded: str) -> Column:
    """The offline rule: any letter without a code is shifted, digits are not. ``coded``: the characters with codes."""
    chars = F.filter(F.split(_c(x), ""), lambda c: c != "")
    known = F.lit(coded)
    moved = lambda c: F.when(c.rlike(r"\p{L}") & ~F.contains(known, c), F.decode(F.unhex(F.lpad(F.hex(F.ascii(c) + SHIFT), 8, "0")), "UTF-32")).otherwise(c)
    return F.array_join(F.transform(chars, moved), "")


def lower_strip(x: Column | str, *, all_space: bool = True) -> Column:
    """Lower case, without white space (or without spaces, and none at the ends)."""
    y = F.lower(_c(x))
    return F.regexp_replace(y, r"(?U)\s", "") if all_space else F.replace(F.trim(y), F.lit(" "), F.lit(""))


def drop_digits(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "[0-9]", "")


def normalise_quotes(x: Column | str) -> Column:
    """Curly quotes, dashes and the ellipsis as ASCII; a double dash stays two."""
    y = F.replace(_c(x), F.lit("……"), F.lit("......"))
    return F.replace(F.translate(y, "“”‘’—―", "\"\"''--"), F.lit("…"), F.lit("..."))


def drop_zero_width(x: Column | str) -> Column:
    return F.translate(_c(x), "\u200b\u00a0", "")


def is_cjk(x: Column | str) -> Column:
    return _c(x).rlike(f"^[{CJK}]$")


def is_punct(x: Column | str) -> Column:
    return _c(x).rlike(f"^[{PUNCT}]$")


def is_space(x: Column | str) -> Column:
    return _c(x).rlike(r"^[ \t\n\r\p{Zs}]$")


def is_control(x: Column | str) -> Column:
    return _c(x).rlike(r"^\p{C}$") & ~_c(x).isin("\t", "\n", "\r")


def clean_text(x: Column | str) -> Column:
    """Without controls, NUL and U+FFFD; white space as spaces."""
    y = F.regexp_replace(_c(x), r"[\p{C}\x{FFFD}&&[^\t\n\r]]", "")
    return F.regexp_replace(y, r"[\t\n\r\p{Zs}]", " ")


def space_cjk(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), f"([{CJK}])", " $1 ")


def strip_accents(x: Column | str) -> Column:
    """Precomposed Latin letters as their bases; loose combining marks go."""
    return F.regexp_replace(F.translate(_c(x), ACCENTED, BASES), r"\p{Mn}", "")


def words(x: Column | str) -> Column:
    """Non-empty parts between white space."""
    return F.filter(F.split(_c(x), r"(?U)\s+"), lambda w: w != "")


def split_on_punct(x: Column | str) -> Column:
    """Tokens between white space, every mark its own."""
    return words(F.regexp_replace(_c(x), f"([{PUNCT}])", " $1 "))


def basic_tokenize(x: Column | str, never_split: list[str] | None = None) -> Column:
    """Cleaned, lower-cased, accent-free words, CJK characters and marks. Words in ``never_split`` stay as they are."""
    tokens = words(space_cjk(clean_text(x)))
    keep = never_split or []
    part = lambda w: split_on_punct(strip_accents(F.lower(w)))
    return F.flatten(F.transform(tokens, lambda w: F.when(w.isin(keep), F.array(w)).otherwise(part(w)) if keep else part(w)))


def sentence_split(x: Column | str) -> Column:
    """Runs without an end mark, each with at most one end mark; further marks are lost."""
    return F.regexp_extract_all(_c(x), F.lit(SENTENCE), 0)


def _class(chars: str) -> str:
    return "".join("\\" + c if c in "\\^-[]*+/" else c for c in chars)


def scored_segments(x: Column | str, *, drop_marks: bool = False) -> Column:
    """Chinese characters and listed marks alone, other runs as words and marks."""
    y = F.lower(F.trim(_c(x)))
    if drop_marks:
        y = F.translate(y, SCORED_MARKS, "")
    single = rf"[\x{{4E00}}-\x{{9FA5}}{_class(SCORED_MARKS)}]"
    other = rf"[\p{{L}}\p{{N}}&&[^\x{{4E00}}-\x{{9FA5}}]]+|[^\s\p{{L}}\p{{N}}]"
    return F.regexp_extract_all(y, F.lit(f"{single}|{other}"), 0)


def remove_scored_punct(x: Column | str) -> Column:
    return F.translate(F.lower(F.trim(_c(x))), SCORED_MARKS, "")


def reader_tokens(x: Column | str) -> Column:
    """Words, CJK characters and marks of a passage."""
    return split_on_punct(space_cjk(x))


def _token_places(text: str) -> list[int]:
    out, token, inside = [], -1, False
    for ch in text:
        if ch.isspace():
            inside = False
        elif _single(ch):
            token, inside = token + 1, False
        elif not inside:
            token, inside = token + 1, True
        out.append(token)
    return out


def _single(ch: str) -> bool:
    """A mark or a CJK character."""
    cp = ord(ch)
    cjk = any(a <= cp <= b for a, b in CJK_RANGES)
    return cjk or (cp < 128 and not ch.isalnum() and cp > 32 and cp != 127) or unicodedata.category(ch).startswith("P")


def token_of_char(x: Column | str) -> Column:
    """For each character the index of its :func:`reader_tokens` token (of the last token begun, for white space). A running
    count over characters is linear only outside higher-order functions, so this one is a vectorised function."""
    @F.pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _token_places(t) for t in texts], dtype=object)

    return places(_c(x))


def blank_tokens(x: Column | str) -> Column:
    """As :func:`reader_tokens`, with idiom blanks whole."""
    return F.regexp_extract_all(_c(x), F.lit(rf"{IDIOM}|[{CJK}{PUNCT}]|[^\s{CJK}{PUNCT}]+"), 0)
