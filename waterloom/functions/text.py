"""Text normalisation for headers, cells and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from waterloom.functions.numbers import SPACES, number, parse_number, trim

# Arabic marks that carry no letter.
ARABIC_MARKS = (
    r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E4}"
    r"\x{06E7}\x{06E8}\x{06EA}-\x{06ED}]"
)
# Arabic letter variants and the letter each is folded to.
ARABIC_VARIANTS = "أإآةىء"
ARABIC_FOLDED = "اااهيه"
# Punctuation removed from names.
PUNCTUATION = r"""[.,;:!?'"()/\\@#$%^&*+=<>~`|{}\[\]]"""
# Units that may end a header.
UNIT_SUFFIX = (
    r"(?iu)(mm|m|cm|ft|inch|in|pi|metres?|meters?|pieds?|pouce|بوصة|قدم|متر|ملم)$"
)
# Words that stand for "no value" in a data cell.
NULL_WORDS = rf"(?i)^[{SPACES}]*(null|none|nan|n/a|n/|/|-+)?[{SPACES}]*$"
# Words that stand for "no value" during validation.
DISGUISED_NULLS = [
    "", "null", "n/a", "na", "-", "--", "---", "n/a.",
    "non disponible", "non renseigné", "inconnu", "inconnue",
    "غير متوفر", "غير معروف", "غير محدد", "غير معرف", "؟", "?",
    "missing", "unknown", "undefined", "none", "nil", "void",
]
# Words a category column is made of.
CATEGORY_LIST = ["open", "closed", "cv", "fsv", "gpv", "pbv", "tcv", "prv", "psv", "fcv", "pump",
                 "yes", "no", "oui", "non"]
CATEGORY_WORDS = rf"(?i)^({'|'.join(CATEGORY_LIST)})$"


def fold_name(value: Column) -> Column:
    """Lower-case and drop separators only."""
    return F.regexp_replace(F.lower(value), rf"[_\-{SPACES}]+", "")


def _characters(pattern: str) -> str:
    """Every character of the basic plane a character class matches, as plain text."""
    python = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", pattern)
    ascii_space = re.compile(python, re.ASCII)
    return "".join(c for c in map(chr, range(1, 0xFFFF)) if ascii_space.match(c))


_DROPPED = _characters(ARABIC_MARKS) + _characters(rf"[_\-{SPACES}]") + _characters(PUNCTUATION)


def normalize_text(value: Column) -> Column:
    """Lower-case, drop Arabic marks, fold letter variants, drop separators and punctuation.

    All of it is one character-by-character pass: ``translate`` deletes what has no counterpart.
    """
    t = F.translate(F.lower(value), ARABIC_VARIANTS + _DROPPED, ARABIC_FOLDED)
    return F.coalesce(t, F.lit(""))


def normalize_header(value: Column) -> Column:
    """Normalised header without its trailing unit."""
    return F.regexp_replace(normalize_text(value), UNIT_SUFFIX, "")


def _strip_group_separators(value: Column) -> Column:
    return F.regexp_replace(value, rf"[,{SPACES}]", "")


def cell_number(value: Column) -> Column:
    """Number in a data cell, thousands separators and quotes removed; null when not numeric.

    None of the null words reads as a number, so they need no test of their own.
    """
    return parse_number(F.regexp_replace(value, rf"[,\"'{SPACES}]", ""))


def is_cell_null(value: Column) -> Column:
    """True for null, empty and the null words of a data cell."""
    return value.isNull() | value.rlike(NULL_WORDS)


def cell_value(value: Column) -> Column:
    """Normalised cell as text: numbers in plain decimal form, text trimmed, nulls null."""
    return F.when(
        ~is_cell_null(value), F.coalesce(number_text(cell_number(value)), trim(value))
    )


def number_text(value: Column) -> Column:
    """A number as plain decimal text, whole numbers without a decimal point."""
    return F.call_function("format_number", value + F.lit(0.0), F.lit("0.####################"))


def is_disguised_null(value: Column) -> Column:
    """True for null and for the words that stand for it."""
    return value.isNull() | F.lower(trim(value)).isin(DISGUISED_NULLS)


def validation_number(value: Column) -> Column:
    """Number seen by the validator: commas and blanks removed, quotes kept."""
    return parse_number(trim(F.regexp_replace(value, "[, ]", "")))


def validation_text(value: Column) -> Column:
    """Cell as the validator compares it: null, number in shortest form, or trimmed text."""
    return F.when(is_disguised_null(value), F.lit(None).cast("string")).otherwise(
        F.coalesce(number_text(validation_number(value)), trim(value))
    )


def is_number_text(value: Column) -> Column:
    """Numeric after commas and white space are removed (empty counts, as it reads as zero)."""
    return number(_strip_group_separators(value)).isNotNull()


def drop_comment_cell(value: Column) -> Column:
    """Empty a cell that is only a comment."""
    return trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"^;.*$", ""))


def parse_label(value: Column) -> Column:
    """``x y "text" anchor`` or ``x y text`` as a struct, null when neither fits."""
    t = trim(value)
    t = F.regexp_replace(t, r'^"(.*)"$', "$1")
    t = F.regexp_replace(t, r"^'(.*)'$", "$1")
    t = F.regexp_replace(t, '""', '"')
    quoted = r'^(-?[\d.]+)\s+(-?[\d.]+)\s+"([^"]*)"\s*(\S+)?$'
    plain = r"^(-?[\d.]+)\s+(-?[\d.]+)\s+(.+)$"

    def parts(pattern: str, text: Column, anchor: Column) -> Column:
        return F.struct(
            number(F.regexp_extract(t, pattern, 1)).alias("x"),
            number(F.regexp_extract(t, pattern, 2)).alias("y"),
            text.alias("text"),
            anchor.alias("anchor"),
        )

    return F.when(
        t.rlike(quoted),
        parts(
            quoted,
            F.regexp_extract(t, quoted, 3),
            F.nullif(F.regexp_extract(t, quoted, 4), F.lit("")),
        ),
    ).when(
        t.rlike(plain),
        parts(
            plain,
            F.regexp_replace(F.regexp_extract(t, plain, 3), "^[\"']|[\"']$", ""),
            F.lit(None).cast("string"),
        ),
    )


def latin1_bytes(value: Column) -> Column:
    """Single-byte encoding with ``?`` for every character outside it."""
    return F.encode(F.regexp_replace(value, r"[^\x{00}-\x{FF}]", "?"), "ISO-8859-1")


def latin1_text(value: Column) -> Column:
    """A string that the text writer puts out as single bytes.

    The writer copies a string's bytes as they are and has no encoding of its own, so the
    encoded bytes are cast, not converted; the result is for writing only.
    """
    return latin1_bytes(value).cast("string")


def comment_tail(line: Column, comment: Column) -> Column:
    """Append ``;comment`` to a tab-separated line, or the bare marker when there is none."""
    return F.when(
        comment.isNull() | (comment == ""), F.concat(line, F.lit("\t;"))
    ).otherwise(F.concat(line, F.lit("\t;"), comment))


