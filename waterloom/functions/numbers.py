"""Number reading and writing with the coercion rules the network files were made under.

Every function takes and returns a Column; nothing here needs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space trimmed around cells (ASCII, no-break space, byte-order mark
# and the Unicode space separators).
SPACES = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|Infinity)$"
HEXADECIMAL = r"^0[xX]([0-9a-fA-F]+)$"
FLOAT_PREFIX = rf"^[{SPACES}]*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"
INT_PREFIX = rf"^[{SPACES}]*([+-]?[0-9]+)"


# The same characters one by one.
SPACE_CHARS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim(value: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.btrim(value, F.lit(SPACE_CHARS))


def parse_number(text: Column) -> Column:
    """Number in an already trimmed text, null when it is empty or not a number.

    The guard matters: a plain cast would read identifiers such as ``1d`` or ``2F`` as numbers.
    """
    return F.coalesce(
        F.when(text.rlike(NUMERIC), text.try_cast("double")),
        F.conv(F.nullif(F.regexp_extract(text, HEXADECIMAL, 1), F.lit("")), 16, 10).try_cast(
            "double"
        ),
    )


def number(value: Column) -> Column:
    """Whole-string number: empty is 0, hexadecimal and Infinity are read, anything else is null."""
    return F.coalesce(
        parse_number(trim(value)), F.when(value.rlike(rf"^[{SPACES}]*$"), F.lit(0.0))
    )


def float_prefix(value: Column) -> Column:
    """Leading decimal number of a string, null when there is none."""
    return F.nullif(F.regexp_extract(value, FLOAT_PREFIX, 1), F.lit("")).try_cast("double")


def int_prefix(value: Column) -> Column:
    """Leading whole number of a string, null when there is none."""
    return F.nullif(F.regexp_extract(value, INT_PREFIX, 1), F.lit("")).try_cast("bigint")


def or_default(value: Column, default) -> Column:
    """``default`` where a number is missing, not-a-number or zero."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(value.isNull() | F.isnan(value) | (value == 0), default).otherwise(value)


def text_or(value: Column, default) -> Column:
    """``default`` where a text is missing or empty."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(value.isNull() | (value == ""), default).otherwise(value)


def to_fixed(value: Column, digits: int) -> Column:
    """Fixed-decimal text, rounding the exact binary value, exact ties away from zero.

    ``format_number`` rounds exact ties to even.  A double is an exact tie at ``digits``
    decimals only when it is an odd multiple of 2**-(digits+1), which is tested exactly.
    """
    pattern = "0" if digits == 0 else "0." + "0" * digits
    x = value.cast("double") + F.lit(0.0)
    doubled = F.abs(x) * F.lit(float(2 ** (digits + 1)))
    tie = (doubled < F.lit(2.0**53)) & (doubled == F.floor(doubled)) & (doubled % 2 == 1)
    scale = F.lit(float(10**digits))
    away = F.signum(x) * (F.floor(F.abs(x) * scale) + 1) / scale
    return F.call_function("format_number", F.when(tie, away).otherwise(x), F.lit(pattern))


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Round with halves going up: floor(x * 10**d + 0.5) / 10**d."""
    scale = float(10**digits)
    rounded = F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double")
    return rounded / F.lit(scale) if digits else rounded


# Numbers of a sum are cut into whole parts of 2**10, 2**-20, 2**-50 and 2**-80: sums of whole numbers
# do not depend on the order or the slices they are taken in.  No part has more than 32 bits, so that a
# long holds the sum of 2**31 of them.
_TOP, _WHOLE, _PART, _MOST = float(1 << 10), float(1 << 20), float(1 << 30), float(1 << 42)
#: Columns that :func:`sum_parts` gives.
SUM_PARTS = 5


def _mask() -> Column:
    return F.lit((1 << 30) - 1).cast("bigint")


def sum_parts(x: Column) -> list[Column]:
    """What to add up for an exact sum of doubles: four whole parts (long), and numbers that do
    not fit them (beyond 2**42, infinite, not a number) as they are.  Null counts as zero."""
    x = F.coalesce(x.cast("double"), F.lit(0.0))
    fits = F.abs(x) < _MOST
    scaled = F.when(fits, x).otherwise(0.0) * _WHOLE
    high = F.floor(scaled)
    rest = (scaled - high) * _PART
    middle = F.floor(rest)
    return [F.shiftright(high, 30), high.bitwiseAND(_mask()), middle,
            F.floor((rest - middle) * _PART), F.when(fits, 0.0).otherwise(x)]


def from_sum_parts(top: Column, high: Column, middle: Column, low: Column, wild: Column) -> Column:
    """The double of a sum of :func:`sum_parts`, each added up by itself.

    Exact up to 2**-80 per term and the rounding of this last step, for 2**31 terms."""
    mask = _mask()
    middle = middle + F.shiftright(low, 30)
    high = high + F.shiftright(middle, 30)
    top = top + F.shiftright(high, 30)
    tail = F.shiftleft(middle.bitwiseAND(mask), 30) + low.bitwiseAND(mask)
    return (top * _TOP + high.bitwiseAND(mask) / _WHOLE) + tail / (_WHOLE * _PART * _PART) + wild


def exact_sum(x: Column) -> Column:
    """Sum of doubles as an aggregate that any order and partitioning of the rows gives alike."""
    return from_sum_parts(*[F.sum(p) for p in sum_parts(x)])
