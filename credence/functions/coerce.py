"""Turn text leaves into typed values, with the defaults of the input contract.

Explicit JSON null counts as missing.  Booleans are parsed ("false" is false).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Everything str.strip() removes; trim() with a set only looks at both ends of the text.
BLANKS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
          "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def text(leaf: Column, default: str = "") -> Column:
    return F.coalesce(strip(leaf), F.lit(default))


def lower_text(leaf: Column, default: str = "") -> Column:
    return F.coalesce(strip(F.lower(leaf)), F.lit(default))


# What a number looks like as text.  The cast alone would also take suffixes such as 1d or 30f.
NUMBER = (r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?"
          r"|(?i:inf|infinity|nan))\s*$")


def number_or_null(leaf: Column) -> Column:
    """The text as double; null if it is no number."""
    return F.when(leaf.rlike(NUMBER), leaf.try_cast("double"))


def number(leaf: Column, default: float = 0.0) -> Column:
    return F.coalesce(number_or_null(leaf), F.lit(float(default)))


def integer_or_null(leaf: Column) -> Column:
    """Whole text stays exact; a fraction is cut off."""
    return F.coalesce(leaf.try_cast("bigint"), number_or_null(leaf).try_cast("bigint"))


def integer(leaf: Column, default: int = 0) -> Column:
    return F.coalesce(integer_or_null(leaf), F.lit(default).cast("bigint"))


def integer_or_default_if_zero(leaf: Column, default: int) -> Column:
    """Zero counts as missing, as in the input contract of the notice period."""
    return F.coalesce(F.nullif(integer_or_null(leaf), F.lit(0).cast("bigint")),
                      F.lit(default).cast("bigint"))


def boolean(leaf: Column) -> Column:
    return F.coalesce(leaf.try_cast("boolean"), F.lit(False))


def unusable_number(leaf: Column) -> Column:
    """A leaf that is there but is not a number: the record cannot be typed."""
    return F.coalesce(number_or_null(leaf).isNull() & (strip(leaf) != ""), F.lit(False))


def iso_date(value: Column) -> Column:
    """yyyy-m-d text to a date; anything else is null."""
    plain = F.when(value.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), value)
    return plain.try_cast("date")
