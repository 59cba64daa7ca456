"""Columns that bring unevenly written values to one form. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the characters that count as blank at the ends of a text.
BLANKS = " \t\n\r\f 　"


def trimmed(c: Column) -> Column:
    """Text without surrounding blanks; null stays null."""
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    """Trimmed text, or null if nothing is left."""
    t = trimmed(c)
    return F.when(t != "", t)


def norm_id(c: Column) -> Column:
    """Identifier in lower case without surrounding blanks; blank gives null."""
    return F.lower(blank_to_null(c))


def canonical_json(c: Column) -> Column:
    """JSON text by content: sorted keys, one spelling of numbers and escapes.

    Text that isn't JSON compares as trimmed text; blank gives null.
    """
    t = blank_to_null(c)
    return F.coalesce(F.to_json(F.try_parse_json(t)), t)


def canonical_number(t: Column) -> Column:
    """Decimal numbers as one spelling (`294.0` -> `294`), anything else null.

    Up to 38 digits are exact; other spellings (exponents, more digits) go through double.
    """
    plain = t.rlike(r"^[+-]?[0-9]{1,26}(\.[0-9]{0,12})?$|^[+-]?\.[0-9]{1,12}$")
    as_decimal = t.try_cast("decimal(38,12)").cast("string")
    short = F.regexp_replace(F.regexp_replace(as_decimal, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    short = F.when(short.rlike(r"^-0$"), "0").otherwise(short)
    wide = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,4})?$")
    return F.when(plain, short).when(wide, t.try_cast("double").cast("string"))


def canonical_value(c: Column) -> Column:
    """Value of an attribute log: null, blank, `None` and `nan` are null, numbers have one
    spelling, booleans are lower case, other text is trimmed."""
    t = blank_to_null(c)
    low = F.lower(t)
    return (
        F.when(low.isin("none", "nan"), None)
        .when(low.isin("true", "false"), low)
        .otherwise(F.coalesce(canonical_number(t), t))
    )


def instant_micros(c: Column) -> Column:
    """Microseconds since 1970 of an instant written as ISO text (`T` or blank, with or without
    colons, fraction, offset; without zone it is UTC) or as digits (milliseconds). Else null."""
    t = trimmed(c)
    colons = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(\d{2})(\d{2})", "$1:$2:$3")
    zoned = F.when(colons.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$") & colons.contains(":"), colons).otherwise(
        F.concat(colons, F.lit("Z"))
    )
    return F.when(t.rlike(r"^-?\d{1,15}$"), t.try_cast("bigint") * 1000).otherwise(
        F.unix_micros(zoned.try_cast("timestamp"))
    )


def period_of(c: Column) -> Column:
    """The day of a snapshot as `yyyy-MM-dd`."""
    return F.date_format(c, "yyyy-MM-dd")
