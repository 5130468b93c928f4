"""Tests on property values, which are always text.

All are column expressions that stay in the JVM.  NULL in gives NULL out.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything up to U+0020 counts as blank.
BLANKS = "".join(chr(c) for c in range(33))

# The patterns of the value grammar.
INTEGER_PATTERN = "^[+-]?[0-9]+$"
DOUBLE_PATTERN = (
    r"^[+-]?(NaN|Infinity|(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    r"|0[xX]([0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)[fFdD]?)$"
)
LENIENT_DATE_PATTERN = "^-?[0-9]"
STRICT_DATE_PATTERN = (
    "^([0-9]{4}-[0-9]{2}-[0-9]{2}"
    "|[0-9]{2}/[0-9]{2}/[0-9]{4}"
    "|[0-9]{2}-[0-9]{2}-[0-9]{4}"
    "|[0-9]{4}/[0-9]{2}/[0-9]{2}"
    "|[0-9]{4}"
    "|[0-9]{4}/[0-9]{2}"
    "|[0-9]{2}/[0-9]{4})$"
)
IP_PATTERN = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0")
LONGEST_BOOLEAN = 5

EMPTY_TYPE = "Unknown (empty)"
CANDIDATE_TYPES = ("Integer", "Double", "Date", "Boolean")


def strip(value: Column) -> Column:
    """Trim all control characters and blanks at both ends."""
    return F.trim(value, F.lit(BLANKS))


def is_integer(value: Column) -> Column:
    """32-bit integer.  A longer number is none, though it is a double."""
    text = strip(value)
    fits = text.rlike(INTEGER_PATTERN) & text.try_cast("int").isNotNull()
    return F.when(value.isNotNull(), fits)


def is_double(value: Column) -> Column:
    """Decimal or hexadecimal floating point, with exponent and type suffix."""
    return strip(value).rlike(DOUBLE_PATTERN)


def is_date(value: Column, strict: bool = False) -> Column:
    """Date in one of seven formats.

    The lenient form takes any text that starts as a date could, that is with
    a (signed) digit; the strict form wants the whole text to fit.
    """
    return strip(value).rlike(STRICT_DATE_PATTERN if strict else LENIENT_DATE_PATTERN)


def is_boolean(value: Column) -> Column:
    text = strip(value)
    return (F.length(text) <= LONGEST_BOOLEAN) & F.lower(text).isin(*BOOLEAN_WORDS)


def is_ip(value: Column) -> Column:
    """IPv4 address with every part in 0..255."""
    text = strip(value)
    parts_fit = F.forall(F.split(text, r"\."), lambda p: p.try_cast("int").between(0, 255))
    return F.when(text.rlike(IP_PATTERN), parts_fit).otherwise(
        F.when(value.isNotNull(), F.lit(False))
    )


def flag_columns(value: Column, strict_dates: bool = False) -> dict[str, Column]:
    """The five tests by their column name."""
    return {
        "is_integer": is_integer(value),
        "is_double": is_double(value),
        "is_date": is_date(value, strict_dates),
        "is_boolean": is_boolean(value),
        "is_ip": is_ip(value),
    }


COUNT_COLUMNS = ("int_cnt", "dbl_cnt", "date_cnt", "bool_cnt", "ip_cnt")


def count_aggregates(value: Column, strict_dates: bool = False) -> list[Column]:
    """Non-null values and how many of them pass each test; all are sums."""
    flags = flag_columns(value, strict_dates).values()
    return [F.count(value).alias("total")] + [
        F.count_if(flag).alias(name) for name, flag in zip(COUNT_COLUMNS, flags)
    ]


def _forced(name: Column, force_string: Iterable[str]) -> Column:
    forced = list(force_string)
    return name.isin(*forced) if forced else F.lit(False)


def unanimous_type(name: Column, force_string: Iterable[str] = ()) -> Column:
    """First candidate type that *all* counted values pass, else String."""
    total = F.col("total")
    return (
        F.when(total == 0, EMPTY_TYPE)
        .when(_forced(name, force_string) | (F.col("ip_cnt") == total), "String")
        .when(F.col("int_cnt") == total, "Integer")
        .when(F.col("dbl_cnt") == total, "Double")
        .when(F.col("date_cnt") == total, "Date")
        .when(F.col("bool_cnt") == total, "Boolean")
        .otherwise("String")
    )


def majority_type(name: Column, force_string: Iterable[str] = ()) -> Column:
    """Candidate type with most values, the first on ties; String if none."""
    total = F.col("total")
    best = F.greatest(*[F.col(c) for c in COUNT_COLUMNS[:4]])
    out = (
        F.when(total == 0, EMPTY_TYPE)
        .when(_forced(name, force_string) | (F.col("ip_cnt") == total), "String")
        .when(best == 0, "String")
    )
    for dtype, cnt in zip(CANDIDATE_TYPES, COUNT_COLUMNS):
        out = out.when(F.col(cnt) == best, dtype)
    return out


def majority_support(name: Column, force_string: Iterable[str] = ()) -> Column:
    """Share of the values behind :func:`majority_type`."""
    total = F.col("total")
    best = F.greatest(*[F.col(c) for c in COUNT_COLUMNS[:4]])
    return (
        F.when(total == 0, 0.0)
        .when(_forced(name, force_string) | (F.col("ip_cnt") == total), 1.0)
        .when(best == 0, 1.0)
        .otherwise(best / total)
    )
