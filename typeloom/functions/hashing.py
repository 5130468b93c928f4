"""Deterministic hash codes.

Every random choice in the package (samples, projections, noise) is a function
of md5, so a run gives the same result whatever the partitioning, a lost task
can be recomputed, and the same numbers can be had from plain SQL.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_SEP = "\u001e"  # between the fields of a composite key
ITEM_SEP = "\u001f"  # between the items of a list inside a key


def code32(col: Column) -> Column:
    """First 32 bits of md5 as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint")


def code32_of(text: str) -> int:
    """The same code for a constant known on the driver."""
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:8], 16)


def hash01(col: Column) -> Column:
    """Uniform number in [0, 1)."""
    return code32(col) / F.lit(4294967296.0)


def seeded(seed: int, *cols: Column) -> Column:
    """Key ``seed|a|b|...`` to feed to :func:`hash01` or :func:`code32`."""
    return F.concat_ws("|", F.lit(str(seed)), *cols)


def key_of(*fields: Column) -> Column:
    """md5 over fields; a list field is joined by an unprintable separator."""
    return F.md5(F.concat_ws(FIELD_SEP, *fields))


def joined(items: Column) -> Column:
    return F.array_join(items, ITEM_SEP)


def packed(text: Column) -> Column:
    """Text as bytes; one of lower-case hexadecimal digits, as a hash is, takes half of its length."""
    halves = F.unhex(text)
    is_hex = F.lower(F.hex(halves)).cast("binary") == text.cast("binary")
    return F.when(is_hex, F.concat(F.lit(b"\1"), halves)).otherwise(
        F.concat(F.lit(b"\0"), text.cast("binary"))
    )


def unpacked(data: Column) -> Column:
    """The text of :func:`packed`."""
    rest = F.substring(data, 2, 2**31 - 1)
    return F.when(F.substring(data, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(
        rest.cast("string")
    )
