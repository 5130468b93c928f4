"""Controlled damage: lost cells, lost properties, lost labels.

What is lost depends on a hash of the element and the seed, so a damaged graph
can be recomputed, and a higher rate loses all that a lower one loses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.hashing import hash01, seeded
from typeloom.model import present_names

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def corrupt_cells(
    df: DataFrame, pct: float, key_cols: Sequence[str], seed: int = 42
) -> DataFrame:
    """Null the same number of cells in each row of a wide table.

    ``floor(columns * pct / 100)`` of the non-integer columns are chosen per
    row without replacement: those whose hash with the row key ranks first.
    Integer columns and the key are left alone.
    """
    targets = [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, _INTEGERS) and f.name not in key_cols
    ]
    k = int(len(targets) * pct / 100)
    if k == 0:
        return df
    key = [F.col(c).cast("string") for c in key_cols]
    ranked = F.array_sort(
        F.array(
            *[
                F.struct(F.md5(seeded(seed, *key, F.lit(n))).alias("h"), F.lit(n).alias("name"))
                for n in targets
            ]
        )
    )
    chosen = F.transform(F.slice(ranked, 1, k), lambda r: r["name"])
    damaged = [
        F.when(~F.array_contains("_lost", n), F.col(n)).alias(n) if n in targets else F.col(n)
        for n in df.columns
    ]
    return df.withColumn("_lost", chosen).select(*damaged)


def drop_properties(
    df: DataFrame, p: float, names: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """Lose each present property with probability ``p``; nodes or edges.

    With ``names`` only those properties are at risk.
    """
    id_col = "edge_id" if "edge_id" in df.columns else "node_id"

    def stays(name):
        safe = hash01(seeded(seed, F.col(id_col), name)) >= p
        return safe if names is None else (~name.isin(*names) | safe)

    out = df.withColumn("props", F.map_filter("props", lambda k, _: stays(k)))
    if "prop_set" in df.columns:
        return out.withColumn("prop_set", F.filter("prop_set", stays))
    return out.withColumn("prop_set", present_names(F.col("props")))


def drop_labels(
    nodes: DataFrame, p: float, labels: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """A node loses the listed labels (all by default) with probability ``p``."""
    lost = hash01(seeded(seed, F.col("node_id"))) < p
    if labels is None:
        rest = F.array().cast("array<string>")
    else:
        rest = F.array_except("labels", F.array(*[F.lit(x) for x in labels]))
    return nodes.withColumn("labels", F.when(lost, rest).otherwise(F.col("labels")))
