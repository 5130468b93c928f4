"""Graphs from ordinary wide tables: one column per property."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.hashing import FIELD_SEP
from typeloom.functions.labels import clean_set
from typeloom.model import endpoint_labels, with_prop_set


def as_text(df: DataFrame, name: str) -> Column:
    """Property value as text; a list becomes its items joined by commas."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.ArrayType):
        return F.array_join(F.col(name).cast("array<string>"), ",")
    return F.col(name).cast("string")


def _property_columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """``props`` and ``prop_set`` from wide columns.

    The names are sorted here, once, so no row is sorted later; the set needs
    only the null test of each column and never its text.
    """
    ordered = sorted(names)
    if not ordered:
        return [
            F.create_map().cast("map<string,string>").alias("props"),
            F.array().cast("array<string>").alias("prop_set"),
        ]
    entries = [c for n in ordered for c in (F.lit(n), as_text(df, n))]
    present = [F.when(F.col(n).isNotNull(), F.lit(n)) for n in ordered]
    return [
        F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()).alias("props"),
        F.array_compact(F.array(*present)).alias("prop_set"),
    ]


def _label_column(df: DataFrame, label_cols: Sequence[str], labels: Sequence[str]) -> Column:
    parts = [F.array(*[F.lit(x) for x in labels])] if labels else []
    for name in label_cols:
        if isinstance(df.schema[name].dataType, T.ArrayType):
            parts.append(F.coalesce(F.col(name), F.array().cast("array<string>")))
        else:
            # one text may carry several labels, joined by a colon
            parts.append(F.coalesce(F.split(F.col(name), ":"), F.array().cast("array<string>")))
    if not parts:
        return F.array().cast("array<string>")
    return clean_set(F.concat(*parts))


def nodes_from_wide(
    df: DataFrame,
    id: Column | str,
    prop_cols: Sequence[str],
    label_cols: Sequence[str] = (),
    labels: Sequence[str] = (),
    truth_col: str | None = None,
) -> DataFrame:
    """Nodes from a table with one row per node.

    Labels come from columns, are given for the whole table, or both.  A
    ``truth_col`` (comma-joined text or a list) is kept apart from the
    properties, so that it cannot leak into what is learned.
    """
    node_id = F.col(id) if isinstance(id, str) else id
    found = _label_column(df, label_cols, labels)
    truth = found
    if truth_col is not None:
        truth = F.col(truth_col)
        if not isinstance(df.schema[truth_col].dataType, T.ArrayType):
            truth = F.split(truth, ",")
        truth = clean_set(truth)
    names = [n for n in prop_cols if n != truth_col]
    return df.select(
        node_id.cast("string").alias("node_id"),
        found.alias("labels"),
        truth.alias("true_labels"),
        *_property_columns(df, names),
    )


def edges_from_wide(
    df: DataFrame,
    src: Column | str,
    dst: Column | str,
    edge_type: Column | str,
    prop_cols: Sequence[str],
    id: Column | None = None,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """Edges from a table with one row per edge.

    Without an id the whole row is the identity of an edge, so that parallel
    edges stay apart.  With ``nodes`` the labels of both end points are added.
    """

    def column(c: Column | str) -> Column:
        return F.col(c) if isinstance(c, str) else c

    src_id = column(src).cast("string")
    dst_id = column(dst).cast("string")
    type_ = column(edge_type).cast("string")
    if id is None:
        rest = [F.coalesce(as_text(df, n), F.lit("")) for n in sorted(df.columns)]
        id = F.md5(F.concat_ws(FIELD_SEP, type_, src_id, dst_id, *rest))
    out = df.select(
        id.cast("string").alias("edge_id"),
        src_id.alias("src_id"),
        dst_id.alias("dst_id"),
        type_.alias("edge_type"),
        *_property_columns(df, prop_cols),
    )
    return out if nodes is None else endpoint_labels(out, nodes)


def snapshot_labels(nodes: DataFrame) -> DataFrame:
    """Keep today's labels as ground truth, before any of them is removed."""
    return nodes.withColumn("true_labels", F.col("labels"))


def property_keys(df: DataFrame) -> DataFrame:
    """All property names in use: the dynamic schema of nodes or edges."""
    return (
        with_prop_set(df).select(F.explode("prop_set").alias("name")).distinct()
    )


def align_wide(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two wide tables whose columns differ; columns in name order."""
    both = first.unionByName(second, allowMissingColumns=True)
    return both.select(*sorted(both.columns))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames with the same columns."""
    return reduce(DataFrame.unionByName, frames)
