"""Graphs from labelled CSV files.

Each file holds one node label or one edge type, and a label or type may have
several files.  Headers follow the usual bulk-import form: ``name:TYPE`` for a
property, ``:ID(Group)`` for the key of a node, ``:START_ID(Group)`` and
``:END_ID(Group)`` for the ends of an edge, ``:LABEL``, ``:TYPE`` and
``:IGNORE``.  Files with plain headers work when the key columns are named.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.model import PropertyGraph
from typeloom.sources.wide import edges_from_wide, nodes_from_wide, union_all

_HEADER = re.compile(r"^(?P<name>[^:]*)(?::(?P<kind>[A-Za-z_]+(?:\[\])?)(?:\((?P<group>[^)]*)\))?)?$")
_ROLES = ("ID", "START_ID", "END_ID", "LABEL", "TYPE", "IGNORE")


def _read(spark: SparkSession, path: str, sep: str, multiline: bool) -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=multiline)


def _value(column: str, header: str) -> Column:
    """A property's text; a list (``name:TYPE[]``) is parted by commas."""
    if header.rstrip().endswith("[]"):
        return F.regexp_replace(column, ";", ",")
    return F.col(column)


def _parse_header(columns: Sequence[str]) -> tuple[dict[str, tuple[str, str]], dict[str, str]]:
    """Roles (role -> column, group) and properties (column -> name)."""
    roles: dict[str, tuple[str, str]] = {}
    props: dict[str, str] = {}
    for column in columns:
        match = _HEADER.match(column)
        kind = (match.group("kind") or "").upper() if match else ""
        if kind in _ROLES:
            roles[kind] = (column, match.group("group") or "")
            if kind == "ID" and match.group("name"):
                props[column] = match.group("name")
        else:
            props[column] = match.group("name") if match and match.group("name") else column
    return roles, props


def _by_position(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns named by position, since headers may hold dots and colons."""
    plain = df.toDF(*[f"c_{i}" for i in range(len(df.columns))])
    return plain, dict(zip(df.columns, plain.columns))


def _key_column(df: DataFrame, given: str | int | None, what: str) -> str:
    if isinstance(given, int) and given < len(df.columns):
        return df.columns[given]
    if given is None or given not in df.columns:
        raise ValueError(f"no key column for {what} among {df.columns}")
    return given


def _scoped(column: str, group: str) -> Column:
    return F.concat(F.lit(f"{group}:"), F.col(column)) if group else F.col(column)


def _node_file(df: DataFrame, label: str, id_column: str | int | None) -> DataFrame:
    roles, props = _parse_header(df.columns)
    if "ID" not in roles:
        roles["ID"] = (_key_column(df, id_column, f"nodes {label}"), "")
    plain, position = _by_position(df)
    key, group = roles["ID"]
    label_cols = ["_labels"] if "LABEL" in roles else []
    out = plain.select(
        _scoped(position[key], group).alias("_key"),
        *[F.regexp_replace(position[roles["LABEL"][0]], ";", ":").alias(c) for c in label_cols],
        *[_value(position[c], c).alias(n) for c, n in props.items()],
    )
    return nodes_from_wide(out, "_key", list(props.values()), label_cols, [label])


def _edge_file(
    df: DataFrame, edge_type: str, src: str | int | None, dst: str | int | None
) -> DataFrame:
    roles, props = _parse_header(df.columns)
    for role, given in (("START_ID", src), ("END_ID", dst)):
        if role not in roles:
            roles[role] = (_key_column(df, given, f"{role} of {edge_type}"), "")
            props.pop(roles[role][0], None)
    plain, position = _by_position(df)
    start, start_group = roles["START_ID"]
    end, end_group = roles["END_ID"]
    type_ = F.lit(edge_type)
    if "TYPE" in roles:
        type_ = F.coalesce(F.col(position[roles["TYPE"][0]]), type_)
    out = plain.select(
        _scoped(position[start], start_group).alias("_src"),
        _scoped(position[end], end_group).alias("_dst"),
        type_.alias("_type"),
        *[_value(position[c], c).alias(n) for c, n in props.items()],
    )
    return edges_from_wide(out, "_src", "_dst", "_type", list(props.values()))


def read_csv_graph(
    spark: SparkSession,
    nodes: Mapping[str, Sequence[str]],
    edges: Mapping[str, Sequence[str]],
    sep: str = "|",
    id_column: str | int | None = None,
    src_column: str | int | None = None,
    dst_column: str | int | None = None,
    multiline: bool = True,
) -> PropertyGraph:
    """Graph from ``{label: [path, ...]}`` and ``{edge type: [path, ...]}``.

    Key columns of plain headers are given by name or by position.  A quoted value may hold
    line breaks; without ``multiline`` it may not, and large files are split.
    """
    node_frames = [
        _node_file(_read(spark, path, sep, multiline), label, id_column)
        for label, paths in nodes.items()
        for path in paths
    ]
    edge_frames = [
        _edge_file(_read(spark, path, sep, multiline), edge_type, src_column, dst_column)
        for edge_type, paths in edges.items()
        for path in paths
    ]
    if not node_frames or not edge_frames:
        raise ValueError("a graph needs at least one node file and one edge file")
    return PropertyGraph(union_all(node_frames), union_all(edge_frames))
