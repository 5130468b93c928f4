"""The property graph as two DataFrames.

nodes: node_id, labels, true_labels, props, prop_set
edges: edge_id, src_id, dst_id, edge_type, props, prop_set

``props`` maps names to text values.  ``prop_set`` is the sorted list of names
that have a value.  It is kept beside the map because nearly everything works
on names alone: a plan that uses ``prop_set`` only neither casts nor carries
the values.

Labels of the end points are not stored with the edges; they follow from the
nodes by :func:`endpoint_labels`, so that a change of node labels shows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.hashing import packed, unpacked
from typeloom.functions.labels import clean_set
from typeloom.functions.sizing import pin
from typeloom.functions.skew import hot_keys

PROPS_TYPE = "map<string,string>"


def present_names(props: Column) -> Column:
    """Sorted names of the non-null entries of a property map."""
    kept = F.map_filter(props, lambda _, v: v.isNotNull())
    return F.coalesce(F.array_sort(F.map_keys(kept)), F.array().cast("array<string>"))


def with_prop_set(df: DataFrame) -> DataFrame:
    """Add ``prop_set`` where a source has the map only."""
    if "prop_set" in df.columns:
        return df
    return df.withColumn("prop_set", present_names(F.col("props")))


def endpoint_labels(
    edges: DataFrame, nodes: DataFrame, labels: str = "labels", hot: list | None = None
) -> DataFrame:
    """Add ``src_labels`` and ``dst_labels`` by two equi-joins on the node id.

    An id that several rows share has the labels of all of them, so an edge
    stays one row.  A sketch over both ends, in one scan that this call starts unless ``hot`` has
    its result (:func:`hot_ends`), finds the nodes that own more than 1/256 of all edges.  Their labels
    are broadcast, and their edges, as those without an end, go to any task.  All
    others meet their nodes by the id alone, so one shuffle of the nodes serves both ends; labels are
    hashed, not sorted, as there is one short row a node.  No id of an edge is read for that; where
    they are asked for they are shuffled as bytes (:func:`packed`).
    """
    if hot is None:
        hot = hot_ends(edges)
    none = F.array().cast("array<string>")
    side = _labels_by_id(nodes, labels)
    known = None
    if hot:
        # fewer than 2 * SHARE rows, those of ids that no node has among them
        ids = edges.sparkSession.createDataFrame(
            [(i,) for i in hot], T.StructType([T.StructField("node_id", edges.schema["src_id"].dataType)])
        )
        owners = _labels_by_id(nodes.filter(F.col("node_id").isin(hot)), labels)
        known = F.broadcast(
            pin(ids.join(owners, "node_id", "left").select("node_id", F.coalesce("_labels", none).alias("_hot")))
        )
    # The task's number keeps parallel edges of two hubs apart; a task that runs again has the same.
    by = [c for c in ("src_id", "dst_id", "edge_type", "prop_set") if c in edges.columns]
    out = edges.withColumn("_spread", F.xxhash64(*by, F.spark_partition_id()))
    for end in ("src", "dst"):
        id_col = f"{end}_id"
        away = F.col(id_col).isNull()
        if known is not None:
            owned = known.select(F.col("node_id").alias(id_col), F.struct("node_id", "_hot").alias(f"_{end}_hot"))
            out = out.join(owned, id_col, "left")
            away = away | F.col(f"_{end}_hot").isNotNull()
        number = F.xxhash64("_spread", F.lit(end)).try_cast(edges.schema[id_col].dataType)
        out = out.withColumns(
            {f"_{end}_away": away, f"_{end}_key": F.when(away, number).otherwise(F.col(id_col))}
        )
    out = out.drop("src_id", "dst_id", "_spread")  # the keys have the ids, so they are shuffled once
    texts = [c for c in ("edge_id",) if c in edges.columns and edges.schema[c].dataType == T.StringType()]
    out = out.withColumns({c: packed(F.col(c)) for c in texts})
    for end in ("src", "dst"):
        names = side.select(
            F.col("node_id").alias(f"_{end}_key"),
            F.col("node_id").alias(f"_{end}_node"),
            F.col("_labels").alias(f"_{end}_found"),
        )
        out = out.join(names.hint("shuffle_hash"), f"_{end}_key", "left")
        # a number that happens to be an id finds one row at most, which is not used
        here = ~F.col(f"_{end}_away")
        # the id too is read behind the join, so no plan leaves the edges of a hub where they were read
        id_ = F.when(here, F.coalesce(f"_{end}_node", f"_{end}_key"))
        found = F.when(here, F.col(f"_{end}_found"))
        if known is not None:
            id_ = F.coalesce(id_, F.col(f"_{end}_hot.node_id"))
            found = F.coalesce(found, F.col(f"_{end}_hot._hot"))
        out = out.withColumns({f"{end}_id": id_, f"{end}_labels": F.coalesce(found, none)})
        out = out.drop(*(f"_{end}_{x}" for x in ("key", "node", "found", "away", "hot")))
    out = out.withColumns({c: unpacked(F.col(c)) for c in texts})
    return out.select(*edges.columns, "src_labels", "dst_labels")


def _labels_by_id(nodes: DataFrame, labels: str) -> DataFrame:
    """(node_id, _labels): the labels of all rows of an id."""
    found = F.collect_set(F.col(labels))  # of an id's label sets, as they stand
    return nodes.groupBy("node_id").agg(clean_set(F.flatten(found)).alias("_labels"))


def hot_ends(edges: DataFrame) -> list:
    """Ids of the nodes that own more than 1/256 of the sources or targets of all edges."""
    return sorted({r["key"] for r in hot_keys(edges, "src_id", "dst_id").collect()})


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    def __post_init__(self) -> None:
        _require(self.nodes, ("node_id", "labels", "props"), "nodes")
        _require(self.edges, ("edge_id", "src_id", "dst_id", "edge_type", "props"), "edges")
        object.__setattr__(self, "nodes", with_prop_set(self.nodes))
        object.__setattr__(self, "edges", with_prop_set(self.edges))

    @cached_property
    def _labeled(self) -> DataFrame:
        if {"src_labels", "dst_labels"} <= set(self.edges.columns):
            return self.edges
        return endpoint_labels(self.edges, self.nodes)

    def labeled_edges(self) -> DataFrame:
        """Edges with the labels of their end points (the plan is made once)."""
        return self._labeled

    def with_nodes(self, nodes: DataFrame) -> PropertyGraph:
        return replace(self, nodes=nodes)

    def with_edges(self, edges: DataFrame) -> PropertyGraph:
        return replace(self, edges=edges)


def _require(df: DataFrame, names: tuple[str, ...], what: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lack the columns {', '.join(missing)}")
