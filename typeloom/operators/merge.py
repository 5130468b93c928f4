"""From clusters to node types and edge types.

A type is made of clusters, a cluster of patterns.  All functions work on the
clustered pattern table and give

* ``typed``: the patterns with ``type_id`` (what assigns elements to types),
* ``types``: one row per type with its labels, size and properties.

Counts are sums over patterns, so a property is mandatory exactly when as many
elements have it as the type has, and merging types is adding counts.

``typed`` is pinned: it has a row per pattern, and all tables of types and
every assignment start from it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.hashing import joined, key_of
from typeloom.functions.labels import clean_set
from typeloom.functions.sizing import pin, pin_small
from typeloom.operators.patterns import edge_pattern_id, node_pattern_id, normal_edges, normal_nodes
from typeloom.operators.setjoin import connected_components, jaccard_pairs

JACCARD_THRESHOLD = 0.9
EDGE_KEYS = ("type", "src", "dst")
PROPS_TYPE = "array<struct<name:string,n_present:bigint,mandatory:boolean>>"
_EDGE_COLUMNS = {"type": "edge_types", "src": "src_labels", "dst": "dst_labels"}


@dataclass(frozen=True)
class MergedTypes:
    types: DataFrame
    typed: DataFrame


# ------------------------------------------------------------------ counting


def type_property_counts(typed: DataFrame) -> DataFrame:
    """(type_id, name, n_present) summed over the patterns of each type."""
    return (
        typed.select("type_id", F.explode("prop_set").alias("name"), "n")
        .groupBy("type_id", "name")
        .agg(F.sum("n").alias("n_present"))
    )


def with_properties(types: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``props`` (sorted by name) to a table with ``type_id`` and ``n``."""
    listed = counts.groupBy("type_id").agg(
        F.array_sort(F.collect_list(F.struct("name", "n_present"))).alias("_counts")
    )
    marked = F.transform(
        F.coalesce("_counts", F.array().cast("array<struct<name:string,n_present:bigint>>")),
        lambda p: F.struct(
            p["name"].alias("name"),
            p["n_present"].alias("n_present"),
            (p["n_present"] == F.col("n")).alias("mandatory"),
        ),
    )
    return types.join(listed, "type_id", "left").withColumn("props", marked).drop("_counts")


def property_lists(types: DataFrame) -> DataFrame:
    """Add the name lists ``mandatory`` and ``optional``."""

    def names(wanted: bool) -> Column:
        kept = F.filter("props", lambda p: p["mandatory"] == F.lit(wanted))
        return F.transform(kept, lambda p: p["name"])

    return types.withColumns({"mandatory": names(True), "optional": names(False)})


# --------------------------------------------------------------------- nodes


def split_by_label(clustered: DataFrame) -> DataFrame:
    """Cut every cluster by the own label of its patterns."""
    return clustered.withColumn("cluster_id", key_of(F.col("cluster_id"), F.col("label_key")))


def cluster_labels(clustered: DataFrame) -> DataFrame:
    """(cluster_id, labels): the distinct non-empty label strings of a cluster."""
    return clustered.groupBy("cluster_id").agg(
        clean_set(F.collect_set("label_key")).alias("labels")
    )


def _labeled_type_id(labels: Column) -> Column:
    return key_of(F.lit("N"), joined(labels))


def _abstract_type_id(cluster_id: Column) -> Column:
    return key_of(F.lit("U"), cluster_id)


def labeled_clusters(clustered: DataFrame) -> DataFrame:
    """(cluster_id, type_id, labels) of the clusters that carry a label."""
    return (
        cluster_labels(clustered)
        .filter(F.size("labels") > 0)
        .withColumn("type_id", _labeled_type_id(F.col("labels")))
    )


def unlabeled_clusters(clustered: DataFrame) -> DataFrame:
    return cluster_labels(clustered).filter(F.size("labels") == 0).select("cluster_id")


def _type_rows(typed: DataFrame) -> DataFrame:
    types = typed.groupBy("type_id").agg(F.first("labels").alias("labels"), F.sum("n").alias("n"))
    return with_properties(types, type_property_counts(typed))


def _typed(clustered: DataFrame, membership: DataFrame) -> DataFrame:
    """Patterns with the type of their cluster, ``labels`` being those of the type."""
    return clustered.drop("labels").join(
        membership.select("cluster_id", "type_id", "labels"), "cluster_id"
    )


def merge_nodes_by_label(clustered: DataFrame) -> MergedTypes:
    """Types from the labelled clusters: equal label sets make one type."""
    typed = _typed(clustered, labeled_clusters(clustered))
    return MergedTypes(_type_rows(typed), typed)


def _property_union(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, items): union of the property sets of the rows of each id."""
    return (
        rows.select(F.col(id_col).alias("id"), F.explode("prop_set").alias("name"))
        .groupBy("id")
        .agg(F.array_sort(F.collect_set("name")).alias("items"))
    )


def absorb_unlabeled(
    clustered: DataFrame, threshold: float = JACCARD_THRESHOLD, multi: bool = False
) -> DataFrame:
    """(cluster_id, type_id, labels, jaccard): unlabelled clusters that fit a type.

    A cluster fits when the Jaccard similarity of its property names with those
    of the type reaches the threshold.  The best type wins, the first label set
    on ties; ``multi`` keeps all.  Clusters with equal property sets are
    matched once.
    """
    labeled = merge_nodes_by_label(clustered)
    type_sets = labeled.types.select(
        F.col("type_id").alias("id"), F.transform("props", lambda p: p["name"]).alias("items")
    )
    loose = clustered.join(unlabeled_clusters(clustered), "cluster_id", "left_semi")
    cluster_sets = _property_union(loose, "cluster_id").withColumn(
        "set_id", F.md5(joined(F.col("items")))
    )
    distinct_sets = cluster_sets.select(F.col("set_id").alias("id"), "items").distinct()
    matches = jaccard_pairs(distinct_sets, type_sets, threshold).join(
        labeled.types.select(F.col("type_id").alias("right_id"), "labels"), "right_id"
    )
    if not multi:
        best = F.min(F.struct((-F.col("jaccard")).alias("d"), "labels", "right_id")).alias("best")
        matches = matches.groupBy("left_id").agg(best).select(
            "left_id",
            F.col("best.right_id").alias("right_id"),
            F.col("best.labels").alias("labels"),
            (-F.col("best.d")).alias("jaccard"),
        )
    return cluster_sets.join(matches, cluster_sets.set_id == matches.left_id).select(
        F.col("id").alias("cluster_id"), F.col("right_id").alias("type_id"), "labels", "jaccard"
    )


def abstract_types(clustered: DataFrame, absorbed: DataFrame) -> DataFrame:
    """(cluster_id, type_id, labels): unlabelled clusters left as types of their own."""
    rest = unlabeled_clusters(clustered).join(absorbed, "cluster_id", "left_anti")
    return rest.select(
        "cluster_id",
        _abstract_type_id(F.col("cluster_id")).alias("type_id"),
        F.array().cast("array<string>").alias("labels"),
    )


def merge_nodes(
    clustered: DataFrame,
    absorb: bool = True,
    threshold: float = JACCARD_THRESHOLD,
    multi: bool = False,
    split_labels: bool = False,
) -> MergedTypes:
    """All node types: by label set, with absorbed clusters, and abstract ones."""
    if split_labels:
        clustered = split_by_label(clustered)
    membership = labeled_clusters(clustered)
    if absorb:
        found = absorb_unlabeled(clustered, threshold, multi).drop("jaccard")
        membership = membership.unionByName(found).unionByName(abstract_types(clustered, found))
    else:
        rest = unlabeled_clusters(clustered)
        membership = membership.unionByName(abstract_types(clustered, rest.limit(0)))
    typed = pin(_typed(clustered, membership))
    return MergedTypes(_type_rows(typed), typed)


# --------------------------------------------------------------------- edges


def edge_cluster_labels(clustered: DataFrame) -> DataFrame:
    """(cluster_id, edge_types, src_labels, dst_labels) as sorted sets."""
    return clustered.groupBy("cluster_id").agg(
        clean_set(F.collect_set("edge_type")).alias("edge_types"),
        clean_set(F.collect_set("src_key")).alias("src_labels"),
        clean_set(F.collect_set("dst_key")).alias("dst_labels"),
    )


def merge_edges(
    clustered: DataFrame, keys: Sequence[str] = EDGE_KEYS, isolate_unlabeled: bool = False
) -> MergedTypes:
    """Edge types: clusters with equal sets under ``keys`` become one type.

    ``keys`` is ``("type", "src", "dst")`` or ``("type",)``; with the latter
    the end-point labels are united.  A cluster without any edge type stays a
    type of its own, and with ``isolate_unlabeled`` so does one without any
    end-point label.
    """
    unknown = set(keys) - set(_EDGE_COLUMNS)
    if unknown or "type" not in keys:
        raise ValueError("keys must hold 'type' and may hold 'src' and 'dst'")
    groups = edge_cluster_labels(clustered)
    alone = F.size("edge_types") == 0
    if isolate_unlabeled:
        alone = alone | ((F.size("src_labels") == 0) & (F.size("dst_labels") == 0))
    parts = [joined(F.col(_EDGE_COLUMNS[k])) for k in keys]
    type_id = F.when(alone, key_of(F.lit("V"), F.col("cluster_id"))).otherwise(
        key_of(F.lit("E"), *parts)
    )
    membership = groups.select("cluster_id", "edge_types", type_id.alias("type_id"))
    typed = pin(clustered.join(membership, "cluster_id"))
    types = typed.groupBy("type_id").agg(
        F.first("edge_types").alias("edge_types"),
        clean_set(F.collect_set("src_key")).alias("src_labels"),
        clean_set(F.collect_set("dst_key")).alias("dst_labels"),
        F.sum("n").alias("n"),
    )
    return MergedTypes(with_properties(types, type_property_counts(typed)), typed)


# ------------------------------------------------------------ generic merging


def merge_clusters_by_jaccard(
    clusters: DataFrame, threshold: float = JACCARD_THRESHOLD
) -> DataFrame:
    """(cluster_id, labels, group_id): clusters whose label sets are alike.

    ``clusters`` is (cluster_id, labels).  Similar means Jaccard >= threshold;
    groups are the connected components.  Equal label sets are compared once,
    and clusters without labels stay apart.
    """
    sets = clusters.select(
        "cluster_id", "labels", F.md5(joined(F.col("labels"))).alias("set_id")
    )
    known = sets.filter(F.size("labels") > 0)
    distinct_sets = known.select(F.col("set_id").alias("id"), F.col("labels").alias("items"))
    distinct_sets = distinct_sets.distinct()
    pairs = jaccard_pairs(distinct_sets, distinct_sets, threshold, below=True)
    groups = connected_components(distinct_sets, pairs)
    return sets.join(groups, sets.set_id == groups.id, "left").select(
        "cluster_id",
        "labels",
        F.coalesce("component", key_of(F.lit("U"), F.col("cluster_id"))).alias("group_id"),
    )


# ------------------------------------------------------------------ regroupings


def _common_and_optional(rows: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = (
        rows.select(*keys, F.explode("prop_set").alias("name"), "n")
        .groupBy(*keys, "name")
        .agg(F.sum("n").alias("n_present"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("name", "n_present"))).alias("counts"))
    )

    def names(test) -> Column:
        return F.transform(F.filter("counts", test), lambda p: p["name"])

    empty = F.array().cast("array<struct<name:string,n_present:bigint>>")
    return (
        totals.join(counts, list(keys), "left")
        .withColumn("counts", F.coalesce("counts", empty))
        .select(
            *keys,
            "n",
            names(lambda p: p["n_present"] == F.col("n")).alias("common"),
            names(lambda p: p["n_present"] < F.col("n")).alias("optional"),
            names(lambda p: F.lit(True)).alias("all_properties"),
        )
    )


def group_by_label(patterns: DataFrame) -> DataFrame:
    """Per single label: element count, common, optional and all properties."""
    rows = patterns.select(F.explode("labels").alias("label"), "prop_set", "n")
    totals = rows.groupBy("label").agg(F.sum("n").alias("n"))
    return _common_and_optional(rows, totals, ["label"])


def label_members(nodes: DataFrame) -> DataFrame:
    """(label, node_id) in long form."""
    return normal_nodes(nodes).select(F.explode("labels").alias("label"), "node_id")


def group_by_edge_type(patterns: DataFrame) -> DataFrame:
    """The same per (type, source labels, target labels), lists joined by ';'."""
    rows = patterns.select(
        F.col("edge_type").alias("edge_types"),
        F.array_join("src_labels", ";").alias("src"),
        F.array_join("dst_labels", ";").alias("dst"),
        "prop_set",
        "n",
    )
    keys = ["edge_types", "src", "dst"]
    totals = rows.groupBy(*keys).agg(F.sum("n").alias("n"))
    return _common_and_optional(rows, totals, keys)


def edge_type_members(edges: DataFrame) -> DataFrame:
    """(edge_types, src, dst, edge_id) in long form."""
    return normal_edges(edges).select(
        F.col("edge_type").alias("edge_types"),
        F.array_join("src_labels", ";").alias("src"),
        F.array_join("dst_labels", ";").alias("dst"),
        "edge_id",
    )


# ------------------------------------------------------------------ assignment


def _assign(elements: DataFrame, typed: DataFrame) -> DataFrame:
    lookup = pin_small(typed.select("pattern_id", "type_id").distinct())
    return elements.join(lookup, "pattern_id").drop("pattern_id")


def assign_nodes(nodes: DataFrame, typed: DataFrame) -> DataFrame:
    """Nodes with ``type_id``, by an equi-join on the pattern of each node."""
    return _assign(normal_nodes(nodes).withColumn("pattern_id", node_pattern_id()), typed)


def assign_edges(edges: DataFrame, typed: DataFrame) -> DataFrame:
    """Edges (with end-point labels) with ``type_id``."""
    return _assign(normal_edges(edges).withColumn("pattern_id", edge_pattern_id()), typed)


# -------------------------------------------------------------- running state


def node_state(patterns: DataFrame) -> DataFrame:
    """Additive form of node types: (labels, name, n), the empty name for totals."""
    return _state(patterns, [F.col("label_key").alias("labels")])


def edge_state(patterns: DataFrame) -> DataFrame:
    """Additive form of edge types: (edge_type, name, n)."""
    return _state(patterns, [F.col("edge_type")])


def _state(patterns: DataFrame, keys: Sequence[Column]) -> DataFrame:
    names = F.array_append("prop_set", F.lit(""))
    rows = patterns.select(*keys, F.explode(names).alias("name"), "n")
    return rows.groupBy(*rows.columns[:-1]).agg(F.sum("n").alias("n"))


def _merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.unionByName(new)
    return both.groupBy(*[c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n"))


def merge_node_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add the counts of a batch to the running node types."""
    return _merge_state(old, new)


def merge_edge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add the counts of a batch to the running edge types."""
    return _merge_state(old, new)


def state_types(state: DataFrame) -> DataFrame:
    """Running state as types: key, n, mandatory and optional names."""
    key = next(c for c in state.columns if c not in ("name", "n"))
    totals = state.filter("name = ''").select(key, F.col("n").alias("total"))
    counts = (
        state.filter("name <> ''")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias("counts"))
    )

    def names(test) -> Column:
        kept = F.filter(F.coalesce("counts", F.array()), test)
        return F.transform(kept, lambda p: p["name"])

    return totals.join(counts, key, "left").select(
        key,
        F.col("total").alias("n"),
        names(lambda p: p["n"] == F.col("total")).alias("mandatory"),
        names(lambda p: p["n"] < F.col("total")).alias("optional"),
    )
