"""Patterns: distinct combinations of labels and property names, with counts.

All that clustering and typing look at is the labels and the set of present
properties of an element, so they work on patterns weighted by ``n``.  One
``groupBy`` with map-side combine gets there; a pattern that a third of all
elements share arrives at the reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.hashing import joined, key_of
from typeloom.functions.labels import clean_set, label_key
from typeloom.model import present_names, with_prop_set

NODE_KEYS = ("labels", "prop_set")
EDGE_KEYS = ("edge_type", "src_labels", "dst_labels", "prop_set")


def prop_set(props: Column) -> Column:
    """Sorted names of the properties that have a value."""
    return present_names(props)


def presence(df: DataFrame, names: Sequence[str], id_col: str = "node_id") -> DataFrame:
    """One 0/1 column ``prop_<name>`` for each given property."""
    bits = [
        F.array_contains("prop_set", n).cast("double").alias(f"prop_{n}") for n in sorted(names)
    ]
    return with_prop_set(df).select(id_col, *bits)


def node_pattern_id() -> Column:
    return key_of(joined(F.col("labels")), joined(F.col("prop_set")))


def edge_pattern_id() -> Column:
    return key_of(
        F.col("edge_type"),
        joined(F.col("src_labels")),
        joined(F.col("dst_labels")),
        joined(F.col("prop_set")),
    )


def normal_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with the pattern columns in normal form."""
    return with_prop_set(nodes).withColumn("labels", clean_set(F.col("labels")))


def normal_truth(nodes: DataFrame) -> DataFrame:
    """Normal nodes, with the true labels in normal form too."""
    return normal_nodes(nodes).withColumn("true_labels", clean_set(F.col("true_labels")))


def normal_edges(edges: DataFrame) -> DataFrame:
    """Edges (with end-point labels) with the pattern columns in normal form."""
    return with_prop_set(edges).withColumns(
        {
            "edge_type": F.coalesce("edge_type", F.lit("")),
            "src_labels": clean_set(F.col("src_labels")),
            "dst_labels": clean_set(F.col("dst_labels")),
        }
    )


def counted(
    elements: DataFrame, keys: Sequence[str], normal: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """(keys..., n): elements counted by keys in normal form.

    They are counted by the keys as they come first, so only what is distinct among
    these is put in normal form.
    """
    found = elements.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return normal(found).groupBy(*keys).agg(F.sum("n").alias("n"))


def node_patterns(nodes: DataFrame) -> DataFrame:
    """(pattern_id, labels, label_key, prop_set, n)."""
    return finish_node_patterns(counted(with_prop_set(nodes), NODE_KEYS, normal_nodes))


def node_truth_counts(nodes: DataFrame) -> DataFrame:
    """(pattern_id, labels, prop_set, true_labels, n): patterns cut by true labels.

    Their sums are the node patterns, so one pass over the nodes serves
    discovery and scoring alike.
    """
    keys = [*NODE_KEYS, "true_labels"]
    found = counted(with_prop_set(nodes), keys, normal_truth)
    return found.withColumn("pattern_id", node_pattern_id())


def patterns_of_truth(truth: DataFrame) -> DataFrame:
    """Node patterns from :func:`node_truth_counts`."""
    return finish_node_patterns(truth.groupBy(*NODE_KEYS).agg(F.sum("n").alias("n")))


def edge_patterns(edges: DataFrame) -> DataFrame:
    """(pattern_id, edge_type, src_labels, dst_labels, src_key, dst_key, prop_set, n)."""
    return finish_edge_patterns(counted(with_prop_set(edges), EDGE_KEYS, normal_edges))


def finish_node_patterns(counted: DataFrame) -> DataFrame:
    """Add the derived columns to counted pattern keys."""
    return counted.select(
        node_pattern_id().alias("pattern_id"),
        "labels",
        label_key(F.col("labels")).alias("label_key"),
        "prop_set",
        "n",
    )


def finish_edge_patterns(counted: DataFrame) -> DataFrame:
    return counted.select(
        edge_pattern_id().alias("pattern_id"),
        "edge_type",
        "src_labels",
        "dst_labels",
        label_key(F.col("src_labels")).alias("src_key"),
        label_key(F.col("dst_labels")).alias("dst_key"),
        "prop_set",
        "n",
    )


def is_edge_frame(patterns: DataFrame) -> bool:
    return "edge_type" in patterns.columns


def distinct_label_sets(patterns: DataFrame) -> DataFrame:
    """One row ``n_labels``: distinct label strings, the empty one included."""
    return patterns.agg(F.countDistinct("label_key").alias("n_labels"))
