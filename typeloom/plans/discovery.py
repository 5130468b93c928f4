"""Discovery from end to end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.functions.sizing import pin
from typeloom.model import PropertyGraph
from typeloom.operators.cardinality import (
    annotate_cardinality,
    cardinalities_of_pairs,
    distinct_pairs,
)
from typeloom.operators.census import property_census
from typeloom.operators.cluster import METHODS, cluster
from typeloom.operators.evaluate import (
    edge_eval_rows,
    evaluate_edges,
    evaluate_nodes,
    node_eval_rows,
)
from typeloom.operators.infer import (
    SAMPLE_VALUES,
    annotate_types,
    infer_types,
)
from typeloom.operators.merge import (
    EDGE_KEYS,
    JACCARD_THRESHOLD,
    MergedTypes,
    assign_edges,
    assign_nodes,
    merge_edges,
    merge_nodes,
)
from typeloom.operators.patterns import (
    edge_patterns,
    node_patterns,
    node_truth_counts,
    patterns_of_truth,
)
from typeloom.operators.render import render_pg_loose, render_pg_strict, render_xsd
from typeloom.sources.documents import write_lines
from typeloom.sources.wide import union_all


@dataclass
class Schema:
    """A discovered schema.

    Its tables hold types and patterns; only the assignments read elements.

    ``edge_types`` unites edges of equal type, as the documents need it;
    ``edge_types_by_ends`` keeps different end points apart, as scoring does.
    """

    node_types: DataFrame
    edge_types: DataFrame
    edge_types_by_ends: DataFrame
    typed_node_patterns: DataFrame
    typed_edge_patterns: DataFrame
    graph: PropertyGraph | None = None
    node_truth: DataFrame | None = None

    def pg_loose(self, **options) -> DataFrame:
        return render_pg_loose(self.node_types, self.edge_types, **options)

    def pg_strict(self, **options) -> DataFrame:
        return render_pg_strict(self.node_types, self.edge_types, **options)

    def xsd(self, **options) -> DataFrame:
        return render_xsd(self.node_types, self.edge_types, **options)

    def export(self, folder: str) -> None:
        """Write the three documents below a folder."""
        write_lines(self.pg_loose(), f"{folder}/pg_schema_loose")
        write_lines(self.pg_strict(), f"{folder}/pg_schema_strict")
        write_lines(self.xsd(), f"{folder}/schema_xsd")

    def _graph(self) -> PropertyGraph:
        if self.graph is None:
            raise ValueError("this schema was made without its graph")
        return self.graph

    def node_assignment(self, nodes: DataFrame | None = None) -> DataFrame:
        """Nodes with ``type_id``."""
        nodes = self._graph().nodes if nodes is None else nodes
        return assign_nodes(nodes, self.typed_node_patterns)

    def edge_assignment(self, edges: DataFrame | None = None) -> DataFrame:
        """Edges with ``type_id`` (types by end points)."""
        edges = self._graph().labeled_edges() if edges is None else edges
        return assign_edges(edges, self.typed_edge_patterns)

    def evaluate(self, truth: DataFrame | None = None) -> DataFrame:
        """Scores of nodes and edges against the known labels, two rows.

        Works on pattern counts; ``truth`` is a table of
        :func:`node_truth_counts` where the schema has none of its own.
        """
        truth = self.node_truth if truth is None else truth
        if truth is None:
            raise ValueError("no ground truth: the nodes had no true_labels")
        return score(
            truth,
            MergedTypes(self.node_types, self.typed_node_patterns),
            MergedTypes(self.edge_types_by_ends, self.typed_edge_patterns),
        )


@dataclass(frozen=True)
class Patterns:
    """Pinned pattern tables of a graph, all that clustering and scoring need."""

    nodes: DataFrame
    edges: DataFrame
    truth: DataFrame | None = None


def pattern_tables(graph: PropertyGraph) -> Patterns:
    """One pass over the nodes and one over the edges."""
    edges = pin(edge_patterns(graph.labeled_edges()))
    if "true_labels" not in graph.nodes.columns:
        return Patterns(pin(node_patterns(graph.nodes)), edges)
    truth = pin(node_truth_counts(graph.nodes))
    return Patterns(pin(patterns_of_truth(truth)), edges, truth)


def score(truth: DataFrame, nodes: MergedTypes, edges: MergedTypes) -> DataFrame:
    """Two rows of scores from typed patterns and the counts of true labels."""
    by_pattern = truth.select("pattern_id", "true_labels", "n").join(
        nodes.typed.select("pattern_id", "type_id"), "pattern_id"
    )
    node_scores = evaluate_nodes(node_eval_rows(by_pattern, nodes.types))
    edge_scores = evaluate_edges(edge_eval_rows(edges.typed, edges.types))
    return node_scores.withColumn("element", F.lit("node")).unionByName(
        edge_scores.withColumn("element", F.lit("edge"))
    )


def score_method(
    tables: Patterns,
    method: str,
    threshold: float = JACCARD_THRESHOLD,
    split_labels: bool = False,
    **options,
) -> DataFrame:
    """Scores of one method on given patterns, without datatypes and cardinalities."""
    if tables.truth is None:
        raise ValueError("no ground truth: the nodes have no true_labels")
    nodes = merge_nodes(
        pin(cluster(tables.nodes, method, **options)),
        absorb=method != "kmeans",
        threshold=threshold,
        split_labels=split_labels,
    )
    edges = merge_edges(pin(cluster(tables.edges, method, **options)), EDGE_KEYS)
    return score(tables.truth, nodes, edges).withColumn("method", F.lit(method))


def merge_all(
    nodes: DataFrame,
    edges: DataFrame,
    method: str,
    threshold: float,
    split_labels: bool,
    options: dict,
) -> tuple[MergedTypes, MergedTypes, MergedTypes]:
    """Node types, edge types by type, edge types by end points of pattern tables."""
    # merging refers to the clusters many times: compute and plan them once
    node_clusters = pin(cluster(nodes, method, **options))
    edge_clusters = pin(cluster(edges, method, **options))
    return (
        merge_nodes(
            node_clusters,
            absorb=method != "kmeans",
            threshold=threshold,
            split_labels=split_labels,
        ),
        merge_edges(edge_clusters, ("type",)),
        merge_edges(edge_clusters, EDGE_KEYS),
    )


def discover(
    graph: PropertyGraph,
    method: str = "lsh",
    threshold: float = JACCARD_THRESHOLD,
    split_labels: bool = False,
    values: str = "all",
    rule: str = "unanimous",
    sample: int = SAMPLE_VALUES,
    **options,
) -> Schema:
    """Schema of a graph by ``lsh``, ``minhash`` or ``kmeans``.

    The elements are read once each for patterns, values and distinct pairs;
    clustering and merging see the pinned pattern tables only.  ``values`` says
    whether datatypes come from ``all`` values or a ``sample``, ``rule`` whether they are what all
    values pass (``unanimous``) or most (``majority``).
    """
    tables = pattern_tables(graph)
    nodes, edges, by_ends = merge_all(
        tables.nodes, tables.edges, method, threshold, split_labels, options
    )

    def dtypes(elements: DataFrame, patterns: DataFrame) -> DataFrame:
        totals = property_census(patterns).withColumnRenamed("n", "total")
        return infer_types(elements, values, rule, sample, totals=totals)

    node_dtypes = dtypes(graph.nodes, tables.nodes)
    edge_dtypes = dtypes(graph.edges, tables.edges)
    found = cardinalities_of_pairs(distinct_pairs(graph.edges))
    return assemble_schema(
        nodes, edges, by_ends, node_dtypes, edge_dtypes, found, graph, tables.truth
    )


def assemble_schema(
    nodes: MergedTypes,
    edges: MergedTypes,
    by_ends: MergedTypes,
    node_dtypes: DataFrame,
    edge_dtypes: DataFrame,
    found: DataFrame,
    graph: PropertyGraph | None = None,
    truth: DataFrame | None = None,
) -> Schema:
    """Annotated types; all tables of the schema are small and computed once."""
    edge_dtypes = pin(edge_dtypes)
    return Schema(
        node_types=pin(annotate_types(nodes.types, node_dtypes)),
        edge_types=pin(annotate_cardinality(annotate_types(edges.types, edge_dtypes), found)),
        edge_types_by_ends=pin(annotate_types(by_ends.types, edge_dtypes)),
        typed_node_patterns=nodes.typed,
        typed_edge_patterns=by_ends.typed,
        graph=graph,
        node_truth=truth,
    )


def discover_all(
    graph: PropertyGraph,
    methods: Sequence[str] = METHODS,
    by_method: Mapping[str, Mapping] | None = None,
    **options,
) -> DataFrame:
    """Scores of every method, one row per method and element kind.

    All methods share one set of pattern tables.  ``options`` go to all of them,
    ``by_method`` has those of single methods, as ``{"kmeans": {"k": 5}}``.
    """
    tables = pattern_tables(graph)
    own = by_method or {}
    return union_all(
        [score_method(tables, m, **{**options, **own.get(m, {})}) for m in methods]
    )
