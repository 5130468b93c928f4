"""Discovery under growing damage."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.hashing import hash01, seeded
from typeloom.functions.sizing import pin
from typeloom.model import PropertyGraph
from typeloom.operators.cluster import METHODS
from typeloom.operators.noise import drop_labels, drop_properties
from typeloom.operators.patterns import (
    EDGE_KEYS,
    NODE_KEYS,
    finish_edge_patterns,
    node_pattern_id,
    normal_edges,
    normal_truth,
    patterns_of_truth,
)
from typeloom.plans.discovery import Patterns, score_method

# The usual grid of noise levels and label loss.
NOISE_LEVELS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)
LABEL_LOSS = (0.0, 0.5, 1.0)
CELL = ("noise", "label_loss")
GRID_ROW = (
    "noise double, label_loss double, method string, element string,"
    " tp bigint, fp bigint, fn bigint, precision double, recall double, f1 double"
)


def damaged(
    graph: PropertyGraph,
    noise: float,
    loss: float,
    labels: Sequence[str] | None = None,
    seed: int = 42,
) -> PropertyGraph:
    """Graph with lost properties and labels; the true labels stay."""
    nodes = drop_properties(graph.nodes, noise, seed=seed) if noise > 0 else graph.nodes
    edges = drop_properties(graph.edges, noise, seed=seed) if noise > 0 else graph.edges
    if loss > 0:
        nodes = drop_labels(nodes, loss, labels, seed)
    return PropertyGraph(nodes, edges)


def _kept_levels(draw: Column, levels: Sequence[float]) -> Column:
    """At how many of the distinct levels something with this draw is kept: at the least ones."""
    found = F.lit(0)
    for level in sorted({float(v) for v in levels}):
        found = found + (draw >= F.lit(level)).cast("int")
    return found


def _name_levels(id_column: str, levels: Sequence[float], seed: int) -> Column:
    """For each name of ``prop_set``, at how many levels it is kept."""
    draws = F.transform("prop_set", lambda name: hash01(seeded(seed, F.col(id_column), name)))
    return F.transform(draws, lambda draw: _kept_levels(draw, levels))


def _kept_names() -> Column:
    return F.filter("prop_set", lambda _, i: F.get("name_levels", i) > F.col("noise_rank"))


def _left(column: str, labels: Sequence[str] | None) -> Column:
    """Labels that are left of a node that loses the listed ones, or all."""
    if labels is None:
        return F.array().cast("array<string>")
    return F.array_except(column, F.array(*[F.lit(x) for x in labels]))


def _levels(values: Sequence[float], name: str) -> Column:
    """Rows (name, name_rank) of the levels; the rank counts the distinct levels below."""
    ranks = {v: i for i, v in enumerate(sorted({float(v) for v in values}))}
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(float(v)).alias(name), F.lit(ranks[float(v)]).alias(f"{name}_rank"))
                for v in values
            ]
        )
    )


def _in_all_cells(drawn: DataFrame, noise: Sequence[float], loss: Sequence[float]) -> DataFrame:
    """Counted draws in every cell, with the properties that are left there."""
    rows = drawn.select("*", _levels(noise, "noise")).withColumn("prop_set", _kept_names())
    return rows.select("*", _levels(loss, "label_loss"))


def _labels_left(column: str, levels: str, labels: Sequence[str] | None) -> Column:
    kept = F.col(levels) > F.col("label_loss_rank")
    return F.when(kept, F.col(column)).otherwise(_left(column, labels))


def grid_patterns(
    graph: PropertyGraph,
    noise: Sequence[float] = NOISE_LEVELS,
    loss: Sequence[float] = LABEL_LOSS,
    labels: Sequence[str] | None = None,
    seed: int = 42,
) -> Patterns:
    """Pattern tables of all damaged graphs, each row with its ``noise`` and ``label_loss``.

    One scan of the nodes and one of the edges: an element draws once for each
    property and for its labels, and what it draws says at how many levels these are kept.
    Elements of one pattern and equal draws are counted first, map-side; only these
    counts are taken to all cells.
    """
    node_draws = ["labels", "true_labels", "prop_set", "name_levels", "label_levels"]
    drawn = graph.nodes.withColumns(
        {
            "name_levels": _name_levels("node_id", noise, seed),
            "label_levels": _kept_levels(hash01(seeded(seed, F.col("node_id"))), loss),
        }
    )
    nodes = _in_all_cells(drawn.groupBy(*node_draws).agg(F.count(F.lit(1)).alias("n")), noise, loss)
    nodes = nodes.withColumn("labels", _labels_left("labels", "label_levels", labels))
    counted = normal_truth(nodes).groupBy(*CELL, *NODE_KEYS, "true_labels").agg(F.sum("n").alias("n"))
    truth = pin(counted.withColumn("pattern_id", node_pattern_id()))

    carried = {"src_labels", "dst_labels"} <= set(graph.edges.columns)  # such labels are not the nodes'
    ends = () if carried else ("src", "dst")
    # drawn before the labels are joined: ids of edges are not shuffled
    drawn = graph.edges.withColumns(
        {
            "name_levels": _name_levels("edge_id", noise, seed),
            **{f"{e}_levels": _kept_levels(hash01(seeded(seed, F.col(f"{e}_id"))), loss) for e in ends},
        }
    )
    edge_draws = [*EDGE_KEYS, "name_levels", *(f"{e}_levels" for e in ends)]
    drawn = graph.with_edges(drawn).labeled_edges()
    edges = _in_all_cells(drawn.groupBy(*edge_draws).agg(F.count(F.lit(1)).alias("n")), noise, loss)
    edges = edges.withColumns({f"{e}_labels": _labels_left(f"{e}_labels", f"{e}_levels", labels) for e in ends})
    counted = normal_edges(edges).groupBy(*CELL, *EDGE_KEYS).agg(F.sum("n").alias("n"))
    return Patterns(truth, pin(counted), truth)


def cell_of(grid: Patterns, noise: float, loss: float) -> Patterns:
    """Pattern tables of one damaged graph."""
    here = (F.col("noise") == F.lit(float(noise))) & (F.col("label_loss") == F.lit(float(loss)))
    truth = grid.truth.filter(here).drop(*CELL)
    edges = finish_edge_patterns(grid.edges.filter(here).drop(*CELL))
    return Patterns(patterns_of_truth(truth), edges, truth)


def robustness_grid(
    graph: PropertyGraph,
    noise: Sequence[float] = NOISE_LEVELS,
    loss: Sequence[float] = LABEL_LOSS,
    methods: Sequence[str] = METHODS,
    labels: Sequence[str] | None = None,
    seed: int = 42,
    at_once: int = 8,
    **options,
) -> DataFrame:
    """Scores for each noise level, label loss and method: two rows a cell, of nodes and of edges.

    The graph is read once for all cells (:func:`grid_patterns`).  Clustering and scoring
    see pattern tables only; ``at_once`` cells run side by side, since their jobs are small.
    """
    grid = grid_patterns(graph, noise, loss, labels, seed)
    cells = [(n, lost, method) for n in noise for lost in loss for method in methods]

    def scored(cell: tuple[float, float, str]) -> list[dict]:
        level, lost, method = cell
        found = score_method(cell_of(grid, level, lost), method, **options)
        return [{**r.asDict(), "noise": float(level), "label_loss": float(lost)} for r in found.collect()]

    with ThreadPoolExecutor(at_once) as pool:
        rows = [row for part in pool.map(scored, cells) for row in part]
    return graph.nodes.sparkSession.createDataFrame(rows, GRID_ROW)
