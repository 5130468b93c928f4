"""Scoring discovered types against known labels.

Rows of the long form carry ``type_id``, what was predicted and what is true.
All scores are sums over (type, truth) groups, so the long form is reduced by
one map-side combine and never shuffled whole.  Where only scores are wanted,
patterns with a count ``n`` take the place of elements.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.labels import clean_set, label_key
from typeloom.functions.sizing import pin, pin_small

_STRINGS = "array<string>"
NODE_TRUTH = ("actual",)
EDGE_TRUTH = ("actual_types", "actual_src", "actual_dst")


def _split_labels(labels: Column) -> Column:
    """Single labels of a list of label strings."""
    return clean_set(F.flatten(F.transform(labels, lambda x: F.split(x, ":"))))


def _one_or_none(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.array(text)).otherwise(
        F.array().cast(_STRINGS)
    )


def node_eval_rows(
    assigned: DataFrame, types: DataFrame, truth: DataFrame | None = None
) -> DataFrame:
    """(node_id, type_id, predicted, actual), or ``n`` in place of the id.

    ``assigned`` has node_id and type_id.  True labels come from its own
    ``true_labels`` or, by a left join, from ``truth`` (node_id, true_labels).
    """
    if truth is not None:
        known = truth.select("node_id", "true_labels")
        assigned = assigned.select("node_id", "type_id").join(known, "node_id", "left")
    elif "true_labels" not in assigned.columns:
        raise ValueError("no ground truth: neither true_labels on the nodes nor a truth frame")
    predicted = types.select("type_id", _split_labels(F.col("labels")).alias("predicted"))
    unit = "node_id" if "node_id" in assigned.columns else "n"
    return assigned.join(pin_small(predicted), "type_id").select(
        unit, "type_id", "predicted", clean_set(F.col("true_labels")).alias("actual")
    )


def node_correctness(rows: DataFrame) -> DataFrame:
    """Rows with ``ok_any`` (a common label) and ``ok_exact`` (equal sets)."""
    return rows.withColumns(
        {
            "ok_any": F.arrays_overlap("predicted", "actual").cast("int"),
            "ok_exact": (F.sort_array("predicted") == F.sort_array("actual")).cast("int"),
        }
    )


def edge_eval_rows(assigned: DataFrame, types: DataFrame) -> DataFrame:
    """(edge_id, type_id, predicted_*, actual_*) with three parts each.

    An edge pattern holds the whole truth about its edges, so typed patterns
    do as well as assigned edges; they have ``n`` in place of the id.
    ``assigned`` has edge_id, type_id, edge_type, src_labels and dst_labels.
    """
    predicted = types.select(
        "type_id",
        F.col("edge_types").alias("predicted_types"),
        F.col("src_labels").alias("predicted_src"),
        F.col("dst_labels").alias("predicted_dst"),
    )
    unit = "edge_id" if "edge_id" in assigned.columns else "n"
    return assigned.join(pin_small(predicted), "type_id").select(
        unit,
        "type_id",
        "predicted_types",
        "predicted_src",
        "predicted_dst",
        _one_or_none(F.col("edge_type")).alias("actual_types"),
        _one_or_none(label_key(assigned["src_labels"])).alias("actual_src"),
        _one_or_none(label_key(assigned["dst_labels"])).alias("actual_dst"),
    )


def edge_correctness(rows: DataFrame) -> DataFrame:
    """Rows with ``ok_any`` (truth within prediction) and ``ok_exact``."""
    inside = F.lit(True)
    equal = F.lit(True)
    for part in ("types", "src", "dst"):
        actual, predicted = F.col(f"actual_{part}"), F.col(f"predicted_{part}")
        inside = inside & (F.size(F.array_except(actual, predicted)) == 0)
        equal = equal & (F.sort_array(actual) == F.sort_array(predicted))
    return rows.withColumns({"ok_any": inside.cast("int"), "ok_exact": equal.cast("int")})


def cluster_counts(rows: DataFrame) -> DataFrame:
    """One row: distinct true label sets and distinct predicted types."""
    truth = _truth_columns(rows)
    return _groups(rows, truth).agg(
        F.count_distinct(F.struct(*truth)).alias("n_true"),
        F.count_distinct("type_id").alias("n_predicted"),
    )


def _truth_columns(rows: DataFrame) -> Sequence[str]:
    return EDGE_TRUTH if "actual_types" in rows.columns else NODE_TRUTH


def _groups(rows: DataFrame, truth: Sequence[str]) -> DataFrame:
    """Element counts by type and truth."""
    if "n" in rows.columns:
        return rows.groupBy("type_id", *truth).agg(F.sum("n").alias("n"))
    return rows.groupBy("type_id", *truth).agg(F.count(F.lit(1)).alias("n"))


def majority_label(rows: DataFrame) -> DataFrame:
    """(type_id, majority): the most frequent true label, the first on ties."""
    truth = _truth_columns(rows)
    return _majority(_groups(rows, truth), truth)


def _majority(groups: DataFrame, truth: Sequence[str]) -> DataFrame:
    best = F.min(F.struct((-F.col("n")).alias("d"), "label"))["label"]
    return (
        groups.select("type_id", F.explode(truth[0]).alias("label"), "n")
        .groupBy("type_id", "label")
        .agg(F.sum("n").alias("n"))
        .groupBy("type_id")
        .agg(best.alias("majority"))
    )


def _scores(rows: DataFrame, truth_totals: DataFrame | None) -> DataFrame:
    truth = _truth_columns(rows)
    groups = pin(_groups(rows, truth))  # the elements are read once
    judged = groups.join(_majority(groups, truth), "type_id", "left").withColumn(
        "hit", F.coalesce(F.array_contains(truth[0], F.col("majority")), F.lit(False))
    )
    scored = F.col("majority").isNotNull()
    per_truth = judged.groupBy(*truth).agg(
        F.sum("n").alias("assigned"),
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(scored & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fp"),
    )
    if truth_totals is None:
        per_truth = per_truth.withColumn("n_actual", F.col("assigned"))
    else:
        per_truth = truth_totals.join(per_truth, list(truth), "full").na.fill(0)
    sums = per_truth.agg(
        F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.greatest(F.col("n_actual") - F.col("tp"), F.lit(0))), F.lit(0)).alias(
            "fn"
        ),
    )
    precision = F.when(
        F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))
    ).otherwise(0.0)
    recall = F.when(
        F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))
    ).otherwise(0.0)
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, p * 2 * r / (p + r)).otherwise(0.0)
    return sums.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1)


def evaluate_nodes(rows: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """One row tp, fp, fn, precision, recall, f1 by majority label.

    ``truth`` (node_id, true_labels) gives the totals where the rows do not
    hold every node exactly once.
    """
    totals = None
    if truth is not None:
        totals = (
            truth.select(clean_set(F.col("true_labels")).alias("actual"))
            .groupBy("actual")
            .agg(F.count(F.lit(1)).alias("n_actual"))
        )
    return _scores(rows, totals)


def evaluate_edges(rows: DataFrame) -> DataFrame:
    """The same for edges, whose truth is (type, source, target)."""
    return _scores(rows, None)
