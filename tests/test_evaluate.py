import pytest
from pyspark.sql import functions as F

from helpers import nodes
from typeloom.operators import evaluate

TYPES = "type_id string, labels array<string>"


def rows(spark):
    assigned = nodes(
        spark,
        [
            ("1", ["A"], ["A"], {}),
            ("2", ["A"], ["A"], {}),
            ("3", [], ["B"], {}),
            ("4", ["B"], ["B"], {}),
            ("5", [], ["A", "B"], {}),
            ("6", [], [], {}),
        ],
    )
    type_of = {"1": "t1", "2": "t1", "3": "t1", "4": "t2", "5": "t2", "6": "t3"}
    pairs = spark.createDataFrame(list(type_of.items()), "node_id string, type_id string")
    types = spark.createDataFrame([("t1", ["A"]), ("t2", ["A:B"]), ("t3", [])], TYPES)
    return evaluate.node_eval_rows(assigned.join(pairs, "node_id"), types), assigned


def test_correctness_and_majority(spark):
    frame, _ = rows(spark)
    got = {r["node_id"]: (r["ok_any"], r["ok_exact"]) for r in evaluate.node_correctness(frame).collect()}
    assert got == {"1": (1, 1), "2": (1, 1), "3": (0, 0), "4": (1, 0), "5": (1, 1), "6": (0, 1)}
    majority = {r["type_id"]: r["majority"] for r in evaluate.majority_label(frame).collect()}
    assert majority == {"t1": "A", "t2": "B"}


def test_scores(spark):
    frame, assigned = rows(spark)
    for row in (
        evaluate.evaluate_nodes(frame).first(),
        evaluate.evaluate_nodes(frame, truth=assigned).first(),
    ):
        # hits 1 2 4 5; node 3 misses; node 6 has no truth, so only its recall suffers
        assert (row["tp"], row["fp"], row["fn"]) == (4, 1, 2)
        assert row["precision"] == pytest.approx(4 / 5) and row["recall"] == pytest.approx(4 / 6)
        assert row["f1"] == pytest.approx(2 * 0.8 * (4 / 6) / (0.8 + 4 / 6))
    counts = evaluate.cluster_counts(frame).first()
    assert (counts["n_true"], counts["n_predicted"]) == (4, 3)


def test_truth_by_join_keeps_every_prediction(spark):
    types = spark.createDataFrame([("t1", ["A"])], TYPES)
    assigned = spark.createDataFrame([("1", "t1"), ("2", "t1")], "node_id string, type_id string")
    truth = spark.createDataFrame([("1", ["A"])], "node_id string, true_labels array<string>")
    got = {r["node_id"]: r["actual"] for r in evaluate.node_eval_rows(assigned, types, truth).collect()}
    assert got == {"1": ["A"], "2": []}
    with pytest.raises(ValueError, match="ground truth"):
        evaluate.node_eval_rows(assigned, types)


def test_edge_scores(spark):
    types = spark.createDataFrame(
        [("t1", ["R"], ["A", "C"], ["B"]), ("t2", ["R", "S"], ["A"], [])],
        "type_id string, edge_types array<string>, src_labels array<string>, dst_labels array<string>",
    )
    assigned = spark.createDataFrame(
        [
            ("e1", "t1", "R", ["A"], ["B"]),
            ("e2", "t1", "R", ["C"], ["B"]),
            ("e3", "t2", "S", ["A"], []),
            ("e4", "t2", "S", ["X"], []),
            ("e5", "t2", "R", ["A"], []),
        ],
        "edge_id string, type_id string, edge_type string, src_labels array<string>, dst_labels array<string>",
    )
    frame = evaluate.edge_eval_rows(assigned, types)
    ok = {r["edge_id"]: (r["ok_any"], r["ok_exact"]) for r in evaluate.edge_correctness(frame).collect()}
    assert ok == {"e1": (1, 0), "e2": (1, 0), "e3": (1, 0), "e4": (0, 0), "e5": (1, 0)}
    row = evaluate.evaluate_edges(frame).first()
    assert (row["tp"], row["fp"], row["fn"]) == (4, 1, 1)
    counted = assigned.drop("edge_id").selectExpr("*", "1L as n")
    same = evaluate.evaluate_edges(evaluate.edge_eval_rows(counted, types)).first()
    assert same == row


def test_no_rows_score_nothing(spark):
    frame, _ = rows(spark)
    row = evaluate.evaluate_nodes(frame.limit(0)).first()
    assert tuple(row) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_assignment_broadcasts_small_lookups(spark):
    """Edges meet their patterns and types where they are; Spark alone would shuffle all for a pinned table."""
    from helpers import edges
    from typeloom.functions.sizing import pin
    from typeloom.operators import merge, patterns

    links = edges(spark, [("a", "b", "T", {})] * 4).withColumns(
        {"src_labels": F.array(F.lit("A")), "dst_labels": F.array(F.lit("B"))}
    )
    found = pin(patterns.edge_patterns(links)).withColumn("cluster_id", F.lit("c"))
    merged = merge.merge_edges(pin(found))
    rows = evaluate.edge_eval_rows(merge.assign_edges(links, merged.typed), merged.types)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2
    assert rows.count() == 4
    assert evaluate.evaluate_edges(rows).first()["tp"] == 4
