import pytest
from pyspark.sql import functions as F

from helpers import EDGE_TYPE_SCHEMA, NODE_TYPE_SCHEMA, edges, nodes
from typeloom.operators import infer
from typeloom.operators.cardinality import annotate_cardinality, cardinalities


def typed_nodes(spark):
    rows = []
    for i in range(40):
        props = {
            "int": str(i),
            "big": str(2**31 + i),
            "dbl": f"{i}.5",
            "date": f"2010-01-{i % 28 + 1:02d}",
            "bool": "yes" if i % 2 else "no",
            "ip": f"10.0.0.{i}",
            "locationIP": str(i),
            "mixed": "abc" if i < 10 else str(i),
            "text": "word",
        }
        rows.append((f"n{i}", ["A"], props))
    return nodes(spark, rows)


def test_unanimous_types(spark):
    got = {r["name"]: r["dtype"] for r in infer.infer_types_sample(typed_nodes(spark)).collect()}
    assert got == {
        "int": "Integer",
        "big": "Double",
        "dbl": "Double",
        "date": "Date",
        "bool": "Boolean",
        "ip": "String",
        "locationIP": "String",
        "mixed": "String",
        "text": "String",
    }


def test_sample_has_exactly_the_size_asked_for(spark):
    n = typed_nodes(spark)
    for size in (1, 5, 39, 1000):
        totals = {r["name"]: r["total"] for r in infer.infer_types_sample(n, size).collect()}
        assert set(totals.values()) == {min(size, 40)}


def test_sample_is_the_least_hashes(spark):
    n = nodes(spark, [(f"n{i}", [], {"p": str(i)}) for i in range(5000)])
    values = infer.property_values(n).withColumn("draw", infer.code32(F.concat_ws("|", "id", "name")))
    want = {r["id"] for r in values.orderBy("draw", "id").limit(7).collect()}
    assert {r["id"] for r in infer.sample_values(n, 7).collect()} == want


def test_majority_types_and_support(spark):
    rows = {r["name"]: r for r in infer.infer_types_stats(typed_nodes(spark)).collect()}
    assert (rows["mixed"]["dtype"], rows["mixed"]["support"]) == ("Integer", 0.75)
    assert (rows["text"]["dtype"], rows["text"]["support"]) == ("String", 1.0)
    assert (rows["ip"]["dtype"], rows["ip"]["ip_cnt"]) == ("String", 40)
    assert rows["big"]["dtype"] == "Double" and rows["date"]["int_cnt"] == 0


def test_types_per_type(spark):
    n = nodes(spark, [("a", [], {"v": "1"}), ("b", [], {"v": "x"})]).withColumn("type_id", F.col("node_id"))
    got = {(r["type_id"], r["dtype"]) for r in infer.infer_types_sample(n, scope="type").collect()}
    assert got == {("a", "Integer"), ("b", "String")}


def test_value_counts_add_up(spark):
    n = typed_nodes(spark)
    whole = infer.value_counts(infer.property_values(n))
    parts = [
        infer.value_counts(infer.property_values(n.filter(F.col("node_id") < "n2"))),
        infer.value_counts(infer.property_values(n.filter(F.col("node_id") >= "n2"))),
    ]
    added = infer.add_value_counts(parts[0].unionByName(parts[1]))
    assert added.exceptAll(whole).count() == 0 and whole.exceptAll(added).count() == 0


def test_error_report(spark):
    report = infer.type_error_report(typed_nodes(spark), 40)
    row = report.summary.first()
    assert (row["n_properties"], row["agreement_pct"], row["avg_delta_pct"]) == (9, 100.0, 0.0)
    assert [r["n"] for r in report.histogram.orderBy("bin").collect()] == [9, 0, 0, 0, 0]
    assert report.mismatches.count() == 0
    few = infer.type_error_report(typed_nodes(spark), 1)
    delta = few.properties.filter("name = 'mixed'").first()
    assert delta["sample_n"] == 1 and delta["delta"] in (0.25, 0.0, 0.75)


def test_annotation(spark):
    types = spark.createDataFrame(
        [("t1", ["A"], 2, [("p", 2, True, None), ("prop_q", 1, False, None)]), ("t2", [], 1, [])],
        NODE_TYPE_SCHEMA,
    )
    types = types.withColumn("props", F.expr("transform(props, p -> struct(p.name, p.n_present, p.mandatory))"))
    dtypes = spark.createDataFrame([("p", "Date")], "name string, dtype string")
    rows = {r["type_id"]: r for r in infer.annotate_types(types, dtypes).collect()}
    assert [(p["name"], p["dtype"]) for p in rows["t1"]["props"]] == [("p", "Date"), ("prop_q", "Unknown")]
    assert rows["t2"]["props"] == []
    assert {r[0] for r in infer.type_properties(types).collect()} == {"p", "q"}


def test_cardinalities(spark):
    pairs = {
        "one": [("a", "x"), ("b", "y"), ("b", "y")],
        "many_targets": [("a", "x"), ("a", "y"), ("b", "z")],
        "many_sources": [("a", "x"), ("b", "x"), ("c", "y")],
        "many": [("a", "x"), ("a", "y"), ("b", "x")],
    }
    e = edges(spark, [(s, d, t, {}) for t, found in pairs.items() for s, d in found])
    rows = {r["edge_type"]: r for r in cardinalities(e).collect()}
    assert {t: r["cardinality"] for t, r in rows.items()} == {
        "one": "1:1",
        "many_targets": "1:N",
        "many_sources": "N:1",
        "many": "N:N",
    }
    r = rows["many_targets"]
    assert (r["max_dst_per_src"], r["min_dst_per_src"], r["avg_dst_per_src"]) == (2, 1, 1.5)
    assert (r["max_src_per_dst"], r["avg_src_per_dst"]) == (1, 1.0)
    types = spark.createDataFrame(
        [("t", ["many", "none", "one"], [], [], 1, [], None), ("u", [], [], [], 1, [], None)],
        EDGE_TYPE_SCHEMA,
    ).drop("cardinality")
    got = {r["type_id"]: r["cardinality"] for r in annotate_cardinality(types, cardinalities(e)).collect()}
    assert got == {"t": "N:N,Unknown,1:1", "u": ""}


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        infer.infer_types_sample(typed_nodes(spark), scope="everywhere")


def test_values_are_sampled_where_they_are_read(spark):
    """No join gathers the values of a property; a name without a limit is left out."""
    rows = nodes(spark, [(f"n{i}", ["A"], {"often": str(i), **({"rare": "x"} if i % 50 == 0 else {})}) for i in range(400)])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = infer.sample_values(rows, n=20)
        plan = found._jdf.queryExecution().executedPlan().toString()
        counts = {r["name"]: r["count"] for r in found.groupBy("name").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert counts == {"often": 20, "rare": 8}
    given = spark.createDataFrame([("rare", 8)], "name string, total bigint")
    assert {r["name"] for r in infer.sample_values(rows, n=20, totals=given).collect()} == {"rare"}
