"""Rules that hold whatever the entry point, hot nodes, repeated ids, files with line breaks."""

import pytest
from pyspark.sql import functions as F

from helpers import EDGE_TYPE_SCHEMA, NODE_TYPE_SCHEMA, document, edges, nodes
from typeloom import PropertyGraph, discover, discover_all
from typeloom.model import endpoint_labels
from typeloom.operators.patterns import node_patterns
from typeloom.operators.render import render_xsd
from typeloom.sources.csv_graph import read_csv_graph


def mixed(spark, n=3000):
    rows = [(f"n{i}", ["Box"], {"few": "text" if i == 7 else str(i), "half": str(i) if i % 5 < 3 else "x"}) for i in range(n)]
    return PropertyGraph(nodes(spark, rows), edges(spark, [("n0", "n1", "IN", {"w": "1"})]))


def dtypes(schema):
    return {p["name"]: p["dtype"] for r in schema.node_types.collect() for p in r["props"]}


def test_one_text_makes_a_property_text(spark):
    graph = mixed(spark)
    assert dtypes(discover(graph, "minhash")) == {"few": "String", "half": "String"}
    assert dtypes(discover(graph, "minhash", rule="majority")) == {"few": "Integer", "half": "Integer"}
    with pytest.raises(ValueError, match="values"):
        discover(graph, "minhash", values="some")


def test_a_hub_has_its_labels_without_adaptive_joins(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = nodes(spark, [("hub", ["Hub"], {}), *((f"n{i}", ["N"], {}) for i in range(20))])
        e = edges(spark, [(f"n{i % 20}", "hub" if i % 10 else f"n{i % 7}", "T", {}) for i in range(1000)])
        got = endpoint_labels(e, n).groupBy("src_labels", "dst_labels").count().collect()
        assert {(tuple(r[0]), tuple(r[1])): r[2] for r in got} == {(("N",), ("Hub",)): 900, (("N",), ("N",)): 100}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_repeated_ids_keep_the_edges(spark):
    n = nodes(spark, [("a", ["A"], {}), ("a", ["B"], {}), ("b", [], {}), ("b", [], {})])
    found = endpoint_labels(edges(spark, [("a", "b", "T", {}), ("a", "gone", "T", {})]), n).collect()
    assert sorted((r["dst_id"], r["src_labels"], r["dst_labels"]) for r in found) == [
        ("b", ["A", "B"], []),
        ("gone", ["A", "B"], []),
    ]


def test_labels_with_colons_are_other_patterns(spark):
    n = nodes(spark, [("a", ["A:B"], {}), ("b", ["A", "B"], {})])
    assert node_patterns(n).select("pattern_id").distinct().count() == 2


def test_xsd_groups_of_one_name(spark):
    node_types = spark.createDataFrame([("t", ["A"], 1, [])], NODE_TYPE_SCHEMA)
    edge_types = spark.createDataFrame(
        [
            ("e1", ["R"], ["A"], ["A"], 3, [("p", 3, True, "Integer"), ("q", 3, True, "Date")], "1:1"),
            ("e2", ["R", "S"], ["A"], ["A"], 7, [("p", 7, True, "String")], "1:1"),
        ],
        EDGE_TYPE_SCHEMA,
    )
    lines = document(render_xsd(node_types, edge_types))
    r, s = (lines.index(f'  <xs:complexType name="{n}">') for n in "RS")
    assert '      <xs:element name="p" type="xs:string" minOccurs="1" maxOccurs="1"/>' in lines[r:s]
    assert '      <xs:element name="q" type="xs:date" minOccurs="0" maxOccurs="1"/>' in lines[r:s]
    assert any('name="p"' in x for x in lines[s:])


def test_files_with_line_breaks_and_lists(spark, tmp_path):
    (tmp_path / "n.csv").write_text('id:ID|note|tags:string[]\n1|"two\nlines"|a;b\n2|"say ""x"""|c\n')
    (tmp_path / "e.csv").write_text(":START_ID|:END_ID\n1|2\n")
    graph = read_csv_graph(spark, {"N": [str(tmp_path / "n.csv")]}, {"T": [str(tmp_path / "e.csv")]})
    got = {r["node_id"]: r["props"] for r in graph.nodes.collect()}
    assert {k.split(":")[-1]: (v["note"], v["tags"]) for k, v in got.items()} == {"1": ("two\nlines", "a,b"), "2": ('say "x"', "c")}


def test_options_of_one_method(spark):
    graph = mixed(spark, 60)
    found = discover_all(graph, ("minhash", "kmeans"), by_method={"kmeans": {"k": 2}})
    assert found.select("method").distinct().count() == 2
    assert found.filter(F.col("f1").isNull()).count() == 0
