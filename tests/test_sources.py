import pytest
from pyspark.sql import functions as F

from helpers import edges, nodes
from typeloom import PropertyGraph
from typeloom.operators.census import label_census, property_census
from typeloom.operators.noise import corrupt_cells, drop_labels, drop_properties
from typeloom.sources import (
    align_wide,
    edge_batches,
    edges_from_wide,
    node_batches,
    nodes_from_wide,
    property_keys,
    read_csv_graph,
    read_graph,
    write_graph,
    write_lines,
)


def test_nodes_from_wide(spark):
    df = spark.createDataFrame(
        [(1, "A:B", [1, 2], 1.5, "x,y"), (2, None, None, None, "x"), (3, "", [], 2.0, None)],
        "id bigint, kind string, list array<int>, v double, original string",
    )
    out = nodes_from_wide(df, "id", ["v", "list", "original"], ["kind"], truth_col="original")
    rows = {r["node_id"]: r for r in out.collect()}
    assert rows["1"]["labels"] == ["A", "B"]
    assert rows["1"]["props"] == {"list": "1,2", "v": "1.5"}
    assert rows["1"]["prop_set"] == ["list", "v"]
    assert rows["1"]["true_labels"] == ["x", "y"]
    assert rows["2"]["labels"] == [] and rows["2"]["props"] == {}
    assert rows["3"]["prop_set"] == ["list", "v"] and rows["3"]["true_labels"] == []


def test_edges_keep_parallel_edges_and_get_end_labels(spark):
    n = nodes(spark, [("a", ["X"], {}), ("b", [], {})])
    df = spark.createDataFrame(
        [("a", "b", "R", 1), ("a", "b", "R", 2), ("b", "z", "R", 1)],
        "s string, d string, t string, w int",
    )
    rows = edges_from_wide(df, "s", "d", "t", ["w"], nodes=n).collect()
    assert len({r["edge_id"] for r in rows}) == 3
    ends = {(r["src_id"], r["dst_id"]): (r["src_labels"], r["dst_labels"]) for r in rows}
    assert ends == {("a", "b"): (["X"], []), ("b", "z"): ([], [])}


def test_missing_columns_are_named(spark):
    n = nodes(spark, [("a", [], {})])
    with pytest.raises(ValueError, match="edge_type"):
        PropertyGraph(n, n)


def test_align_wide(spark):
    a = spark.createDataFrame([(1, "x")], "b int, a string")
    b = spark.createDataFrame([(2, 0.5)], "b int, c double")
    out = align_wide(a, b)
    assert out.columns == ["a", "b", "c"]
    assert sorted(map(tuple, out.collect()), key=str) == [("x", 1, None), (None, 2, 0.5)]


def test_property_keys_and_census(spark):
    n = nodes(spark, [("a", ["X"], {"p": "1", "q": None}), ("b", ["X", "Y"], {"p": "2"})])
    assert [r[0] for r in property_keys(n).collect()] == ["p"]
    assert {tuple(r) for r in property_census(n).collect()} == {("p", 2)}
    assert {tuple(r) for r in label_census(n).collect()} == {("X", 2), ("Y", 1)}


def test_batches_cover_everything_once(spark):
    n = nodes(spark, [(str(i), [], {}) for i in range(200)])
    e = edges(spark, [(str(i), str(i), "R", {}) for i in range(200)])
    for batched in (node_batches(n, 50), edge_batches(e, 50)):
        sizes = {r[0]: r[1] for r in batched.groupBy("batch_id").count().collect()}
        assert set(sizes) == {0, 1, 2, 3} and sum(sizes.values()) == 200
        assert all(25 <= v <= 80 for v in sizes.values())
    with pytest.raises(ValueError):
        node_batches(n, 0)


def test_csv_with_import_headers(spark, tmp_path):
    (tmp_path / "p1.csv").write_text("id:ID(Person)|name|:LABEL|age:int\n1|Ann|Admin;Staff|30\n2||Staff|\n")
    (tmp_path / "p2.csv").write_text("id:ID(Person)|name|email\n3|Cy|c@x\n")
    (tmp_path / "c.csv").write_text(":ID(City)|name\n1|Rome\n")
    (tmp_path / "k.csv").write_text(":START_ID(Person)|:END_ID(Person)|since\n1|2|2010\n")
    (tmp_path / "l.csv").write_text(":START_ID(Person)|:END_ID(City)|skip:IGNORE\n1|1|x\n3|1|y\n")
    g = read_csv_graph(
        spark,
        {"Person": [str(tmp_path / "p1.csv"), str(tmp_path / "p2.csv")], "City": [str(tmp_path / "c.csv")]},
        {"KNOWS": [str(tmp_path / "k.csv")], "LIVES_IN": [str(tmp_path / "l.csv")]},
    )
    rows = {r["node_id"]: r for r in g.nodes.collect()}
    assert rows["Person:1"]["labels"] == ["Admin", "Person", "Staff"]
    assert rows["Person:1"]["props"] == {"id": "1", "name": "Ann", "age": "30"}
    assert rows["Person:2"]["prop_set"] == ["id"]
    assert rows["Person:3"]["prop_set"] == ["email", "id", "name"]
    assert rows["City:1"]["props"] == {"name": "Rome"}
    found = {
        (r["src_id"], r["edge_type"], r["dst_id"], tuple(r["prop_set"])) for r in g.edges.collect()
    }
    assert found == {
        ("Person:1", "KNOWS", "Person:2", ("since",)),
        ("Person:1", "LIVES_IN", "City:1", ()),
        ("Person:3", "LIVES_IN", "City:1", ()),
    }


def test_csv_with_plain_headers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id,name\n1,A\n2,B\n")
    (tmp_path / "e.csv").write_text("N.id,N.id,w\n1,2,9\n")
    g = read_csv_graph(
        spark,
        {"N": [str(tmp_path / "n.csv")]},
        {"E": [str(tmp_path / "e.csv")]},
        sep=",",
        id_column="id",
        src_column=0,
        dst_column=1,
    )
    row = g.labeled_edges().first()
    assert (row["src_id"], row["dst_id"], row["props"]) == ("1", "2", {"w": "9"})
    assert row["src_labels"] == ["N"]
    with pytest.raises(ValueError, match="key column"):
        read_csv_graph(spark, {"N": [str(tmp_path / "n.csv")]}, {"E": [str(tmp_path / "e.csv")]}, ",")


def test_graph_roundtrip_and_document(spark, tmp_path):
    g = PropertyGraph(nodes(spark, [("a", ["X"], {"p": "1"})]), edges(spark, [("a", "a", "R", {})]))
    write_graph(g, str(tmp_path / "g"))
    back = read_graph(spark, str(tmp_path / "g"))
    assert back.nodes.first()["props"] == {"p": "1"} and back.edges.count() == 1
    lines = spark.createDataFrame([("2", "b"), ("1", "a"), ("3", "")], "ord string, line string")
    write_lines(lines, str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert text == "a\nb\n\n"


def test_corrupt_cells_takes_the_same_number_per_row(spark):
    df = spark.createDataFrame(
        [(i, f"k{i}", "a", "b", 1.0, "d") for i in range(100)],
        "i int, key string, a string, b string, c double, d string",
    )
    out = corrupt_cells(df, 60, ["key"])
    assert out.columns == df.columns
    lost = sum(F.col(c).isNull().cast("int") for c in "abcd")
    assert {r[0] for r in out.select(lost).collect()} == {2}
    assert out.filter("i is null or key is null").count() == 0
    assert {r[0] for r in out.select(*[F.count(c) for c in "abcd"]).collect()[0:1]} != {100}
    assert corrupt_cells(df, 10, ["key"]).exceptAll(df).count() == 0


def test_noise_rates_nest(spark):
    n = nodes(spark, [(f"n{i}", ["X", "Y"], {"p": "1", "q": "2"}) for i in range(2000)])
    low, high = drop_properties(n, 0.2), drop_properties(n, 0.5)
    kept_low = low.select("node_id", F.explode("prop_set"))
    kept_high = high.select("node_id", F.explode("prop_set"))
    assert kept_high.exceptAll(kept_low).count() == 0
    assert 0.75 < kept_low.count() / 4000 < 0.85 and 0.45 < kept_high.count() / 4000 < 0.55
    assert low.filter("size(props) <> size(prop_set)").count() == 0
    only = drop_properties(n, 1.0, ["q"])
    assert {tuple(r["prop_set"]) for r in only.collect()} == {("p",)}
    bare = drop_labels(n, 0.3, ["X"])
    counts = {tuple(r[0]): r[1] for r in bare.groupBy("labels").count().collect()}
    assert set(counts) == {("X", "Y"), ("Y",)} and 500 < counts[("Y",)] < 700
    assert drop_labels(n, 1.0).filter("size(labels) > 0 or size(true_labels) = 0").count() == 0
