import pytest
from pyspark.sql import functions as F

from helpers import document, edges, nodes, type_dict
from typeloom import PropertyGraph, discover, discover_all, robustness_grid, schema_from_state
from typeloom.operators.patterns import node_truth_counts
from typeloom.plans import damaged
from typeloom.plans.discovery import pattern_tables
from typeloom.plans.robustness import cell_of, grid_patterns
from typeloom.streaming import update_state
from workload import queries


@pytest.fixture(scope="module")
def graph(spark):
    rows = []
    for i in range(60):
        props = {"name": f"n{i}", "born": f"19{i + 10}-01-01", "mail": "m"}
        if i % 4 == 0:
            del props["mail"]
        rows.append((f"p{i}", ["Person"], props))
        rows.append((f"c{i}", ["City"], {"title": "t", "pop": str(i), "lat": f"{i}.25", "lon": "1.5"}))
    links = [(f"p{i}", f"c{i % 7}", "LIVES_IN", {"since": "2001"}) for i in range(60)]
    links += [(f"p{i}", f"p{i + 1}", "KNOWS", {}) for i in range(59)]
    return PropertyGraph(nodes(spark, rows), edges(spark, links))


@pytest.mark.parametrize("method", ["lsh", "minhash", "kmeans"])
def test_invariants(graph, method):
    schema = discover(damaged(graph, 0.2, 0.3), method)
    for types, assigned, total in (
        (schema.node_types, schema.node_assignment(), 120),
        (schema.edge_types_by_ends, schema.edge_assignment(), 119),
    ):
        sizes = {r["type_id"]: r["n"] for r in types.collect()}
        counts = {r[0]: r[1] for r in assigned.groupBy("type_id").count().collect()}
        assert sizes == counts and sum(sizes.values()) == total
        for r in types.collect():
            names = [p["name"] for p in r["props"]]
            assert len(names) == len(set(names))
            assert all(p["mandatory"] == (p["n_present"] == r["n"]) for p in r["props"])


def test_clean_labels_are_found_exactly(graph):
    schema = discover(graph, "lsh", split_labels=True)
    assert type_dict(schema.node_types) == {
        ("City",): (60, ["lat", "lon", "pop", "title"], []),
        ("Person",): (60, ["born", "name"], ["mail"]),
    }
    scores = {r["element"]: r for r in schema.evaluate().collect()}
    assert scores["node"]["f1"] == 1.0
    dtypes = {
        p["name"]: p["dtype"] for r in schema.node_types.collect() for p in r["props"]
    }
    assert dtypes["born"] == "Date" and dtypes["pop"] == "Integer" and dtypes["lat"] == "Double"


def test_documents_and_export(graph, tmp_path):
    schema = discover(graph, "minhash")
    strict = document(schema.pg_strict())
    assert "  (:PersonType)-[lives_inType]->(:CityType)," in strict
    assert "  FOR (x:PersonType) SINGLETON y WITHIN (x)-[y: lives_inType]->(:CityType)" in strict
    assert "  FOR (x:PersonType) SINGLETON x,y WITHIN (x)-[y: knowsType]->(:PersonType)" in strict
    schema.export(str(tmp_path))
    parts = sorted((tmp_path / "pg_schema_strict").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == strict


def test_methods_and_grid(graph):
    rows = discover_all(graph).collect()
    assert {(r["method"], r["element"]) for r in rows} == {
        (m, e) for m in ("lsh", "minhash", "kmeans") for e in ("node", "edge")
    }
    grid = robustness_grid(graph, noise=(0.0, 0.4), loss=(0.0, 1.0), methods=("minhash",)).collect()
    f1 = {(r["noise"], r["label_loss"]): r["f1"] for r in grid if r["element"] == "node"}
    assert f1[(0.0, 0.0)] == 1.0 and len(f1) == 4
    with pytest.raises(ValueError, match="unknown method"):
        discover(graph, "magic")


def streamed(spark, graph, folder, n):
    nodes_ = graph.nodes.repartition(n)
    edges_ = graph.labeled_edges().repartition(n)
    nodes_.write.parquet(f"{folder}/nodes")
    edges_.write.parquet(f"{folder}/edges")
    streams = [
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
        for name, df in (("nodes", nodes_), ("edges", edges_))
    ]
    update_state(*streams, f"{folder}/state")
    return streams


def rows_of(types):
    return sorted(map(repr, types.collect()))


def test_stream_gives_the_same_schema_however_it_is_cut(spark, graph, tmp_path):
    noisy = damaged(graph, 0.2, 0.3)
    whole = discover(noisy, "minhash")
    for n in (1, 3):
        folder = str(tmp_path / str(n))
        streamed(spark, noisy, folder, n)
        schema = schema_from_state(spark, f"{folder}/state", "minhash")
        for a, b in (
            (schema.node_types, whole.node_types),
            (schema.edge_types, whole.edge_types),
        ):
            assert rows_of(a) == rows_of(b)
        truth = node_truth_counts(noisy.nodes)
        assert schema.evaluate(truth).collect() == whole.evaluate().collect()


def test_a_second_run_takes_in_only_what_is_new(spark, graph, tmp_path):
    folder = str(tmp_path)
    streams = streamed(spark, graph, folder, 2)
    update_state(*streams, f"{folder}/state")
    total = spark.read.parquet(f"{folder}/state/node_patterns").agg(F.sum("n")).first()[0]
    assert total == 120
    more = nodes(spark, [("x1", ["Dog"], {"name": "rex"})])
    more.select(*graph.nodes.columns).write.mode("append").parquet(f"{folder}/nodes")
    update_state(*streams, f"{folder}/state")
    schema = schema_from_state(spark, f"{folder}/state", "minhash", split_labels=True)
    assert type_dict(schema.node_types)[("Dog",)] == (1, ["name"], [])
    assert schema.node_types.agg(F.sum("n")).first()[0] == 121


def test_one_scan_gives_the_patterns_of_every_cell(graph):
    grid = grid_patterns(graph, noise=(0.0, 0.4), loss=(0.0, 0.5), labels=["City"])
    for noise in (0.0, 0.4):
        for loss in (0.0, 0.5):
            cell = cell_of(grid, noise, loss)
            tables = pattern_tables(damaged(graph, noise, loss, ["City"]))
            for name in ("nodes", "edges", "truth"):
                a, b = getattr(cell, name), getattr(tables, name)
                assert rows_of(a.select(b.columns)) == rows_of(b)


def test_draws_are_counted_before_they_go_to_the_cells(graph, monkeypatch):
    monkeypatch.setattr("typeloom.plans.robustness.pin", lambda df: df)
    grid = grid_patterns(graph, noise=(0.4, 0.0, 0.4), loss=(0.5,))
    for table in (grid.truth, grid.edges):
        todo, cells = [table._jdf.queryExecution().optimizedPlan()], []
        while todo:
            node = todo.pop()
            if node.nodeName() == "Generate" and "noise_rank" in node.simpleString(1000):
                cells.append("Aggregate" in node.child().toString())
            todo += [node.children().apply(i) for i in range(node.children().length())]
        assert cells and all(cells)
    # a level that is given twice counts twice
    one = grid_patterns(graph, noise=(0.4,), loss=(0.5,))
    total = {t: t.filter("noise = 0.4").agg(F.sum("n")).first()[0] for t in (grid.edges, one.edges)}
    assert total[grid.edges] == 2 * total[one.edges]


def test_edges_with_ids_are_labelled_once(spark, graph, monkeypatch):
    monkeypatch.setattr(queries, "lossy_graph", lambda spark, sf_dir: graph)
    once, types = queries.assigned_edges(spark, "", ids=True)
    twice, _ = queries.assigned_edges(spark, "")
    columns = ["edge_id", "type_id", "edge_type", "src_labels", "dst_labels"]
    assert rows_of(once.select(columns)) == rows_of(twice.select(columns)) and types.count()
    assert "_src_key" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert "_src_key" in twice._jdf.queryExecution().optimizedPlan().toString()
