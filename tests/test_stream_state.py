"""Streams whose edges know their end points by id only, and state that is merged as it grows."""

import pytest
from pyspark.sql import functions as F

from helpers import edges, nodes
from typeloom.model import PropertyGraph
from typeloom.operators.cardinality import distinct_pairs
from typeloom.operators.patterns import edge_patterns
from typeloom.plans import discover
from typeloom.plans.robustness import damaged
from typeloom.streaming import schema_from_state, update_state
from typeloom.streaming.incremental import edge_pair_state, edge_pattern_state, read_state
from typeloom.streaming.statelog import StateLog
from workload import queries


@pytest.fixture(scope="module")
def graph(spark):
    rows, links = [], []
    for i in range(40):
        rows.append((f"p{i}", ["Person"], {"name": f"n{i}", "born": f"19{i + 10}-01-01"}))
        rows.append((f"c{i}", ["City"], {"title": "t", "pop": str(i)}))
        links.append((f"p{i}", f"c{i % 7}", "LIVES_IN", {"since": "2001"}))
        links.append((f"p{i}", f"p{(i * 3) % 40}", "KNOWS", {}))
    return PropertyGraph(nodes(spark, rows), edges(spark, links))


def rows_of(types):
    return sorted(map(repr, types.collect()))


def streams(spark, folder, schemas):
    return [
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
        for name, schema in schemas.items()
    ]


def test_bare_edges_meet_their_nodes_in_any_order(spark, graph, tmp_path):
    noisy = damaged(graph, 0.2, 0.3)
    # some nodes never come: their edges count with the labels of the other end, or of none
    known = noisy.nodes.filter(F.xxhash64("node_id") % 7 != 0)
    bare = noisy.edges.select("edge_id", "src_id", "dst_id", "edge_type", "props", "prop_set")
    folder, first, second = str(tmp_path), "xxhash64(node_id) % 2 = 0", "xxhash64(node_id) % 2 <> 0"
    def pattern_rows(frame):
        return rows_of(frame.select("edge_type", "src_labels", "dst_labels", "prop_set", "n"))

    bare.coalesce(1).write.parquet(f"{folder}/edges")
    known.filter(first).coalesce(1).write.parquet(f"{folder}/nodes")
    both = streams(spark, folder, {"nodes": known.schema, "edges": bare.schema})
    update_state(*both, f"{folder}/state")
    half = PropertyGraph(known.filter(first), bare)
    assert pattern_rows(edge_pattern_state(spark, f"{folder}/state")) == pattern_rows(edge_patterns(half.labeled_edges()))
    known.filter(second).coalesce(1).write.mode("append").parquet(f"{folder}/nodes")
    update_state(*both, f"{folder}/state")
    whole = discover(PropertyGraph(known, bare), "minhash")
    schema = schema_from_state(spark, f"{folder}/state", "minhash")
    assert rows_of(schema.node_types) == rows_of(whole.node_types)
    assert rows_of(schema.edge_types) == rows_of(whole.edge_types)


def test_an_edge_is_counted_by_the_ends_that_are_there(spark, tmp_path):
    folder = str(tmp_path)
    known = nodes(spark, [("a", ["A"], {}), ("b", ["B"], {}), ("b", ["Later"], {})])
    bare = edges(spark, [(a, b, "T", {}) for a, b in (("a", "b"), ("a", "x"), ("x", "b"), ("x", "y"))])
    known.coalesce(1).write.parquet(f"{folder}/nodes")
    bare.write.parquet(f"{folder}/edges")
    update_state(*streams(spark, folder, {"nodes": known.schema, "edges": bare.schema}), f"{folder}/state")
    got = edge_pattern_state(spark, f"{folder}/state").collect()
    assert sorted((r.src_key, r.dst_key, r.n) for r in got) == [("", "", 1), ("", "B", 1), ("A", "", 1), ("A", "B", 1)]


def counts(spark, *pairs):
    return spark.createDataFrame(pairs, "key string, n long")


@pytest.fixture
def log(spark, tmp_path):
    merge = lambda parts: parts.groupBy("key").agg(F.sum("n").alias("n"))
    return StateLog(spark, str(tmp_path), "s", {"t": merge}, fan=3)


def total(log):
    return {r.key: r.n for r in log.read("t").groupBy("key").agg(F.sum("n").alias("n")).collect()}


def test_segments_do_not_grow_with_the_batches(spark, log):
    for i in range(29):
        log.commit(i, {"t": counts(spark, ("all", 1), (f"k{i % 2}", 10))})
        assert len(log.segments()) <= 2 * 4
    assert total(log) == {"all": 29, "k0": 150, "k1": 140}
    assert [s[0] for s in log.segments()] == [3, 0, 0]
    # what was replaced is gone, and so are old manifests
    assert len(log.read("t").inputFiles()) < 29
    assert len(log._versions()) == 2
    assert set(log._files.names(f"{log.state_dir}/t")) == {"batch_id=27", "batch_id=28"}


def test_a_replayed_batch_changes_nothing(spark, log):
    for i in range(3):
        log.commit(i, {"t": counts(spark, ("a", 1))})
    assert [s[0] for s in log.segments()] == [1]
    for again in (1, 2):
        log.commit(again, {"t": counts(spark, ("a", 1))})
    assert total(log) == {"a": 3}


def test_a_batch_counts_once_its_manifest_is_there(spark, log, monkeypatch):
    log.commit(0, {"t": counts(spark, ("a", 1))})
    log.commit(1, {"t": counts(spark, ("a", 1))})

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as lost:
        lost.setattr(log._files, "write", fails)
        with pytest.raises(OSError):
            log.commit(2, {"t": counts(spark, ("a", 1))})  # written and merged, but not committed
    assert total(log) == {"a": 2}
    log.commit(2, {"t": counts(spark, ("a", 1))})
    assert total(log) == {"a": 3}
    log.commit(5, {"t": counts(spark, ("a", 1))})  # batches without rows may be skipped
    assert total(log) == {"a": 4}


def test_no_batch_yet(spark, log, tmp_path):
    assert log.read("t") is None and log.segments() == []
    with pytest.raises(ValueError, match="no batch of nodes"):
        schema_from_state(spark, str(tmp_path), "minhash")


def test_bare_edges_need_no_more_streams_than_others(spark, tmp_path):
    """Two streams take in nodes and edges; ends are looked up when patterns are summed."""
    folder = str(tmp_path)
    bare = edges(spark, [("a", "b", "T", {}), ("a", "b", "T", {}), (None, "b", None, {"p": "1"})])
    bare.coalesce(1).write.parquet(f"{folder}/edges")
    known = nodes(spark, [("a", ["A"], {}), (None, ["N"], {})])
    known.filter("false").coalesce(1).write.parquet(f"{folder}/nodes")
    both = streams(spark, folder, {"nodes": known.schema, "edges": bare.schema})

    def counted():
        update_state(*both, f"{folder}/state")
        got = edge_pattern_state(spark, f"{folder}/state").collect()
        return sorted((r.edge_type, r.src_key, r.dst_key, r.n) for r in got)

    assert counted() == [("", "", "", 1), ("T", "", "", 2)]
    known.coalesce(1).write.mode("append").parquet(f"{folder}/nodes")
    assert counted() == [("", "", "", 1), ("T", "A", "", 2)]
    late = nodes(spark, [("b", ["B"], {}), ("a", ["Later"], {})])
    late.coalesce(1).write.mode("append").parquet(f"{folder}/nodes")
    assert counted() == [("", "", "B", 1), ("T", "A", "B", 2)]
    assert len(list((tmp_path / "state" / "_progress").iterdir())) == 2


@pytest.mark.parametrize("bare", [False, True])
def test_streamed_edges_carry_no_ids_and_pairs_are_kept_once(spark, graph, monkeypatch, bare):
    monkeypatch.setattr(queries, "lossy_graph", lambda spark, sf_dir: graph)
    state = queries.stream_state(spark, "", bare)
    assert "edge_id" not in spark.read.parquet(f"{state}/../edges").columns
    pairs = distinct_pairs(graph.edges)
    assert read_state(spark, state, "edge_pairs").count() == (0 if bare else pairs.count())
    assert rows_of(edge_pair_state(spark, state)) == rows_of(pairs)
    schema, whole = schema_from_state(spark, state, "minhash"), discover(graph, "minhash")
    assert rows_of(schema.node_types) == rows_of(whole.node_types)
    assert rows_of(schema.edge_types) == rows_of(whole.edge_types)
