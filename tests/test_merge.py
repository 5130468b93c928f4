import itertools
import random

import pytest

from helpers import clusters, edge_clusters, edges, nodes, type_dict
from typeloom.operators.merge import (
    absorb_unlabeled,
    assign_nodes,
    edge_state,
    group_by_edge_type,
    group_by_label,
    merge_clusters_by_jaccard,
    merge_edge_state,
    merge_edges,
    merge_node_state,
    merge_nodes,
    merge_nodes_by_label,
    node_state,
    state_types,
)
from typeloom.operators.patterns import node_patterns
from typeloom.operators.setjoin import connected_components, jaccard_pairs


def test_mandatory_means_every_element(spark):
    c = clusters(
        spark,
        [("c1", "A", ["a"], 1), ("c2", "A", ["b"], 2), ("c3", "A", ["b", "c"], 3), ("c4", "B", [], 1)],
    )
    assert type_dict(merge_nodes_by_label(c).types) == {
        ("A",): (6, [], ["a", "b", "c"]),
        ("B",): (1, [], []),
    }


def test_absorption_unites_and_leaves_the_rest_abstract(spark):
    ten = [f"p{i}" for i in range(10)]
    c = clusters(
        spark,
        [
            ("c1", "A", ten, 5),
            ("c2", "B", ["x"], 5),
            ("u1", "", ten[:9], 2),  # 0.9 with A
            ("u2", "", ten[:8], 3),  # 0.8: stays
            ("u3", "", ["x"], 4),  # 1.0 with B
            ("u4", "", [], 1),  # nothing in common with anything
        ],
    )
    found = {r["cluster_id"]: (r["labels"], r["jaccard"]) for r in absorb_unlabeled(c).collect()}
    assert found == {"u1": (["A"], 0.9), "u3": (["B"], 1.0)}
    rows = merge_nodes(c).types.collect()
    sizes = sorted((tuple(r["labels"]), r["n"]) for r in rows)
    assert sizes == [((), 1), ((), 3), (("A",), 7), (("B",), 9)]
    types = type_dict(merge_nodes(c).types.filter("size(labels) > 0"))
    assert types[("A",)] == (7, ten[:9], ["p9"])
    apart = merge_nodes(c, absorb=False).types.collect()
    assert sum(r["n"] for r in apart) == 20 and len(apart) == 6


def test_ties_go_to_the_first_label_unless_multi(spark):
    c = clusters(spark, [("c1", "B", ["x"], 1), ("c2", "A", ["x"], 1), ("u", "", ["x"], 1)])
    assert [r["labels"] for r in absorb_unlabeled(c).collect()] == [["A"]]
    both = absorb_unlabeled(c, multi=True).collect()
    assert sorted(r["labels"] for r in both) == [["A"], ["B"]]


def test_mixed_bucket_makes_a_type_with_both_labels(spark):
    c = clusters(spark, [("c1", "A", ["x"], 1), ("c1", "B", ["x"], 2), ("c1", "", ["x"], 3)])
    assert type_dict(merge_nodes(c).types) == {("A", "B"): (6, ["x"], [])}
    split = type_dict(merge_nodes(c, split_labels=True).types)
    # the unlabelled part has the property set of both and goes to the first
    assert split == {("A",): (4, ["x"], []), ("B",): (2, ["x"], [])}


def test_edges_by_ends_and_by_type(spark):
    c = edge_clusters(
        spark,
        [
            ("c1", "R", "A", "B", ["w"], 2),
            ("c2", "R", "C", "B", [], 3),
            ("c3", "R", "A", "B", [], 1),
            ("c4", "S", "", "", ["w"], 4),
            ("c5", "", "A", "B", [], 5),
        ],
    )
    by_ends = {
        (tuple(r["edge_types"]), tuple(r["src_labels"]), tuple(r["dst_labels"])): r["n"]
        for r in merge_edges(c).types.collect()
    }
    assert by_ends == {
        (("R",), ("A",), ("B",)): 3,
        (("R",), ("C",), ("B",)): 3,
        (("S",), (), ()): 4,
        ((), ("A",), ("B",)): 5,
    }
    by_type = merge_edges(c, ("type",)).types
    assert type_dict(by_type, "edge_types")[("R",)] == (6, [], ["w"])
    r = by_type.filter("array_contains(edge_types, 'R')").first()
    assert (r["src_labels"], r["dst_labels"]) == (["A", "C"], ["B"])
    with pytest.raises(ValueError):
        merge_edges(c, ("src",))


def test_jaccard_pairs_against_brute_force(spark):
    rng = random.Random(7)
    sets = {f"s{i}": frozenset(rng.sample("abcdefghij", rng.randint(0, 9))) for i in range(60)}
    frame = spark.createDataFrame(
        [(k, sorted(v)) for k, v in sets.items()], "id string, items array<string>"
    )
    for threshold in (0.3, 0.7, 0.9, 1.0):
        want = {
            (a, b)
            for a, b in itertools.product(sets, sets)
            if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold
        }
        got = {(r[0], r[1]) for r in jaccard_pairs(frame, frame, threshold).collect()}
        assert got == want


def test_components_of_a_long_chain(spark):
    ids = spark.createDataFrame([(f"{i:03d}",) for i in range(90)], "id string")
    links = spark.createDataFrame(
        [(f"{i:03d}", f"{i + 1:03d}") for i in range(89) if i != 40], "left_id string, right_id string"
    )
    got = {r["id"]: r["component"] for r in connected_components(ids, links).collect()}
    assert got == {f"{i:03d}": "000" if i <= 40 else "041" for i in range(90)}


def test_clusters_with_alike_labels(spark):
    frame = spark.createDataFrame(
        [("c1", ["A", "B"]), ("c2", ["A", "B", "C"]), ("c3", ["B", "C", "D"]), ("c4", []), ("c5", [])],
        "cluster_id string, labels array<string>",
    )
    got = {r["cluster_id"]: r["group_id"] for r in merge_clusters_by_jaccard(frame, 0.5).collect()}
    assert got["c1"] == got["c2"] == got["c3"]
    assert len({got["c1"], got["c4"], got["c5"]}) == 3


def test_regrouping(spark):
    n = nodes(spark, [("1", ["A", "B"], {"p": "1"}), ("2", ["A"], {"p": "1", "q": "2"}), ("3", ["C"], {})])
    rows = {r["label"]: r for r in group_by_label(node_patterns(n)).collect()}
    assert (rows["A"]["common"], rows["A"]["optional"], rows["A"]["n"]) == (["p"], ["q"], 2)
    assert rows["B"]["common"] == ["p"] and rows["C"]["all_properties"] == []
    c = edge_clusters(spark, [("c", "R", "A", "B", ["w"], 2), ("c", "R", "A", "B", [], 1)])
    row = group_by_edge_type(c).first()
    assert (row["edge_types"], row["src"], row["dst"], row["optional"]) == ("R", "A", "B", ["w"])


def test_every_node_gets_one_type(spark):
    n = nodes(spark, [(str(i), ["A"] if i % 3 else [], {"p": "1"} if i % 2 else {}) for i in range(30)])
    typed = merge_nodes(node_patterns(n).withColumnRenamed("pattern_id", "pattern_id").selectExpr("*", "pattern_id as cluster_id")).typed
    rows = assign_nodes(n, typed).collect()
    assert sorted(int(r["node_id"]) for r in rows) == list(range(30))


def test_state_is_additive(spark):
    a = clusters(spark, [("", "A", ["p", "q"], 2), ("", "B", ["r"], 1)])
    b = clusters(spark, [("", "A", ["p"], 3)])
    merged = merge_node_state(node_state(a), node_state(b))
    rows = {r["labels"]: (r["n"], r["mandatory"], r["optional"]) for r in state_types(merged).collect()}
    assert rows == {"A": (5, ["p"], ["q"]), "B": (1, ["r"], [])}
    empty = merge_node_state(merged, node_state(b).limit(0))
    assert empty.exceptAll(merged).count() == 0
    e = edge_clusters(spark, [("", "R", "A", "B", ["w"], 2)])
    twice = merge_edge_state(edge_state(e), edge_state(e))
    assert {(r["name"], r["n"]) for r in twice.collect()} == {("", 4), ("w", 4)}
