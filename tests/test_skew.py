"""Hot keys are found, dealt out in proportion, and joined as plain joins join them."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import edges, nodes
from typeloom.functions.sizing import pin
from typeloom.functions.skew import SHARE, hot_keys, split_join
from typeloom.model import endpoint_labels
from typeloom.operators import setjoin
from typeloom.operators.patterns import edge_patterns
from typeloom.operators.setjoin import connected_components


def test_hot_keys_and_their_groups(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("k"), "id")).alias("a"),
        F.when(F.col("id") % 2 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("b"),
    )
    found = {(r["column"], r["key"]): r["parts"] for r in hot_keys(rows, "a", "b").collect()}
    assert found == {("a", "hub"): -(-SHARE // 3)}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_split_join_is_a_join(spark, how):
    left = spark.createDataFrame(
        [(i, None if i % 7 == 0 else "hub" if i % 3 == 0 else f"k{i % 50}") for i in range(2000)], "id int, k string"
    )
    right = spark.createDataFrame(
        [("hub", 1), ("hub", 2), (None, 3), *((f"k{i}", i) for i in range(40))], "k string, v int"
    )
    got = split_join(left, right, "k", hot_keys(left, "k"), [F.col("id")], how).select("id", "k", "v")
    want = left.join(right, "k", how).select("id", "k", "v")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_split_join_of_empty_tables(spark):
    left = spark.createDataFrame([], "id int, k bigint")
    right = spark.createDataFrame([(1, 2)], "k bigint, v int")
    assert hot_keys(left, "k").count() == 0
    assert split_join(left, right, "k", hot_keys(left, "k"), [F.col("id")]).count() == 0


def test_edges_of_a_hub_are_many_tasks_work(spark):
    """A third of all edges end in one node; without adaptive joins no partition has them all."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        n = nodes(spark, [("hub", ["Hub"], {}), *((f"n{i}", ["N"], {}) for i in range(2000))])
        e = edges(spark, [(f"n{i % 2000}", "hub" if i % 3 == 0 else f"n{i * 7 % 2000}", "T", {}) for i in range(6000)])
        found = endpoint_labels(e, n)
        assert Counter(tuple(r[0]) for r in found.select("dst_labels").collect()) == {("Hub",): 2000, ("N",): 4000}
        of_hub = found.filter("dst_id = 'hub'").groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in of_hub) < 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)


@pytest.mark.parametrize("shape", ["chain", "star", "clique"])
def test_components_of_shapes(spark, shape):
    size = {"chain": 60, "star": 1000, "clique": 20}[shape]
    members = [i * 37 % 1009 for i in range(size)]  # distinct, out of order
    pairs = {
        "chain": list(zip(members, members[1:])),
        "star": [(members[3], x) for x in members if x != members[3]],
        "clique": [(a, b) for a in members for b in members if a < b],
    }[shape]
    alone = [2000, 2001]
    ids = spark.createDataFrame([(x,) for x in members + alone], "id bigint")
    links = spark.createDataFrame([*pairs, (3000, 3000)], "left_id bigint, right_id bigint")
    got = {r["id"]: r["component"] for r in connected_components(ids, links).collect()}
    assert got == {**dict.fromkeys(members, min(members)), 2000: 2000, 2001: 2001}


def _join_outputs(df):
    """Names of the columns that the joins of the optimized plan give."""
    plan, found = df._jdf.queryExecution().optimizedPlan(), []
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Join":
            found.append({node.output().apply(i).name() for i in range(node.output().length())})
        todo += [node.children().apply(i) for i in range(node.children().length())]
    return found


def test_patterns_shuffle_no_edge_ids(spark):
    links = edges(spark, [("a", "b", "T", {"p": "1"}), ("a", None, "T", {}), (None, "b", None, {})])
    known = nodes(spark, [("a", ["", "B", "A"], {}), ("a", ["C"], {}), ("b", None, {}), ("b", ["D"], {}), (None, ["N"], {})])
    found = edge_patterns(endpoint_labels(links, known))
    wide = [names for names in _join_outputs(found) if {"src_labels", "dst_labels"} & names]
    assert wide and not any("edge_id" in names for names in wide)
    got = sorted((r.edge_type, r.src_key, r.dst_key, r.prop_set, r.n) for r in found.collect())
    assert got == [("", "", "D", [], 1), ("T", "A:B:C", "", [], 1), ("T", "A:B:C", "D", ["p"], 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "shuffle_hash" in plan


def _outputs(df):
    """Names that the operators of the optimized plan above its sources give."""
    found, todo = set(), [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().length())]
        if below:
            found |= {node.output().apply(i).name() for i in range(node.output().length())}
        todo += below
    return found


def test_patterns_read_no_edge_ids(spark):
    """An id may be a digest of the whole row, which patterns have no use for."""
    links = edges(spark, [("a", "b", "T", {})] * 3)
    found = _outputs(edge_patterns(endpoint_labels(links, nodes(spark, [("a", ["A"], {})]))))
    assert "src_labels" in found and "edge_id" not in found


def test_ends_that_are_hubs_missing_or_shared(spark):
    rows = [("hub", "gone", "T", {})] * 300 + [("hub", None, "T", {})] * 20 + [(None, "a", "T", {}), ("a", "hub", "U", {"p": "1"})]
    known = nodes(spark, [("hub", ["H"], {}), ("hub", ["G", "H"], {}), ("a", None, {}), ("a", ["A"], {}), (None, ["N"], {})])
    links = edges(spark, rows)
    found = endpoint_labels(links, known)
    assert found.columns == [*links.columns, "src_labels", "dst_labels"]
    labels = {"hub": ["G", "H"], "a": ["A"]}
    got = {r.edge_id: (r.src_id, r.dst_id, r.src_labels, r.dst_labels) for r in found.collect()}
    assert got == {f"e{i}": (s, d, labels.get(s, []), labels.get(d, [])) for i, (s, d, *_) in enumerate(rows)}
    assert found.count() == len(rows)


def test_no_hot_key_among_many(spark):
    rows = spark.range(20000).select(F.col("id").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    assert hot_keys(rows, "a", "b").collect() == []


def test_rounds_over_few_links_are_few_tasks(spark, monkeypatch):
    """However many partitions a shuffle has, a task takes TASK_LINKS links; many links keep many tasks."""
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    kept = []
    monkeypatch.setattr(setjoin, "pin", lambda df: kept.append(pin(df)) or kept[-1])
    try:
        ids = spark.range(80).select("id")
        links = ids.select(F.col("id").alias("left_id"), (F.col("id") + 8).alias("right_id")).filter("right_id < 80")
        for least, links_a_task, most in ((3, 1000, 3), (1, 10, 8)):
            monkeypatch.setattr(setjoin, "LEAST_TASKS", least)
            monkeypatch.setattr(setjoin, "TASK_LINKS", links_a_task)
            kept.clear()
            got = {r["id"]: r["component"] for r in connected_components(ids, links).collect()}
            assert got == {i: i % 8 for i in range(80)}
            partitions = [df.rdd.getNumPartitions() for df in kept[1:-1]]  # without what comes in and goes out
            assert partitions and max(partitions) == most
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_few_links_are_joined_in_few_tasks_without_looking_for_hubs(spark, monkeypatch):
    """Hubs are looked for once LEAST_TASKS tasks no longer hold all links; the components are the same."""
    kept, looked = [], []
    monkeypatch.setattr(setjoin, "pin", lambda df: kept.append(pin(df)) or kept[-1])
    monkeypatch.setattr(setjoin, "hot_keys", lambda *a: looked.append(a) or hot_keys(*a))
    ids = spark.range(-1, 700).select("id")
    hub = ids.select(F.lit(1).cast("long").alias("left_id"), F.col("id").alias("right_id")).filter("id between 2 and 400")
    chain = ids.select("id", F.col("id") + 1).filter("id >= 500 and id < 520")
    twice = spark.createDataFrame([(600, 601), (601, 600), (601, 601), (None, 602)], "left_id long, right_id long")
    links = hub.union(chain).union(twice).repartition(16)
    want = {i: i for i in range(-1, 700)} | dict.fromkeys(range(1, 401), 1) | dict.fromkeys(range(500, 521), 500)
    want[601] = 600
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r["id"]: r["component"] for r in connected_components(ids, links).collect()} == want
        assert not looked and max(df.rdd.getNumPartitions() for df in kept[1:-1]) <= 4
        monkeypatch.setattr(setjoin, "TASK_LINKS", 50)
        assert {r["id"]: r["component"] for r in connected_components(ids, links).collect()} == want
        assert looked
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edge_ids_are_shuffled_as_bytes(spark):
    some = nodes(spark, [("a", ["A"], {}), ("b", ["B"], {})])
    links = edges(spark, [("a", "b", "T", {}), ("b", "x", "T", {})]).withColumn(
        "edge_id", F.when(F.col("dst_id") == "b", F.md5("edge_id")).otherwise(F.lit("plain-ID"))
    )
    out = endpoint_labels(links, some)
    todo, carried = [out._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "Join" and "_key" in node.simpleString(100):  # not those with hot nodes, which are broadcast
            columns = node.left().output()
            columns = [columns.apply(i) for i in range(columns.length())]
            carried += [c.dataType().typeName() for c in columns if c.name() == "edge_id"]
        todo += [node.children().apply(i) for i in range(node.children().length())]
    assert carried == ["binary", "binary"]
    got = {(r["edge_id"], tuple(r["src_labels"]), tuple(r["dst_labels"])) for r in out.collect()}
    md5 = links.filter("dst_id = 'b'").first()["edge_id"]
    assert got == {(md5, ("A",), ("B",)), ("plain-ID", ("B",), ())}
