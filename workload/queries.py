"""Registered queries: the Spark form of each with its SQL twin, if it has one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom import discover, discover_all, robustness_grid
from typeloom.functions.sizing import keep, pin, work_folder
from typeloom.functions.values import flag_columns
from typeloom.model import PropertyGraph
from typeloom.operators import cardinality as card
from typeloom.operators import census, cluster, encode, evaluate, infer, merge, noise, patterns, render
from typeloom.plans.discovery import Schema
from typeloom.plans.robustness import LABEL_LOSS, NOISE_LEVELS
from typeloom.sources import batches, csv_graph, wide
from typeloom.streaming import schema_from_state, update_state
from workload import oracle as sql
from workload.graph import EDGE_TABLES, NODE_TABLES, Table, load_graph, wide_table
from workload.graph import register as register_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
LOSS = sql.LOSS


def register(name: str, twin: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if twin is not None:
            ORACLES[name] = twin
        return fn

    return add


# ------------------------------------------------------------------- helpers


def lossy_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph with three labels in ten removed."""
    graph = load_graph(spark, sf_dir)
    return graph.with_nodes(noise.drop_labels(graph.nodes, LOSS))


def lossy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pin(patterns.node_patterns(lossy_graph(spark, sf_dir).nodes))


def lossy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_patterns_of(lossy_graph(spark, sf_dir))


def edge_patterns_of(graph: PropertyGraph) -> DataFrame:
    return pin(patterns.edge_patterns(graph.labeled_edges()))


def node_clusters(spark: SparkSession, sf_dir: str, method: str = "lsh") -> DataFrame:
    return pin(cluster.cluster(lossy_nodes(spark, sf_dir), method))


def edge_clusters(spark: SparkSession, sf_dir: str, method: str = "minhash") -> DataFrame:
    return pin(cluster.cluster(lossy_edges(spark, sf_dir), method))


def text(col: str) -> Column:
    return F.array_join(col, ",").alias(col)


def props_text() -> Column:
    one = F.transform(
        "props",
        lambda p: F.concat_ws(
            ":", p["name"], p["n_present"].cast("string"), F.when(p["mandatory"], "m").otherwise("o")
        ),
    )
    return F.array_join(one, ",").alias("props")


def node_type_text(types: DataFrame) -> DataFrame:
    return types.select("type_id", text("labels"), "n", props_text())


def edge_type_text(types: DataFrame) -> DataFrame:
    return types.select(
        "type_id", text("edge_types"), text("src_labels"), text("dst_labels"), "n", props_text()
    )


NODE_TYPE_TEXT = f"type_id, array_to_string(labels, ',') as labels, n, {sql.PROPS_TEXT} as props"
EDGE_TYPE_TEXT = f"""type_id, array_to_string(types, ',') as edge_types,
  array_to_string(srcs, ',') as src_labels, array_to_string(dsts, ',') as dst_labels, n,
  {sql.PROPS_TEXT} as props"""

CLEAN = sql.base(0.0)
LOSSY = sql.base(LOSS)


# ------------------------------------------------------- sources and patterns


@register(
    "nodes_from_wide",
    sql.query(
        CLEAN,
        """select n.node_id, n.label as labels, coalesce(v.props, '') as props
        from nodes n left join (
          select id, string_agg(name || '=' || val, chr(31) order by name) as props
          from node_values group by id) v on v.id = n.node_id""",
    ),
)
def nodes_from_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.transform(F.map_entries("props"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return load_graph(spark, sf_dir).nodes.select(
        "node_id", text("labels"), F.array_join(pairs, "\u001f").alias("props")
    )


@register(
    "edges_with_endpoint_labels",
    sql.query(LOSSY, "select edge_id, src_id, dst_id, edge_type, src_key, dst_key from edges"),
)
def edges_with_endpoint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lossy_graph(spark, sf_dir).labeled_edges().select(
        "edge_id",
        "src_id",
        "dst_id",
        "edge_type",
        F.array_join("src_labels", ":").alias("src_key"),
        F.array_join("dst_labels", ":").alias("dst_key"),
    )


@register(
    "property_keys",
    sql.query(
        CLEAN,
        "select distinct 'node' as element, name from node_values"
        " union all select distinct 'edge', name from edge_values",
    ),
)
def property_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = load_graph(spark, sf_dir)
    nodes, edges = wide.property_keys(graph.nodes), wide.property_keys(graph.edges)
    return nodes.select(F.lit("node").alias("element"), "name").unionByName(
        edges.select(F.lit("edge").alias("element"), "name")
    )


@register(
    "property_census",
    sql.query(
        CLEAN,
        "select 'node' as element, name, count(*) as n from node_values group by name"
        " union all select 'edge', name, count(*) from edge_values group by name",
    ),
)
def property_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = load_graph(spark, sf_dir)
    nodes, edges = census.property_census(graph.nodes), census.property_census(graph.edges)
    return nodes.select(F.lit("node").alias("element"), "name", "n").unionByName(
        edges.select(F.lit("edge").alias("element"), "name", "n")
    )


@register(
    "label_census",
    sql.query(LOSSY, "select label, count(*) as n from nodes where label <> '' group by label"),
)
def label_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.label_census(lossy_graph(spark, sf_dir).nodes)


@register(
    "snapshot_labels",
    sql.query(
        LOSSY, "select true_label as truth, label as labels, count(*) as n from nodes group by all"
    ),
)
def snapshot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = wide.snapshot_labels(load_graph(spark, sf_dir).nodes)
    return (
        noise.drop_labels(kept, LOSS)
        .groupBy(F.array_join("true_labels", ",").alias("truth"), text("labels"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "align_wide",
    """select c_acctbal as acctbal, c_custkey as key, c_mktsegment as mktsegment, c_name as name
       from customer
       union all select s_acctbal, s_suppkey, null, s_name from supplier""",
)
def align_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey as key", "c_name as name", "c_acctbal as acctbal", "c_mktsegment as mktsegment"
    )
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(
        "s_acctbal as acctbal", "s_suppkey as key", "s_name as name"
    )
    return wide.align_wide(customers, suppliers)


NODE_NAMES = sorted({name for t in NODE_TABLES for name, _ in t.props})
EDGE_NAMES = sorted({name for t in EDGE_TABLES for name, _ in t.props})


def _presence_sql(rows: str, id_column: str, names: list[str]) -> str:
    bits = ", ".join(f"list_contains(pset, '{n}')::INTEGER::DOUBLE as prop_{n}" for n in names)
    return sql.query(CLEAN, f"select {id_column}, {bits} from {rows}")


@register("presence_matrix", _presence_sql("nodes", "node_id", NODE_NAMES))
def presence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.presence(load_graph(spark, sf_dir).nodes, NODE_NAMES)


@register("presence_matrix_edges", _presence_sql("edges", "edge_id", EDGE_NAMES))
def presence_matrix_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.presence(load_graph(spark, sf_dir).edges, EDGE_NAMES, "edge_id")


@register(
    "node_patterns",
    sql.query(
        LOSSY,
        "select pattern_id, label_key, array_to_string(pset, ',') as prop_set, n from np",
    ),
)
def node_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.node_patterns(lossy_graph(spark, sf_dir).nodes)
    return found.select("pattern_id", "label_key", text("prop_set"), "n")


@register(
    "edge_patterns",
    sql.query(
        LOSSY,
        "select pattern_id, edge_type, src_key, dst_key, array_to_string(pset, ',') as prop_set, n"
        " from ep",
    ),
)
def edge_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.edge_patterns(lossy_graph(spark, sf_dir).labeled_edges())
    return found.select("pattern_id", "edge_type", "src_key", "dst_key", text("prop_set"), "n")


@register(
    "distinct_label_sets", sql.query(LOSSY, "select count(distinct label_key) as n_labels from np")
)
def distinct_label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.distinct_label_sets(
        patterns.node_patterns(lossy_graph(spark, sf_dir).nodes)
    )


@register(
    "label_hash_codes",
    sql.query(
        LOSSY,
        "select label_key, array_to_string(c, ',') as codes from ("
        f"select distinct label_key, {sql.codes('label_key', 5)} as c from np)",
    ),
)
def label_hash_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.node_patterns(lossy_graph(spark, sf_dir).nodes)
    codes = encode.label_codes(F.col("label_key"), 5, 42).cast("array<string>")
    return found.select("label_key", F.array_join(codes, ",").alias("codes")).distinct()


@register("assemble_features", sql.query(LOSSY, sql.features()))
def assemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the feature vectors of nodes and edges."""
    nodes = encode.feature_rows(lossy_nodes(spark, sf_dir)).withColumn("element", F.lit("node"))
    return nodes.unionByName(
        encode.feature_rows(lossy_edges(spark, sf_dir)).withColumn("element", F.lit("edge"))
    )


@register("assemble_features_ml")
def assemble_features_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding by word2vec and presence bits, as text."""
    found = encode.assemble(lossy_nodes(spark, sf_dir), "word2vec")
    return found.select("pattern_id", F.col("features").cast("string").alias("features"))


# ------------------------------------------------------------------ clustering


PARAMS = [*LOSSY, sql.params()]


@register(
    "distance_stats",
    sql.query(
        PARAMS,
        "select 'node' as element, * from nstats union all select 'edge', * from estats",
    ),
)
def distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = cluster.distance_stats(lossy_nodes(spark, sf_dir))
    edges = cluster.distance_stats(lossy_edges(spark, sf_dir))
    return nodes.withColumn("element", F.lit("node")).unionByName(
        edges.withColumn("element", F.lit("edge"))
    )


@register(
    "distance_moments",
    sql.query(
        LOSSY,
        f"select 'node' as element, * from ({sql.moments('n')}) union all"
        f" select 'edge', * from ({sql.moments('e')})",
    ),
)
def distance_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = cluster.distance_moments(lossy_nodes(spark, sf_dir)).withColumn("element", F.lit("node"))
    edges = cluster.distance_moments(lossy_edges(spark, sf_dir)).withColumn("element", F.lit("edge"))
    return nodes.unionByName(edges)


@register(
    "lsh_params",
    sql.query(PARAMS, "select 'node' as element, * from nlsh union all select 'edge', * from elsh"),
)
def lsh_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = cluster.lsh_params(lossy_nodes(spark, sf_dir))
    edges = cluster.lsh_params(lossy_edges(spark, sf_dir))
    return nodes.withColumn("element", F.lit("node")).unionByName(
        edges.withColumn("element", F.lit("edge"))
    )


@register(
    "minhash_params",
    sql.query(PARAMS, "select 'node' as element, * from nmh union all select 'edge', * from emh"),
)
def minhash_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = cluster.minhash_params(lossy_nodes(spark, sf_dir))
    edges = cluster.minhash_params(lossy_edges(spark, sf_dir))
    return nodes.withColumn("element", F.lit("node")).unionByName(
        edges.withColumn("element", F.lit("edge"))
    )


LSH = sql.clustered(LOSS, "lsh")
MINHASH = sql.clustered(LOSS, "minhash")
IDS = "pattern_id, n, cluster_id"


@register("lsh_clusters_det", sql.query(LSH, f"select {IDS} from nc"))
def lsh_clusters_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_lsh(lossy_nodes(spark, sf_dir)).select(*IDS.split(", "))


@register("lsh_edge_clusters_det", sql.query(LSH, f"select {IDS} from ec"))
def lsh_edge_clusters_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_lsh(lossy_edges(spark, sf_dir)).select(*IDS.split(", "))


@register("minhash_clusters_det", sql.query(MINHASH, f"select {IDS} from nc"))
def minhash_clusters_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_minhash(lossy_nodes(spark, sf_dir)).select(*IDS.split(", "))


@register("minhash_edge_clusters_det", sql.query(MINHASH, f"select {IDS} from ec"))
def minhash_edge_clusters_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_minhash(lossy_edges(spark, sf_dir)).select(*IDS.split(", "))


@register("lsh_clusters_ml")
def lsh_clusters_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.cluster_lsh(lossy_nodes(spark, sf_dir), impl="ml", embedding="word2vec")
    return found.select(*IDS.split(", "))


@register("lsh_edge_clusters_ml")
def lsh_edge_clusters_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.cluster_lsh(lossy_edges(spark, sf_dir), impl="ml")
    return found.select(*IDS.split(", "))


@register("minhash_clusters_ml")
def minhash_clusters_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.cluster_minhash(lossy_nodes(spark, sf_dir), impl="ml")
    return found.select(*IDS.split(", "))


@register("minhash_edge_clusters_ml")
def minhash_edge_clusters_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.cluster_minhash(lossy_edges(spark, sf_dir), impl="ml")
    return found.select(*IDS.split(", "))


KMEANS = sql.clustered(LOSS, "kmeans")


@register("kmeans_nodes", sql.query(KMEANS, f"select {IDS} from nc"))
def kmeans_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_kmeans(lossy_nodes(spark, sf_dir)).select(*IDS.split(", "))


@register("kmeans_edges", sql.query(KMEANS, f"select {IDS} from ec"))
def kmeans_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_kmeans(lossy_edges(spark, sf_dir)).select(*IDS.split(", "))


@register(
    "cluster_summary",
    sql.query(
        LSH,
        """select c.cluster_id, c.n_patterns, c.n, c.label_keys, coalesce(p.props, '') as props
        from (select cluster_id, count(*) as n_patterns, sum(n)::BIGINT as n,
                string_agg(distinct label_key, ',' order by label_key) as label_keys
              from nc group by cluster_id) c
        left join (
          select cluster_id, string_agg(x || ':' || m::varchar, ',' order by x) as props from (
            select cluster_id, x, sum(n)::BIGINT as m from (
              select cluster_id, n, unnest(pset) as x from nc) group by cluster_id, x)
          group by cluster_id) p on p.cluster_id = c.cluster_id""",
    ),
)
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.cluster_summary(node_clusters(spark, sf_dir))
    props = F.transform(
        "props", lambda p: F.concat_ws(":", p["name"], p["n_present"].cast("string"))
    )
    return found.select(
        "cluster_id", "n_patterns", "n", text("label_keys"), F.array_join(props, ",").alias("props")
    )


@register(
    "cluster_property_sets",
    sql.query(
        LSH,
        "select cluster_id, array_to_string(pset, ',') as prop_set, sum(n)::BIGINT as n"
        " from nc group by cluster_id, pset",
    ),
)
def cluster_property_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.cluster_property_sets(node_clusters(spark, sf_dir))
    return found.select("cluster_id", text("prop_set"), "n")


# --------------------------------------------------------------------- merging


MERGED = sql.merged(LOSS, "lsh")
MERGED_MH = sql.merged(LOSS, "minhash")


@register("merge_nodes_by_label", sql.query(MERGED, f"select {NODE_TYPE_TEXT} from ltypes"))
def merge_nodes_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_type_text(merge.merge_nodes_by_label(node_clusters(spark, sf_dir)).types)


ABSORBED = "select cluster_id, type_id, array_to_string(labels, ',') as labels"


@register(
    "absorb_unlabeled",
    sql.query(MERGED_MH, f"{ABSORBED}, round(jaccard, 6) as jaccard from absorbed"),
)
def absorb_unlabeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.absorb_unlabeled(node_clusters(spark, sf_dir, "minhash"))
    return found.select(
        "cluster_id", "type_id", text("labels"), F.round("jaccard", 6).alias("jaccard")
    )


@register(
    "absorb_unlabeled_multi",
    sql.query(
        MERGED_MH,
        f"{ABSORBED}, round(jaccard, 6) as jaccard from jac where jaccard >= 0.5::DOUBLE",
    ),
)
def absorb_unlabeled_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = node_clusters(spark, sf_dir, "minhash")
    found = merge.absorb_unlabeled(clusters, threshold=0.5, multi=True)
    return found.select(
        "cluster_id", "type_id", text("labels"), F.round("jaccard", 6).alias("jaccard")
    )


@register(
    "abstract_types",
    sql.query(MERGED_MH, f"{ABSORBED} from abstract"),
)
def abstract_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = node_clusters(spark, sf_dir, "minhash")
    found = merge.abstract_types(clusters, merge.absorb_unlabeled(clusters))
    return found.select("cluster_id", "type_id", text("labels"))


@register("merge_nodes", sql.query(MERGED_MH, f"select {NODE_TYPE_TEXT} from ntypes"))
def merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_type_text(merge.merge_nodes(node_clusters(spark, sf_dir, "minhash")).types)


@register("merge_edges_by_endpoints", sql.query(MERGED_MH, f"select {EDGE_TYPE_TEXT} from etypes"))
def merge_edges_by_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_type_text(merge.merge_edges(edge_clusters(spark, sf_dir)).types)


@register("merge_edges_by_type", sql.query(MERGED_MH, f"select {EDGE_TYPE_TEXT} from rtypes"))
def merge_edges_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_type_text(merge.merge_edges(edge_clusters(spark, sf_dir), ("type",)).types)


MERGED_KM = sql.merged(LOSS, "kmeans")


@register("merge_kmeans_nodes", sql.query(MERGED_KM, f"select {NODE_TYPE_TEXT} from ntypes"))
def merge_kmeans_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = node_clusters(spark, sf_dir, "kmeans")
    return node_type_text(merge.merge_nodes(clusters, absorb=False).types)


@register("merge_kmeans_edges", sql.query(MERGED_KM, f"select {EDGE_TYPE_TEXT} from etypes"))
def merge_kmeans_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_type_text(merge.merge_edges(edge_clusters(spark, sf_dir, "kmeans")).types)


JACCARD_GROUPS = f"""
csets as (select cluster_id, labels, md5(array_to_string(labels, {sql.IS})) as id from ncl),
dsets as (select distinct id, labels from csets where len(labels) > 0),
linked as (
  select a.id, b.id as other from dsets a, dsets b
  where len(list_intersect(a.labels, b.labels))::DOUBLE / (len(a.labels) + len(b.labels)
    - len(list_intersect(a.labels, b.labels))) >= 0.4::DOUBLE),
reach as (
  select id, other from linked
  union select r.id, l.other from reach r join linked l on l.id = r.other)"""


@register(
    "merge_clusters_jaccard",
    sql.query(
        [*MERGED, JACCARD_GROUPS],
        f"""select c.cluster_id, array_to_string(c.labels, ',') as labels,
          coalesce(g.g, md5('U' || {sql.FS} || c.cluster_id)) as group_id
        from csets c left join (select id, min(other) as g from reach group by id) g on g.id = c.id
          and len(c.labels) > 0""",
        recursive=True,
    ),
)
def merge_clusters_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = merge.cluster_labels(node_clusters(spark, sf_dir))
    found = merge.merge_clusters_by_jaccard(labels, threshold=0.4)
    return found.select("cluster_id", text("labels"), "group_id")


def _grouped(keys: str, rows: str) -> str:
    return f"""
      select {keys}, n, coalesce(common, '') as common, coalesce(optional, '') as optional,
        coalesce(all_properties, '') as all_properties
      from (select {keys}, sum(n)::BIGINT as n from ({rows}) group by {keys}) t
      left join (
        select {keys}, string_agg(x, ',' order by x) filter (m = tot) as common,
          string_agg(x, ',' order by x) filter (m < tot) as optional,
          string_agg(x, ',' order by x) as all_properties
        from (select {keys}, x, sum(n)::BIGINT as m from (
                select {keys}, n, unnest(pset) as x from ({rows})) group by {keys}, x)
        join (select {keys}, sum(n)::BIGINT as tot from ({rows}) group by {keys}) using ({keys})
        group by {keys}) p using ({keys})"""


@register(
    "group_by_label",
    sql.query(LOSSY, _grouped("label", "select label_key as label, pset, n from np where label_key <> ''")),
)
def group_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.group_by_label(patterns.node_patterns(lossy_graph(spark, sf_dir).nodes))
    return found.select("label", "n", text("common"), text("optional"), text("all_properties"))


@register(
    "group_by_edge_type",
    sql.query(
        LOSSY,
        _grouped(
            "edge_types, src, dst",
            "select edge_type as edge_types, src_key as src, dst_key as dst, pset, n from ep",
        ),
    ),
)
def group_by_edge_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.group_by_edge_type(lossy_edges(spark, sf_dir))
    return found.select(
        "edge_types", "src", "dst", "n", text("common"), text("optional"), text("all_properties")
    )


@register(
    "label_members", sql.query(LOSSY, "select label, node_id from nodes where label <> ''")
)
def label_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.label_members(lossy_graph(spark, sf_dir).nodes)


@register(
    "edge_type_members",
    sql.query(
        LOSSY,
        "select edge_type as edge_types, src_key as src, dst_key as dst, edge_id from edges",
    ),
)
def edge_type_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.edge_type_members(lossy_graph(spark, sf_dir).labeled_edges())


EVAL = [*MERGED_MH, sql.evaluation()]


def assigned_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    merged = merge.merge_nodes(node_clusters(spark, sf_dir, "minhash"))
    return merge.assign_nodes(lossy_graph(spark, sf_dir).nodes, merged.typed), merged.types


def assigned_edges(spark: SparkSession, sf_dir: str, ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges with ``type_id``, and the types; with their ``ids`` they are labelled once, for patterns and types."""
    graph = lossy_graph(spark, sf_dir)  # one, so its hot nodes are looked for once
    labeled = graph.labeled_edges()
    if ids:  # shuffled anyway: kept, they take less disk than a second round of joins
        labeled = keep(labeled.select("edge_id", *patterns.EDGE_KEYS))
    found = pin(patterns.edge_patterns(labeled))
    merged = merge.merge_edges(pin(cluster.cluster(found, "minhash")))
    return merge.assign_edges(labeled, merged.typed), merged.types


@register("assign_nodes", sql.query(EVAL, "select node_id, type_id from neval"))
def assign_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned_nodes(spark, sf_dir)[0].select("node_id", "type_id")


@register("assign_edges", sql.query(EVAL, "select edge_id, type_id from eeval"))
def assign_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned_edges(spark, sf_dir, ids=True)[0].select("edge_id", "type_id")


# ------------------------------------------------------------------- inference


TYPING = [*CLEAN, sql.typing("node"), sql.typing("edge")]


@register(
    "value_predicates",
    sql.query(
        [
            *CLEAN,
            f"tested as (select 'node' as element, id, name, {sql.flags()} from node_values"
            f" union all select 'edge', id, name, {sql.flags()} from edge_values)",
        ],
        "select element, id, name, is_integer::INTEGER as is_integer, is_double::INTEGER as is_double,"
        " is_date::INTEGER as is_date, is_boolean::INTEGER as is_boolean, is_ip::INTEGER as is_ip"
        " from tested",
    ),
)
def value_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _both_kinds(infer.property_values, spark, sf_dir)
    flags = [f.cast("int").alias(n) for n, f in flag_columns(F.col("value")).items()]
    return values.select("element", "id", "name", *flags)


def _both_kinds(fn, spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = load_graph(spark, sf_dir)
    return fn(graph.nodes).withColumn("element", F.lit("node")).unionByName(
        fn(graph.edges).withColumn("element", F.lit("edge"))
    )


def _both_sql(select: str) -> str:
    return f"{select.format(e='node')} union all {select.format(e='edge')}"


@register(
    "infer_types_sample",
    sql.query(
        TYPING,
        _both_sql(f"select '{{e}}' as element, name, total, {sql.UNANIMOUS} as dtype from {{e}}sample"),
    ),
)
def infer_types_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_kinds(infer.infer_types_sample, spark, sf_dir)


@register(
    "infer_types_stats",
    sql.query(
        TYPING,
        _both_sql(
            "select '{e}' as element, name, total, int_cnt, dbl_cnt, date_cnt, bool_cnt, ip_cnt,"
            f" {sql.MAJORITY} as dtype, round({sql.SUPPORT}, 6) as support from {{e}}full"
        ),
    ),
)
def infer_types_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _both_kinds(infer.infer_types_stats, spark, sf_dir)
    return found.withColumn("support", F.round("support", 6))


ERROR_SAMPLE = 20


def _compared(kind: str) -> str:
    """Sample against full types of one kind of elements."""
    return f"""
{kind}compared as (
  select '{kind}' as element, s.name, s.dtype as sample_type, f.dtype as full_type,
    s.support as sample_support, f.support as full_support, abs(s.support - f.support) as delta
  from (select name, {sql.MAJORITY} as dtype, {sql.SUPPORT} as support from {kind}sample) s
  join (select name, {sql.MAJORITY} as dtype, {sql.SUPPORT} as support from {kind}full) f
    on f.name = s.name)"""


REPORT = [
    *CLEAN,
    *[sql.typing(k).replace("r <= 1000", f"r <= {ERROR_SAMPLE}") for k in ("node", "edge")],
    _compared("node"),
    _compared("edge"),
    "compared as (select * from nodecompared union all select * from edgecompared)",
]


def _of_both(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    graph = load_graph(spark, sf_dir)
    frames = [
        getattr(infer.type_error_report(elements, ERROR_SAMPLE), part).withColumn("element", F.lit(kind))
        for kind, elements in (("node", graph.nodes), ("edge", graph.edges))
    ]
    return frames[0].unionByName(frames[1])


@register(
    "type_error_summary",
    sql.query(
        REPORT,
        """select element, count(*) as n_properties, count(*) filter (sample_type = full_type) as n_matches,
          round(avg((sample_type = full_type)::INTEGER::DOUBLE) * 100, 4) as agreement_pct,
          round(avg(delta) * 100, 4) as avg_delta_pct from compared group by element""",
    ),
)
def type_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_both(spark, sf_dir, "summary")


@register(
    "type_error_histogram",
    sql.query(
        REPORT,
        """select e.element, b.bin, b.low, count(c.delta) as n from (
            values (1, 0::DOUBLE, 0.05::DOUBLE), (2, 0.05::DOUBLE, 0.1::DOUBLE),
              (3, 0.1::DOUBLE, 0.2::DOUBLE), (4, 0.2::DOUBLE, 0.3::DOUBLE),
              (5, 0.3::DOUBLE, 9::DOUBLE)) b(bin, low, high)
          cross join (values ('node'), ('edge')) e(element)
          left join compared c on c.element = e.element and c.delta >= b.low and c.delta < b.high
          group by e.element, b.bin, b.low""",
    ),
)
def type_error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_both(spark, sf_dir, "histogram")


def _mismatch_sql(table: str) -> str:
    return f"""select element, name, sample_type, full_type, round(sample_support, 6) as sample_support,
      round(full_support, 6) as full_support, round(delta, 6) as delta
      from {table} where sample_type <> full_type"""


@register("type_mismatches", sql.query(REPORT, _mismatch_sql("compared")))
def type_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_report(_of_both(spark, sf_dir, "mismatches"))


def _rounded_report(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.round(c, 6) for c in ("sample_support", "full_support", "delta")})


@register(
    "type_properties",
    sql.query(MERGED_MH, "select distinct unnest(props).name as name from ntypes"),
)
def type_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = merge.merge_nodes(node_clusters(spark, sf_dir, "minhash")).types
    return infer.type_properties(types)


ANNOTATED = [
    *MERGED_MH,
    sql.typing("node"),
    sql.typing("edge"),
    sql.CARD,
    f"""
ndt as (select name, {sql.UNANIMOUS} as dtype from nodefull),
edt as (select name, {sql.UNANIMOUS} as dtype from edgefull),
nprops as (
  select p.type_id, p.p.name as name, p.p.man as man, coalesce(d.dtype, 'Unknown') as dtype
  from (select type_id, unnest(props) as p from ntypes) p left join ndt d on d.name = p.p.name),
eprops as (
  select p.type_id, p.p.name as name, p.p.man as man, coalesce(d.dtype, 'Unknown') as dtype
  from (select type_id, unnest(props) as p from rtypes) p left join edt d on d.name = p.p.name)""",
]


def annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge types of the lossy graph, ready for rendering."""
    graph = lossy_graph(spark, sf_dir)
    nodes = merge.merge_nodes(node_clusters(spark, sf_dir, "minhash")).types
    edges = merge.merge_edges(edge_clusters(spark, sf_dir), ("type",)).types
    node_types = infer.annotate_types(nodes, infer.infer_types(graph.nodes))
    edge_types = infer.annotate_types(edges, infer.infer_types(graph.edges))
    found = card.cardinalities(graph.edges)
    return pin(node_types), pin(card.annotate_cardinality(edge_types, found))


@register(
    "annotate_types",
    sql.query(
        ANNOTATED,
        """select t.type_id, array_to_string(t.labels, ',') as labels, t.n, coalesce(p.props, '') as props
        from ntypes t left join (
          select type_id, string_agg(name || ':' || dtype || case when man then ':m' else ':o' end,
            ',' order by name) as props from nprops group by type_id) p on p.type_id = t.type_id""",
    ),
)
def annotate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.transform(
        "props",
        lambda p: F.concat_ws(":", p["name"], p["dtype"], F.when(p["mandatory"], "m").otherwise("o")),
    )
    return annotated(spark, sf_dir)[0].select(
        "type_id", text("labels"), "n", F.array_join(props, ",").alias("props")
    )


@register("cardinalities", sql.query([*CLEAN, sql.CARD], "select * from card"))
def cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = card.cardinalities(load_graph(spark, sf_dir).edges)
    return found.withColumns({c: F.round(c, 6) for c in ("avg_dst_per_src", "avg_src_per_dst")})


@register(
    "annotate_cardinality",
    sql.query(
        ANNOTATED,
        """select t.type_id, array_to_string(t.types, ',') as edge_types, t.n,
          array_to_string(list_transform(t.types, lambda x: m[x]), ',') as cardinality
        from rtypes t, (select map(list(edge_type), list(cardinality)) as m from card)""",
    ),
)
def annotate_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = merge.merge_edges(edge_clusters(spark, sf_dir), ("type",)).types
    found = card.cardinalities(load_graph(spark, sf_dir).edges)
    return card.annotate_cardinality(edges, found).select(
        "type_id", text("edge_types"), "n", "cardinality"
    )


# ------------------------------------------------------------------ evaluation


@register(
    "node_correctness",
    sql.query(
        EVAL,
        """select node_id, type_id, array_to_string(predicted, ',') as predicted,
          array_to_string(actual, ',') as actual, list_has_any(actual, predicted)::INTEGER as ok_any,
          (list_sort(actual) = list_sort(predicted))::INTEGER as ok_exact from neval""",
    ),
)
def node_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.node_correctness(evaluate.node_eval_rows(*assigned_nodes(spark, sf_dir)))
    return rows.select(
        "node_id", "type_id", text("predicted"), text("actual"), "ok_any", "ok_exact"
    )


@register("majority_label", sql.query(EVAL, "select type_id, majority from nmaj"))
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.majority_label(evaluate.node_eval_rows(*assigned_nodes(spark, sf_dir)))


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@register(
    "evaluate_nodes",
    sql.query(
        EVAL,
        sql.scores(
            "select array_to_string(actual, ',') as truth, list_contains(actual, majority) as hit"
            " from neval join nmaj using (type_id)"
        ),
    ),
)
def evaluate_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.node_eval_rows(*assigned_nodes(spark, sf_dir))
    return _rounded(evaluate.evaluate_nodes(rows))


@register(
    "evaluate_nodes_lsh",
    sql.query(
        [*MERGED, sql.evaluation()],
        sql.scores(
            "select array_to_string(actual, ',') as truth, list_contains(actual, majority) as hit"
            " from neval join nmaj using (type_id)"
        ),
    ),
)
def evaluate_nodes_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.merge_nodes(node_clusters(spark, sf_dir))
    nodes = lossy_graph(spark, sf_dir).nodes
    assigned = merge.assign_nodes(nodes, merged.typed)
    rows = evaluate.node_eval_rows(assigned, merged.types, truth=nodes)
    return _rounded(evaluate.evaluate_nodes(rows, truth=nodes))


@register(
    "edge_correctness",
    sql.query(
        EVAL,
        """select edge_id, type_id,
          (list_contains(ptypes, edge_type) and list_has_all(psrc, asrc)
            and list_has_all(pdst, adst))::INTEGER as ok_any,
          (ptypes = [edge_type] and psrc = asrc and pdst = adst)::INTEGER as ok_exact
        from eeval""",
    ),
)
def edge_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.edge_correctness(evaluate.edge_eval_rows(*assigned_edges(spark, sf_dir, ids=True)))
    return rows.select("edge_id", "type_id", "ok_any", "ok_exact")


EDGE_TRUTH = (
    "edge_type || '|' || array_to_string(asrc, ',') || '|' || array_to_string(adst, ',') as truth"
)


@register(
    "evaluate_edges",
    sql.query(
        EVAL,
        sql.scores(
            f"select {EDGE_TRUTH}, edge_type = majority as hit from eeval join emaj using (type_id)"
        ),
    ),
)
def evaluate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.edge_eval_rows(*assigned_edges(spark, sf_dir))
    return _rounded(evaluate.evaluate_edges(rows))


@register(
    "cluster_counts",
    sql.query(
        EVAL,
        f"""select 'node' as element, count(distinct actual) as n_true,
          count(distinct type_id) as n_predicted from neval
        union all select 'edge', count(distinct truth), count(distinct type_id)
        from (select type_id, {EDGE_TRUTH} from eeval)""",
    ),
)
def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = evaluate.cluster_counts(evaluate.node_eval_rows(*assigned_nodes(spark, sf_dir)))
    edges = evaluate.cluster_counts(evaluate.edge_eval_rows(*assigned_edges(spark, sf_dir)))
    return nodes.withColumn("element", F.lit("node")).unionByName(
        edges.withColumn("element", F.lit("edge"))
    )


# ----------------------------------------------------------------------- noise


PART_TEXTS = ("p_name", "p_brand", "p_type", "p_retailprice")


@register(
    "corrupt_cells",
    f"""with cells as (
      select p_partkey, x, row_number() over (partition by p_partkey
        order by md5('42|' || p_partkey::varchar || '|' || x)) as r
      from (select p_partkey, unnest({list(PART_TEXTS)}) as x from part)),
    lost as (select p_partkey, list(x) as xs from cells where r <= 2 group by p_partkey)
    select p.p_partkey, """
    + ", ".join(
        f"case when not list_contains(xs, '{c}') then {c} end as {c}" for c in PART_TEXTS
    )
    + ", p_size from part p join lost l on l.p_partkey = p.p_partkey",
)
def corrupt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return noise.corrupt_cells(part, 50, ["p_partkey"])


_KEPT_SQL = "list_filter(pset, lambda x: {} >= 0.3::DOUBLE)"


@register(
    "drop_properties",
    sql.query(
        CLEAN,
        "select node_id as id, array_to_string("
        + _KEPT_SQL.format(sql.h01("('42|' || node_id || '|' || x)"))
        + ", ',') as prop_set from nodes union all select edge_id, array_to_string("
        + _KEPT_SQL.format(sql.h01("('42|' || edge_id || '|' || x)"))
        + ", ',') from edges",
    ),
)
def drop_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = load_graph(spark, sf_dir)
    nodes = noise.drop_properties(graph.nodes, 0.3)
    edges = noise.drop_properties(graph.edges, 0.3)
    return nodes.select(F.col("node_id").alias("id"), text("prop_set")).unionByName(
        edges.select(F.col("edge_id").alias("id"), text("prop_set"))
    )


@register("drop_labels", sql.query(LOSSY, "select node_id, label as labels from nodes"))
def drop_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lossy_graph(spark, sf_dir).nodes.select("node_id", text("labels"))


# ------------------------------------------------------------------- rendering


def _prop_list(props: str, optional_mark: str) -> str:
    """(type_id, txt): property text of each type, mandatory ones first."""
    pg = (
        "case lower(dtype) when 'integer' then 'INTEGER' when 'double' then 'DOUBLE'"
        " when 'date' then 'DATE' when 'boolean' then 'BOOLEAN' else 'STRING' end"
    )
    return f"""(select type_id, ' {{' || string_agg(case when man then '' else '{optional_mark}' end
      || name || ' ' || {pg}, ', ' order by man desc, name) || '}}' as txt from {props} group by type_id)"""


NAMED = f"""
nn as (
  select *, len(labels) = 0 as abs,
    case when len(labels) = 0 then 'AbstractType_' || no else array_to_string(labels, '_') || 'Type' end as tname,
    case when len(labels) = 0 then '1|' || lpad(no::varchar, 12, '0')
      else '0|' || array_to_string(labels, '_') end as key
  from (select *, case when len(labels) = 0
          then row_number() over (partition by len(labels) = 0 order by type_id) end as no from ntypes)),
holders as (select unnest(labels) as l, tname from nn),
en as (
  select t.*, array_to_string(types, '_') as rel, array_to_string(types, ' | ') as elabel,
    concat_ws('|', array_to_string(types, '_'), array_to_string(srcs, '_'),
      array_to_string(dsts, '_'), type_id) as key,
    coalesce((select string_agg(distinct coalesce(h.tname, s.l || 'Type'), '|'
        order by coalesce(h.tname, s.l || 'Type'))
      from (select unnest(t.srcs) as l) s left join holders h on h.l = s.l), 'ABSTRACT_SRC') as sname,
    coalesce((select string_agg(distinct coalesce(h.tname, s.l || 'Type'), '|'
        order by coalesce(h.tname, s.l || 'Type'))
      from (select unnest(t.dsts) as l) s left join holders h on h.l = s.l), 'ABSTRACT_DST') as dname,
    (select string_agg(c.cardinality, ',' order by p.i)
      from (select unnest(t.types) as x, unnest(range(0, len(t.types))) as i) p
      join card c on c.edge_type = p.x) as cardinality
  from rtypes t)"""


def _abstract_sql(section: str, before: str, after: str) -> str:
    return " union all ".join(
        f"select '{section}|{i}', '{before}ABSTRACT_{e}{after}'"
        f" where exists (select 1 from en where {c} = 'ABSTRACT_{e}')"
        for i, (e, c) in enumerate((("SRC", "sname"), ("DST", "dname")))
    )


@register(
    "render_pg_loose",
    sql.query(
        [*ANNOTATED, NAMED],
        f"""select '00' as ord, 'CREATE GRAPH TYPE NewGraphSchema LOOSE {{' as line
        union all select '04', '}}'
        union all select '01|' || key, '  (' || case when abs then 'AbstractType' else tname end || ': '
          || case when abs then 'Abstract' else array_to_string(labels, ' | ') end
          || coalesce(txt, '') || '),'
          from nn left join {_prop_list("nprops", "")} p using (type_id)
        union all {_abstract_sql("02", "  (", ": OPEN),")}
        union all select '03|' || key, '  (:' || sname || ')-[' || rel || 'Type: ' || elabel
          || coalesce(txt, '') || ']->(:' || dname || '),'
          from en left join {_prop_list("eprops", "")} p using (type_id)""",
    ),
)
def render_pg_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_pg_loose(*annotated(spark, sf_dir))


@register(
    "render_pg_strict",
    sql.query(
        [*ANNOTATED, NAMED],
        f"""select '00' as ord, '-- NODE TYPES --' as line
        union all select * from (values ('03|0', ''), ('03|1', '-- EDGE TYPES --'), ('05|0', ''),
          ('05|1', 'CREATE GRAPH TYPE NewGraphSchema STRICT {{'), ('09|0', ''),
          ('09|1', '  // Constraints'), ('11', '}}'))
        union all select '01|' || key, 'CREATE NODE TYPE ' || tname || ' : '
          || case when abs then 'ABSTRACT_' || no else array_to_string(labels, ' | ') end
          || coalesce(txt, '') || ';'
          from nn left join {_prop_list("nprops", "OPTIONAL ")} p using (type_id)
        union all {_abstract_sql("02", "CREATE NODE TYPE ", " : OPEN;")}
        union all select '04|' || key, 'CREATE EDGE TYPE ' || lower(rel) || 'Type : ' || elabel
          || coalesce(txt, '') || ';'
          from en left join {_prop_list("eprops", "OPTIONAL ")} p using (type_id)
        union all select '06|' || key, '  (' || tname || '),' from nn
        union all {_abstract_sql("07", "  (", "),")}
        union all select '08|' || key, '  (:' || sname || ')-[' || lower(rel) || 'Type]->(:' || dname
          || '),' from en
        union all select '10|' || key, case cardinality
          when '1:1' then '  FOR (x:' || sname || ') SINGLETON x,y WITHIN (x)-[y: ' || lower(rel)
            || 'Type]->(:' || dname || ')'
          when 'N:1' then '  FOR (x:' || sname || ') SINGLETON y WITHIN (x)-[y: ' || lower(rel)
            || 'Type]->(:' || dname || ')'
          else '  FOR (x:' || dname || ') SINGLETON x WITHIN (:' || sname || ')-[y: ' || lower(rel)
            || 'Type]->(x)' end
          from en where cardinality in ('1:1', 'N:1', '1:N')""",
    ),
)
def render_pg_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_pg_strict(*annotated(spark, sf_dir))


XSD_TYPE = (
    "case lower(dtype) when 'integer' then 'xs:integer' when 'double' then 'xs:double'"
    " when 'date' then 'xs:date' when 'boolean' then 'xs:boolean' else 'xs:string' end"
)
_XSD_PROPS = f"""list('      <xs:element name="' || name || '" type="' || {XSD_TYPE}
    || '" minOccurs="' || case when man then '1' else '0' end || '" maxOccurs="1"/>'
    order by man desc, name)"""


@register(
    "render_xsd",
    sql.query(
        [*ANNOTATED, NAMED],
        f"""select '00' as ord,
          '<xs:schema name="NewGraphSchema" xmlns:xs="http://www.w3.org/2001/XMLSchema">' as line
        union all select '03', '</xs:schema>'
        union all select section || '|' || key || '|' || lpad((i - 1)::varchar, 6, '0'), ls[i] from (
          select section, key, ls, unnest(range(1, len(ls) + 1)) as i from (
            select '01' as section, key, list_concat(list_concat(
              ['  <xs:complexType name="' || case when abs then 'UNKNOWN_' || no else labels[1] end || '">'],
              case when els is null then [] else list_concat(list_concat(['    <xs:sequence>'], els),
                ['    </xs:sequence>']) end),
              ['    <xs:attribute name="id" type="xs:ID" use="required"/>',
               '    <xs:attribute name="label" type="xs:string"/>', '  </xs:complexType>']) as ls
            from nn left join (select type_id, {_XSD_PROPS} as els from nprops group by type_id) p
              using (type_id)
            union all
            select '02', types[1], list_concat(list_concat(list_concat(list_concat(
              ['  <xs:complexType name="' || types[1] || '">', '    <xs:sequence>'],
              list_transform(srcs, lambda x: '      <xs:element name="source" type="' || x || '"/>')),
              list_transform(dsts, lambda x: '      <xs:element name="target" type="' || x || '"/>')),
              coalesce(els, [])), ['    </xs:sequence>', '  </xs:complexType>'])
            from rtypes left join (select type_id, {_XSD_PROPS} as els from eprops group by type_id) p
              using (type_id)))""",
    ),
)
def render_xsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_xsd(*annotated(spark, sf_dir))


# ----------------------------------------------------------- batches and streams


N_BATCHES = 4
FILES_PER_TRIGGER = 16


def _state_sql(kind: str, key: str, table: str) -> str:
    return f"""
      select {key}, '' as name, sum(n)::BIGINT as n from {table} group by {key}
      union all select {key}, x, sum(n)::BIGINT from (
        select {key}, n, unnest(pset) as x from {table}) group by {key}, x"""


@register(
    "incremental_node_state",
    sql.query(
        LOSSY, _state_sql("n", "labels", "(select label_key as labels, pset, n from np)")
    ),
)
def incremental_node_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = batches.node_batches(lossy_graph(spark, sf_dir).nodes, count=N_BATCHES)
    folder = f"{work_folder(spark)}/nodes"
    batches.write_batches(batched, folder)  # each batch is then read by itself
    state = None
    for batch in range(N_BATCHES):
        part = spark.read.parquet(folder).filter(F.col("batch_id") == batch)
        part = merge.node_state(patterns.node_patterns(part))
        state = part if state is None else merge.merge_node_state(state, part)
    return state


@register("incremental_edge_state", sql.query(LOSSY, _state_sql("e", "edge_type", "ep")))
def incremental_edge_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lossy_graph(spark, sf_dir)
    # the batch of an edge is known before its labels; the joins then carry no ids of edges and no values
    split = graph.with_edges(batches.edge_batches(graph.edges, count=N_BATCHES)).labeled_edges()
    batched = split.select("batch_id", *patterns.EDGE_KEYS)
    folder = f"{work_folder(spark)}/edges"
    batches.write_batches(batched, folder)
    state = None
    for batch in range(N_BATCHES):
        part = spark.read.parquet(folder).filter(F.col("batch_id") == batch)
        part = merge.edge_state(patterns.edge_patterns(part))
        state = part if state is None else merge.merge_edge_state(state, part)
    return state


def _batches_sql(kind: str) -> str:
    """The batch of an element is the code of its id, modulo the number of batches."""
    return sql.query(
        CLEAN,
        f"""select {sql.c32(f"{kind}_id")} % b.n as batch_id, count(*) as n
        from {kind}s, (select ceil(count(*) / ceil(count(*) / {N_BATCHES}::DOUBLE))::BIGINT as n
          from {kind}s) b
        group by 1""",
    )


@register("node_batches", _batches_sql("node"))
def node_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load_graph(spark, sf_dir).nodes
    size = -(-nodes.count() // N_BATCHES)
    return batches.node_batches(nodes, size).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@register("edge_batches", _batches_sql("edge"))
def edge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = load_graph(spark, sf_dir).edges
    size = -(-edges.count() // N_BATCHES)
    return batches.edge_batches(edges, size).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


def stream_state(spark: SparkSession, sf_dir: str, bare: bool = False) -> str:
    """Stream the lossy graph in batches; the folder that holds the state.

    ``bare`` edges know their end points by id only.
    """
    graph = lossy_graph(spark, sf_dir)
    folder = work_folder(spark)
    # the batch of an edge is known before its labels; no table of the state has ids of edges
    split = graph.with_edges(batches.edge_batches(graph.edges, count=N_BATCHES))
    edges = split.edges if bare else split.labeled_edges()
    tables = {
        "nodes": batches.node_batches(graph.nodes, count=N_BATCHES),
        "edges": edges.drop("edge_id"),
    }
    streams = {}
    for name, table in tables.items():
        batches.write_batches(table, f"{folder}/{name}")
        streams[name] = (
            spark.readStream.schema(table.schema)
            .option("maxFilesPerTrigger", FILES_PER_TRIGGER)
            .parquet(f"{folder}/{name}")
            .drop("batch_id")
        )
    update_state(streams["nodes"], streams["edges"], f"{folder}/state")
    return f"{folder}/state"


def typed_props_text() -> Column:
    """name:count:m or o:datatype of every property."""
    one = F.transform(
        "props",
        lambda p: F.concat_ws(
            ":",
            p["name"],
            p["n_present"].cast("string"),
            F.when(p["mandatory"], "m").otherwise("o"),
            p["dtype"],
        ),
    )
    return F.array_join(one, ",").alias("props")


def schema_text(schema: Schema) -> DataFrame:
    """Everything a schema says of its types, node types and edge types."""
    none = F.lit("")
    nodes = schema.node_types.select(
        F.lit("node").alias("element"),
        "type_id",
        text("labels"),
        none.alias("src_labels"),
        none.alias("dst_labels"),
        "n",
        typed_props_text(),
        none.alias("cardinality"),
    )
    edges = schema.edge_types.select(
        F.lit("edge").alias("element"),
        "type_id",
        F.array_join("edge_types", ",").alias("labels"),
        text("src_labels"),
        text("dst_labels"),
        "n",
        typed_props_text(),
        "cardinality",
    )
    return nodes.unionByName(edges)


def _schema_sql(method: str) -> str:
    def typed(types: str, kind: str) -> str:
        return f"""
        select p.type_id, string_agg(p.p.name || ':' || p.p.cnt::varchar
            || case when p.p.man then ':m:' else ':o:' end || coalesce(d.dtype, 'Unknown'), ','
            order by p.p.name) as props
        from (select type_id, unnest(props) as p from {types}) p
        left join (select name, {sql.UNANIMOUS} as dtype from {kind}full) d on d.name = p.p.name
        group by p.type_id"""

    return sql.query(
        [*sql.merged(LOSS, method), sql.typing("node"), sql.typing("edge"), sql.CARD],
        f"""select 'node' as element, t.type_id, array_to_string(labels, ',') as labels,
          '' as src_labels, '' as dst_labels, n, coalesce(p.props, '') as props, '' as cardinality
        from ntypes t left join ({typed("ntypes", "node")}) p on p.type_id = t.type_id
        union all
        select 'edge', t.type_id, array_to_string(types, ','), array_to_string(srcs, ','),
          array_to_string(dsts, ','), n, coalesce(p.props, ''),
          array_to_string(list_transform(t.types, lambda x: c.m[x]), ',')
        from rtypes t left join ({typed("rtypes", "edge")}) p on p.type_id = t.type_id,
          (select map(list(edge_type), list(cardinality)) as m from card) c""",
    )


@register("stream_equals_batch", _schema_sql("minhash"))
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_text(schema_from_state(spark, stream_state(spark, sf_dir), "minhash"))


@register("stream_finds_ends", _schema_sql("minhash"))
def stream_finds_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_text(schema_from_state(spark, stream_state(spark, sf_dir, bare=True), "minhash"))


# ------------------------------------------------------------------- pipelines


def _discovered(spark: SparkSession, sf_dir: str, method: str, **options) -> DataFrame:
    return schema_text(discover(lossy_graph(spark, sf_dir), method, **options))


@register("discover_lsh", _schema_sql("lsh"))
def discover_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovered(spark, sf_dir, "lsh")


@register("discover_minhash", _schema_sql("minhash"))
def discover_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovered(spark, sf_dir, "minhash")


@register("discover_kmeans", _schema_sql("kmeans"))
def discover_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovered(spark, sf_dir, "kmeans")


def _cell_sql(noise_: float, loss: float, method: str) -> str:
    nodes = (
        "select array_to_string(actual, ',') as truth, list_contains(actual, majority) as hit"
        " from neval join nmaj using (type_id)"
    )
    edges = f"select {EDGE_TRUTH}, edge_type = majority as hit from eeval join emaj using (type_id)"
    found = sql.query(
        [*sql.merged(loss, method, noise_), sql.evaluation()],
        f"select 'node' as element, * from ({sql.scores(nodes)})"
        f" union all select 'edge', * from ({sql.scores(edges)})",
    )
    return (
        f"select {noise_}::DOUBLE as noise, {loss}::DOUBLE as label_loss, '{method}' as method, *"
        f" from ({found})"
    )


@register(
    "discover_all",
    "select * exclude (noise, label_loss) from ("
    + " union all ".join(f"({_cell_sql(0.0, LOSS, m)})" for m in cluster.METHODS)
    + ")",
)
def discover_all_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(discover_all(lossy_graph(spark, sf_dir)))


def _grid_sql(*methods: str) -> str:
    cells = [(n, lost, m) for n in NOISE_LEVELS for lost in LABEL_LOSS for m in methods]
    return " union all ".join(f"({_cell_sql(*cell)})" for cell in cells)


@register("robustness_grid", _grid_sql(*cluster.METHODS))
def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(robustness_grid(load_graph(spark, sf_dir)))


@register("robustness_grid_minhash", _grid_sql("minhash"))
def robustness_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(robustness_grid(load_graph(spark, sf_dir), methods=("minhash",)))


@register("robustness_grid_kmeans", _grid_sql("kmeans"))
def robustness_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(robustness_grid(load_graph(spark, sf_dir), methods=("kmeans",)))


CSV_GRAPH_SQL = """
select 'node' as element, kind, name, count(*) as n from (
  select 'Customer' as kind, unnest(['custkey', 'name', 'acctbal']) as name from customer
  union all select 'Supplier', unnest(['suppkey', 'name', 'acctbal']) from supplier
  union all select 'Nation', unnest(['nationkey', 'name']) from nation) group by kind, name
union all
select 'edge', kind, name, count(*) from (
  select 'IN_NATION' as kind, c_mktsegment as name from customer
  union all select 'IN_NATION', 'none' from supplier) group by kind, name"""


@register("csv_graph_roundtrip", CSV_GRAPH_SQL)
def csv_graph_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written as labelled CSV files and read back as a graph."""
    folder = work_folder(spark)

    def write(table: str, name: str, *columns: str) -> str:
        path = f"{folder}/{name}"
        frame = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)
        frame.write.csv(path, header=True, sep="|", quote='"', escape='"')
        return path

    graph = csv_graph.read_csv_graph(
        spark,
        nodes={
            "Customer": [
                write(
                    "customer",
                    "customer",
                    "c_custkey as `custkey:ID(Customer)`",
                    "c_name as `name`",
                    "c_acctbal as `acctbal:double`",
                )
            ],
            "Supplier": [
                write(
                    "supplier",
                    "supplier",
                    "s_suppkey as `suppkey:ID(Supplier)`",
                    "s_name as `name`",
                    "s_acctbal as `acctbal:double`",
                )
            ],
            "Nation": [
                write("nation", "nation", "n_nationkey as `nationkey:ID(Nation)`", "n_name as `name`")
            ],
        },
        edges={
            "IN_NATION": [
                write(
                    "customer",
                    "customer_nation",
                    "c_custkey as `:START_ID(Customer)`",
                    "c_nationkey as `:END_ID(Nation)`",
                    "c_mktsegment as `segment`",
                ),
                write(
                    "supplier",
                    "supplier_nation",
                    "s_suppkey as `:START_ID(Supplier)`",
                    "s_nationkey as `:END_ID(Nation)`",
                ),
            ]
        },
    )
    labeled = graph.nodes.select("prop_set", F.explode("labels").alias("kind"))
    node_counts = labeled.select("kind", F.explode("prop_set").alias("name"))
    edges = graph.labeled_edges().filter("size(src_labels) = 1 and size(dst_labels) = 1")
    edge_counts = edges.select(
        F.col("edge_type").alias("kind"),
        F.coalesce(F.try_element_at("props", F.lit("segment")), F.lit("none")).alias("name"),
    )
    count = F.count(F.lit(1)).alias("n")
    return (
        node_counts.groupBy("kind", "name").agg(count).withColumn("element", F.lit("node"))
    ).unionByName(
        edge_counts.groupBy("kind", "name").agg(count).withColumn("element", F.lit("edge"))
    )


CSV_TEXTS = ("brand", "kind", "lang", "mktsegment", "name", "role", "source", "text", "type")


def _csv_values_sql(element: str, kind: str, rows: str) -> str:
    """Values and their characters by name; numbers and times are written differently by engines."""
    return (
        f"select '{element}' as element, {kind} as kind, name, count(*) as n,"
        f" sum(case when name in {CSV_TEXTS} then length(val) else 0 end)::BIGINT as n_chars"
        f" from (select {kind}, unnest(names) as name, unnest(vals) as val from {rows})"
        f" where val is not null group by {kind}, name"
    )


@register(
    "csv_whole_graph",
    sql.query(
        CLEAN,
        f"{_csv_values_sql('node', 'label', 'raw_nodes')}"
        f" union all {_csv_values_sql('edge', 'edge_type', 'raw_edges')}",
    ),
)
def csv_whole_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All node and edge tables, texts with line breaks included, as CSV files read back as a graph."""
    folder = work_folder(spark)

    def write(tables: Sequence[Table], *keys: str) -> dict[str, list[str]]:
        paths: dict[str, list[str]] = {}
        for i, table in enumerate(tables):
            path = f"{folder}/{keys[0].strip(':').lower()}_{i}"
            wide_table(spark, table, keys).write.csv(
                path,
                header=True,
                sep="|",
                quote='"',
                escape='"',
                ignoreLeadingWhiteSpace=False,
                ignoreTrailingWhiteSpace=False,
            )
            paths.setdefault(table.name, []).append(path)
        return paths

    register_tables(spark, sf_dir)
    graph = csv_graph.read_csv_graph(
        spark, write(NODE_TABLES, ":ID"), write(EDGE_TABLES, ":IGNORE", ":START_ID", ":END_ID")
    )
    long = graph.nodes.select(
        F.lit("node").alias("element"), F.explode("labels").alias("kind"), "props"
    ).unionByName(graph.edges.select(F.lit("edge").alias("element"), F.col("edge_type").alias("kind"), "props"))
    values = long.select("element", "kind", F.explode("props").alias("name", "value")).filter("value is not null")
    chars = F.when(F.col("name").isin(*CSV_TEXTS), F.length("value")).otherwise(0)
    return values.groupBy("element", "kind", "name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(chars).cast("long").alias("n_chars")
    )
