"""Small frames made by hand."""

from pyspark.sql import functions as F

from typeloom.model import with_prop_set

NODE_SCHEMA = "node_id string, labels array<string>, true_labels array<string>, props map<string,string>"
EDGE_SCHEMA = "edge_id string, src_id string, dst_id string, edge_type string, props map<string,string>"
NODE_TYPE_SCHEMA = (
    "type_id string, labels array<string>, n bigint,"
    " props array<struct<name:string,n_present:bigint,mandatory:boolean,dtype:string>>"
)
EDGE_TYPE_SCHEMA = (
    "type_id string, edge_types array<string>, src_labels array<string>, dst_labels array<string>,"
    " n bigint, props array<struct<name:string,n_present:bigint,mandatory:boolean,dtype:string>>,"
    " cardinality string"
)


def nodes(spark, rows):
    """rows: (id, labels, props) or (id, labels, true_labels, props)."""
    full = [r if len(r) == 4 else (r[0], r[1], r[1], r[2]) for r in rows]
    return with_prop_set(spark.createDataFrame(full, NODE_SCHEMA))


def edges(spark, rows):
    """rows: (src, dst, type, props)."""
    full = [(f"e{i}", *r) for i, r in enumerate(rows)]
    return with_prop_set(spark.createDataFrame(full, EDGE_SCHEMA))


def clusters(spark, rows):
    """Clustered node patterns; rows: (cluster, label, names, n)."""
    full = [
        (f"p{i}", [label] if label else [], label, sorted(names), n, cluster)
        for i, (cluster, label, names, n) in enumerate(rows)
    ]
    return spark.createDataFrame(
        full,
        "pattern_id string, labels array<string>, label_key string, prop_set array<string>,"
        " n bigint, cluster_id string",
    )


def edge_clusters(spark, rows):
    """Clustered edge patterns; rows: (cluster, type, src, dst, names, n)."""
    full = [
        (f"p{i}", t, [s] if s else [], [d] if d else [], s, d, sorted(names), n, c)
        for i, (c, t, s, d, names, n) in enumerate(rows)
    ]
    return spark.createDataFrame(
        full,
        "pattern_id string, edge_type string, src_labels array<string>, dst_labels array<string>,"
        " src_key string, dst_key string, prop_set array<string>, n bigint, cluster_id string",
    )


def type_dict(types, key="labels"):
    """{labels: (n, mandatory, optional)}"""
    return {
        tuple(r[key]): (
            r["n"],
            [p["name"] for p in r["props"] if p["mandatory"]],
            [p["name"] for p in r["props"] if not p["mandatory"]],
        )
        for r in types.collect()
    }


def document(lines):
    return [r["line"] for r in lines.orderBy(F.col("ord")).collect()]
