"""The given tables as a property graph, for Spark and for SQL.

One list of tables serves both: every expression below reads the same in Spark
SQL and in ANSI SQL.  Whole tables are used; a property is absent where its
value says so (a negative balance, a discount of nothing, a priority that is
not specified, a document nobody rated).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.model import PropertyGraph
from typeloom.sources.wide import edges_from_wide, nodes_from_wide, union_all


@dataclass(frozen=True)
class Table:
    name: str  # label or edge type
    source: str  # FROM clause
    ids: tuple[str, ...]  # (node id) or (edge id, source id, target id)
    props: tuple[tuple[str, str], ...]  # (name, expression)


def _id(prefix: str, column: str) -> str:
    return f"concat('{prefix}:', cast({column} as string))"


def _whole_row(name: str, *columns: str) -> str:
    cast = ", '~', ".join(f"cast({c} as string)" for c in columns)
    return f"md5(concat('{name}~', {cast}))"


NODE_TABLES = (
    Table(
        "Customer",
        "customer",
        (_id("C", "c_custkey"),),
        (
            ("acctbal", "case when c_acctbal >= 0 then c_acctbal end"),
            ("mktsegment", "nullif(c_mktsegment, 'MACHINERY')"),
            ("name", "c_name"),
            ("nationkey", "c_nationkey"),
        ),
    ),
    Table(
        "Supplier",
        "supplier",
        (_id("S", "s_suppkey"),),
        (
            ("acctbal", "case when s_acctbal >= 0 then s_acctbal end"),
            ("name", "s_name"),
            ("nationkey", "s_nationkey"),
        ),
    ),
    Table(
        "Part",
        "part",
        (_id("P", "p_partkey"),),
        (
            ("brand", "p_brand"),
            ("name", "p_name"),
            ("retailprice", "p_retailprice"),
            ("size", "case when p_type <> 'PROMO' then p_size end"),
            ("type", "p_type"),
        ),
    ),
    Table(
        "Order",
        "orders",
        (_id("O", "o_orderkey"),),
        (
            ("orderdate", "o_orderdate"),
            ("orderpriority", "nullif(o_orderpriority, '4-NOT SPECIFIED')"),
            ("orderstatus", "o_orderstatus"),
            ("totalprice", "o_totalprice"),
        ),
    ),
    Table("Nation", "nation", (_id("N", "n_nationkey"),), (("name", "n_name"),)),
    Table("Region", "region", (_id("R", "r_regionkey"),), (("name", "r_name"),)),
    Table(
        "Event",
        "events",
        (_id("E", "event_id"),),
        (
            ("k", "regexp_extract(props, '[0-9]+', 0)"),
            ("kind", "event_type"),
            ("ts", "ts"),
            ("value", "case when event_type <> 'error' then value end"),
        ),
    ),
    Table(
        "Document",
        "(select d.*, l.quality, l.toxic from documents d left join labels l"
        " on l.doc_id = d.doc_id) d",
        (_id("D", "doc_id"),),
        (
            ("lang", "lang"),
            ("n_chars", "n_chars"),
            ("quality", "quality"),
            ("source", "source"),
            ("text", "text"),
            ("toxic", "toxic"),
        ),
    ),
    Table(
        "Turn",
        "conversations",
        ("concat('T:', cast(conv_id as string), '-', cast(turn as string))",),
        (("role", "role"), ("text", "text"), ("text_len", "length(text)")),
    ),
)

EDGE_TABLES = (
    Table(
        "PLACED",
        "orders",
        (_id("PLACED", "o_orderkey"), _id("C", "o_custkey"), _id("O", "o_orderkey")),
        (),
    ),
    Table(
        "CONTAINS",
        "lineitem",
        (
            _whole_row(
                "CONTAINS",
                "l_orderkey",
                "l_partkey",
                "l_suppkey",
                "l_linenumber",
                "l_quantity",
                "l_extendedprice",
                "l_discount",
                "l_tax",
                "l_returnflag",
                "l_linestatus",
                "l_shipdate",
            ),
            _id("O", "l_orderkey"),
            _id("P", "l_partkey"),
        ),
        (
            ("discount", "nullif(l_discount, 0)"),
            ("quantity", "l_quantity"),
            ("returnflag", "l_returnflag"),
            ("shipdate", "l_shipdate"),
        ),
    ),
    Table(
        "SUPPLIED_BY",
        "(select distinct l_partkey, l_suppkey from lineitem) l",
        (
            _whole_row("SUPPLIED_BY", "l_partkey", "l_suppkey"),
            _id("P", "l_partkey"),
            _id("S", "l_suppkey"),
        ),
        (),
    ),
    Table(
        "IN_NATION",
        "customer",
        (_id("CN", "c_custkey"), _id("C", "c_custkey"), _id("N", "c_nationkey")),
        (),
    ),
    Table(
        "IN_NATION",
        "supplier",
        (_id("SN", "s_suppkey"), _id("S", "s_suppkey"), _id("N", "s_nationkey")),
        (),
    ),
    Table(
        "IN_REGION",
        "nation",
        (_id("NR", "n_nationkey"), _id("N", "n_nationkey"), _id("R", "n_regionkey")),
        (),
    ),
    Table("DID", "events", (_id("DID", "event_id"), _id("C", "user_id"), _id("E", "event_id")), ()),
    Table(
        "NEXT_TURN",
        "(select a.conv_id, a.turn, b.turn as next from conversations a"
        " join conversations b on a.conv_id = b.conv_id and a.turn + 1 = b.turn) c",
        (
            "concat('NT:', cast(conv_id as string), '-', cast(turn as string))",
            "concat('T:', cast(conv_id as string), '-', cast(turn as string))",
            "concat('T:', cast(conv_id as string), '-', cast(next as string))",
        ),
        (),
    ),
)

SOURCES = (
    "region nation customer supplier part orders lineitem events documents labels conversations"
).split()


def register(spark: SparkSession, sf_dir: str) -> None:
    for name in SOURCES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def wide_table(spark: SparkSession, table: Table, keys: Sequence[str]) -> DataFrame:
    columns = [f"{e} as `{k}`" for e, k in zip(table.ids, keys)]
    columns += [f"{e} as `{n}`" for n, e in table.props]
    return spark.sql(f"select {', '.join(columns)} from {table.source}")


_PLANS: dict[tuple[str, int, str], PropertyGraph] = {}


def load_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of a folder.

    Its plan is made once per session; no data are kept, every use reads the
    tables again.
    """
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _PLANS:
        _PLANS[key] = _load(spark, sf_dir)
    return _PLANS[key]


def _load(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    register(spark, sf_dir)
    nodes = [
        nodes_from_wide(
            wide_table(spark, t, ("node_key",)), "node_key", [n for n, _ in t.props], labels=[t.name]
        )
        for t in NODE_TABLES
    ]
    edges = [
        edges_from_wide(
            wide_table(spark, t, ("edge_key", "src_key", "dst_key")),
            "src_key",
            "dst_key",
            F.lit(t.name),
            [n for n, _ in t.props],
            id=F.col("edge_key"),
        )
        for t in EDGE_TABLES
    ]
    return PropertyGraph(union_all(nodes), union_all(edges))


# ------------------------------------------------------------------ SQL form


def _sql_rows(table: Table, keys: tuple[str, ...], name_column: str) -> str:
    values = ", ".join(f"cast({e} as varchar)" for _, e in table.props)
    names = ", ".join(f"'{n}'" for n, _ in table.props)
    ids = ", ".join(f"{e} as {k}" for e, k in zip(table.ids, keys))
    return (
        f"select {ids}, '{table.name}' as {name_column},"
        f" cast([{names}] as varchar[]) as names, cast([{values}] as varchar[]) as vals"
        f" from {table.source}"
    )


def graph_ctes() -> str:
    """CTEs g_nodes, g_edges with parallel lists, and the same in long form."""
    nodes = "\n  union all ".join(_sql_rows(t, ("node_id",), "label") for t in NODE_TABLES)
    edges = "\n  union all ".join(
        _sql_rows(t, ("edge_id", "src_id", "dst_id"), "edge_type") for t in EDGE_TABLES
    )
    return f"""
raw_nodes as (
  {nodes}),
raw_edges as (
  {edges}),
node_values as (
  select * from (select node_id as id, unnest(names) as name, unnest(vals) as val from raw_nodes)
  where val is not null),
edge_values as (
  select * from (select edge_id as id, unnest(names) as name, unnest(vals) as val from raw_edges)
  where val is not null)"""
