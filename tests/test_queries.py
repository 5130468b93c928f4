import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of
from typeloom.operators import cluster
from typeloom.plans.robustness import LABEL_LOSS, NOISE_LEVELS

SF_DIR = "/root/testdata/sf0.001"
# one of each family; check.py runs them all
CHECKED = [
    "nodes_from_wide",
    "edge_patterns",
    "lsh_clusters_det",
    "minhash_edge_clusters_det",
    "merge_nodes",
    "infer_types_sample",
    "cardinalities",
    "corrupt_cells",
    "render_pg_strict",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_twin(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    cursor = con.execute(oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, df.collect()) == want


def test_every_twin_has_its_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_the_grid_has_every_method_in_every_cell(spark, monkeypatch):
    """The methods that robustness_grid asks for, in Spark and in SQL."""
    seen = {}

    def grid(graph, methods=cluster.METHODS, **options):
        seen["methods"], seen["options"] = methods, options
        rows = [(n, lost, m, "node") for n in NOISE_LEVELS for lost in LABEL_LOSS for m in methods]
        found = spark.createDataFrame(rows, "noise double, label_loss double, method string, element string")
        return found.withColumns({c: F.lit(0.0) for c in ("precision", "recall", "f1")})

    monkeypatch.setattr("workload.queries.robustness_grid", grid)
    monkeypatch.setattr("workload.queries.load_graph", lambda spark, sf_dir: None)
    queries()["robustness_grid"](spark, "").count()
    assert set(seen["methods"]) == {"lsh", "minhash", "kmeans"} and not seen["options"]
    twin = oracle_sql()["robustness_grid"]
    for noise in NOISE_LEVELS:
        for lost in LABEL_LOSS:
            for method in cluster.METHODS:
                assert f"{noise}::DOUBLE as noise, {lost}::DOUBLE as label_loss, '{method}' as method" in twin
