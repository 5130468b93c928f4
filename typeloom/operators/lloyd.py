"""k-means of patterns in integer arithmetic.

A pattern is a sparse vector: the integer codes of its labels, and ``SCALE`` for each property
name it has.  Its rows (pattern, dimension, value) are joined with the centres' rows
(cluster, dimension, value) on the dimension, so neither a list of all names nor a dense
vector is made anywhere.  Since distances are whole numbers, a run gives the same clusters
whatever the partitioning, and plain SQL gives them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.hashing import seeded
from typeloom.functions.sizing import pin
from typeloom.operators.encode import SCALE, pattern_codes

#: Rounds of assigning and averaging; their number is fixed, so nothing depends on a tolerance.
ROUNDS = 6
#: No component of a vector is further from zero.
LARGEST = 2 * SCALE


def sparse_rows(patterns: DataFrame, seed: int = 42) -> DataFrame:
    """(pattern_id, n, dim, x): the codes of the labels, and a component for each name."""
    codes = F.transform(
        pattern_codes(patterns, seed),
        lambda x, i: F.struct(F.concat(F.lit("E|"), i.cast("string")).alias("dim"), x.alias("x")),
    )
    bits = F.transform(
        "prop_set",
        lambda name: F.struct(F.concat(F.lit("P|"), name).alias("dim"), F.lit(SCALE).cast("bigint").alias("x")),
    )
    return patterns.select("pattern_id", "n", F.inline(F.concat(codes, bits)))


def first_centres(patterns: DataFrame, rows: DataFrame, k: int, seed: int) -> DataFrame:
    """(cluster, dim, x): the ``k`` patterns whose hash is least; fewer where there are fewer."""
    drawn = patterns.select(F.md5(seeded(seed, F.col("pattern_id"))).alias("draw"), "pattern_id")
    least = drawn.orderBy("draw", "pattern_id").limit(k)  # a top-k: no sort of all patterns
    ranked = least.agg(F.array_sort(F.collect_list(F.struct("draw", "pattern_id"))).alias("all")).select(
        F.posexplode("all").alias("cluster", "p")
    )
    return ranked.select("cluster", "p.pattern_id").join(rows, "pattern_id").select("cluster", "dim", "x")


def _nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """(pattern_id, n, cluster): the nearest centre of each pattern, the first of equal ones.

    The squared distance without the pattern's own square: the centre's square less twice the
    product.  A pattern shares no dimension with some centres; their product is 0.
    """
    squares = (
        centres.groupBy("cluster")
        .agg(F.sum(F.col("x") * F.col("x")).alias("square"))
        .agg(F.array_sort(F.collect_list(F.struct("cluster", "square"))).alias("all"))
    )
    products = (
        rows.join(centres.withColumnRenamed("x", "c"), "dim")
        .groupBy("pattern_id", "cluster")
        .agg(F.sum(F.col("x") * F.col("c")).alias("product"))
        .groupBy("pattern_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("cluster", "product"))).alias("products"))
    )
    patterns = rows.select("pattern_id", "n").distinct()

    def distance(centre: Column) -> Column:
        product = F.coalesce(F.try_element_at("products", centre["cluster"]), F.lit(0).cast("bigint"))
        return F.struct((centre["square"] - 2 * product).alias("d"), centre["cluster"].alias("cluster"))

    found = patterns.join(products, "pattern_id", "left").withColumn("squares", squares.scalar())
    return found.select(
        "pattern_id", "n", F.array_min(F.transform("squares", distance))["cluster"].alias("cluster")
    )


def _averaged(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """Centres of the assigned patterns, rounded down; a cluster without any has none."""
    sizes = assigned.groupBy("cluster").agg(F.sum("n").alias("size"))
    sums = (
        rows.join(assigned.select("pattern_id", "cluster"), "pattern_id")
        .groupBy("cluster", "dim")
        .agg(F.sum(F.col("n") * F.col("x")).alias("total"))
    )
    # lifted above zero, so that truncating division rounds down
    mean = F.expr(f"(total + {LARGEST}L * size) div size - {LARGEST}L")
    return sums.join(sizes, "cluster").select("cluster", "dim", mean.alias("x")).filter("x <> 0")


def integer_kmeans(
    patterns: DataFrame, k: int = 10, seed: int = 1, rounds: int = ROUNDS, code_seed: int = 42
) -> DataFrame:
    """``patterns`` with ``cluster_id``; patterns weigh as much as elements have them.

    Centres are ``k`` vectors over the dimensions that their members have.  Every
    round is one join of two sparse tables and is pinned.
    """
    rows = pin(sparse_rows(patterns, code_seed))
    centres = pin(first_centres(patterns, rows, k, seed))
    for _ in range(rounds):
        centres = pin(_averaged(rows, _nearest(rows, centres)))
    assigned = pin(_nearest(rows, centres)).select(
        "pattern_id", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("cluster_id")
    )
    return patterns.join(assigned, "pattern_id", "left")
