"""Clustering of patterns: random projection, MinHash, k-means.

Each function takes a pattern table and gives it back with ``cluster_id``.
The hashed forms compute the cluster of a pattern from the pattern alone, in a
projection without a shuffle; equal hashes in *all* tables make a cluster.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH, HashingTF, MinHashLSH
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.functions.hashing import code32, code32_of, hash01, seeded
from typeloom.operators.encode import SCALE, assemble, embedding_of, pattern_codes
from typeloom.operators.lloyd import integer_kmeans, sparse_rows
from typeloom.operators.patterns import distinct_label_sets, is_edge_frame

SAMPLE_SIZE = 10_000
FALLBACK_BUCKET = 0.2
LARGEST_SUM = 10**15  # no projection in integer units comes near it
PRIME = 2**31 - 1
METHODS = ("lsh", "minhash", "kmeans")


# ---------------------------------------------------------------- statistics


def _sampled(patterns: DataFrame, sample_size: int, seed: int) -> DataFrame:
    """About ``sample_size`` elements, drawn from the pattern counts.

    A pattern stands for ``n`` elements and gives ``n * rate`` of them, rounded
    up or down by its hash; no scan of the elements is needed.
    """
    total = patterns.agg(F.sum("n")).scalar()
    rate = F.least(F.lit(sample_size) / total, F.lit(1.0))
    draw = hash01(seeded(seed, F.col("pattern_id")))
    return (
        patterns.select(
            "pattern_id",
            "prop_set",
            pattern_codes(patterns, seed).alias("codes"),
            F.floor(F.col("n") * rate + draw).cast("int").alias("copies"),
        )
        .filter("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .drop("copies")
        .withColumn("draw", F.md5(seeded(seed, F.col("pattern_id"), F.col("copy").cast("string"))))
    )


def distance_stats(
    patterns: DataFrame, sample_size: int = SAMPLE_SIZE, seed: int = 42
) -> DataFrame:
    """One row: avg, min, max, stddev of the Euclidean distance of a sample.

    The sample holds about ``sample_size`` elements in random order, so the
    one-partition window over it is bounded.  Each is paired with the next
    ones, as many as give ``sample_size`` pairs, by an equi-join on the rank;
    pairs with equal features do not count.
    """
    order = Window.orderBy("draw", "pattern_id", "copy")
    ranked = _sampled(patterns, sample_size, seed).select(
        "prop_set",
        "codes",
        F.row_number().over(order).alias("rank"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("m"),
    )
    shifts = F.least(F.col("m") - 1, F.ceil(F.lit(sample_size) / F.col("m"))).cast("int")
    left = ranked.withColumn("shifts", shifts).filter("shifts > 0").select(
        F.col("prop_set").alias("a_props"),
        F.col("codes").alias("a_codes"),
        F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + F.col("shifts"))).alias("rank"),
    )
    right = ranked.select(
        "rank", F.col("prop_set").alias("b_props"), F.col("codes").alias("b_codes")
    )
    squares = F.aggregate(
        F.zip_with("a_codes", "b_codes", lambda x, y: (x - y) * (x - y)),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )
    bits = F.size(F.array_except("a_props", "b_props")) + F.size(
        F.array_except("b_props", "a_props")
    )
    distance = F.sqrt(squares / F.lit(float(SCALE) ** 2) + bits)
    return (
        left.join(right, "rank")
        .select(distance.alias("d"))
        .filter("d > 0")
        .agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.round(F.avg("d"), 6).alias("avg_distance"),
            F.round(F.min("d"), 6).alias("min_distance"),
            F.round(F.max("d"), 6).alias("max_distance"),
            F.round(F.stddev("d"), 6).alias("stddev_distance"),
        )
    )


def distance_moments(patterns: DataFrame, seed: int = 42) -> DataFrame:
    """One row: n_pairs, mean_square, rms_distance of all pairs of elements whose features differ.

    Exact, and without pairs: over all pairs the squared distances add up to
    N * sum(n * |x|^2) - |sum(n * x)|^2, and equal elements add nothing to it.  Both sums are of
    integers, by dimension; elements with equal features are counted to leave their pairs out.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)").cast("double")
    lengths = sparse_rows(patterns, seed).agg(
        F.sum(F.col("n").cast("decimal(18,0)") * (F.col("x") * F.col("x")).cast("decimal(15,0)")).alias("lengths")
    )
    centre = (
        sparse_rows(patterns, seed)
        .groupBy("dim")
        .agg(F.sum(F.col("n") * F.col("x")).cast("double").alias("total"))
        .agg(F.sum(F.col("total") * F.col("total")).alias("centre"))
    )
    alike = (
        patterns.groupBy(pattern_codes(patterns, seed).alias("codes"), "prop_set")
        .agg(F.sum("n").alias("n"))
        .agg(
            F.sum("n").cast("double").alias("all"),
            F.sum(F.col("n").cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)")).alias("equal"),
        )
    )
    sums = alike.withColumn("lengths", lengths.scalar()).withColumn("centre", centre.scalar())
    n_pairs = (F.col("all") * F.col("all") - wide("equal")) / 2
    unit = F.lit(float(SCALE) ** 2)
    square = (F.col("all") * wide("lengths") - F.col("centre")) / unit
    mean = F.when(n_pairs > 0, square / n_pairs)
    return sums.select(
        n_pairs.alias("n_pairs"),
        F.round(mean, 6).alias("mean_square"),
        F.round(F.sqrt(mean), 6).alias("rms_distance"),
    )


# ---------------------------------------------------------------- parameters


def _by_label_count(few: float, some: float, many: float) -> Column:
    n = F.col("n_labels")
    return F.when(n <= 3, few).when(n <= 10, some).otherwise(many)


def _clamped(rows_per_table: int, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(F.col("n") / rows_per_table)))


def _size(patterns: DataFrame) -> DataFrame:
    """(n, n_labels) of the elements behind the patterns; edges have no n_labels."""
    if is_edge_frame(patterns):
        return patterns.agg(F.sum("n").alias("n"))
    labels = distinct_label_sets(patterns).scalar()
    return patterns.agg(F.sum("n").alias("n")).withColumn("n_labels", labels)


def lsh_params(
    patterns: DataFrame, sample_size: int = SAMPLE_SIZE, seed: int = 42, exact: bool = False
) -> DataFrame:
    """One row (n, bucket, tables) for the random projection of nodes or edges.

    ``exact`` takes the root of the mean squared distance of all pairs for the mean distance of
    a sample.
    """
    if exact:
        stats = distance_moments(patterns, seed).select("rms_distance")
    else:
        stats = distance_stats(patterns, sample_size, seed).select("avg_distance")
    sized = _size(patterns).withColumn("avg_distance", stats.scalar())
    if is_edge_frame(patterns):
        bucket = F.col("avg_distance") * 1.2
        tables = _clamped(20_000, 3, 20)
    else:
        bucket = F.col("avg_distance") * 1.2 * _by_label_count(0.8, 1.0, 1.5)
        tables = F.greatest(
            F.lit(15), F.floor(_clamped(30_000, 5, 25) * _by_label_count(1.5, 1.0, 0.8))
        )
    usable = F.when(bucket > 0, F.round(bucket, 6)).otherwise(FALLBACK_BUCKET)
    return sized.select("n", usable.alias("bucket"), tables.cast("int").alias("tables"))


def minhash_params(patterns: DataFrame) -> DataFrame:
    """One row (n, tables) for the MinHash of nodes or edges."""
    if is_edge_frame(patterns):
        tables = _clamped(2_000, 3, 20)
    else:
        tables = F.greatest(
            F.lit(25), F.floor(_clamped(3_000, 5, 25) * _by_label_count(2.0, 1.5, 1.0))
        )
    return _size(patterns).select("n", tables.cast("int").alias("tables"))


# --------------------------------------------------------- random projection


def _bit_coefficient(seed: int, name: Column, table: Column) -> Column:
    """Coefficient of a presence bit in -1000..1000."""
    key = F.concat(F.lit(f"{seed}|P|"), table.cast("string"), F.lit("|"), name)
    return code32(key) % F.lit(2001) - F.lit(1000)


def _embedding_coefficients(patterns: DataFrame, tables: int, seed: int) -> list[list[int]]:
    dims = sum(embedding_of(patterns).values())
    return [
        [code32_of(f"{seed}|E|{t}|{i}") % 2001 - 1000 for i in range(dims)] for t in range(tables)
    ]


def _longs(values: list[int]) -> str:
    return f"array({', '.join(f'{v}L' for v in values)})"


def _bucket_widths(
    patterns: DataFrame, bucket: float, coefficients: list[list[int]], seed: int
) -> DataFrame:
    """One row, one column: bucket width of each table in integer units.

    A projection is measured in lengths of its coefficient vector, whose bit
    part covers every property name in use.
    """
    own = _longs([sum(c * c for c in row) for row in coefficients])
    tables = F.sequence(F.lit(0), F.lit(len(coefficients) - 1))
    names = patterns.select(F.explode("prop_set").alias("name")).distinct()
    bits = (
        names.select("name", F.explode(tables).alias("t"))
        .withColumn("c", _bit_coefficient(seed, F.col("name"), F.col("t")))
        .groupBy("t")
        .agg(F.sum(F.col("c") * F.col("c")).alias("square"))
        .agg(F.map_from_entries(F.collect_list(F.struct("t", "square"))).alias("squares"))
    )

    def width(t: Column) -> Column:
        square = F.coalesce(F.try_element_at("squares", t), F.lit(0).cast("bigint"))
        length = F.sqrt(square + F.element_at(F.expr(own), t + 1))
        return F.greatest(
            F.lit(1).cast("bigint"), F.round(length * F.lit(bucket * SCALE)).cast("bigint")
        )

    return bits.select(F.transform(tables, width))


def _hashed_projection(patterns: DataFrame, bucket: float, tables: int, seed: int) -> DataFrame:
    coefficients = _embedding_coefficients(patterns, tables, seed)
    table_rows = F.expr(f"array({', '.join(_longs(row) for row in coefficients)})")
    zero = F.lit(0).cast("bigint")
    widths = _bucket_widths(patterns, bucket, coefficients, seed)

    def bucket_of(table: Column) -> Column:
        labels = F.aggregate(
            F.zip_with("codes", F.element_at(table_rows, table + 1), lambda x, a: x * a),
            zero,
            lambda acc, x: acc + x,
        )
        bits = F.aggregate(
            "prop_set",
            zero,
            lambda acc, p: acc + _bit_coefficient(seed, p, table) * F.lit(SCALE),
        )
        width = F.element_at("widths", table + 1)
        # whole buckets are added, so that truncating division rounds down
        buckets = F.call_function("div", F.lit(LARGEST_SUM), width) + 1
        shifted = labels + bits + buckets * width
        return F.call_function("div", shifted, width).cast("string")

    return (
        patterns.withColumn("codes", pattern_codes(patterns, seed))
        .withColumn("widths", widths.scalar())
        .withColumn(
            "cluster_id",
            F.md5(
                F.array_join(
                    F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), bucket_of), ","
                )
            ),
        )
        .drop("codes", "widths")
    )


def cluster_lsh(
    patterns: DataFrame,
    bucket: float | None = None,
    tables: int | None = None,
    seed: int = 42,
    impl: str = "hash",
    embedding: str = "hash",
) -> DataFrame:
    """Random-projection clusters; parameters are estimated where not given."""
    if bucket is None or tables is None:
        row = lsh_params(patterns, seed=seed).first()
        bucket = row["bucket"] if bucket is None else bucket
        tables = row["tables"] if tables is None else tables
    if impl == "hash":
        return _hashed_projection(patterns, bucket, tables, seed)
    model = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed
    )
    features = assemble(patterns, embedding, seed)
    return _by_hash_vectors(model.fit(features).transform(features), tables)


def _by_hash_vectors(hashed: DataFrame, tables: int) -> DataFrame:
    parts = [vector_to_array(F.col("hashes")[t])[0].cast("string") for t in range(tables)]
    cluster = F.md5(F.concat_ws(",", *parts))
    return hashed.withColumn("cluster_id", cluster).drop("features", "hashes")


# ------------------------------------------------------------------- minhash


def _tokens(patterns: DataFrame) -> Column:
    def tagged(tag: str, items: str) -> Column:
        return F.transform(items, lambda x: F.concat(F.lit(tag), x))

    props = tagged("P:", "prop_set")
    if not is_edge_frame(patterns):
        return F.concat(tagged("L:", "labels"), props)
    type_ = F.array(F.concat(F.lit("T:"), F.col("edge_type")))
    return F.concat(type_, tagged("S:", "src_labels"), tagged("D:", "dst_labels"), props)


def cluster_minhash(
    patterns: DataFrame, tables: int | None = None, seed: int = 42, impl: str = "hash"
) -> DataFrame:
    """MinHash clusters over the labels and property names of a pattern."""
    if tables is None:
        tables = minhash_params(patterns).first()["tables"]
    if impl == "ml":
        # the labels and names themselves: of a dense embedding every dimension is there
        tokens = patterns.withColumn(
            "tokens", F.when(F.size(_tokens(patterns)) > 0, _tokens(patterns)).otherwise(F.array(F.lit("")))
        )
        features = HashingTF(
            inputCol="tokens", outputCol="features", numFeatures=1 << 18, binary=True
        ).transform(tokens).drop("tokens")
        model = MinHashLSH(
            inputCol="features", outputCol="hashes", numHashTables=tables, seed=seed
        ).fit(features)
        return _by_hash_vectors(model.transform(features), tables)
    codes = F.transform(_tokens(patterns), lambda t: code32(t) % F.lit(PRIME))
    factors = _longs([code32_of(f"{seed}|a|{t}") % (PRIME - 1) + 1 for t in range(tables)])
    shifts = _longs([code32_of(f"{seed}|b|{t}") % PRIME for t in range(tables)])
    zipped = F.zip_with(
        F.expr(factors), F.expr(shifts), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    lowest = F.expr(
        f"transform(table_codes, t -> coalesce("
        f"array_min(transform(codes, h -> (h * t.a + t.b) % {PRIME}L)), -1L))"
    )
    return (
        patterns.withColumns({"codes": codes, "table_codes": zipped})
        .withColumn("cluster_id", F.md5(F.array_join(lowest.cast("array<string>"), ",")))
        .drop("codes", "table_codes")
    )


# ------------------------------------------------------------------- k-means


def cluster_kmeans(
    patterns: DataFrame, k: int = 10, seed: int = 1, embedding: str = "hash", impl: str = "integer"
) -> DataFrame:
    """k-means clusters of the patterns, weighted by their counts.

    By default in integer arithmetic over sparse rows; ``impl="ml"`` fits Spark's own
    model to dense vectors, for which the names go through the driver.
    """
    if impl == "integer":
        return integer_kmeans(patterns, k, seed)
    features = assemble(patterns, embedding, 42)
    # the block solver fails on fewer than k distinct vectors, the row solver does not
    model = KMeans(
        k=k,
        seed=seed,
        solver="row",
        featuresCol="features",
        predictionCol="cluster",
        weightCol="n",
    ).fit(features.withColumn("n", F.col("n").cast("double")))
    return (
        model.transform(features)
        .withColumn("cluster_id", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")))
        .drop("features", "cluster")
    )


def cluster(patterns: DataFrame, method: str = "lsh", **options) -> DataFrame:
    """Clusters by the named method."""
    if method == "lsh":
        return cluster_lsh(patterns, **options)
    if method == "minhash":
        return cluster_minhash(patterns, **options)
    if method == "kmeans":
        return cluster_kmeans(patterns, **options)
    raise ValueError(f"unknown method {method}, use one of {', '.join(METHODS)}")


# ------------------------------------------------------------------- summary


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """One row per cluster: its label strings, sizes and property counts.

    What is collected per cluster is labels and property names, both of schema
    size.  Members stay in the assignment tables and property sets in
    :func:`cluster_property_sets`, since either may grow with the data.
    """
    keys = ("edge_type", "src_key", "dst_key") if is_edge_frame(clustered) else ("label_key",)
    base = clustered.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_patterns"),
        F.sum("n").alias("n"),
        *[F.array_sort(F.collect_set(k)).alias(f"{k}s") for k in keys],
    )
    props = (
        clustered.select("cluster_id", F.explode("prop_set").alias("name"), "n")
        .groupBy("cluster_id", "name")
        .agg(F.sum("n").alias("n_present"))
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("name", "n_present"))).alias("props"))
    )
    empty = F.array().cast("array<struct<name:string,n_present:bigint>>")
    return base.join(props, "cluster_id", "left").withColumn("props", F.coalesce("props", empty))


def cluster_property_sets(clustered: DataFrame) -> DataFrame:
    """Distinct property sets of each cluster in long form."""
    return clustered.groupBy("cluster_id", "prop_set").agg(F.sum("n").alias("n"))
