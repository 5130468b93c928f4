"""Feature vectors of patterns: label embeddings followed by presence bits.

An embedding here is a small vector per label string, within 0.5/size in each
component, so that labels weigh less than a presence bit.  The default derives
it from md5.  Training skip-gram on documents of one word, the other mode,
never moves a vector from its random start, so both say the same: equal labels
are equal, different labels are some small distance apart.
"""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.functions.hashing import code32
from typeloom.functions.sizing import pin
from typeloom.operators.patterns import is_edge_frame
from typeloom.sources.wide import property_keys

# Embedding sizes by the label column they encode.
NODE_EMBEDDING = {"label_key": 5}
EDGE_EMBEDDING = {"edge_type": 10, "src_key": 4, "dst_key": 4}

SCALE = 1_000_000  

def embedding_of(patterns: DataFrame) -> dict[str, int]:
    return EDGE_EMBEDDING if is_edge_frame(patterns) else NODE_EMBEDDING


def label_codes(label: Column, dim: int, seed: int) -> Column:
    """Integer embedding: ``dim`` components within +-0.5/dim, times SCALE."""
    half = SCALE // (2 * dim)
    return F.array(
        *[
            code32(F.concat(F.lit(f"{seed}|{i}|"), label)) % F.lit(2 * half + 1) - F.lit(half)
            for i in range(dim)
        ]
    )


def pattern_codes(patterns: DataFrame, seed: int) -> Column:
    """All embeddings of a pattern in one array of integers."""
    parts = [label_codes(F.col(c), dim, seed) for c, dim in embedding_of(patterns).items()]
    return F.concat(*parts)


def embed_labels(
    df: DataFrame, col: str, dim: int, mode: str = "hash", seed: int = 42, out: str | None = None
) -> DataFrame:
    """Add an ML vector that embeds the label strings of ``col``."""
    out = out or f"{col}_vector"
    token = F.coalesce(F.col(col), F.lit(""))
    if mode == "hash":
        scaled = F.transform(label_codes(token, dim, seed), lambda c: c / F.lit(float(SCALE)))
        return df.withColumn(out, array_to_vector(scaled))
    if mode == "word2vec":
        words = df.withColumn(f"_{col}_words", F.array(token))
        model = Word2Vec(
            vectorSize=dim, minCount=0, seed=seed, inputCol=f"_{col}_words", outputCol=out
        ).fit(words)
        return model.transform(words).drop(f"_{col}_words")
    raise ValueError(f"unknown embedding mode {mode}")


def vocabulary(patterns: DataFrame) -> DataFrame:
    """(name, idx): the property names, numbered from 0 in their order.

    Names are dealt out by range and ranked where they are; the counts of the ranges before
    give each range its offset.  No task and no driver sees all names.
    """
    placed = pin(
        property_keys(patterns)
        .select("name")
        .repartitionByRange("name")
        .select("name", F.spark_partition_id().alias("part"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # a row for each range
        placed.groupBy("part")
        .agg(F.count(F.lit(1)).alias("names"))
        .select("part", F.coalesce(F.sum("names").over(before), F.lit(0)).alias("offset"))
    )
    rank = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    return placed.join(offsets, "part").select("name", (F.col("offset") + rank - 1).alias("idx"))


def feature_rows(patterns: DataFrame, mode: str = "hash", seed: int = 42) -> DataFrame:
    """(pattern_id, idx, value): the components of the feature vectors that are not 0.

    Embeddings come first, then a bit for each name of the :func:`vocabulary`.  Names meet
    their index in a join.
    """
    embedded, columns = patterns, []
    for col, dim in embedding_of(patterns).items():
        embedded = embed_labels(embedded, col, dim, mode, seed)
        columns.append(vector_to_array(f"{col}_vector"))
    dims = sum(embedding_of(patterns).values())
    labels = embedded.select("pattern_id", F.posexplode(F.concat(*columns)).alias("idx", "value"))
    bits = (
        patterns.select("pattern_id", F.explode("prop_set").alias("name"))
        .join(vocabulary(patterns), "name")
        .select("pattern_id", (F.col("idx") + dims).alias("idx"), F.lit(1.0).alias("value"))
    )
    return labels.filter("value <> 0").withColumn("idx", F.col("idx").cast("bigint")).unionByName(bits)


@F.udf(VectorUDT())
def _sparse(width, entries):
    return Vectors.sparse(width, [(e["idx"], e["value"]) for e in entries or []])


def assemble(patterns: DataFrame, mode: str = "hash", seed: int = 42) -> DataFrame:
    """Add ``features``: the :func:`feature_rows` of a pattern as a sparse ML vector."""
    rows = feature_rows(patterns, mode, seed)
    dims = sum(embedding_of(patterns).values())
    width = property_keys(patterns).agg(F.count(F.lit(1)) + dims).scalar()
    entries = rows.groupBy("pattern_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_entries")
    )
    found = patterns.join(entries, "pattern_id", "left").withColumn("_width", width)
    return found.withColumn("features", _sparse("_width", "_entries")).drop("_width", "_entries")
