"""Counts of property names and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.model import with_prop_set


def property_census(df: DataFrame) -> DataFrame:
    """(name, n) of nodes, edges, or patterns with counts."""
    weight = F.sum("n") if "pattern_id" in df.columns else F.count(F.lit(1))
    rows = with_prop_set(df).withColumn("name", F.explode("prop_set"))
    return rows.groupBy("name").agg(weight.alias("n"))


def label_census(nodes: DataFrame) -> DataFrame:
    """(label, n) of nodes, or node patterns with counts."""
    weight = F.sum("n") if "pattern_id" in nodes.columns else F.count(F.lit(1))
    return nodes.withColumn("label", F.explode("labels")).groupBy("label").agg(weight.alias("n"))
