"""Similarity join of sets, and the components of the pairs it finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.functions.sizing import pin
from typeloom.functions.skew import hot_keys, split_join

#: A round of components runs in a task for so many links, and in LEAST_TASKS at least.
TASK_LINKS = 20_000
LEAST_TASKS = 4


def _prefixes(sets: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """Rows (token, id, items, size) for the rarest tokens of each set.

    Two sets with Jaccard >= t share a token among the first
    ``size - ceil(t * size) + 1`` of each, whatever the common order of
    tokens.  Rare tokens first keeps the groups that meet in the join small.
    """
    ranked = (
        sets.filter(F.size("items") > 0)
        .select("id", F.explode("items").alias("token"))
        .join(frequency, "token")
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("freq", "token"))).alias("ranked"))
    )
    size = F.size("ranked")
    keep = (size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    return ranked.select(
        "id",
        F.transform("ranked", lambda r: r["token"]).alias("items"),
        size.alias("size"),
        F.explode(F.slice("ranked", F.lit(1), keep)).alias("entry"),
    ).select(F.col("entry.token").alias("token"), "id", "items", "size")


def jaccard_pairs(
    left: DataFrame, right: DataFrame, threshold: float, below: bool = False
) -> DataFrame:
    """(left_id, right_id, jaccard) of all pairs of sets with Jaccard >= threshold.

    Both sides are (id, items), with ids unique per side and items distinct.
    Exact: prefixes and sizes only sort out pairs that cannot reach the
    threshold.  Empty sets match nothing.  ``below`` asks for left_id < right_id only:
    where both sides are one table, each pair then comes once.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    tokens = left.select(F.explode("items").alias("token")).unionAll(
        right.select(F.explode("items").alias("token"))
    )
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    a = _prefixes(left, frequency, threshold).select(
        "token",
        F.col("id").alias("left_id"),
        F.col("items").alias("left_items"),
        F.col("size").alias("left_size"),
    )
    b = _prefixes(right, frequency, threshold).select(
        "token",
        F.col("id").alias("right_id"),
        F.col("items").alias("right_items"),
        F.col("size").alias("right_size"),
    )
    fits = (F.least("left_size", "right_size") + 1e-9) >= F.greatest(
        "left_size", "right_size"
    ) * F.lit(threshold)
    common = F.size(F.array_intersect("left_items", "right_items"))
    return (
        a.join(b, "token")
        .filter(F.col("left_id") < F.col("right_id") if below else F.lit(True))
        .filter(fits)
        .withColumn("jaccard", common / (F.col("left_size") + F.col("right_size") - common))
        .filter(F.col("jaccard") >= threshold)
        .select("left_id", "right_id", "jaccard")
        .distinct()
    )


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("id", "to").cast("decimal(38,0)")).cast("string")
    ).first()
    return tuple(row)


def _met(links: DataFrame, least: DataFrame, column: str, hot: DataFrame | None, by: str, how: str) -> DataFrame:
    """Links with the ``least`` of their ``column``; those of a hot one are dealt out by ``by``."""
    if hot is None:
        return links.join(least, column, how)
    return split_join(links, least, column, hot, [F.col(by)], how)


def connected_components(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component): the least id that each id can reach over the pairs.

    Links lead from the larger id to the smaller.  A round is a large star, in which each link
    is led on to the least id that its end is linked to, and a small star, in which the ends of
    an id's links are linked to the least of them.  Rounds grow with the logarithm of a
    component's diameter, and links do not multiply.  An id with a great part of all links is
    dealt out in proportion, on both sides.  Every star is pinned, which cuts the lineage.
    Partitions are drawn together by the counted links, so that rounds over few links are few tasks.
    Where LEAST_TASKS tasks are enough for all links, so are they for any one id's, and none are dealt out.
    """
    links = pin(
        pairs.filter("left_id <> right_id")
        .select(F.greatest("left_id", "right_id").alias("id"), F.least("left_id", "right_id").alias("to"))
        .distinct()
    )
    before, now = None, _fingerprint(links)
    while now[0] and now != before:
        tasks = max(LEAST_TASKS, -(-now[0] // TASK_LINKS))
        links = links.coalesce(tasks)
        hot = hot_keys(links, "id", "to") if tasks > LEAST_TASKS else None
        least = links.groupBy("id").agg(F.min("to").alias("least")).coalesce(tasks)
        led = _met(links, least.withColumnRenamed("id", "to"), "to", hot, "id", "left")
        led = led.select("id", F.coalesce("least", "to").alias("to")).coalesce(tasks)
        large = pin(led.distinct().coalesce(tasks))
        least = large.groupBy("id").agg(F.min("to").alias("least")).coalesce(tasks)
        small = _met(large, least, "id", hot, "to", "inner").coalesce(tasks).select(
            F.explode(F.array("id", "to")).alias("id"), F.col("least").alias("to")
        )
        links = pin(small.filter("id <> to").distinct().coalesce(tasks))
        before, now = now, _fingerprint(links)
    ends = links.withColumnRenamed("to", "component")
    return pin(
        ids.select("id").distinct().join(ends, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    )
