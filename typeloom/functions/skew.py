"""Equi-joins whose hot keys are dealt into as many groups as their share of the rows asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.sizing import pin, shuffles_freed

#: A key with more than 1/SHARE of all rows is hot; there are fewer than SHARE of them.
SHARE = 256
#: Keys that a frequency sketch follows; it is off by some 3/TRACKED of all rows at most.
TRACKED = 8192

#: Hash buckets whose rows are counted, a few thousand numbers a column.
BUCKETS = 4096
#: Tasks that sum these numbers.
COUNT_TASKS = 32


def hot_keys(df: DataFrame, *columns: str) -> DataFrame:
    """(column, key, parts): the hot keys of ``columns``, which are of one type, and their groups.

    Rows are counted by hash buckets first: a hot key makes its bucket hot.  Only where a bucket is,
    a second scan takes the rows of such buckets into a mergeable heavy-hitter sketch, whose result has
    fewer than SHARE rows a column.
    The sketch depends on the order in which parts of it are merged, so the table is pinned:
    both sides of a join must see the same groups.  A key that the sketch misses is joined as
    any other.
    """
    def bucket(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")

    places = [F.when(F.col(c).isNotNull(), F.lit(i * BUCKETS) + bucket(c)) for i, c in enumerate(columns)]
    with shuffles_freed(df.sparkSession):
        counts = df.select(F.explode(F.array(*places)).alias("place")).filter("place is not null")
        counts = counts.groupBy("place").agg(F.count(F.lit(1)).alias("n")).coalesce(COUNT_TASKS)
        counts = {r["place"]: r["n"] for r in counts.collect()}
    totals = {c: sum(n for p, n in counts.items() if p // BUCKETS == i) for i, c in enumerate(columns)}
    full = {
        c: [p % BUCKETS for p, n in counts.items() if p // BUCKETS == i and n * SHARE > totals[c]]
        for i, c in enumerate(columns)
    }
    full = {c: sorted(places) for c, places in full.items() if places}
    if not full:
        key_type = df.schema[columns[0]].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"column string, key {key_type}, parts int")
    tops = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(totals[c]).alias("total"),
            F.expr(f"approx_top_k(`{c}`, {SHARE}, {TRACKED}) filter (where `_{c}`)").alias("top"),
        )
        for c in full
    ]
    within = {f"_{c}": F.col(c).isNotNull() & bucket(c).isin(places) for c, places in full.items()}
    found = (
        df.select(*full)
        .withColumns(within)
        .filter(" or ".join(f"`{c}`" for c in within))
        .agg(*[t.alias(f"t{i}") for i, t in enumerate(tops)])
        .select(F.inline(F.array(*[f"t{i}" for i in range(len(tops))])))
        .select("column", "total", F.inline("top").alias("key", "n"))
        .filter(F.col("n") * SHARE > F.col("total"))
    )
    parts = F.ceil(F.col("n") * SHARE / F.col("total")).cast("int")
    return pin(found.select("column", "key", parts.alias("parts")))


def _parts(hot: DataFrame, column: str) -> DataFrame:
    return F.broadcast(
        hot.filter(F.col("column") == column).select(F.col("key").alias(column), F.col("parts").alias("_parts"))
    )


def deal(left: DataFrame, column: str, hot: DataFrame, by: list[Column], group: str = "_group") -> DataFrame:
    """``left`` with the ``group`` of each row: by a hash of ``by`` where its key is hot, else 0.

    Rows without a key, which match nothing, are dealt out too.
    """
    groups = F.when(F.col(column).isNull(), F.lit(SHARE)).otherwise(F.coalesce("_parts", F.lit(1)))
    number = F.pmod(F.xxhash64(*by), groups).cast("int")
    return left.join(_parts(hot, column), column, "left").withColumn(group, number).drop("_parts")


def join_dealt(
    dealt: DataFrame,
    right: DataFrame,
    column: str,
    hot: DataFrame,
    how: str = "left",
    group: str = "_group",
) -> DataFrame:
    """Rows of :func:`deal` joined with ``right`` on ``column``; the group is dropped.

    Only the right rows of hot keys are copied, once for each group.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    copied = right.join(_parts(hot, column), column, "left").withColumn(group, F.explode(copies)).drop("_parts")
    return dealt.join(copied, [column, group], how).drop(group)


def split_join(
    left: DataFrame, right: DataFrame, column: str, hot: DataFrame, by: list[Column], how: str = "left"
) -> DataFrame:
    """``left`` joined with ``right`` on ``column``; rows of a hot key go to groups by a hash of ``by``.

    ``hot`` is a table of :func:`hot_keys` over ``left``.
    """
    return join_dealt(deal(left, column, hot, by), right, column, hot, how)
