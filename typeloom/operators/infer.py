"""Datatypes of properties, from all values or from a sample of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.functions.hashing import code32
from typeloom.functions.values import (
    COUNT_COLUMNS,
    count_aggregates,
    majority_support,
    majority_type,
    unanimous_type,
)

SAMPLE_VALUES = 1000
FORCE_STRING = ("locationIP",)  # fixed value: a name always taken as text
TRUTH_NAMES = ("original_label",)  # fixed value: ground truth is no property
UNKNOWN_TYPE = "Unknown"
# Bounds of the bins of the support difference.
DELTA_BINS = ((0.0, 0.05), (0.05, 0.10), (0.10, 0.20), (0.20, 0.30), (0.30, None))


def type_properties(types: DataFrame) -> DataFrame:
    """Distinct property names of all types, without prefix and ground truth."""
    name = F.regexp_replace("p.name", "^prop_", "")
    return (
        types.select(F.explode("props").alias("p"))
        .select(name.alias("name"))
        .filter(~F.col("name").isin(*TRUTH_NAMES))
        .distinct()
    )


def _keys(scope: str) -> list[str]:
    if scope == "global":
        return ["name"]
    if scope == "type":
        return ["type_id", "name"]
    raise ValueError("scope is 'global' or 'type'")


def property_values(elements: DataFrame, scope: str = "global") -> DataFrame:
    """(id, keys..., value): one row per property value of nodes or edges; no id where these have none."""
    ids = [F.col(c).alias("id") for c in ("edge_id", "node_id") if c in elements.columns][:1]
    extra = [k for k in _keys(scope) if k != "name"]
    return elements.select(*ids, *extra, F.explode("props").alias("name", "value"))


def value_totals(elements: DataFrame, scope: str = "global") -> DataFrame:
    """(keys..., total): number of values of each property."""
    keys = _keys(scope)
    names = elements.select(*keys[:-1], F.explode("prop_set").alias("name"))
    return names.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))


def _draw(id_: Column, name: Column) -> Column:
    return code32(F.concat_ws("|", id_, name))


def sample_values(
    elements: DataFrame,
    n: int = SAMPLE_VALUES,
    scope: str = "global",
    totals: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` values of each property whose hash is least.

    A first filter keeps values with a hash below ``(2n + 100) / total``, which
    leaves about twice what is wanted, so no more than that meets in one task
    to be ranked, however common the property is.  The limits have a row per
    property and are broadcast: values are filtered where they are read, and
    no join gathers those of one property.
    """
    keys = _keys(scope)
    wanted = F.lit(2.0 * n + 100.0)
    if totals is None:
        totals = value_totals(elements, scope)
    limits = totals.select(
        *keys,
        F.least(F.lit(2.0**32), wanted * F.lit(2.0**32) / F.col("total")).alias("below"),
    )
    # names are drawn before values are looked up: most values are never cast to text
    id_col = F.col("edge_id" if "edge_id" in elements.columns else "node_id")
    drawn = (
        elements.select(
            id_col.alias("id"), *keys[:-1], "props", F.explode("prop_set").alias("name")
        )
        .withColumn("draw", _draw(F.col("id"), F.col("name")))
        .join(F.broadcast(limits), keys)
        .filter(F.col("draw") < F.col("below"))
        .select("id", *keys, F.try_element_at("props", F.col("name")).alias("value"), "draw")
    )
    order = Window.partitionBy(*keys).orderBy("draw", "id")
    return (
        drawn.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("id", *keys, "value")
    )


def value_counts(values: DataFrame, scope: str = "global", strict_dates: bool = False) -> DataFrame:
    """(keys..., total, int_cnt, dbl_cnt, date_cnt, bool_cnt, ip_cnt), all additive."""
    return values.groupBy(*_keys(scope)).agg(*count_aggregates(F.col("value"), strict_dates))


def add_value_counts(parts: DataFrame) -> DataFrame:
    """Sum of value counts that were taken batch by batch."""
    keys = [c for c in parts.columns if c not in ("total", *COUNT_COLUMNS)]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("total", *COUNT_COLUMNS)])


def types_from_counts(
    counts: DataFrame, rule: str = "unanimous", force_string: Sequence[str] = FORCE_STRING
) -> DataFrame:
    """Datatype by counts: all values pass (unanimous) or most do (majority)."""
    keys = [c for c in counts.columns if c not in ("total", *COUNT_COLUMNS)]
    name = F.col("name")
    if rule == "unanimous":
        return counts.select(*keys, "total", unanimous_type(name, force_string).alias("dtype"))
    if rule != "majority":
        raise ValueError("rule is 'unanimous' or 'majority'")
    return counts.select(
        *keys,
        "total",
        *COUNT_COLUMNS,
        majority_type(name, force_string).alias("dtype"),
        majority_support(name, force_string).alias("support"),
    )


def infer_types_sample(
    elements: DataFrame,
    n: int = SAMPLE_VALUES,
    force_string: Sequence[str] = FORCE_STRING,
    scope: str = "global",
    strict_dates: bool = False,
    totals: DataFrame | None = None,
) -> DataFrame:
    """(keys..., total, dtype) from at most ``n`` values of each property."""
    return infer_types(
        elements, "sample", "unanimous", n, force_string, scope, strict_dates, totals
    )


def infer_types_stats(
    elements: DataFrame,
    force_string: Sequence[str] = FORCE_STRING,
    scope: str = "global",
    strict_dates: bool = False,
) -> DataFrame:
    """(keys..., total, counts, dtype, support) from all values, in one pass."""
    return infer_types(
        elements, "all", "majority", 0, force_string, scope, strict_dates
    )


def infer_types(
    elements: DataFrame,
    values: str = "all",
    rule: str = "unanimous",
    n: int = SAMPLE_VALUES,
    force_string: Sequence[str] = FORCE_STRING,
    scope: str = "global",
    strict_dates: bool = False,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Datatypes of properties: from ``all`` values or a ``sample``, by one of two rules.

    By default a type is what all values pass, in batches and streams alike.
    """
    if values == "all":
        taken = property_values(elements, scope)
    elif values == "sample":
        taken = sample_values(elements, n, scope, totals)
    else:
        raise ValueError("values is 'all' or 'sample'")
    return types_from_counts(value_counts(taken, scope, strict_dates), rule, force_string)


@dataclass(frozen=True)
class TypeErrorReport:
    """How well types from a sample agree with types from all values."""

    properties: DataFrame
    summary: DataFrame
    histogram: DataFrame
    mismatches: DataFrame


def type_error_report(
    elements: DataFrame,
    n: int = SAMPLE_VALUES,
    force_string: Sequence[str] = FORCE_STRING,
    totals: DataFrame | None = None,
    top: int | None = None,
) -> TypeErrorReport:
    """All mismatches by default, the ``top`` widest on request."""
    sampled = types_from_counts(
        value_counts(sample_values(elements, n, "global", totals)), "majority", force_string
    ).select(
        "name",
        F.col("dtype").alias("sample_type"),
        F.col("support").alias("sample_support"),
        F.col("total").alias("sample_n"),
    )
    full = infer_types_stats(elements, force_string).select(
        "name",
        F.col("dtype").alias("full_type"),
        F.col("support").alias("full_support"),
        F.col("total").alias("full_n"),
    )
    properties = sampled.join(full, "name").withColumns(
        {
            "matches": F.col("sample_type") == F.col("full_type"),
            "delta": F.abs(F.col("sample_support") - F.col("full_support")),
        }
    )
    summary = properties.agg(
        F.count(F.lit(1)).alias("n_properties"),
        F.count_if("matches").alias("n_matches"),
        F.round(F.avg(F.col("matches").cast("double")) * 100, 4).alias("agreement_pct"),
        F.round(F.avg("delta") * 100, 4).alias("avg_delta_pct"),
    )
    delta = F.col("delta")
    bins = [
        F.count_if((delta >= low) if high is None else (delta >= low) & (delta < high))
        for low, high in DELTA_BINS
    ]
    entries = [
        F.struct(F.lit(i + 1).alias("bin"), F.lit(low).alias("low"), b.alias("n"))
        for i, ((low, _), b) in enumerate(zip(DELTA_BINS, bins))
    ]
    histogram = (
        properties.agg(F.array(*entries).alias("bins"))
        .select(F.explode("bins").alias("b"))
        .select("b.bin", "b.low", "b.n")
    )
    mismatches = (
        properties.filter(~F.col("matches"))
        .orderBy(F.desc("delta"), "name")
        .select("name", "sample_type", "full_type", "sample_support", "full_support", "delta")
    )
    if top is not None:
        mismatches = mismatches.limit(top)
    return TypeErrorReport(properties, summary, histogram, mismatches)


def annotate_types(types: DataFrame, dtypes: DataFrame) -> DataFrame:
    """Types with ``dtype`` in each entry of ``props``.

    ``dtypes`` is (name, dtype) or (type_id, name, dtype); a name without a
    type is Unknown.
    """
    keys = ["type_id", "name"] if "type_id" in dtypes.columns else ["name"]
    entries = types.select("type_id", F.explode("props").alias("p")).select("type_id", "p.*")
    listed = (
        entries.join(dtypes.select(*keys, "dtype"), keys, "left")
        .groupBy("type_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "name",
                        "n_present",
                        "mandatory",
                        F.coalesce("dtype", F.lit(UNKNOWN_TYPE)).alias("dtype"),
                    )
                )
            ).alias("props")
        )
    )
    empty = F.array().cast(
        "array<struct<name:string,n_present:bigint,mandatory:boolean,dtype:string>>"
    )
    return (
        types.drop("props")
        .join(listed, "type_id", "left")
        .withColumn("props", F.coalesce("props", empty))
    )
