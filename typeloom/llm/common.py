"""What several operators share: tables, worker caches, column helpers."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts are handed to numpy in slices of about so many characters.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """A value kept as long as the Python worker lives, across its tasks.

    Functions of this package reach a worker by value, so their globals are new
    in every task; a module of the interpreter's own table is not.  A worker keeps one
    value: that of another name is dropped, so the stages of a pipeline do not add up.
    """
    kept = sys.modules.setdefault("_typeloom_worker", types.ModuleType("_typeloom_worker"))
    if not hasattr(kept, name):
        for other in [k for k in vars(kept) if not k.startswith("__")]:
            delattr(kept, other)
        setattr(kept, name, make())
    return getattr(kept, name)


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def fold_of(column: Column | str, parts: int) -> Column:
    """crc32 of an id written as text, modulo ``parts``; a null id counts as ''."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts


def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches one by one; the memory of those before goes back to the system, which Arrow else keeps."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        yield batch
        del batch


def text_slices(
    batches: Iterable[pa.RecordBatch], column: str = "text", chars: int = SLICE_CHARS
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with their texts, null as ''.

    A slice ends once its texts reach ``chars`` characters, so what a task
    holds in numpy is bounded by the slice and one text.
    """
    for batch in released(batches):
        texts = batch.column(column)
        start = held = 0
        part: list[str] = []
        for i in range(len(texts)):
            text = texts[i].as_py() or ""
            part.append(text)
            held += len(text)
            if held >= chars:
                yield batch.slice(start, i + 1 - start), part
                start, held, part = i + 1, 0, []
        if part:
            yield batch.slice(start, len(part)), part
        del batch, texts, part  # before the next one is read


def ranked(df: DataFrame, group: list[str], order: list[str], folder: str) -> DataFrame:
    """``df`` with ``rank`` (from 0) of each row in its group and ``size``, the rows of the group.

    Group columns hold no null; nulls of ``order`` come first.  Rows are sorted by
    range, so a group of any size lies in as many partitions as it needs: each numbers
    its own rows, and one row a partition and group carries the numbers on.  The
    sorted rows are written to ``folder``, so their places stay what they are when an
    executor is lost.  Rows equal in all of these columns lie in one range: end ``order``
    with a column that tells rows apart.
    """
    spark = df.sparkSession
    keys = [*group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.withColumn("place", F.monotonically_increasing_id())
    placed.write.parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder).withColumn(
        "part", F.shiftright("place", 33)
    )
    runs = placed.groupBy("part", *group).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("size", F.sum("n").over(whole)).withColumn(
        "base", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    )
    joined = placed.join(runs.drop("first", "n"), ["part", *group])
    return joined.withColumn("rank", F.col("place") + F.col("base")).drop("part", "place", "base")


def sql_crc32(text: str) -> str:
    """DuckDB expression: unsigned crc32 of an ASCII text, bit by bit."""
    text = f"({text})"
    codes = f"list_transform(range(length({text})), lambda i: ord({text}[i + 1])::bigint)"
    bits = (
        "list_reduce(list_prepend(xor(crc, code), range(8)::bigint[]),"
        " lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    )
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {codes}), lambda crc, code: {bits}))"
    )
