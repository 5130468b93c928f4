"""Keeping plans safe at scale: a shared work folder and cut lineage."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of a table that is broadcast.
SMALL_BYTES = 8 << 20
#: Spark's setting for shuffle files that go with the execution that wrote them.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_freeing = threading.Lock()
_open: dict[str, tuple[int, str | None]] = {}  # of a session: blocks that are open, the setting before


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    A session without the setting gets a folder in its warehouse, which executors share as
    well.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_typeloom"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def work_folder(spark: SparkSession) -> str:
    """A fresh folder name below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/typeloom-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Frames made and run in this block give the disk of their shuffles back when they end.

    Otherwise it is held until the driver's JVM happens to collect its garbage, beside the
    shuffles of what comes next.  Blocks may nest and run side by side.
    """
    key = spark._jsparkSession.sessionUUID()  # a stream's batches come with sessions of their own
    with _freeing:
        depth, before = _open.get(key) or (0, spark.conf.get(FREED, None))
        _open[key] = depth + 1, before
        spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        with _freeing:
            depth, before = _open.pop(key)
            if depth > 1:
                _open[key] = depth - 1, before
            elif before is None:
                spark.conf.unset(FREED)
            else:
                spark.conf.set(FREED, before)


def pin(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder, so a lost executor costs nothing."""
    checkpoint_root(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own: that of ``df`` keeps its shuffles


def keep(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder as compressed columns, for long tables."""
    folder = f"{work_folder(df.sparkSession)}/kept"
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def pin_small(df: DataFrame) -> DataFrame:
    """``df`` pinned, and broadcast where its rows, now counted, are small.

    Spark does not know the size of a pinned table, and shuffles the other side of a join for it.
    """
    kept = pin(df)
    size = F.sum(F.octet_length(F.to_json(F.struct(*kept.columns))))
    return F.broadcast(kept) if (kept.agg(size).first()[0] or 0) <= SMALL_BYTES else kept
