"""Intermediate tables in the folder that driver and executors share, and ranks over sorted tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of monotonically_increasing_id() below the partition's number.
_WITHIN = 33


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset a temporary one is set, on one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-millrace-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"


#: Paths of the tables that are written for the rows which ``only_rows`` makes, in this thread or task.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def own_path(spark: SparkSession, name: str) -> str:
    """A new path that is deleted with the tables of the rows it serves."""
    path = new_path(spark, name)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table written in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = own_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only_rows(spark: SparkSession, make: Callable[[], DataFrame], name: str, always: bool = False) -> DataFrame:
    """The rows of ``make()`` without the tables that were written for them: if there are any (or ``always``), the rows are written as well and the tables
    deleted.

    Each call knows its own tables only, so several may run at once in one driver."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        rows = make()
        if own or always:
            # the rows' own table belongs to what is around this call
            _scope.reset(token)
            token = None
            rows = written(rows, name)
    finally:
        if token is not None:
            _scope.reset(token)
        _delete(spark, own)
    return rows


def ranked(df: DataFrame, order: list[Column], rank: str, name: str, group: str | None = None) -> DataFrame:
    """``df`` with each row's rank from 0 in a total order, or within ``group``, which must then lead the order.

    The order is dealt out by ranges and written; what comes together on one task afterwards is one row for each partition
    and group that meet.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", _WITHIN)
    keys = ["_part"] + ([group] if group else [])
    rows = rows.withColumn("_part", part)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if group:
        sums = sums.withColumn("_total", F.sum("_n").over(Window.partitionBy(group)))
        on = (F.col("r._part") == F.col("s._part")) & F.col(f"r.{group}").eqNullSafe(F.col(f"s.{group}"))
    else:
        on = F.col("r._part") == F.col("s._part")
    extra = [F.col("s._total").alias(f"{rank}_of")] if group else []
    return rows.alias("r").join(sums.alias("s"), on).select(*(F.col(f"r.{c}") for c in df.columns), (F.col("s._before") + F.col("r._at") - F.col("s._from")).alias(rank), *extra)
