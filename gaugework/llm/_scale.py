"""Helpers shared by the operators: shared storage, worker imports, distributed prefix sums.

Nothing here holds more than a bounded summary on the driver.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
_OWN: dict[str, str] = {}


def workers_can_import(spark: SparkSession) -> None:
    """Put this package's root on the Python workers' path (they may start in another folder)."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


class Freed:
    """A function over Arrow batches that gives its memory back to the system after its task.

    Python workers outlive their tasks, and what one stage's arrays took would count against the next.
    """

    def __init__(self, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        self.run = run

    def __call__(self, batches):
        try:
            yield from self.run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with a function of this package."""
    workers_can_import(df.sparkSession)
    run = Freed(run)
    return df.mapInArrow(lambda batches: run(batches), schema)


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named by place, so that no name clashes with a helper's; original name -> new name."""
    names = [f"in{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder takes its place on a single machine; a cluster
    would scatter the files over its machines, so there it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="gaugework-")
        _OWN[app] = f"{base.rstrip('/')}/gaugework-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _OWN[app])
    return _OWN[app]


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and is not run twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("parquet.block.size", 32 << 20).parquet(path)  # small row groups, as two tasks of an executor write at once
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bounded(df: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` (a saved table) marked for broadcasting if it has at most ``most`` rows; else Catalyst shuffles both sides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bits_for(rows: int, per_bucket: int = 4096, most: int = 32) -> int:
    """log2 of the number of hash buckets that hold about ``per_bucket`` rows each."""
    return max(0, min(most, (max(rows, 1) // per_bucket).bit_length()))


def prefix_sums(df: DataFrame, group: str, key: str, ties: list, value, bits: int, out: str, extra: DataFrame | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` in the order of ``key`` (hex digest) within ``group``.

    ``group`` must not hold nulls. A hot group never meets in one task: rows are cut by the leading
    ``bits`` of the uniformly distributed key and summed inside each (group, cut); the cuts' totals are
    scanned in blocks of the square root of their number, and the blocks' totals before them. ``extra``
    (one row a group) is joined to the cut totals, so that the rows are shuffled once.
    """
    cut = F.shiftright(F.conv(F.substring(F.col(key), 1, 8), 16, 10).cast("long"), 32 - bits)
    df = df.withColumn("_cut", cut).withColumn("_value", value.cast("long"))
    totals = df.groupBy(group, "_cut").agg(F.sum("_value").alias("_t")).withColumn("_block", F.shiftright("_cut", bits // 2))
    up_to = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if bits > 12:
        blocks = totals.groupBy(group, "_block").agg(F.sum("_t").alias("_b"))
        blocks = blocks.withColumn("_ahead", up_to(Window.partitionBy(group).orderBy("_block"), "_b")).drop("_b")
        totals = totals.join(blocks, [group, "_block"])
    else:
        totals = totals.withColumn("_block", F.lit(0)).withColumn("_ahead", F.lit(0))
    if extra is not None:
        totals = totals.join(extra, group)
    totals = totals.withColumn("_before", F.col("_ahead") + up_to(Window.partitionBy(group, "_block").orderBy("_cut"), "_t")).drop("_t", "_block", "_ahead")
    inside = Window.partitionBy(group, "_cut").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return df.join(totals, [group, "_cut"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_cut", "_value", "_before", "_inside")
