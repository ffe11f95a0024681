"""Tables that end a lineage: written to the shared folder and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``, removed when the application ends.

    A temporary folder takes its place only on a single machine (tests): on a cluster every machine
    would write to a disk of its own, so there a missing setting is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            local = tempfile.mkdtemp(prefix="gaugework-")
            atexit.register(shutil.rmtree, local, True)
            base = f"file://{local}"
        _OWN[app] = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
        atexit.register(drop, spark, _OWN[app])
    return _OWN[app]


def saved(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder, if the application still runs."""
    if spark.sparkContext._jsc is not None:
        fs, p = _place(spark, path)
        fs.delete(p, True)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbered tables in a folder that were written to their end."""
    fs, p = _place(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in found if n.isdigit() and fs.exists(_place(spark, f"{folder}/{n}/_SUCCESS")[1]))
