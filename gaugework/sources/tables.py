"""Table and metadata sources."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schema import GaugeError, Metadata


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV (header, types inferred), by suffix in any case; any address that Spark reads."""
    suffix = Path(path.rstrip("/")).suffix.lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix == ".csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    raise GaugeError(f"unsupported file type {suffix!r}: {path}")


def as_frame(spark: SparkSession, table) -> DataFrame:
    """A Spark DataFrame as it is; a pandas one through Arrow."""
    return table if isinstance(table, DataFrame) else spark.createDataFrame(table)


def read_metadata(path: str) -> Metadata:
    """JSON: {"primary_key": ..., "columns": {name: {"dtype", "sensitive", "quasi_identifier"}}}."""
    return Metadata.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))
