"""Pairs of tables carved from the test tables by predicates that Spark and DuckDB read alike."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..schema import ColumnMetadata, ColumnType, Metadata


@dataclass(frozen=True)
class Pair:
    """Keys modulo 5: 0 and 1 are real, 2 and 3 synthetic, 4 holdout. ``distort`` replaces columns of the synthetic side."""

    table: str
    key: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    distort: dict[str, str] = field(default_factory=dict)
    everywhere: dict[str, str] = field(default_factory=dict)
    where: str = ""
    leaky: bool = False

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.numeric, *self.categorical)

    def sql(self, table: str | None = None) -> str:
        t = table or self.table

        def part(side: str, test: str, extra: dict[str, str], shift: int = 0) -> str:
            cols = ", ".join(f"{(self.everywhere | extra).get(c, c)} AS {c}" for c in self.columns)
            more = f" AND {self.where}" if side == "s" and self.where and not shift else ""
            return f"SELECT '{side}' AS side, {self.key} + {shift} AS id, {cols} FROM {t} WHERE {test}{more}"

        parts = [part("r", f"{self.key} % 5 IN (0, 1)", {}), part("s", f"{self.key} % 5 IN (2, 3)", self.distort), part("h", f"{self.key} % 5 = 4", {})]
        if self.leaky:
            parts.append(part("s", f"{self.key} % 10 = 0", {}, 100_000_000))
        return " UNION ALL ".join(parts)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """-> _side, id and the columns."""
        source = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        return spark.sql(self.sql("{t}"), t=source).withColumnRenamed("side", "_side")

    def meta(self, **roles) -> Metadata:
        cols = {c: ColumnMetadata(c, ColumnType.NUMERIC if c in self.numeric else ColumnType.CATEGORICAL, c in roles.get("sensitive", ()), c in roles.get("quasi", ())) for c in self.columns}
        return Metadata(cols)


LINE = Pair("lineitem", "l_orderkey", ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus"), {"l_extendedprice": "l_extendedprice * 0.8", "l_returnflag": "CASE WHEN l_returnflag = 'R' AND l_orderkey % 3 = 0 THEN 'N' ELSE l_returnflag END"})
CUT = Pair("lineitem", "l_orderkey", ("l_quantity", "l_extendedprice"), ("l_returnflag",), where="l_quantity BETWEEN 6 AND 46")
EVENTS = Pair("events", "event_id", ("value",), ("event_type",), {"value": "value + 1"}, {"value": "CASE WHEN event_id % 7 = 3 THEN NULL ELSE value END", "event_type": "CASE WHEN event_id % 11 = 5 THEN NULL ELSE event_type END"})
PART = Pair("part", "p_partkey", ("p_size", "p_retailprice"), ("p_brand", "p_type"))
PART_ROWS = Pair("part", "p_partkey", ("p_size",), ("p_brand", "p_type"), leaky=True)
CUSTOMER = Pair("customer", "c_custkey", ("c_acctbal",), ("c_mktsegment", "c_nationkey"), leaky=True)
CUT_FLAG = Pair("lineitem", "l_orderkey", ("l_quantity",), ("l_returnflag", "l_linestatus"), where="l_quantity BETWEEN 6 AND 46")
