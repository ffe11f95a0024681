"""Scoring a growing synthetic table: every micro-batch is folded into running frequencies.

The state is a table of label counts, whose size grows with the labels and not with the rows; each
batch's counts are added by one small aggregation, and the shares are compared with the real ones.
The state of every batch is a numbered table beside the stream's checkpoint; a restart goes on from
the last one that was written to its end, and all but the last two are removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.storage import drop, saved, shared_dir, versions
from ..plans import kernels as K


class RunningTvd:
    """Total variation distance of each label column between the real table and all synthetic rows so far."""

    def __init__(self, real: DataFrame, columns: list[str], on_update: Callable[[int, DataFrame], None] | None = None, state: str | None = None):
        self.columns, self.on_update = columns, on_update
        self.real = saved(self._count(real, "r"), "counts")
        self.resume(state or f"{shared_dir(real.sparkSession)}/running-{uuid.uuid4().hex[:12]}")

    def resume(self, state: str) -> None:
        """Go on from what the folder ``state`` holds."""
        self.state, spark = state, self.real.sparkSession
        self.done = max(versions(spark, state), default=-1)
        self.counts = self.real.unionByName(self._version(self.done)) if self.done >= 0 else self.real

    def _version(self, epoch: int) -> DataFrame:
        return self.real.sparkSession.read.schema(self.real.schema).parquet(f"{self.state}/{epoch}")

    def _count(self, df: DataFrame, side: str) -> DataFrame:
        long = K.label_long(df.withColumn("_side", F.lit(side)), self.columns)
        return long.groupBy("_side", "column", "label").agg(F.count(F.lit(1)).alias("n"))

    def update(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self.done:  # a batch that is delivered again counts once
            return
        spark = self.real.sparkSession
        every = self.counts.where("_side = 's'").unionByName(self._count(batch, "s")).groupBy("_side", "column", "label").agg(F.sum("n").alias("n"))
        every.write.mode("overwrite").parquet(f"{self.state}/{epoch}")
        self.done, self.counts = epoch, self.real.unionByName(self._version(epoch))
        for old in versions(spark, self.state)[:-2]:
            drop(spark, f"{self.state}/{old}")
        if self.on_update:
            self.on_update(epoch, self.table())

    def table(self) -> DataFrame:
        n = self.counts.groupBy("column", "label").agg(*[F.sum(F.when(F.col("_side") == s, F.col("n")).otherwise(0)).alias(s) for s in "rs"])
        t = n.groupBy("column").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"))
        gap = F.abs(F.try_divide(F.col("r").cast("double"), F.col("tr").cast("double")) - F.try_divide(F.col("s").cast("double"), F.col("ts").cast("double")))
        return n.join(t, "column").groupBy("column").agg((F.sum(gap) / 2).alias("tvd"))

    def attach(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        self.resume(f"{checkpoint.rstrip('/')}-running")
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
