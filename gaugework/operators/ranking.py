"""Normalising and ranking candidates, as window functions over a score table (candidate, c, metric, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalised(scores: DataFrame, mode: str = "absolute") -> DataFrame:
    """Scores of each metric put on one scale across candidates: absolute, linear, normal or quantile."""
    w = Window.partitionBy("metric")
    x = F.col("score")
    if mode == "linear":
        r = F.round(x, 14)
        lo, hi = F.min(r).over(w), F.max(r).over(w)
        x = F.when(lo == hi, F.lit(1.0)).otherwise((r - lo) / F.nullif(hi - lo, F.lit(0.0)))
    elif mode == "normal":
        m, sd = F.avg(x).over(w), F.stddev_pop(x).over(w)
        x = F.when(sd < 1e-14, F.lit(0.0)).otherwise((x - m) / F.nullif(sd, F.lit(0.0)))
    elif mode == "quantile":
        r = F.round(x, 14)
        ordered, equal = Window.partitionBy("metric").orderBy(r), Window.partitionBy("metric", r)
        place = F.rank().over(ordered) - 1 + (F.count(F.lit(1)).over(equal) - 1) / 2.0
        n = F.count(F.lit(1)).over(w)
        x = F.when(n < 2, F.lit(0.5)).otherwise(place / F.nullif(n - 1, F.lit(0)))
    elif mode != "absolute":
        raise ValueError(f"unknown normalisation {mode!r}")
    return scores.withColumn("score", x)


def compared(scores: DataFrame) -> DataFrame:
    """Only metrics that every candidate with any score has a score for."""
    n = scores.select(F.countDistinct("candidate").alias("_n"))
    full = scores.groupBy("metric").agg(F.countDistinct("candidate").alias("_k")).join(F.broadcast(n), F.col("_k") == F.col("_n")).select("metric")
    return scores.join(full, "metric", "left_semi")


def dimension_scores(scores: DataFrame, mode: str = "absolute") -> DataFrame:
    """-> candidate, c, score: mean over the compared metrics of a dimension."""
    return normalised(compared(scores), mode).groupBy("candidate", "c").agg(F.avg("score").alias("score"))


def leaderboard(scores: DataFrame, mode: str = "absolute", by: str = "overall", candidates: DataFrame | None = None) -> DataFrame:
    """-> place, candidate, overall (null: nothing to rank by): best first, ties by name, candidates without a value last.

    ``by`` is overall (the mean over dimensions of the mean over compared metrics), a dimension, or a
    metric, which not every candidate needs to have. ``candidates`` (candidate) may name some that have no score at all.
    """
    parts = dimension_scores(scores, mode)
    if by != "overall":
        parts = parts.where(F.col("c") == by).unionByName(normalised(scores.where(F.col("metric") == by), mode).select("candidate", "c", "score"))
    total = parts.groupBy("candidate").agg(F.avg("score").alias("overall"))
    every = (scores if candidates is None else candidates).select("candidate").distinct().join(total, "candidate", "left")
    order = Window.orderBy(F.desc_nulls_last("overall"), "candidate")  # a row a candidate
    return every.select(F.row_number().over(order).alias("place"), "candidate", "overall")
