"""Windowed statistics: the last N pushes over all keys, and what is asked of each key among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_pushes(pushes: DataFrame, order: list[str], size: int) -> DataFrame:
    """The last ``size`` rows of the whole stream; a distributed top-N, no global sort."""
    if size < 1:
        raise ValueError("window_size must be at least 1")
    return pushes.orderBy(*[F.col(c).desc() for c in order]).limit(size)


def moment(value: Column, degree: int, center: float | Column) -> Column:
    """Mean of (value - center)^degree; -1 for a negative degree, 1 for degree 0."""
    if degree < 0:
        return F.lit(-1.0)
    if degree == 0:
        return F.lit(1.0)
    return F.avg(F.pow(value - center, F.lit(degree)))


def window_summary(window: DataFrame, key: str, value: str, center: float = 0.0) -> DataFrame:
    """Count, sum, max, min, population deviation and moments of each key of a window."""
    v = F.col(value)
    return window.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(v).alias("sum"), F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_pop(v).alias("stddev"),
        moment(v, 1, 0.0).alias("moment1"), moment(v, 2, 0.0).alias("moment2"), moment(v, 3, center).alias("moment3"),
    )


def entropy(window: DataFrame, key: str) -> DataFrame:
    """One row: ln n - sum(c ln c) / n over the counts c of keys; 0 for an empty window."""
    counts = window.groupBy(key).count()
    n = F.sum("count")
    return counts.agg(F.coalesce(F.log(n) - F.sum(F.col("count") * F.log("count")) / n, F.lit(0.0)).alias("entropy"))


def running(pushes: DataFrame, key: str, value: str, order: list[str], size: int) -> DataFrame:
    """For each push the count and sum of its key among the last ``size`` pushes of that key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(size - 1), Window.currentRow)
    return pushes.withColumn("run_n", F.count("*").over(w)).withColumn("run_sum", F.sum(value).over(w)).withColumn("run_max", F.max(value).over(w)).withColumn("run_min", F.min(value).over(w))
