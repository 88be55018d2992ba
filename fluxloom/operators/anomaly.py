"""Local outlier factors over exact nearest neighbours: (row_id, neighbour, distance) tables, k nearest of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INFINITY = float("inf")


def nearest(pairs: DataFrame, k: int, by: str = "row_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy("distance", "neighbour")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def k_distance(pairs: DataFrame, k: int) -> DataFrame:
    """Distance of the k-th neighbour; the row itself (distance 0) counts if ``pairs`` has it."""
    return nearest(pairs, k).groupBy("row_id").agg(F.max("distance").alias("kdist"))


def _lrd(near: DataFrame, kdist: DataFrame, by: str, floor: float | None = None) -> DataFrame:
    """Densities: neighbours over their reach distances' sum, which has ``floor`` added; without one a sum of 0 is an
    infinite density."""
    reach = near.join(kdist.select(F.col("row_id").alias("neighbour"), "kdist"), "neighbour")
    total = F.sum(F.greatest("distance", "kdist"))
    if floor is not None:
        return reach.groupBy(by).agg((F.count("*") / (total + floor)).alias("lrd"))
    return reach.groupBy(by).agg(F.when(total == 0, INFINITY).otherwise(F.count("*") / total).alias("lrd"))


def local_density(pairs: DataFrame, kdist: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    return _lrd(nearest(pairs, k), kdist, "row_id", floor)


def scores(query_pairs: DataFrame, kdist: DataFrame, lrd: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """LOF of queries (query_id, neighbour, distance): mean density of the neighbours over the query's own; both
    infinite is 1."""
    near = nearest(query_pairs, k, "query_id")
    own = _lrd(near, kdist, "query_id", floor)
    mean = near.join(lrd.select(F.col("row_id").alias("neighbour"), F.col("lrd").alias("n_lrd")), "neighbour").groupBy("query_id").agg(F.avg("n_lrd").alias("mean"))
    lof = F.when((F.col("lrd") == INFINITY) & (F.col("mean") == INFINITY), 1.0).otherwise(F.col("mean") / F.col("lrd"))
    return own.join(mean, "query_id").select("query_id", lof.alias("lof"))


def stored_scores(pairs: DataFrame, k: int, floor: float | None = None) -> DataFrame:
    """LOF of every stored row, which is no neighbour of itself; ``pairs`` (row_id, neighbour, distance) has each row with
    itself too, which counts for its k-distance, and at least k + 1 of its nearest."""
    kdist = k_distance(pairs, k)
    others = pairs.filter("row_id <> neighbour")
    lrd = local_density(pairs, kdist, k, floor)
    return scores(others.withColumnRenamed("row_id", "query_id"), kdist, lrd, k, floor).withColumnRenamed("query_id", "row_id")


def without_kth_same(stored: DataFrame, new: DataFrame, k: int, point: str | list[str] = "x", order: str = "row_id") -> DataFrame:
    """The rows of ``new`` that are taken in order: one whose k - 1 nearest are all at distance 0 is left out, so k - 1 rows
    of one point at most are held. Spark keeps k - 1 rows a point before it shuffles, however many there are."""
    keys = [point] if isinstance(point, str) else point
    w = Window.partitionBy(*keys).orderBy(order)
    first = new.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k - 1)
    held = stored.groupBy(*keys).agg(F.count("*").alias("_held"))
    return first.join(held, keys, "left").filter(F.col("_n") + F.coalesce("_held", F.lit(0)) <= k - 1).select(*new.columns)
