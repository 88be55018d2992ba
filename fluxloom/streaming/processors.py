"""Continuous versions: event-time windows, the last values of each key, and models merged after each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, time: str, key: str, value: str, interval: str, late: str) -> DataFrame:
    """start, key, n, total of each window; rows later than ``late`` are not counted (a watermark)."""
    w = events.withWatermark(time, late).groupBy(F.window(time, interval), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), key, "n", "total")


def last_values(events: DataFrame, key: str, value: str, order: str, size: int) -> DataFrame:
    """After each micro-batch: key, n, total, most, least of the last ``size`` values of each key that it touched.

    State is at most ``size`` values a key. ``order`` is a number; rows of a micro-batch are taken in its order.
    """
    kind = events.schema[key].dataType.simpleString()

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        new = pd.concat(list(batches)).sort_values(order)
        held = (held + new[value].tolist())[-size:]
        state.update((held,))
        yield pd.DataFrame({key: [k[0]], "n": [len(held)], "total": [float(sum(held))], "most": [max(held)], "least": [min(held)]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double, most double, least double", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def merge_each_batch(events: DataFrame, difference: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame | None, DataFrame], DataFrame], path: str, checkpoint: str):
    """Folds micro-batches into a model: each batch's difference is merged with the model so far and written as the next
    version below ``path``. A batch that is run again writes the same version again."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        master = spark.read.parquet(f"{path}/version={number - 1}") if number else None
        merge(master, difference(batch)).write.mode("overwrite").parquet(f"{path}/version={number}")

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
