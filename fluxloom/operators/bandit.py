"""Multi-armed bandits: sums of trials and rewards by player and arm, and the arms that policies choose."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def sums(events: DataFrame, assume_unrewarded: bool = False) -> DataFrame:
    """player, arm, trial_count, weight, expectation from events (player, arm, kind select or reward, reward)."""
    counted = "select" if assume_unrewarded else "reward"
    out = events.groupBy("player", "arm").agg(F.sum(F.when(F.col("kind") == counted, 1).otherwise(0)).cast("long").alias("trial_count"), F.coalesce(F.sum(F.when(F.col("kind") == "reward", F.col("reward"))), F.lit(0.0)).alias("weight"))
    return expectations(out)


def expectations(table: DataFrame) -> DataFrame:
    """Sums with the mean reward of a trial, 0 without trials."""
    return table.withColumn("expectation", F.when(F.col("trial_count") > 0, F.col("weight") / F.col("trial_count")).otherwise(0.0))


def _argmax(arms: DataFrame, value: str) -> DataFrame:
    """The first arm in name order of the largest value, for each player; a partial aggregation."""
    return arms.groupBy("player").agg(F.min(F.struct((-F.col(value)).alias("v"), "arm")).alias("b")).select("player", F.col("b.arm").alias("arm"))


def greedy(arms: DataFrame) -> DataFrame:
    return _argmax(arms, "expectation")


def epsilon_greedy(arms: DataFrame, epsilon: float, seed: int = 0) -> DataFrame:
    if not 0 <= epsilon <= 1:
        raise ValueError("epsilon must be in [0, 1]")
    any_arm = _argmax(arms.withColumn("_r", F.rand(seed)), "_r").withColumnRenamed("arm", "random_arm")
    return greedy(arms).join(any_arm, "player").select("player", F.when(F.rand(seed + 1) < epsilon, F.col("random_arm")).otherwise(F.col("arm")).alias("arm"))


def decreasing_epsilon(arms: DataFrame, rate: float) -> DataFrame:
    """player, epsilon = min(1, 5 K (ln t / t) / rate^2), t trials and one."""
    if not 0 < rate < 1:
        raise ValueError("decreasing_rate must be in (0, 1)")
    t = F.sum("trial_count") + 1
    return arms.groupBy("player").agg(F.least(F.lit(1.0), 5 * F.count("*") * (F.log(t) / t) / rate**2).alias("epsilon"))


def ucb1(arms: DataFrame) -> DataFrame:
    """The first untried arm, else the largest mean + sqrt(2 ln T / n)."""
    total = F.sum("trial_count").over(Window.partitionBy("player"))
    value = F.when(F.col("trial_count") == 0, float("inf")).otherwise(F.col("expectation") + F.sqrt(2 * F.log(total) / F.col("trial_count")))
    return _argmax(arms.withColumn("_v", value), "_v")


def softmax(arms: DataFrame, tau: float) -> DataFrame:
    """player, arm, probability."""
    if tau <= 0:
        raise ValueError("tau must be positive")
    w = F.exp(F.col("expectation") / tau)
    return arms.select("player", "arm", (w / F.sum(w).over(Window.partitionBy("player"))).alias("probability"))


def exp3_probabilities(arms: DataFrame, gamma: float) -> DataFrame:
    if not 0 < gamma <= 1:
        raise ValueError("gamma must be in (0, 1]")
    w = F.exp("weight")
    return arms.select("player", "arm", ((1 - gamma) * w / F.sum(w).over(Window.partitionBy("player")) + gamma / F.count("*").over(Window.partitionBy("player"))).alias("probability"))


def exp3(events: DataFrame, arms: list[str], gamma: float) -> DataFrame:
    """player, arm, weight after each player's rewards in order of seq: w += gamma r / (p K); unknown arms don't count."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, n = dict.fromkeys(arms, 0.0), len(arms)
        for arm, reward in pdf.sort_values("seq")[["arm", "reward"]].itertuples(index=False):
            if arm in w:
                e = np.exp(np.array(list(w.values())) - max(w.values()))
                p = (1 - gamma) * e[arms.index(arm)] / e.sum() + gamma / n
                w[arm] += reward / p * gamma / n
        return pd.DataFrame({"player": key[0], "arm": arms, "weight": list(w.values())})

    return events.groupBy("player").applyInPandas(fold, f"player {events.schema['player'].dataType.simpleString()}, arm string, weight double")


def thompson(arms: DataFrame, seed: int = 0) -> DataFrame:
    """The arm with the largest draw of Beta(w + 1, n - w + 1)."""

    @F.pandas_udf("double")
    def draw(w: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, k & 0x7FFFFFFF]).beta(a + 1, b - a + 1) for a, b, k in zip(w, n, key)])

    return _argmax(arms.withColumn("_v", draw("weight", F.col("trial_count").cast("double"), F.hash("player", "arm"))), "_v")


def register_arms(table: DataFrame, arms: list[str]) -> DataFrame:
    """Sums with a row of zeros for every player and arm without one."""
    players = table.select("player").distinct().select("player", F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm"))
    new = players.join(table, ["player", "arm"], "left_anti")
    return table.unionByName(new.select("player", "arm", F.lit(0).cast("long").alias("trial_count"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("expectation")))


def delete_arm(table: DataFrame, arm: str) -> DataFrame:
    """Sums without the arm; totals are sums of trials, so its trials are gone from them too."""
    return table.filter(F.col("arm") != arm)


def reset(table: DataFrame, player) -> DataFrame:
    return table.filter(F.col("player") != F.lit(player))
