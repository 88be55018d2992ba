"""Numbers that the JVM lacks or spells otherwise: fractions, small vectors, seeded draws, sparse matrices, calendars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def transpose(cells: DataFrame, row: str = "row", column: str = "column") -> DataFrame:
    """A sparse matrix (row, column, value) with rows and columns exchanged; nothing is shuffled."""
    return cells.select(F.col(column).alias(row), F.col(row).alias(column), *[c for c in cells.columns if c not in (row, column)])


def ratio(n: Column, d: Column) -> Column:
    """A fraction in lowest terms as a struct n, d (whole numbers, d over 0); null for a denominator of 0."""
    n, d = n.cast("long"), d.cast("long")
    # Euclid's steps: at most 92 for 64-bit numbers
    start = F.struct(F.abs(n).alias("a"), F.abs(d).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % s["b"]).alias("b")))
    common = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])
    sign = F.when(d < 0, -1).otherwise(1)
    return F.when(d != 0, F.struct((sign * n / common).cast("long").alias("n"), (sign * d / common).cast("long").alias("d")))


def ratio_add(x: Column, y: Column) -> Column:
    return ratio(x["n"] * y["d"] + y["n"] * x["d"], x["d"] * y["d"])


def ratio_multiply(x: Column, y: Column) -> Column:
    return ratio(x["n"] * y["n"], x["d"] * y["d"])


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def length(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def scaled(x: Column, by: Column | float) -> Column:
    return F.transform(x, lambda v: v * by)


def cross(x: Column, y: Column) -> Column:
    """Of arrays of three numbers."""
    at = lambda i, j: x[i] * y[j] - x[j] * y[i]
    return F.array(at(1, 2), at(2, 0), at(0, 1))


def uniform(key: Column, seed: int = 0) -> Column:
    """A number of [0, 1) that depends on the key and the seed alone, whatever the partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / float(1 << 52)


def gaussian(key: Column, seed: int = 0) -> Column:
    """A draw of the standard normal distribution (Box and Muller)."""
    return F.sqrt(-2 * F.log(1 - uniform(key, seed))) * F.cos(2 * np.pi * uniform(key, seed + 1))


def drawn(distribution: str, *parameters: float, seed: int = 0):
    """A function of a key: draws of NumPy's distributions, gamma and beta among them, that depend on key and seed alone."""

    @F.pandas_udf("double")
    def draw(keys: pd.Series) -> pd.Series:
        return pd.Series([float(getattr(np.random.default_rng([seed, k & 0x7FFFFFFFFFFFFFFF]), distribution)(*parameters)) for k in keys])

    return lambda key: draw(F.xxhash64(key))


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows drawn without replacement (all, if there are fewer): a distributed top-N of hashes of the key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def sample_again(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows drawn with replacement, column turn from 0: each turn's row is the one with the least hash of key and turn,
    a partial aggregation of n numbers a partition."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("turn")
    drawn = rows.select(key, turns).select(key, "turn", F.xxhash64(F.lit(seed), "turn", key).alias("h"))
    # numbers alone are summed up without a sort of n times the rows; the keys of the n least hashes are looked up then
    least = F.broadcast(drawn.groupBy("turn").agg(F.min("h").alias("h")))
    won = drawn.join(least, ["turn", "h"]).groupBy("turn").agg(F.min(key).alias(key))
    return rows.join(F.broadcast(won), key).select("turn", *rows.columns)


def calendar(seconds: Column) -> Column:
    """Seconds since 1970 as a struct of year, month, day, hour, minute, second, in the session's time zone."""
    t = F.timestamp_seconds(seconds)
    return F.struct(*[f(t).alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.day), ("hour", F.hour), ("minute", F.minute), ("second", F.second))])
