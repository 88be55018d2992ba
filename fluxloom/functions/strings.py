"""String and number helpers that the JVM lacks, as vectorised functions."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.lineage import cut


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def lis_length(values: list) -> int:
    """Length of the longest strictly increasing subsequence."""
    tails: list = []
    for v in values:
        at = bisect.bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)


@F.pandas_udf(T.LongType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs_length(x, y) for x, y in zip(a, b)], dtype="Int64")


@F.pandas_udf(T.LongType())
def lis(a: pd.Series) -> pd.Series:
    return pd.Series([lis_length(list(x)) for x in a])


def find_any(patterns: list[str]):
    """Array of (start, pattern) of all occurrences of a list of patterns, by one automaton."""

    @F.pandas_udf("array<struct<start:int,pattern:string>>")
    def found(texts: pd.Series) -> pd.Series:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in patterns:
            automaton.add_word(p, p)
        automaton.make_automaton()
        return pd.Series([sorted((end - len(p) + 1, p) for end, p in automaton.iter(t)) if t else [] for t in texts])

    return found


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fft_magnitude(x: pd.Series) -> pd.Series:
    return pd.Series([np.abs(np.fft.fft(np.asarray(v, float))).tolist() for v in x])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def suffix_array(texts: pd.Series) -> pd.Series:
    """Starts of the suffixes in order, by prefix doubling."""

    def build(t: str) -> list[int]:
        n, k = len(t), 1
        rank = np.unique(np.array(list(t)), return_inverse=True)[1] if n else np.zeros(0, int)
        order = np.argsort(rank, kind="stable")
        while n > 1 and k < n and len(np.unique(rank)) < n:
            second = np.full(n, -1)
            second[: n - k] = rank[k:]
            order = np.lexsort((second, rank))
            change = np.concatenate([[0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0))])
            rank = np.empty(n, int)
            rank[order] = change
            k *= 2
        return order.tolist()

    return pd.Series([build(t or "") for t in texts])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def inverse_suffix_array(suffixes: pd.Series) -> pd.Series:
    """The place of each suffix in their order."""
    return pd.Series([np.argsort(np.asarray(s, int), kind="stable").tolist() for s in suffixes])


def range_minimum(values: Column, first: Column | int, last: Column | int) -> Column:
    """The place (from 0) of the least of the values from ``first`` to ``last``, the first of equal ones."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    part = F.slice(values, first + 1, last - first + 1)
    return first + F.array_position(part, F.array_min(part)).cast("int") - 1


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def fft(x: pd.Series) -> pd.Series:
    """The transform of arrays of real numbers, as pairs of a real and an imaginary part."""
    return pd.Series([[[float(c.real), float(c.imag)] for c in np.fft.fft(np.asarray(v, float))] for v in x])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def inverse_fft(x: pd.Series) -> pd.Series:
    """The real part of the inverse transform."""
    return pd.Series([np.fft.ifft(np.array([c[0] + 1j * c[1] for c in v])).real.tolist() for v in x])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def fft2_magnitude(x: pd.Series) -> pd.Series:
    """Magnitudes of the two-dimensional transform of arrays of rows."""
    return pd.Series([np.abs(np.fft.fft2(np.stack([np.asarray(r, float) for r in v]))).tolist() for v in x])


def contains_at(text: Column, pattern: str) -> Column:
    """0-based place of the first occurrence, -1 if none."""
    return F.instr(text, pattern) - 1


def gamma_code(n: Column) -> Column:
    """Elias' gamma code of n >= 1 as a string of 0 and 1."""
    b = F.bin(n)
    return F.when(n >= 1, F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b))


def word_code(n: Column, length: int) -> Column:
    """The ``length`` lowest bits of a number, the lowest first, as a string of 0 and 1."""
    return F.reverse(F.lpad(F.substring(F.bin(n), -length, length), length, "0"))


def byte_code(n: Column) -> Column:
    """One byte as eight bits, the lowest first."""
    return word_code(n.bitwiseAND(255), 8)


def delta_code(n: Column) -> Column:
    """Elias' delta code of n >= 1: the gamma code of the length, then the bits below the leading one."""
    b = F.bin(n)
    return F.when(n >= 1, F.concat(gamma_code(F.length(b).cast("long")), F.substring(b, 2, 64)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def lcp_array(texts: pd.Series, suffixes: pd.Series) -> pd.Series:
    """Length of the prefix that each suffix, in order, shares with the one before; 0 for the first."""

    def shared(t: str, order) -> list[int]:
        n, out, h = len(t), [0] * len(t), 0
        rank = np.empty(n, int)
        rank[np.asarray(order, int)] = np.arange(n)
        for i in range(n):
            if rank[i] == 0:
                h = 0
                continue
            j = int(order[rank[i] - 1])
            while i + h < n and j + h < n and t[i + h] == t[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(0, h - 1)
        return out

    return pd.Series([shared(t or "", s) for t, s in zip(texts, suffixes)])


def intern(df, column: str):
    """column, id: dense ids from 0 in order of the values. Values are sorted by ranges; only one count a range is read."""
    ranged = df.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(F.col(column)).sortWithinPartitions(column)
    placed = ranged.withColumn("_n", F.monotonically_increasing_id())
    placed = cut(placed)
    part = F.shiftright("_n", 33)
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}
    before, at = {}, 0
    for p in sorted(sizes):
        before[p], at = at, at + sizes[p]
    if not before:
        return placed.select(column, F.col("_n").alias("id"))
    starts = F.create_map(*[v for p, n in before.items() for v in (F.lit(p), F.lit(n))])
    return placed.select(column, (F.element_at(starts, part) + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("id"))
