"""Bursts of keywords: documents and hits in batches of positions, and a two-state automaton over a window of batches."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Keywords that one plan tests as literals; more are taken in parts of this size.
PART = 500


def holds(text: Column, keyword: Column | str) -> Column:
    """Whether a text contains a keyword; a null text does not."""
    return F.coalesce(text.contains(keyword), F.lit(False))


def batch_counts(documents: DataFrame, keywords: DataFrame, interval: float) -> DataFrame:
    """keyword, batch, d (documents), r (documents that hold the keyword), also for r = 0.

    Only hits are shuffled, after a partial count, never documents times keywords. Keywords are settings and read to the driver.
    """
    batch = F.floor(F.col("pos") / interval).alias("batch")
    words = sorted(r[0] for r in keywords.select("keyword").distinct().collect())
    parts = []
    for at in range(0, max(1, len(words)), PART):
        every = F.array(*[F.lit(w) for w in words[at : at + PART]]).cast("array<string>")
        held = F.filter(every, lambda w: holds(F.col("text"), w))
        # the empty name stands for the document itself
        named = documents.select(batch, F.explode(F.concat(F.array(F.struct(F.lit(True).alias("all"), F.lit("").alias("w"))), F.transform(held, lambda w: F.struct(F.lit(False).alias("all"), w.alias("w"))))).alias("h"))
        counted = named.groupBy("batch", "h").agg(F.count("*").alias("n"))
        of_batch = counted.groupBy("batch").agg(F.max(F.when(F.col("h.all"), F.col("n"))).alias("d"), F.map_from_entries(F.collect_list(F.when(~F.col("h.all"), F.struct("h.w", "n")))).alias("m"))
        parts.append(of_batch.select(F.explode(every).alias("keyword"), "batch", "d", "m").select("keyword", "batch", "d", F.coalesce(F.element_at("m", F.col("keyword")), F.lit(0)).cast("long").alias("r")))
    return reduce(DataFrame.unionByName, parts)


def place(arrivals: DataFrame, interval: float, size: int) -> DataFrame:
    """batch, cutoff, starts for documents (seq, pos) in order of seq: overlapping windows of ``size`` batches.

    A window opens when a document lies at or over the end of the newest one, so that its batch is number size // 2 of the
    new window. Documents before the newest window's start are late: those of a batch from seq ``cutoff`` on (null: none).
    ``starts`` are the windows that hold the batch. One task folds one row for each occupied batch, not the documents.
    """
    if size < 2:
        raise ValueError("window_batch_size must be at least 2")

    def fold(batches):
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("first", kind="stable")
        starts, opened = [], []
        for b, first in zip(pdf["batch"].tolist(), pdf["first"].tolist()):
            if not starts or b >= starts[-1] + size:
                starts.append(b - size // 2)
                opened.append(first)
        own = pdf["batch"].to_numpy()
        after = np.searchsorted(starts, own, side="right")  # windows from here on begin after the batch
        from_ = np.searchsorted(starts, own - size, side="right")
        pdf["cutoff"] = pd.array([opened[k] if k < len(opened) else None for k in after], "Int64")
        pdf["starts"] = [starts[lo:hi] for lo, hi in zip(from_, after)]
        yield pdf[["batch", "cutoff", "starts"]]

    firsts = arrivals.groupBy(F.floor(F.col("pos") / interval).alias("batch")).agg(F.min("seq").cast("long").alias("first"))
    return firsts.coalesce(1).mapInPandas(fold, "batch long, cutoff long, starts array<long>")


def on_time(documents: DataFrame, placed: DataFrame, interval: float) -> DataFrame:
    """The documents that a window takes."""
    late = placed.filter("cutoff IS NOT NULL").select("batch", "cutoff")
    dated = documents.withColumn("batch", F.floor(F.col("pos") / interval))
    return dated.join(late, "batch", "left").filter("cutoff IS NULL OR seq < cutoff").select(*documents.columns)


def windowed(counts: DataFrame, placed: DataFrame) -> DataFrame:
    """keyword, start, batch, d, r: the counts of each window's occupied batches."""
    return counts.join(placed.select("batch", F.explode("starts").alias("start")), "batch").select("keyword", "start", "batch", "d", "r")


def overlap(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """a_start, b_start, begin, end: batches that windows (start) of two sets share; an equi-join on blocks of ``size``."""
    block = lambda c: F.explode(F.sequence(F.floor(F.col(c) / size), F.floor((F.col(c) + size - 1) / size)))
    left = a.select(F.col("start").alias("a_start")).distinct().withColumn("block", block("a_start"))
    right = b.select(F.col("start").alias("b_start")).distinct().withColumn("block", block("b_start"))
    near = left.join(right, "block").filter(F.abs(F.col("a_start") - F.col("b_start")) < size)
    return near.select("a_start", "b_start", F.greatest("a_start", "b_start").alias("begin"), (F.least("a_start", "b_start") + size).alias("end")).distinct()


def detect(d: list[float], r: list[float], scaling: float, gamma: float, reuse: list[float] = (), costcut: float = -1.0) -> list[float]:
    """Weight of each batch: what the burst state saves over the base state where the cheapest path bursts. The first
    len(reuse) batches keep their weights. With a ``costcut`` of 0 or more, a batch whose burst path costs more than that
    over the base path comes from the base state."""
    n = len(d)
    weights = [*reuse[:n], *[0.0] * (n - len(reuse))]
    total, hits = sum(d), sum(r)
    p0 = hits / total if total else 0.0
    p1 = p0 * scaling
    if p0 == 0:
        return weights
    if p1 > 1:
        return [*reuse[:n], *[math.inf] * (n - len(reuse))]

    def cost(i: int, p: float) -> float:
        missed = d[i] - r[i]
        return -(r[i] * math.log(p) if r[i] else 0.0) - (0.0 if missed == 0 else missed * math.log(1 - p) if p < 1 else -math.inf)

    up = gamma * math.log(n) if n > 1 else 0.0
    bursting = bool(reuse) and reuse[-1] > 0
    base, burst = (math.inf, 0.0) if bursting else (0.0, math.inf)
    back: list[tuple[int, int]] = []
    for i in range(len(reuse), n):
        to_burst = 0 if base + up < burst or 0 <= costcut < burst - base else 1
        to_base = 1 if burst < base and d[i] > 0 else 0
        back.append((to_base, to_burst))
        base, burst = (burst if to_base else base) + cost(i, p0), (burst if to_burst else base + up) + cost(i, p1)
    state = 1 if burst < base else 0
    for i in range(n - 1, len(reuse) - 1, -1):
        if state == 1:
            weights[i] = max(0.0, cost(i, p0) - cost(i, p1))
        state = back[i - len(reuse)][state]
    return weights


def window_bursts(counts: DataFrame, settings: DataFrame) -> DataFrame:
    """keyword, batch, weight for one window of batches; a keyword's batches are bounded by the window."""

    def run(key: tuple, pdf):
        pdf = pdf.sort_values("batch")
        pdf["weight"] = detect(pdf["d"].tolist(), pdf["r"].tolist(), float(pdf["scaling"].iloc[0]), float(pdf["gamma"].iloc[0]))
        return pdf[["keyword", "batch", "weight"]]

    return counts.join(settings, "keyword").groupBy("keyword").applyInPandas(run, "keyword string, batch long, weight double")


def results(windows: DataFrame, settings: DataFrame, size: int, reuse: int = 0, costcut: float = -1.0) -> DataFrame:
    """keyword, start, batch, d, r, weight of all ``size`` batches of each window, from windowed(). The first ``reuse``
    batches at most that a window shares with the keyword's window before keep that window's weights."""

    kind = "keyword string, start long, batch long, d long, r long, weight double"

    def weigh(pdf: pd.DataFrame, before: dict) -> dict:
        """One window's rows as columns; ``before`` has the weights of the window before, and gets this one's."""
        keyword, start = pdf["keyword"].iloc[0], int(pdf["start"].iloc[0])
        d, r = np.zeros((2, size), np.int64)
        at = pdf["batch"].to_numpy(np.int64) - start
        held = (at >= 0) & (at < size)
        d[at[held]], r[at[held]] = pdf["d"].to_numpy()[held], pdf["r"].to_numpy()[held]
        kept = []
        for b in range(start, start + min(reuse, size)):
            if b not in before:
                break
            kept.append(before[b])
        weights = detect(d.tolist(), r.tolist(), float(pdf["scaling"].iloc[0]), float(pdf["gamma"].iloc[0]), kept, costcut)
        before.clear()
        before.update(zip(range(start, start + size), weights))
        return {"keyword": [keyword] * size, "start": [start] * size, "batch": list(range(start, start + size)), "d": d.tolist(), "r": r.tolist(), "weight": weights}

    def run(batches):
        """Windows stream by in order; one window and a thousand results are held."""
        out, own, last, before = {n: [] for n in names}, [], None, {}

        def close():
            nonlocal own
            if own:
                for n, x in weigh(pd.concat(own), before).items():
                    out[n].extend(x)
            own = []

        for pdf in batches:
            place = pd.MultiIndex.from_frame(pdf[["keyword", "start"]])
            edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(pdf) else []
            for lo, hi in zip(edge, [*edge[1:], len(pdf)]):
                if place[lo] != last:
                    close()
                    if last is None or place[lo][0] != last[0]:
                        before.clear()
                    last = place[lo]
                own.append(pdf.iloc[lo:hi])
                if len(out["keyword"]) >= 4096:
                    yield pd.DataFrame(out)
                    out = {n: [] for n in names}
        close()
        yield pd.DataFrame(out)

    names = ["keyword", "start", "batch", "d", "r", "weight"]
    # without reuse the windows are independent, so a keyword's windows need not share a task
    keys = ["keyword"] if reuse else ["keyword", "start"]
    return windows.join(settings, "keyword").repartition(*keys).sortWithinPartitions("keyword", "start").mapInPandas(run, kind)


def bursted_at(found: DataFrame, batch: int) -> DataFrame:
    """Keywords that burst at a batch, by the newest window that holds it."""
    newest = found.filter(F.col("batch") == batch).groupBy("keyword").agg(F.max_by("weight", "start").alias("weight"))
    return newest.filter("weight > 0").select("keyword")


def merge_results(found: DataFrame) -> DataFrame:
    """Of results of the same keyword and window (column shard tells them apart) the one with the most documents."""
    most = found.groupBy("keyword", "start", "shard").agg(F.sum("d").alias("all")).groupBy("keyword", "start").agg(F.min_by("shard", F.struct(-F.col("all"), F.col("shard"))).alias("shard"))
    return found.join(most, ["keyword", "start", "shard"], "left_semi").drop("shard")


def bursted(weights: DataFrame) -> DataFrame:
    """Keywords whose last batch bursts."""
    return weights.groupBy("keyword").agg(F.max_by("weight", "batch").alias("last")).filter("last > 0").select("keyword")
