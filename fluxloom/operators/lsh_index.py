"""An index of buckets for nearest neighbours by Euclidean distance: random projections, cut into cells of a fixed width,
name one bucket a table; queries look into their own buckets and, in order of closeness, into those around."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.lineage import cut
from fluxloom.operators import similarity as S

MIX = np.uint64(0x9E3779B97F4A7C15)


def offsets(n: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).uniform(0, 1, n)


def bucket(cells: np.ndarray) -> np.ndarray:
    """One 64-bit name of each row of cell numbers; equal cells have equal names."""
    name = np.zeros(len(cells), np.uint64)
    with np.errstate(over="ignore"):
        for column in cells.T.astype(np.int64).view(np.uint64):
            name = S.mix64(name * MIX + column)
    return name.view(np.int64)


def perturbations(rest: np.ndarray, most: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """The ``most`` cheapest moves (table, ((hash, -1 or 1), ...)) of a query with places ``rest`` (tables x hashes, 0 to 1)
    within its cells. A move costs the squared distances to the borders that it crosses; own buckets cost nothing."""
    order = []
    for t, row in enumerate(rest):
        steps = sorted([(x * x, i, -1) for i, x in enumerate(row)] + [((1 - x) ** 2, i, 1) for i, x in enumerate(row)])
        order.append(steps)
    heap = [(order[t][0][0], t, (0,)) for t in range(len(rest))]
    heapq.heapify(heap)
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    while heap and len(found) < most:
        cost, t, picked = heapq.heappop(heap)
        steps, last = order[t], picked[-1]
        if last + 1 < len(steps):
            step = steps[last + 1][0]
            heapq.heappush(heap, (cost - steps[last][0] + step, t, (*picked[:-1], last + 1)))
            heapq.heappush(heap, (cost + step, t, (*picked, last + 1)))
        moves = tuple((steps[p][1], steps[p][2]) for p in picked)
        if len({i for i, _ in moves}) == len(moves):
            found.append((t, moves))
    return found


def index(rows: DataFrame, hashes: int = 4, tables: int = 4, width: float = 1.0, bits: int = 64, seed: int = 0, probes: int = 0) -> DataFrame:
    """row_id, bits, norm, buckets (array of struct table, name); ``probes`` adds the buckets of that many moves."""
    n, shift = hashes * tables, offsets(hashes * tables, seed)

    def sign(names, values, first):
        x = S.project(names, values, first, max(n, bits))
        place = x[:, :n] / width + shift
        cells = np.floor(place).astype(np.int64).reshape(-1, tables, hashes)
        rest = place.reshape(-1, tables, hashes) - cells
        own = np.stack([bucket(cells[:, t]) for t in range(tables)], 1)
        out = []
        for k in range(len(own)):
            buckets = [{"table": t, "name": int(own[k, t])} for t in range(tables)]
            for t, moves in perturbations(rest[k], probes) if probes else ():
                moved = cells[k, t].copy()
                for i, step in moves:
                    moved[i] += step
                buckets.append({"table": t, "name": int(bucket(moved[None])[0])})
            out.append(buckets)
        return {"bits": S.words(x[:, :bits] > 0), "norm": np.sqrt(np.add.reduceat(values**2, first)), "buckets": pd.Series(out)}

    return S.by_row(rows, sign, "bits array<bigint>, norm double, buckets array<struct<table:int,name:bigint>>")


class InBuckets(S.Scores):
    """Scores of pairs of which the query looks into one of the row's buckets (columns b_table, b_name); others are none."""

    def __init__(self, base: S.Scores):
        self.base = base

    def take(self, table: pa.Table) -> dict:
        tables, names = (table[c].combine_chunks() for c in ("b_table", "b_name"))
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(tables).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return {"base": self.base.take(table), "first": first, "table": tables.flatten().to_numpy(), "name": names.flatten().to_numpy()}

    def part(self, arrays: dict, lo: int, hi: int) -> dict:
        a, b = arrays["first"][lo], arrays["first"][hi]
        return {"base": self.base.part(arrays["base"], lo, hi), "first": arrays["first"][lo : hi + 1] - a, "table": arrays["table"][a:b], "name": arrays["name"][a:b]}

    def of(self, q: dict, r: dict, wide: bool):
        keys, slack, key, exact = self.base.of(q["base"], r["base"], wide)
        seen = np.zeros(keys.shape, bool)
        qi, ri = (np.repeat(np.arange(len(x["first"]) - 1), np.diff(x["first"])) for x in (q, r))
        for t in np.unique(q["table"]):
            asked, held = q["table"] == t, r["table"] == t
            order = np.argsort(r["name"][held], kind="stable")
            names, rows = r["name"][held][order], ri[held][order]
            lo, hi = (np.searchsorted(names, q["name"][asked], side) for side in ("left", "right"))
            for line, a, b in zip(qi[asked].tolist(), lo.tolist(), hi.tolist()):
                seen[line, rows[a:b]] = True
        keys[~seen] = -np.inf
        return keys, slack, key, exact

    def least_scores(self, keys: np.ndarray, key) -> np.ndarray:
        return self.base.least_scores(keys, key)


def neighbours(rows: DataFrame, queries: DataFrame, k: int, hashes: int = 4, tables: int = 4, width: float = 1.0, bits: int = 64, seed: int = 0, probes: int = 16, exact: bool = False) -> DataFrame:
    """query_id, row_id, score (minus the distance), rank. Queries that find fewer than k rows in their buckets are compared
    with all rows instead, so none gets fewer than there are. Distances are those of the signatures, or with ``exact`` of
    the rows themselves. Pairs of a bucket are scored in the blocks of ``in_blocks`` and never listed."""
    indexed, asked = cut(index(rows, hashes, tables, width, bits, seed)), cut(index(queries, hashes, tables, width, bits, seed, probes))
    named = lambda df: df.select("row_id", "bits", "norm", F.col("buckets.table").alias("b_table"), F.col("buckets.name").alias("b_name"))
    held, wanted, base = named(indexed), named(asked), S.Signed(bits, True)
    if exact:
        listed = lambda df, of: df.select("row_id", "b_table", "b_name").join(S.packed(of), "row_id")
        held, wanted, base = listed(held, rows), listed(wanted, queries), S.Sparse("euclidean", zero_rows=True)
    found = cut(S.in_blocks(held, wanted, k, InBuckets(base)))
    enough = found.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
    few = asked.join(enough, F.col("row_id") == F.col("query_id"), "left_anti")
    if exact:
        rest = S.euclidean_scores(rows, queries.join(few.select("row_id"), "row_id", "left_semi"), k=k)
    else:
        rest = S.signature_top_k(indexed, few, k, bits, euclid=True).drop("rank")
    return S.top_k(found.join(enough, "query_id", "left_semi").unionByName(rest), k)
