"""Packing of documents into fixed-length sequences by cutting-stock column generation.

Documents are encoded, closed by an end id and cut at multiples of the sequence length; what remains of each is an item.
The histogram of item lengths (in steps of ``grain`` tokens, rounded up: at most length / grain classes, whatever the
number of documents) is the only thing that reaches the driver. There a linear program over patterns of classes is
solved by column generation: the simplex duals price classes and a knapsack dynamic program finds the next pattern. The
solution's whole parts are used as they are; what is left over, a few patterns' worth, is filled greedily. Items are
ranked within their class and take the places that the patterns hold for their rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxloom.llm.bpe import encoder
from fluxloom.llm.common import PIECE, Workspace, id_type, map_batches

LENGTH = 4096
GRAIN = 8
END_ID = 2


def token_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, length: int, grain: int, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, class (units of grain; of whole sequences length / grain)."""
    end = int(end_id).to_bytes(4, "little")

    def make():
        bpe = encoder(path, by_library=True)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, starts, sizes, crcs, totals = [], [], [], [], []
            for at, text in enumerate(batch.column(1)):
                ids = bpe.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    size = min(length, n - start)
                    rows.append(at)
                    starts.append(start)
                    sizes.append(size)
                    crcs.append(zlib.crc32(memoryview(ids)[4 * start : 4 * (start + size)]))
                    totals.append(n)
            size = np.array(sizes, np.int64)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, sizes, crcs, totals)), pa.array((size + grain - 1) // grain, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"],
            )

        return step

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS text")
    return map_batches(rows, make, f"doc_id {id_type(rows, 'doc_id')}, start long, length long, ids_crc32 long, doc_tokens long, class long", PIECE)


def best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming; sizes ascend. The value and how many of each class."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            value = best[c - sizes[:k]] + prices[:k]
            top = int(value.argmax())
            if value[top] > best[c] + 1e-12:
                best[c], took[c] = value[top], top
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[room]), pattern


def cutting_stock(sizes: np.ndarray, counts: np.ndarray, room: int, rounds: int = 6000, close: float = 3e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many of each class) and how often each is used; together they hold exactly ``counts`` items.

    It ends when the sequences are within ``close`` of the linear program's least (Farley's bound). That and ``rounds``
    bound the column generation, not the items: patterns found so far are feasible at any time.
    """
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(room // sizes).astype(np.int64)
    demand = counts.astype(float)
    inverse = np.diag(1.0 / np.diag(columns))  # of the basis; kept up by rank-one steps
    level = inverse @ demand
    for _ in range(rounds):
        value, pattern = best_pattern(sizes, inverse.sum(0), room)
        if value <= 1 + close:
            break
        rate = inverse @ pattern
        up = rate > 1e-7
        if not up.any():
            break
        out = int(np.where(up, level / np.where(up, rate, 1), np.inf).argmin())
        columns[:, out] = pattern
        step = level[out] / rate[out]
        level = np.maximum(level - step * rate, 0)
        level[out] = step
        row = inverse[out] / rate[out]
        inverse -= np.outer(rate, row)
        inverse[out] = row
    used, left = [], counts.astype(np.int64).copy()
    for k in np.argsort(-level, kind="stable"):
        pattern = columns[:, k]
        n = int(np.floor(level[k] + 1e-6))
        has = pattern > 0
        n = min(n, int((left[has] // pattern[has]).min())) if has.any() else 0
        if n > 0:
            used.append((pattern.copy(), n))
            left -= n * pattern
    while left.any():  # the largest that fits, again and again
        pattern, free = np.zeros(m, np.int64), room
        for k in range(m - 1, -1, -1):
            if left[k] and sizes[k] <= free:
                pattern[k] = min(left[k], free // sizes[k])
                free -= pattern[k] * sizes[k]
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        used.append((pattern, n))
        left -= n * pattern
    return used


class Plan:
    """Which sequence and place the item of each rank in a class gets."""

    def __init__(self, counts: dict[int, int], room: int):
        sizes = np.array(sorted(k for k in counts if k < room), np.int64)
        patterns = cutting_stock(sizes, np.array([counts[int(k)] for k in sizes], np.int64), room)
        spans: dict[int, list[tuple[int, int, int, int]]] = {int(k): [] for k in sizes}
        filled, sequence = dict.fromkeys(spans, 0), 0
        for pattern, n in patterns:
            slot = 0
            for k in np.flatnonzero(pattern)[::-1]:
                size, each = int(sizes[k]), int(pattern[k])
                spans[size].append((filled[size], each, sequence, slot))
                filled[size] += n * each
                slot += each
            sequence += n
        self.spans = {k: np.array(v, np.int64).T for k, v in spans.items()}
        self.room, self.sequences = room, sequence

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = self.sequences + rank, np.zeros(len(rank), np.int64)  # of whole sequences
        for k in np.unique(size[size < self.room]):
            low, each, first, place = self.spans[int(k)]
            at = np.flatnonzero(size == k)
            span = np.searchsorted(low, rank[at], side="right") - 1
            past = rank[at] - low[span]
            sequence[at] = first[span] + past // each[span]
            slot[at] = place[span] + past % each[span]
        return sequence, slot


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, and its end id, lies in exactly one piece; null and empty texts have the end id alone.
    Ids may be null or repeat (each row is a document of its own); other columns are not read. Only documents longer than
    a sequence are cut. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    # a class may hold most of the rows: it is ranked in parts, by hashes of ids and starts
    parts = 8 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = ws.save(token_pieces(docs, path, id_col, text_col, length, grain, end_id).withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts))), "pieces")
    sizes = ws.save(pieces.groupBy("class", "part").agg(F.count("*").alias("n")), "sizes")
    plan = Plan({r[0]: r[1] for r in sizes.groupBy("class").agg(F.sum("n")).collect()}, length // grain)
    before = sizes.select("class", "part", (F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    own = F.row_number().over(Window.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32"))
    ranked = pieces.withColumn("own", own).join(before, ["class", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("own") - 1 + F.coalesce("before", F.lit(0))).alias("rank"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sequence, slot = plan.place(batch.column("class").to_numpy(), batch.column("rank").to_numpy())
            return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(slot)], [*batch.schema.names[:5], "sequence_id", "slot"])

        return step

    placed = map_batches(ranked, make, f"doc_id {id_type(pieces, 'doc_id')}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    in_order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(in_order), F.lit(0))).drop("slot")
