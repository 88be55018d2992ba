"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits. Anchors are the words of a covering code: of each 23 bits of the first 46 the perfect binary
Golay code (covering radius 3), so 2^24 anchors. A fingerprint's home is the one anchor within the covering radius in
either half. It is copied to every anchor that lies, over the radius, no further than the threshold in both halves
together: if two fingerprints differ in at most the threshold's bits, the home of either holds a copy of the other.
At each anchor the homes are compared with the copies, and only a spanning forest of the links found goes on. Anchors with
many homes are dealt out in parts of bounded size, each of which gets all copies.

The forest's components are found by alternating large-star and small-star steps over written tables.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.common import PIECE, Workspace, column, id_type, map_batches, unused

SHINGLE = 3
THRESHOLD = 2
SEED = 42
_BITS, _CHECK = 23, 11
_GENERATOR = 0b101011100011  # of the Golay code: x^11+x^9+x^7+x^6+x^5+x+1
#: Homes of one anchor that one task holds at a time.
HOMES = 4096
#: Pairs of fingerprints that are looked at in one go; all of a dense block may be links.
PAIRS = 1 << 18


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """Of UTF-8 text; bit k is set if it is in over half of the shingles' hashes."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[k:] for k in range(words)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(x.as_py() or b"", words) for x in batch.column(1)], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

        return step

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(cast(`{text_col}` AS string) AS binary) AS text")
    return map_batches(rows, make, f"doc_id {id_type(rows, 'doc_id')}, fp long", PIECE)


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    rest = words.astype(np.int64)
    for bit in range(_BITS - 1, _CHECK - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (_GENERATOR << (bit - _CHECK)), rest)
    return rest


@functools.lru_cache(1)
def error_patterns(most: int = 5) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each excess over the radius 3 (0, 1, ...): where each syndrome's patterns begin, and the patterns."""
    by_excess: list[list[int]] = [[] for _ in range(most - 2)]
    for weight in range(most + 1):
        for bits in combinations(range(_BITS), weight):
            by_excess[max(0, weight - 3)].append(sum(1 << b for b in bits))
    starts, patterns = [], []
    for found in by_excess:
        own = np.array(found, np.int64)
        s = syndromes(own)
        order = np.argsort(s, kind="stable")
        starts.append(np.searchsorted(s[order], np.arange((1 << _CHECK) + 1)))
        patterns.append(own[order])
    return starts, patterns


def covering(fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, anchors, and whether the anchor is the row's home, for unsigned fingerprints."""
    starts, patterns = error_patterns(3 + threshold)
    half = [(fp >> np.uint64(k * _BITS) & np.uint64((1 << _BITS) - 1)).astype(np.int64) for k in (0, 1)]
    which = [syndromes(h) for h in half]
    rows, anchors, home = [], [], []
    for a in range(threshold + 1):
        for b in range(threshold + 1 - a):
            low = [starts[e][w] for e, w in ((a, which[0]), (b, which[1]))]
            many = [starts[e][w + 1] - lo for e, w, lo in ((a, which[0], low[0]), (b, which[1], low[1]))]
            each = many[0] * many[1]
            row = np.repeat(np.arange(len(fp)), each)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            first = half[0][row] ^ patterns[a][low[0][row] + nth // many[1][row]]
            second = half[1][row] ^ patterns[b][low[1][row] + nth % many[1][row]]
            rows.append(row)
            anchors.append(first | second << _BITS)
            home.append(np.full(len(row), a == b == 0))
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(home)


def _anchored(fps: DataFrame, threshold: int, homes_only: bool) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = batch.column(0).to_numpy().view(np.uint64)
            row, anchor, home = covering(fp, 0 if homes_only else threshold)
            return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

        return step

    return map_batches(fps.select("fp"), make, "anchor long, fp long, home boolean", PIECE)


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes is linked with."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, left, root[right])
        np.minimum.at(new, right, root[left])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _spanning(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, each end with its root."""
    ends, which = np.unique(np.concatenate([left, right]), return_inverse=True)
    root = ends[_roots(len(ends), which[: len(left)], which[len(left) :])]
    return ends[ends != root], root[ends != root]


def _forest(homes: np.ndarray, copies: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of other fingerprints within the threshold, as a spanning forest of each block of copies."""
    out, wide = [], min(1024, max(1, PAIRS // max(1, len(homes))))
    for k in range(0, len(copies), 1024):
        block = []
        for j in range(k, min(k + 1024, len(copies)), wide):
            part = copies[j : min(j + wide, k + 1024)]
            h, c = np.nonzero(np.bitwise_count(homes[:, None] ^ part[None, :]) <= threshold)
            apart = homes[h] != part[c]
            if apart.any():
                block.append(_spanning(homes[h[apart]], part[c[apart]]))
        if block:
            out.append(block[0] if len(block) == 1 else _spanning(*(np.concatenate(x) for x in zip(*block))))
    return out


def _linker(threshold: int):
    """Over batches sorted by anchor and part, homes first. A cell's homes are held (at most HOMES), its copies stream."""

    def make():
        last: dict = {"key": None, "homes": np.zeros(0, np.uint64)}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            anchor, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fp, home = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False)
            if not len(fp):
                return None
            low = np.concatenate([[0], np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1])
            high = np.append(low[1:], len(fp))
            goes_on = (int(anchor[0]), int(part[0])) == last["key"] and len(last["homes"]) > 0
            work = (np.add.reduceat(home.astype(np.int64), low) > 0) & (high - low > 1)
            work[0] |= goes_on
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for k in np.flatnonzero(work).tolist():
                rows = slice(low[k], high[k])
                homes = fp[rows][home[rows]]
                if k == 0 and goes_on:
                    homes = np.concatenate([last["homes"], homes])
                found += _forest(homes, fp[rows], threshold)
            rows = slice(low[-1], high[-1])
            kept = fp[rows][home[rows]]
            if len(low) == 1 and goes_on:
                kept = np.concatenate([last["homes"], kept])
            last["key"], last["homes"] = (int(anchor[-1]), int(part[-1])), kept
            if not found:
                return None
            u, v = (np.concatenate([x[k] for x in found]).view(np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        return step

    return make


def links(ws: Workspace, fps: DataFrame, threshold: int = THRESHOLD, homes_held: int = HOMES) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that join all that are within the threshold of each other."""
    every = _anchored(fps, threshold, False)
    many = ws.save(_anchored(fps, threshold, True).groupBy("anchor").count().filter(f"count > {homes_held}").selectExpr("anchor", f"cast(ceil(count / {homes_held}) AS int) AS parts"), "crowded")
    if many.isEmpty():
        cells = every.select("anchor", F.lit(0).alias("part"), "fp", "home")
    else:
        dealt = every.join(many, "anchor", "left").withColumn("own", F.expr("pmod(xxhash64(fp), coalesce(parts, 1))"))
        cells = dealt.select("anchor", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")).alias("part"), "fp", "home", "own").selectExpr("anchor", "part", "fp", "home AND own = part AS home")
    cells = cells.repartition("anchor", "part").sortWithinPartitions("anchor", "part", F.desc("home"))
    return map_batches(cells, _linker(threshold), "u long, v long")


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it is linked with), of each node but the roots, for edges u, v."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())

    edges = ws.save(edges.filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "edges0")
    was, turn = None, 0
    while (now := state(edges)) != was:
        was, turn = now, turn + 1
        # large star: larger neighbours go to the smallest one
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        least = ws.save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"least{turn}a")
        larger = edges.selectExpr("v AS u", "u AS v").join(least, "u").selectExpr("v AS u", "m AS v").distinct()
        larger = ws.save(larger, f"edges{turn}a")
        # small star: smaller neighbours and the node itself go to the smallest one
        least = ws.save(larger.groupBy("u").agg(F.min("v").alias("m")), f"least{turn}b")
        smaller = larger.join(least, "u").filter("v <> m").selectExpr("v AS u", "m AS v").unionByName(least.selectExpr("u", "m AS v"))
        edges = ws.save(smaller.distinct(), f"edges{turn}b")
        ws.drop(f"least{turn}a", f"least{turn}b", f"edges{turn}a", "edges0" if turn == 1 else f"edges{turn - 1}b")
    return edges.selectExpr("u AS node", "v AS root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, threshold: int = THRESHOLD, homes_held: int = HOMES) -> DataFrame:
    """Per row: doc_id, fp, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links).

    A-Z are lower-cased; words are split at ASCII white space; fewer words than a shingle are one shingle; null, empty
    and blank texts have fingerprint zero, which is linked like any other. Null ids are left out of the smallest id (a
    component of none but such rows has a null id); repeated rows are rows of one component. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    rows = ws.save(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = ws.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(ws, links(ws, nodes, threshold, homes_held))
    rooted = ws.save(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = ws.save(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = ws.save(rooted.join(smallest, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component, with all its columns, whatever their names: of the smallest id, and of several with that
    id the first read.

    Rows go by their own numbers, not by ids, so null and repeated ids take no other rows with them; a null id comes last.
    Null, empty and blank texts are of one component. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "one-of-each")
    (row,) = unused(docs, "_row")
    rows = ws.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    named = rows.select(F.struct(column(id_col).isNull().alias("unnamed"), column(id_col).alias("id"), F.col(row).alias("row")).alias("key"), column(text_col).alias("text"))
    found = near_duplicates(named, "key", "text", words, threshold)
    gone = found.filter("doc_id.row <> component_id.row").select(F.col("doc_id.row").alias(row))
    return rows.join(gone, row, "left_anti").select(*map(column, docs.columns))
