"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands propose pairs, exact sets decide.

Rows that share a band's values share a bucket. First each row is compared with its buckets' first rows, which joins the
copies of one text without pairing them with each other. Buckets that are not of one component then are gone through
again: each row outside the first row's component is compared with all rows of the bucket, in cells of at most about HOMES
such rows and COPIES of the bucket's, each a task's work of its own. Sketches pick the pairs, exact sets decide, and a pair that is joined already
is skipped. So no pair of a bucket is left out, whatever the bucket's size; two rows of similarity 0.8 share no bucket with
a probability of 0.001, and their sketches differ too much with one of 0.0003.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.common import PIECE, Workspace, column, map_batches, unused
from fluxloom.llm.simhash import SEED, components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, VALUES = 14, 4
#: Rows of a bucket that one cell holds, and rows that stream by.
HOMES, COPIES = 512, 4096
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * VALUES)).astype(np.uint64)


def shingles(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of UTF-8 text's shingles, ascending; fewer words than a shingle are one."""
    found = text.lower().split()
    joined = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[k:] for k in range(words))))
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least value of each drawn permutation."""
    least = np.full(BANDS * VALUES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 8192):
        least = np.minimum(least, (hashes[k : k + 8192, None] * (_DRAWN[0] | np.uint64(1)) + _DRAWN[1]).min(0))
    return least


def buckets(least: np.ndarray) -> np.ndarray:
    """A key for each band."""
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, VALUES))], np.uint64)


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two ascending sets are at least so similar."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _proposed(words: int):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [buckets(sketch(shingles(x.as_py() or b"", words))) for x in batch.column(1)]
            keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "row"])

        return step

    return make


def _similar(words: int, similarity: float):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept = [alike(*(shingles(t.as_py() or b"", words) for t in pair), similarity) for pair in zip(batch.column(2), batch.column(3))]
            return batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

        return step

    return make


def _sets(words: int):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingles(x.as_py() or b"", words) for x in batch.column(1)]
            drawn = [(sketch(x) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for x in found]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(drawn, pa.binary())], ["row", "hashes", "sketch"])

        return step

    return make


class _Cell:
    """The homes of one cell, and the components that are known in it."""

    def __init__(self, key: list | None = None):
        self.key, self.row, self.root, self.sketch, self.hashes, self.over = key, [], [], [], [], {}

    def top(self, root: int) -> int:
        while root in self.over:
            root = self.over[root]
        return root


def _cells(similarity: float):
    """Over batches sorted by cell (bucket, part, block), homes first: key, part, block, home, row, root, hashes, sketch."""
    # a count that a pair of this similarity reaches but with a chance of 0.0003
    n = BANDS * VALUES
    enough = similarity * n - 3.6 * np.sqrt(n * similarity * (1 - similarity))

    def make():
        cell = _Cell()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            nonlocal cell
            found: list[tuple[int, int]] = []
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            rows, roots = (batch.column(k).to_pylist() for k in (4, 5))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at] and end - at < 256:
                    end += 1
                *name, home = keys[at]
                if cell.key != name:
                    cell = _Cell(name)
                hashes = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(6).slice(at, end - at)]
                sketches = np.array([np.frombuffer(x.as_py(), np.uint16) for x in batch.column(7).slice(at, end - at)])
                if home:
                    cell.row += rows[at:end]
                    cell.root += roots[at:end]
                    cell.sketch += list(sketches)
                    cell.hashes += hashes
                elif cell.row:
                    held = np.array(cell.sketch)
                    agree = np.zeros((len(held), end - at), np.uint8)
                    for j in range(n):
                        agree += held[:, j, None] == sketches[None, :, j]
                    for h, c in zip(*(x.tolist() for x in np.nonzero(agree >= enough))):
                        a, b = cell.top(cell.root[h]), cell.top(roots[at + c])
                        if a != b and alike(cell.hashes[h], hashes[c], similarity):
                            cell.over[a] = b
                            found.append((cell.row[h], rows[at + c]))
                at = end
            if not found:
                return None
            u, v = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        return step

    return make


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds to rows (row) the root of its component, itself if it has no links."""
    return rows.join(roots.select(F.col("node").alias("row"), "root"), "row", "left").withColumn("root", F.coalesce("root", "row"))


def similar_rows(ws: Workspace, texts: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY, homes_held: int = HOMES, copies_held: int = COPIES) -> DataFrame:
    """node, root (the smallest row that it is linked with) of each row but the roots, for texts (row long, text binary)."""
    proposed = ws.save(map_batches(texts, _proposed(words), "key long, row long", PIECE), "proposed")
    firsts = ws.save(proposed.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1"), "firsts")
    members = ws.save(proposed.join(firsts, "key"), "members")
    ws.drop("proposed")
    pairs = ws.save(members.filter("row <> first").select("row", "first").distinct(), "pairs")
    one = ws.save(pairs.join(texts, "row").select("row", "first", F.col("text").alias("a")), "one")
    other = ws.save(texts.select(F.col("row").alias("first"), F.col("text").alias("b")).join(pairs.select("first").distinct(), "first", "left_semi"), "other")
    both = one.join(other, "first").select(F.col("row").alias("u"), F.col("first").alias("v"), "a", "b")
    linked = ws.save(map_batches(both, _similar(words, similarity), "u long, v long", PIECE), "linked")
    ws.drop("one", "other", "pairs")
    roots = ws.save(components(ws, linked), "roots")
    # buckets of two rows are decided; of the others those that are of several components are gone through
    rooted = ws.save(_rooted(members.filter("n > 2").select("key", "row"), roots), "rooted")
    ws.drop("members")
    open_ = rooted.groupBy("key").agg(F.min_by("root", "row").alias("main"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key", "main")
    cells = ws.save(rooted.join(open_, "key").select("key", "row", "root", (F.col("root") != F.col("main")).alias("home")), "open")
    if cells.isEmpty():
        return roots
    sets = ws.save(map_batches(texts.join(cells.select("row").distinct(), "row", "left_semi"), _sets(words), "row long, hashes binary, sketch binary", PIECE), "sets")
    many = cells.groupBy("key").agg(F.ceil(F.sum(F.col("home").cast("long")) / homes_held).cast("int").alias("parts"), F.ceil(F.count("*") / copies_held).cast("int").alias("blocks"))
    dealt = cells.join(ws.save(many, "parts"), "key")
    own = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    homes = dealt.filter("home").select("key", own("parts").alias("part"), every("blocks").alias("block"), F.lit(True).alias("home"), "row", "root")
    copies = dealt.select("key", every("parts").alias("part"), own("blocks").alias("block"), F.lit(False).alias("home"), "row", "root")
    dealt = homes.unionByName(copies).join(sets, "row").select("key", "part", "block", "home", "row", "root", "hashes", "sketch")
    dealt = dealt.repartition("key", "part", "block").sortWithinPartitions("key", "part", "block", F.desc("home"))
    further = ws.save(map_batches(dealt, _cells(similarity), "u long, v long", PIECE), "further")
    ws.drop("rooted", "open", "sets", "parts")
    return components(Workspace(ws.spark, "similar-further"), linked.unionByName(further))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, similarity: float = SIMILARITY, homes_held: int = HOMES, copies_held: int = COPIES) -> DataFrame:
    """One row of each component of similar texts, with all its columns, whatever their names: of the smallest id, a null
    id last, and of several with that id the first read.

    A-Z are lower-cased and words split at ASCII white space; null, empty and blank texts are equal, and a text of fewer
    words than a shingle is one shingle. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "similar")
    (row,) = unused(docs, "_row")
    rows = ws.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(row).alias("row"), column(text_col).cast("string").cast("binary").alias("text"))
    roots = ws.save(similar_rows(ws, texts, words, similarity, homes_held), "all-roots")
    named = rows.select(F.col(row).alias("row"), F.struct(column(id_col).isNull().alias("unnamed"), column(id_col).alias("id"), F.col(row).alias("row")).alias("at"))
    members = roots.select(F.col("node").alias("row"), "root").unionByName(roots.select(F.col("root").alias("row"), "root").distinct())
    members = ws.save(members.join(named, "row"), "in-components")
    kept = members.groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.row").alias("row"))
    gone = ws.save(members.select("row").join(kept, "row", "left_anti").select(F.col("row").alias(row)), "gone")
    return rows.join(gone, row, "left_anti").select(*map(column, docs.columns))
