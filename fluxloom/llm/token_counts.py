"""Token counts of documents in flat token files without an index, by a scan for separators.

Files hold token ids (unsigned 16-bit, little-endian), each document's closed by an end-of-document id. They are scanned
in blocks of fixed size, each a task's work of its own, that know nothing of documents: a vectorised search finds the
separators, and gives the gaps between them. What lies before a block's first separator is completed by a prefix scan
over the blocks' summaries (one row a block).
"""

from __future__ import annotations

import base64
import functools
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxloom.llm.common import Workspace, id_type, map_batches, workers_find_us

END_ID = 50256
BLOCK_BYTES = 4 << 20
FILE_BYTES = 512 << 20
WIDTH = 2


@functools.lru_cache(2)
def rank_encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, folder: str, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files and returns doc_id, file, nth (the document's place in its file) and file_ids, the ids in the
    file so far. Save it before use: each evaluation writes files anew."""
    workers_find_us(docs.sparkSession)
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS text")

    def run(batches):
        encoding = rank_encoder(path, pattern)
        filesystem, base = fs.FileSystem.from_uri(folder)
        out, name, nth, held = None, "", 0, 0
        end = np.array([end_id], "<u2").tobytes()
        try:
            for batch in batches:
                files, places, ids_so_far = [], [], []
                for text in batch.column(1):
                    if out is None:
                        filesystem.create_dir(base)
                        name, nth, held = f"tokens-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.bin", 0, 0
                        out = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                    ids = encoding.encode_ordinary(text.as_py() or "")
                    out.write(np.array(ids, "<u2").tobytes() + end)
                    held += len(ids) + 1
                    files.append(name)
                    places.append(nth)
                    ids_so_far.append(held)
                    nth += 1
                    if held * WIDTH >= file_bytes:
                        out.close()
                        out = None
                if files:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files), pa.array(places, pa.int64()), pa.array(ids_so_far, pa.int64())], ["doc_id", "file", "nth", "file_ids"])
        finally:
            if out is not None:
                out.close()

    return rows.mapInArrow(run, f"doc_id {id_type(rows, 'doc_id')}, file string, nth long, file_ids long")


def scan_block(ids: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, int]:
    """Ids before each separator since the one before (or the block's start), and ids after the last."""
    at = np.flatnonzero(ids == end_id)
    return np.diff(at, prepend=-1) - 1, len(ids) - 1 - int(at[-1]) if len(at) else len(ids)


def scan_tokens(ws: Workspace, files: DataFrame, folder: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, nth, n_tokens for each document of the files (file, bytes)."""
    blocks = files.select("file", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0), {block_bytes}L)")).alias("start"), "bytes")
    blocks = blocks.selectExpr("file", f"start div {block_bytes} AS block", "start", f"least(bytes - start, {block_bytes}) AS size").repartition("file", "block")

    def make():
        filesystem, base = fs.FileSystem.from_uri(folder)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            files, numbers, starts, sizes = (batch.column(k).to_pylist() for k in range(4))
            found = []
            for file, start, size in zip(files, starts, sizes, strict=True):
                with filesystem.open_input_file(f"{base}/{file}") as source:
                    found.append(scan_block(np.frombuffer(source.read_at(size, start), "<u2"), end_id))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g for g, _ in found], pa.list_(pa.int64())), pa.array([t for _, t in found], pa.int64())], ["file", "block", "gaps", "tail"]) if found else None

        return step

    scanned = ws.save(map_batches(blocks, make, "file string, block long, gaps array<bigint>, tail long"), "scanned")
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    summary = scanned.select("file", "block", F.size("gaps").cast("long").alias("n"), "tail")
    # ids since the last separator, at each block's end
    since = summary.withColumn("run", F.sum(F.expr("if(n > 0, 1, 0)")).over(in_file)).withColumn("open", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block")))
    carry = since.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.lag("open").over(in_file), F.lit(0)).alias("carried"))
    gaps = scanned.select("file", "block", F.posexplode("gaps").alias("k", "gap"))
    return gaps.join(carry, ["file", "block"]).selectExpr("file", "base + k AS nth", "gap + if(k = 0, carried, 0) AS n_tokens")


def token_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_bytes: int = BLOCK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Per row: doc_id, n_tokens (without the end id), from files written of the whole texts.

    Null and empty texts have no tokens. Ids may be null or repeat: each row is a document of its own. Other columns are
    not read. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "token-counts")
    folder = f"{ws.path}/tokens"
    written = ws.save(write_tokens(docs, folder, path, pattern, id_col, text_col, end_id, file_bytes), "written")
    files = written.groupBy("file").agg((F.max("file_ids") * WIDTH).alias("bytes"))
    counts = scan_tokens(ws, files, folder, end_id, block_bytes)
    return written.join(counts, ["file", "nth"]).select("doc_id", "n_tokens")
