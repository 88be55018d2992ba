"""Exact deduplication by deterministic block naming (prefix-doubling names over fixed-size blocks).

Every normalised text is cut into blocks of ``block_bytes`` bytes. The distinct blocks are sorted and numbered; then
adjacent names of a document are paired, the distinct pairs are sorted and numbered, and so on until each document has
one name. Documents with as many rounds and the same name are equal texts: names are numbers of distinct contents, so
no two contents share one.

A 64-bit hash stands for each block: blocks are sorted by it, and routed to their names. The distinct blocks themselves
are compared (they are the grouping key), and if two of them share a hash, blocks are sorted and looked up themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxloom.llm.common import Workspace, ascii_lower, column, unused

BLOCK_BYTES = 4096


def _blocks(block_bytes: int) -> str:
    count = f"greatest(1, ceil(octet_length(t) / {block_bytes}))"
    return f"transform(sequence(0L, {count} - 1), i -> substring(cast(t AS binary), cast(i * {block_bytes} + 1 AS int), {block_bytes}))"


def _named(ws: Workspace, distinct: DataFrame, table: str, *keys: str) -> DataFrame:
    """Integer names of distinct rows: their places in sorted order, whatever partitions they lie in."""
    ordered = distinct.orderBy(*keys).select(*keys, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    ordered = ws.save(ordered, f"{table}-ordered")
    # one row a partition
    sizes = ordered.groupBy("p").agg(F.count("*").alias("n"))
    before = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    named = ordered.join(F.broadcast(before), "p").select(*keys, (F.col("before") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("name"))
    named = ws.save(named, table)
    ws.drop(f"{table}-ordered")
    return named


def document_names(ws: Workspace, docs: DataFrame, id_col: str, text_col: str, block_bytes: int, routing_bits: int) -> DataFrame:
    """One row per row of docs: row, doc_id, text_sha256, level, name. (level, name) is equal for equal texts only."""
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    mask = -1 if routing_bits >= 64 else (1 << routing_bits) - 1
    hashed = f"transform({_blocks(block_bytes)}, b -> xxhash64(b) & {mask}L)"
    seen = ws.save(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), F.expr(hashed).alias("hashes")), "seen")
    distinct = base.select(F.explode(F.expr(_blocks(block_bytes))).alias("block")).distinct().select(F.expr(f"xxhash64(block) & {mask}L").alias("h"))
    names = _named(ws, distinct, "names0", "h")
    whole = ["row", "doc_id", "text_sha256"]
    if names.groupBy("h").count().filter("count > 1").isEmpty():
        pieces = seen.select(*whole, F.size("hashes").cast("long").alias("n"), F.posexplode("hashes").alias("at", "h"))
        current = pieces.join(names, "h")
    else:
        full = ws.save(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), F.expr(_blocks(block_bytes)).alias("blocks")), "full")
        pieces = full.select(*whole, F.size("blocks").cast("long").alias("n"), F.posexplode("blocks").alias("at", "block"))
        current = pieces.join(_named(ws, pieces.select("block").distinct(), "blocks0", "block"), "block")
    current = ws.save(current.select(*whole, "n", F.col("at").cast("long").alias("at"), "name"), "level0")
    most = current.agg(F.max("n")).first()[0] or 1
    done = current.filter("n = 1").select(*whole, F.lit(0).alias("level"), "name")
    for level in range(1, math.ceil(math.log2(most)) + 1):
        half = current.filter("n > 1").groupBy(*whole, F.expr("(n + 1) div 2").alias("n"), F.expr("at div 2").alias("at"))
        pairs = ws.save(half.agg(F.max(F.expr("if(at % 2 = 0, name, null)")).alias("a"), F.coalesce(F.max(F.expr("if(at % 2 = 1, name, null)")), F.lit(-1)).alias("b")), f"pairs{level}")
        names = _named(ws, pairs.select("a", "b").distinct(), f"names{level}", "a", "b")
        current = ws.save(pairs.join(names, ["a", "b"]).select(*whole, "n", "at", "name"), f"level{level}")
        done = done.unionByName(current.filter("n = 1").select(*whole, F.lit(level).alias("level"), "name"))
    return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, routing_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts. Texts are compared after lower-casing A-Z. The row with the largest id stays; a null
    id is smaller than any, and of repeated rows (same id, same text) one stays. Other columns are not read. An empty
    table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "exact-dedup")
    rows = document_names(ws, docs, id_col, text_col, block_bytes, routing_bits)
    groups = ws.save(rows.groupBy("level", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["level", "name"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of rows that repeat an id and a text,
    one. Null texts are empty ones, a null id is smaller than any. An empty table gives no rows."""
    found = exact_dedup(docs, id_col, text_col)
    of_id, of_sha, own = unused(docs, "_id", "_sha", "_own")
    kept = found.filter("kept").select(F.col("doc_id").alias(of_id), F.col("text_sha256").alias(of_sha))
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(own, F.sha2(ascii_lower(text).cast("binary"), 256))
    stay = rows.join(kept, column(id_col).eqNullSafe(F.col(of_id)) & (F.col(own) == F.col(of_sha)), "left_semi")
    if not found.groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():
        stay = stay.dropDuplicates([id_col, own])
    return stay.drop(own)


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
