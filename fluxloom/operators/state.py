"""Versioned rows, merges of differences, bounded state, saved models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxloom.functions.rules import key_matches


def latest(rows: DataFrame, key: str, clock: str) -> DataFrame:
    """The last writer's row of each key: a partial aggregation, not a sort of each key's rows."""
    others = [c for c in rows.columns if c not in (key, clock)]
    return rows.groupBy(key).agg(F.max(F.struct(clock, *others)).alias("_r")).select(key, f"_r.{clock}", *[f"_r.{c}" for c in others])


def overlay(master: DataFrame, diff: DataFrame, key: str, tombstone: str) -> DataFrame:
    """The difference overrides the master; rows marked as gone are left out."""
    kept = master.join(diff.select(key), key, "left_anti")
    return kept.unionByName(diff.filter(~F.col(tombstone)).drop(tombstone))


def add_up(parts: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def keep_recent(touches: DataFrame, key: str, seq: str, most: int, sticky: str | None = None) -> DataFrame:
    """Keys that a least-recently-used memory of ``most`` keys still holds; sticky keys stay and count."""
    if most < 1:
        raise ValueError("max_size must be positive")
    last = touches.groupBy(key).agg(F.max(seq).alias("last")).withColumn("sticky", key_matches(F.col(key).cast("string"), sticky) if sticky is not None else F.lit(False))
    held = last.filter("sticky").select(key, "last")
    room = most - (held.count() if sticky is not None else 0)
    if room <= 0:
        return held
    return held.unionByName(last.filter("NOT sticky").orderBy(F.col("last").desc(), F.col(key)).limit(room).select(key, "last"))


def keep_random(keys: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    return keys.select(key).distinct().orderBy(F.xxhash64(F.lit(seed), key)).limit(most)


def keep_random_but(touches: DataFrame, key: str, turn: str, now: int, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` keys: those of the turn ``now`` first, of the others drawn ones."""
    last = touches.groupBy(key).agg(F.max(turn).alias(turn))
    return last.orderBy(F.col(turn) != now, F.xxhash64(F.lit(seed), F.lit(now), key)).limit(most).select(key)


def save_model(tables: dict[str, DataFrame], path: str, **tags: str) -> None:
    """Tables below a new folder, then its tags; a folder without tags is no whole model, and one with them is not
    written over."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    marks = {**tags, **{f"table {name}": df.schema.simpleString() for name, df in tables.items()}}
    spark.createDataFrame(sorted(marks.items()), "key string, value string").coalesce(1).write.parquet(f"{path}/_model/tags")


def load_model(spark: SparkSession, path: str, names: list[str], **tags: str) -> dict[str, DataFrame]:
    """The tables of a saved model, which must have the same tables and tags."""
    found = {r.key: r.value for r in spark.read.parquet(f"{path}/_model/tags").collect()}
    wrong = [f"{k} is {found.get(k)!r}, not {v!r}" for k, v in tags.items() if found.get(k) != v]
    held = {k.removeprefix("table ") for k in found if k.startswith("table ")}
    if held != set(names):
        wrong.append(f"tables are {sorted(held)}, not {sorted(names)}")
    if wrong:
        raise ValueError(f"{path} holds another model: " + "; ".join(wrong))
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def first_kept(*parts: DataFrame, key: str, tombstone: str) -> DataFrame:
    """A merge in which the first part that has a key gives its row, and a tombstone in any part takes it away."""
    every = None
    for turn, part in enumerate(parts):
        named = part.withColumn("_turn", F.lit(turn))
        every = named if every is None else every.unionByName(named)
    rest = [c for c in parts[0].columns if c != key]
    best = every.groupBy(key).agg(F.min_by(F.struct(*rest), "_turn").alias("_r"), F.max(tombstone).alias("_gone"))
    return best.filter("NOT _gone").select(key, "_r.*").select(*parts[0].columns).drop(tombstone)


def update_rows(table: DataFrame, changes: DataFrame, key: str = "key", clock: str = "clock") -> DataFrame:
    """Rows whose key is in ``changes`` take the columns given there, and a clock over the table's newest."""
    now = (table.agg(F.max(clock)).first()[0] or 0) + 1
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, F.struct(*names).alias("_new"))
    keep = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.when(F.col("_new").isNotNull(), F.lit(now)).otherwise(F.col(c)).alias(c) if c == clock else F.col(c) for c in table.columns]
    return table.join(new, key, "left").select(*keep)


def exact_match(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The rows whose key is asked for."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def delete_rows(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)


def merge_json(a: Column, b: Column) -> Column:
    """One JSON object of two; where both have a key, the second's value stays. Values keep their types."""
    kind = "map<string,variant>"
    first, second = F.from_json(a, kind), F.from_json(b, kind)
    only = F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k))
    return F.to_json(F.map_concat(only, second))


def status(**values: object) -> dict[str, str]:
    return {k: str(v) for k, v in values.items()}


def top_results(results: DataFrame, key: str, start: str, most: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(start).desc())
    return results.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def newer(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows (key, owner, clock, ...) that a peer lacks, which has seen each owner's rows up to ``clock``."""
    s = seen.groupBy("owner").agg(F.max("clock").alias("_seen"))
    return rows.join(s, "owner", "left").filter("_seen IS NULL OR clock > _seen").select(*rows.columns)


def accept(mine: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """Versioned rows after a push: an incoming row replaces one whose clock is not larger than its own."""
    others = [c for c in mine.columns if c != key]
    every = mine.withColumn("_in", F.lit(0)).unionByName(incoming.select(*mine.columns).withColumn("_in", F.lit(1)))
    last = every.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("clock", "_in")).alias("_r"))
    return last.select(key, "_r.*").select(*mine.columns)


def apply_difference(master: DataFrame, version: int, diff: DataFrame, diff_version: int, keys: list[str], values: list[str]) -> tuple[DataFrame, int, bool]:
    """The master with a mixed difference added, its version and whether it was taken: one of another version is not."""
    if diff_version != version:
        return master, version, False
    return add_up(master.select(*keys, *values).unionByName(diff.select(*keys, *values)), keys, values), version + 1, True
