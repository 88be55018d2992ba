"""Feature extraction: datums in long form (row_id, key, value) to named features (row_id, feature, value).

A converter is a list of rules; it compiles to one DataFrame plan. Statistics of the corpus (document frequencies,
lengths) are DataFrames; they are only computed when a rule needs them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fluxloom.functions import rules as R
from fluxloom.lineage import written

K1, B = 1.2, 0.75


def melt(df: DataFrame, row_id: str, columns: list[str], cast: str = "double") -> DataFrame:
    """A wide table's columns as (row_id, key, value)."""
    return df.select(F.col(row_id).alias("row_id"), *[F.col(c).cast(cast).alias(c) for c in columns]).unpivot("row_id", columns, "key", "value")


def check_keys(df: DataFrame) -> DataFrame:
    """Keys must not hold '$'."""
    return df.withColumn("key", F.when(F.col("key").contains("$"), F.raise_error(F.concat(F.lit("feature key contains '$': "), F.col("key")))).otherwise(F.col("key")))


def apply_filters(values: DataFrame, filters: list[tuple[str, str | None, object, str]]) -> DataFrame:
    """Each (pattern, except, column function, suffix) adds filtered values, of the originals and of all values that
    earlier filters have made."""
    out = values
    for pattern, but, function, suffix in filters:
        made = out.filter(R.rule_matches(F.col("key"), pattern, but)).select("row_id", F.concat("key", F.lit(suffix)).alias("key"), function(F.col("value")).alias("value"))
        out = out.unionByName(made)
    return out


def string_features(values: DataFrame, name: str, kind: str = "str", sample: str = "bin", gw: str = "bin", key: str = "*", but: str | None = None, **options) -> DataFrame:
    """row_id, feature (key$token@rule#sample/global), value (sample weight), group_key; zero weights are not emitted."""
    tag = f"@{name}#{sample}/{gw}"
    rows = values.filter(R.rule_matches(F.col("key"), key, but)).select("row_id", "key", F.explode(R.tokens(F.col("value"), kind, **options)).alias("token"))
    if isinstance(rows.schema["token"].dataType, T.StructType):  # a plugin's tokens have scores
        rows = rows.select("row_id", "key", F.col("token.value").alias("token"), F.col("token.score").cast("double").alias("score"))
    else:
        rows = rows.withColumn("score", F.lit(1.0))
    counted = rows.groupBy("row_id", "key", "token").agg(F.sum("score").alias("tf"))
    return counted.select("row_id", F.concat("key", F.lit("$"), "token", F.lit(tag)).alias("feature"), R.sample_weight(F.col("tf"), sample).alias("value"), F.concat("key", F.lit(tag)).alias("group_key")).filter("value <> 0")


def made_features(values: DataFrame, function, key: str = "*", but: str | None = None) -> DataFrame:
    """Features of a plugin: ``function`` of the columns key and value gives an array of structs feature, value."""
    held = values.filter(R.rule_matches(F.col("key"), key, but))
    return held.select("row_id", F.explode(function(F.col("key"), F.col("value"))).alias("f")).select("row_id", F.col("f.feature").alias("feature"), F.col("f.value").cast("double").alias("value"))


def num_features(values: DataFrame, kind: str = "num", key: str = "*", but: str | None = None) -> DataFrame:
    name, value = R.num_feature(F.col("key"), F.col("value"), kind)
    return values.filter(R.rule_matches(F.col("key"), key, but)).select("row_id", name.alias("feature"), value.alias("value"))


def document_frequency(features: DataFrame) -> DataFrame:
    """feature, df: entries of the unweighted vectors, duplicates counted twice."""
    return features.groupBy("feature").agg(F.count("*").cast("double").alias("df"))


def running_frequency(features: DataFrame, seq: str = "seq", span: int = 1 << 16) -> DataFrame:
    """Each entry with df as of its own record, itself included (online statistics). Entries of a feature are counted in
    spans of ``span`` values of seq, and what lies in earlier spans is added, so that a common feature is many tasks' work."""
    part = F.floor(F.col(seq) / span).alias("_part")
    sums = features.groupBy("feature", part).agg(F.count("*").alias("_n"))
    before = sums.select("feature", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = Window.partitionBy("feature", "_part").orderBy(seq).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = features.withColumn("_part", F.floor(F.col(seq) / span)).withColumn("_own", F.count("*").over(own))
    return counted.join(before, ["feature", "_part"]).withColumn("df", (F.col("_own") + F.col("_before")).cast("double")).drop("_part", "_own", "_before")


def idf(n: Column, df: Column, plus: float = 0.0) -> Column:
    return F.log((n + 1) / (df + 1)) + plus


def group_lengths(features: DataFrame) -> DataFrame:
    """group_key, freq (records that have the group), total (the sum of its sample weights): what bm25 keeps of a corpus."""
    own = features.filter("group_key IS NOT NULL").groupBy("row_id", "group_key").agg(F.sum("value").alias("len"))
    return own.groupBy("group_key").agg(F.count("*").cast("double").alias("freq"), F.sum("len").alias("total"))


def global_weight(features: DataFrame, kind: str, n: int | None = None, frequencies: DataFrame | None = None, weights: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Features times the global weight bin, idf, idf1, bm25 or weight; zero values are dropped. Statistics are the
    corpus's: n records, df by feature, and for bm25 the lengths of ``groups`` (default: of these features)."""
    if kind == "bin":
        out = features
    elif kind in ("idf", "idf1"):
        joined = features.join(frequencies, "feature", "left")
        out = joined.withColumn("value", F.col("value") * idf(F.lit(float(n)), F.coalesce("df", F.lit(0.0)), 1.0 if kind == "idf1" else 0.0)).drop("df")
    elif kind == "bm25":
        lengths = features.groupBy("row_id", "group_key").agg(F.sum("value").alias("len"))
        average = (group_lengths(features) if groups is None else groups).select("group_key", (F.col("total") / F.col("freq")).alias("avg_len"))
        joined = features.join(frequencies, "feature", "left").join(lengths, ["row_id", "group_key"]).join(average, "group_key")
        d, tf = F.coalesce("df", F.lit(0.0)), F.col("value")
        weight = F.log((n - d + 0.5) / (d + 0.5)) * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        out = joined.withColumn("value", tf * weight).drop("df", "len", "avg_len")
    elif kind == "weight":
        bare = F.regexp_replace("feature", "#[^#]*$", "")
        out = features.join(weights.select(F.col("feature").alias("_f"), F.col("weight")), bare == F.col("_f"), "left").withColumn("value", F.col("value") * F.coalesce("weight", F.lit(0.0))).drop("_f", "weight")
    else:
        raise ValueError(f"unknown global weight {kind}")
    return out.filter("value <> 0")


def merge(features: DataFrame) -> DataFrame:
    """Duplicates summed by feature."""
    return features.groupBy("row_id", "feature").agg(F.sum("value").alias("value"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Features of new rows overwrite those of old ones, the rest stay."""
    n = new.select("row_id", "feature", F.col("value").alias("_new"))
    return old.join(n, ["row_id", "feature"], "full_outer").select("row_id", "feature", F.coalesce("_new", "value").alias("value"))


def combinations(features: DataFrame, name: str, function, left: str = "*", right: str = "*", commutative: bool = True) -> DataFrame:
    """Features of pairs within a row, named left&right/name: unordered pairs in order of ``pos`` if commutative."""
    a, b = features.alias("a"), features.alias("b")
    order = F.col("a.pos") < F.col("b.pos") if commutative else F.col("a.pos") != F.col("b.pos")
    hit = R.key_matches(F.col("a.feature"), left) & R.key_matches(F.col("b.feature"), right)
    if commutative:
        hit = hit | (R.key_matches(F.col("b.feature"), left) & R.key_matches(F.col("a.feature"), right))
    pairs = a.join(b, (F.col("a.row_id") == F.col("b.row_id")) & order & hit)
    return pairs.select(F.col("a.row_id").alias("row_id"), F.concat("a.feature", F.lit("&"), "b.feature", F.lit(f"/{name}")).alias("feature"), function(F.col("a.value"), F.col("b.value")).alias("value")).filter("value <> 0")


def hash_features(features: DataFrame, size: int) -> DataFrame:
    """Names become the decimal of FNV-1 mod ``size``; collisions are left to merge()."""
    if size < 1:
        raise ValueError("hash_max_size must be positive")

    @F.pandas_udf("string")
    def hashed(names: pd.Series) -> pd.Series:
        encoded = [x.encode() for x in names]
        h = np.full(len(encoded), 0xCBF29CE484222325, np.uint64)
        longest = max(map(len, encoded), default=0)
        table = np.zeros((len(encoded), longest), np.int8)
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        for k, x in enumerate(encoded):
            table[k, : len(x)] = np.frombuffer(x, np.int8)
        with np.errstate(over="ignore"):
            for j in range(longest):
                on = lengths > j
                h[on] = (h[on] * np.uint64(0x100000001B3)) ^ table[on, j].astype(np.int64).view(np.uint64)
        return pd.Series((h % np.uint64(size)).astype(str))

    return features.withColumn("feature", hashed("feature"))


def revert(features: DataFrame) -> DataFrame:
    """Features back to datum entries: row_id, key, num_value or string_value; other features are dropped."""
    f = F.col("feature")
    num, one_hot, text = f.endswith("@num"), f.rlike("@str\\$[^@]*$"), f.rlike("(?s)^[^$]*\\$.*@str#[^#@]*$")
    return features.select(
        "row_id",
        F.when(num, F.regexp_extract(f, "(?s)^(.*)@num$", 1)).when(one_hot, F.regexp_extract(f, "(?s)^(.*)@str\\$[^@]*$", 1)).when(text, F.regexp_extract(f, "(?s)^([^$]*)\\$", 1)).alias("key"),
        F.when(num, F.col("value")).when(one_hot, F.regexp_extract(f, "@str\\$([^@]*)$", 1).cast("double")).alias("num_value"),
        F.when(text & ~num & ~one_hot, F.regexp_extract(f, "(?s)^[^$]*\\$(.*)@str#[^#@]*$", 1)).alias("string_value"),
    ).filter("key IS NOT NULL")


def record_ids(*records: DataFrame | None) -> DataFrame:
    return reduce(DataFrame.union, [r.select("row_id") for r in records if r is not None]).distinct()


@dataclass
class StringRule:
    name: str
    kind: str = "str"
    sample: str = "bin"
    gw: str = "bin"
    key: str = "*"
    but: str | None = None
    options: dict = field(default_factory=dict)


@dataclass
class NumRule:
    kind: str = "num"
    key: str = "*"
    but: str | None = None


    function: object = None


@dataclass
class BinaryRule:
    function: object
    key: str = "*"
    but: str | None = None


@dataclass
class Converter:
    """Compiles rules to a plan: filters, string and number features, global weights, combinations, hashing."""

    string_rules: list[StringRule] = field(default_factory=list)
    num_rules: list[NumRule] = field(default_factory=list)
    string_filters: list[tuple] = field(default_factory=list)
    num_filters: list[tuple] = field(default_factory=list)
    combination_rules: list[tuple] = field(default_factory=list)
    hash_max_size: int | None = None
    binary_rules: list[BinaryRule] = field(default_factory=list)

    def unweighted(self, strings: DataFrame | None, nums: DataFrame | None, binaries: DataFrame | None = None) -> list[tuple[str, DataFrame]]:
        """Each rule's global weight and features (row_id, feature, value, group_key) before it is applied."""
        out, no_group = [], F.lit(None).cast("string")
        if binaries is not None:
            out += [("bin", made_features(check_keys(binaries), r.function, r.key, r.but).withColumn("group_key", no_group)) for r in self.binary_rules]
        if strings is not None:
            values = apply_filters(check_keys(strings), self.string_filters)
            out += [(r.gw, string_features(values, r.name, r.kind, r.sample, r.gw, r.key, r.but, **r.options)) for r in self.string_rules]
        if nums is not None:
            values = apply_filters(check_keys(nums), self.num_filters)
            made = lambda r: made_features(values, r.function, r.key, r.but) if r.function else num_features(values, r.kind, r.key, r.but)
            out += [("bin", made(r).withColumn("group_key", no_group)) for r in self.num_rules]
        return out

    def convert(self, strings: DataFrame | None = None, nums: DataFrame | None = None, n: int | None = None, frequencies: DataFrame | None = None, weights: DataFrame | None = None, groups: DataFrame | None = None, binaries: DataFrame | None = None) -> DataFrame:
        """Merged features of each row; statistics default to those of these rows themselves."""
        parts = self.unweighted(strings, nums, binaries)
        needs = any(g in ("idf", "idf1", "bm25") for g, _ in parts)
        if needs and frequencies is None:
            parts = [(g, written(p)) for g, p in parts]  # texts are cut into tokens once
            every = parts[0][1]
            for _, p in parts[1:]:
                every = every.unionByName(p)
            frequencies = document_frequency(every)
            n = record_ids(strings, nums, binaries).count()
        weighted = [global_weight(p, g, n, frequencies, weights, groups).select("row_id", "feature", "value") for g, p in parts]
        out = weighted[0]
        for w in weighted[1:]:
            out = out.unionByName(w)
        if self.combination_rules:
            placed = out.withColumn("pos", F.row_number().over(Window.partitionBy("row_id").orderBy("feature")))
            for rule in self.combination_rules:
                out = out.unionByName(combinations(placed, *rule))
        if self.hash_max_size:
            out = hash_features(out, self.hash_max_size)
        return merge(out)
