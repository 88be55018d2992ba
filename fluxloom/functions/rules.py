"""Rules on keys and values as column expressions: key patterns, filters of strings and numbers, tokens."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def key_matches(key: Column, pattern: str, full: bool = False) -> Column:
    """'' and '*' match all, '*x' a suffix (tested before prefixes), 'x*' a prefix, '/x/' a regexp anchored at the
    start (``full``: at both ends), anything else the key itself."""
    if pattern in ("", "*"):
        return F.lit(True)
    if pattern.startswith("*"):
        return key.endswith(pattern[1:])
    if pattern.endswith("*"):
        return key.startswith(pattern[:-1])
    if len(pattern) > 1 and pattern[0] == pattern[-1] == "/":
        return key.rlike(f"^(?:{pattern[1:-1]})" + ("$" if full else ""))
    return key == pattern


def rule_matches(key: Column, pattern: str, but: str | None = None) -> Column:
    return key_matches(key, pattern) & ~key_matches(key, but) if but is not None else key_matches(key, pattern)


def regexp_filter(value: Column, pattern: str, replacement: str) -> Column:
    r"""All matches replaced; \0 to \9 in the replacement are groups, \\ a backslash."""
    java = re.sub(r"\\(\\|\d)|\$", lambda m: r"\$" if m[0] == "$" else r"\\" if m[1] == "\\" else "$" + m[1], replacement)
    return F.regexp_replace(value, pattern, java)


def add(value: Column, n: float) -> Column:
    return value + F.lit(float(n))


def linear_normalization(value: Column, low: float, high: float, truncate: bool = True) -> Column:
    if not high > low:
        raise ValueError("max must be larger than min")
    scaled = (value - low) / (high - low)
    return F.when(value > high, 1.0).when(value < low, 0.0).otherwise(scaled) if truncate else scaled


def gaussian_normalization(value: Column, average: float, deviation: float) -> Column:
    if deviation < 0:
        raise ValueError("standard_deviation must not be negative")
    if deviation == 0:  # as IEEE division has it
        return F.when(value > average, F.lit(float("inf"))).when(value < average, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return (value - average) / deviation


def sigmoid_normalization(value: Column, gain: float = 1.0, bias: float = 0.0) -> Column:
    if gain == 0:
        raise ValueError("gain must not be 0")
    return 1 / (1 + F.exp(-gain * (value - bias)))


def tokens(value: Column, kind: str = "str", **options) -> Column:
    """Array of tokens: str (the value), space, split (characters ``separators``), ngram (``char_num`` code points),
    regexp (``group``, by default 0, of every match of ``pattern``), dynamic (``function`` of the value and the other
    options gives an array of strings, or of structs value, score)."""
    if kind == "str":
        return F.array(value)
    if kind == "space":
        return F.filter(F.split(value, "[ \\t\\f\\n\\r\\x0B]+"), lambda t: t != "")
    if kind == "split":
        chars = "".join("\\" + c if not c.isalnum() else c for c in options["separators"])
        return F.filter(F.split(value, f"[{chars}]"), lambda t: t != "")
    if kind == "ngram":
        n = int(options["char_num"])
        if n < 1:
            raise ValueError("char_num must be positive")
        places = F.sequence(F.lit(1), F.char_length(value) - (n - 1))
        return F.when(F.char_length(value) >= n, F.transform(places, lambda i: F.substring(value, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    if kind == "regexp":
        group = int(options.get("group", 0))
        found = F.regexp_extract_all(value, F.lit(options["pattern"]), F.lit(0)) if group == 0 else groups(options["pattern"], group)(value)
        return F.filter(found, lambda t: t != "")
    if kind == "dynamic":
        from fluxloom.functions import plugins

        more = {k: v for k, v in options.items() if k not in ("function", "path")}
        return plugins.resolve(options["function"])(value, **more)
    raise ValueError(f"unknown string type {kind}")


def groups(pattern: str, group: int):
    """One group of each match; the search goes on where the group's length ends, counted from the match's begin, so that
    what stands round a group may be shared by two matches."""
    found = re.compile(pattern)
    if not 0 <= group <= found.groups:
        raise ValueError(f"the pattern has no group {group}")

    @F.pandas_udf("array<string>")
    def tokens_of(values: pd.Series) -> pd.Series:
        out = []
        for text in values:
            got, at = [], 0
            while text is not None and at < len(text) and (m := found.search(text, at)):
                got.append(m[group] or "")
                at = m.start() + max(1, len(got[-1]))
            out.append(None if text is None else got)
        return pd.Series(out)

    return tokens_of


def sample_weight(tf: Column, kind: str) -> Column:
    kinds = {"bin": lambda: F.lit(1.0), "tf": lambda: tf, "log_tf": lambda: F.log1p(tf)}
    if kind not in kinds:
        raise ValueError(f"unknown sample weight {kind}")
    return kinds[kind]()


def num_feature(key: Column, value: Column, kind: str) -> tuple[Column, Column]:
    """Feature name and value of the number types num, log and str."""
    if kind == "num":
        return F.concat(key, F.lit("@num")), value
    if kind == "log":
        return F.concat(key, F.lit("@log")), natural_log(F.greatest(F.lit(1.0), value))
    if kind == "str":
        # six significant digits, as streams print doubles by default
        return F.concat(key, F.lit("@str$"), six_digits(value)), F.lit(1.0)
    raise ValueError(f"unknown num type {kind}")


def natural_log(value: Column) -> Column:
    """The C library's logarithm, as the engine's and SQL's; the JVM's differs in the last bit of one in a hundred."""

    @F.pandas_udf("double")
    def log(values: pd.Series) -> pd.Series:
        return pd.Series(list(map(math.log, values.tolist())), dtype="float64")

    return log(value)


def six_digits(value: Column) -> Column:
    plain = F.regexp_replace(F.format_string("%.10f", F.round(value, 10)), "\\.?0+$", "")
    digits = F.lit(5) - F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-4)))).cast("int")
    scale = F.pow(F.lit(10.0), digits)
    short = F.regexp_replace(F.format_string("%.10f", F.rint(value * scale) / scale), "\\.?0+$", "")
    return F.when(value == F.floor(value), F.when(F.abs(value) < 1e6, F.format_string("%d", value.cast("long"))).otherwise(plain)).otherwise(short)


def fnv1_64(text: str, seed: int = 0xCBF29CE484222325) -> int:
    """FNV-1 (multiply, then xor) with bytes from 0x80 on extended with their sign."""
    h = seed
    for b in text.encode():
        h = h * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        h ^= b if b < 0x80 else b | 0xFFFFFFFFFFFFFF00
    return h
