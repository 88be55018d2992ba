"""From JSON configurations to plans: validation that collects all errors, and compilation of converter rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from fluxloom.functions import plugins
from fluxloom.functions import rules as R
from fluxloom.operators.features import BinaryRule, Converter, NumRule, StringRule


class ConfigError(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Param:
    default: object
    check: Callable[[object], bool] = lambda v: True
    says: str = ""


positive = lambda v: isinstance(v, (int, float)) and v > 0
at_least = lambda n: lambda v: isinstance(v, (int, float)) and v >= n
FLOAT_MAX = 3.4028234663852886e38

#: Parameters of each service: default values and ranges.
PARAMETERS: dict[str, dict[str, Param]] = {
    "classifier": {"regularization_weight": Param(1.0, positive, "must be positive"), "hash_num": Param(64, at_least(1), "must be at least 1")},
    "regression": {"sensitivity": Param(0.1, at_least(0), "must not be negative"), "regularization_weight": Param(FLOAT_MAX, positive, "must be positive"), "learning_rate": Param(0.1, positive, "must be positive"), "nearest_neighbor_num": Param(10, at_least(1), "must be at least 1"), "weight": Param("uniform", lambda v: v in ("uniform", "distance"), "must be uniform or distance"), "hash_num": Param(64, at_least(1), "must be at least 1")},
    "nearest_neighbor": {"hash_num": Param(64, at_least(1), "must be at least 1")},
    "recommender": {"hash_num": Param(64, at_least(1), "must be at least 1"), "table_num": Param(4, at_least(1), "must be at least 1"), "bin_width": Param(100.0, positive, "must be positive"), "probe_num": Param(64, at_least(0), "must not be negative"), "seed": Param(1091), "ignore_orthogonal": Param(False)},
    "anomaly": {"nearest_neighbor_num": Param(10, at_least(2), "must be at least 2"), "reverse_nearest_neighbor_num": Param(30, at_least(2), "must be at least 2"), "ignore_kth_same_point": Param(False), "hash_num": Param(64, at_least(1), "must be at least 1")},
    "clustering": {"k": Param(2, at_least(1), "must be at least 1"), "seed": Param(0), "eps": Param(2.0, positive, "must be positive"), "min_core_point": Param(1, at_least(1), "must be at least 1"), "distance": Param("euclidean", lambda v: v in ("euclidean", "cosine"), "must be euclidean or cosine"), "bucket_size": Param(10000, at_least(2), "must be at least 2"), "bucket_length": Param(2, at_least(2), "must be at least 2"), "compressed_bucket_size": Param(200, at_least(1), "must be at least 1"), "compressor_method": Param("simple", lambda v: v in ("simple", "compressive"), "must be simple or compressive"), "forgetting_factor": Param(2.0, at_least(0), "must not be negative"), "forgetting_threshold": Param(0.05, lambda v: 0 <= v <= 1, "must be in [0, 1]")},
    "burst": {"window_batch_size": Param(5, positive, "must be positive"), "batch_interval": Param(10.0, positive, "must be positive"), "max_reuse_batch_num": Param(5, at_least(0), "must not be negative"), "costcut_threshold": Param(-1.0), "result_window_rotate_size": Param(5, positive, "must be positive")},
    "stat": {"window_size": Param(128, at_least(1), "must be at least 1")},
    "graph": {"damping_factor": Param(0.9, lambda v: 0 < v < 1, "must be in (0, 1)"), "landmark_num": Param(5, at_least(0), "must not be negative")},
    "bandit": {"assume_unrewarded": Param(False), "epsilon": Param(0.1, lambda v: 0 <= v <= 1, "must be in [0, 1]"), "decreasing_rate": Param(0.5, lambda v: 0 < v < 1, "must be in (0, 1)"), "tau": Param(0.05, positive, "must be positive"), "gamma": Param(0.1, lambda v: 0 < v <= 1, "must be in (0, 1]"), "seed": Param(0)},
    "weight": {},
    "unlearner": {"method": Param("lru", lambda v: v in ("lru", "random"), "must be lru or random"), "max_size": Param(1, positive, "must be positive"), "sticky_pattern": Param(None), "seed": Param(0)},
}


def parameters(service: str, given: dict | None = None) -> dict[str, object]:
    """The parameters of a service with defaults filled in; all errors are told at once."""
    known, given = PARAMETERS[service], given or {}
    errors = [f".{service}.{k}: unknown parameter" for k in given if k not in known]
    out = {k: given.get(k, p.default) for k, p in known.items()}
    for k, p in known.items():
        try:
            fine = p.check(out[k])
        except TypeError:
            fine = False
        if not fine:
            errors.append(f".{service}.{k}: {p.says}, got {out[k]!r}")
    if service == "anomaly" and not errors and out["reverse_nearest_neighbor_num"] < out["nearest_neighbor_num"]:
        errors.append(".anomaly.reverse_nearest_neighbor_num: must be at least nearest_neighbor_num")
    if errors:
        raise ConfigError(errors)
    return out


def _num_filter(kind: dict):
    n = lambda k: float(kind[k])
    made = {
        "add": lambda: lambda v: R.add(v, n("value")),
        "linear_normalization": lambda: lambda v: R.linear_normalization(v, n("min"), n("max"), str(kind.get("truncate", "True")) == "True"),
        "gaussian_normalization": lambda: lambda v: R.gaussian_normalization(v, n("average"), n("standard_deviation")),
        "sigmoid_normalization": lambda: lambda v: R.sigmoid_normalization(v, float(kind.get("gain", 1)), float(kind.get("bias", 0))),
        "dynamic": lambda: plugins.resolve(kind["function"]),
    }
    return made[kind["method"]]()


def converter(config: dict) -> Converter:
    """A converter's JSON as a plan: types by name, rules in order. Unknown types are errors, all told at once."""
    errors: list[str] = []
    types = {k: config.get(f"{k}_types", {}) for k in ("string_filter", "num_filter", "string", "num", "binary", "combination")}

    def typed(group: str, name: str, defaults: tuple[str, ...]) -> dict:
        if name in types[group]:
            return types[group][name]
        if name in defaults:
            return {"method": name}
        errors.append(f".{group}_rules: unknown type {name!r}")
        return {"method": {"string": "str", "num": "num"}.get(group, "add"), "value": 0}

    string_filters, num_filters, strings, nums, binaries, pairs = [], [], [], [], [], []
    for r in config.get("string_filter_rules", []):
        t = typed("string_filter", r["type"], ())
        f = plugins.resolve(t["function"]) if t["method"] == "dynamic" else (lambda v, t=t: R.regexp_filter(v, t.get("pattern", ""), t.get("replace", "")))
        string_filters.append((r["key"], r.get("except"), f, r["suffix"]))
    for r in config.get("num_filter_rules", []):
        num_filters.append((r["key"], r.get("except"), _num_filter(typed("num_filter", r["type"], ())), r["suffix"]))
    for r in config.get("string_rules", []):
        t = typed("string", r["type"], ("str", "space"))
        options = {k: v for k, v in t.items() if k != "method"}
        if t["method"] not in ("str", "space", "split", "ngram", "regexp", "dynamic"):
            errors.append(f".string_types.{r['type']}.method: unknown method {t['method']!r}")
        strings.append(StringRule(r["type"], t["method"], r.get("sample_weight", "bin"), r.get("global_weight", "bin"), r.get("key", "*"), r.get("except"), options))
    for r in config.get("num_rules", []):
        t = typed("num", r["type"], ("num", "log", "str"))
        made = t["method"] == "dynamic"
        if not made and t["method"] not in ("num", "log", "str"):
            errors.append(f".num_types.{r['type']}.method: unknown method {t['method']!r}")
        nums.append(NumRule("num" if made else t["method"], r.get("key", "*"), r.get("except"), plugins.resolve(t["function"]) if made else None))
    for r in config.get("binary_rules", []):
        t = typed("binary", r["type"], ())
        if t["method"] != "dynamic":
            errors.append(f".binary_types.{r['type']}.method: only dynamic ones are known")
        else:
            binaries.append(BinaryRule(plugins.resolve(t["function"]), r.get("key", "*"), r.get("except")))
    for r in config.get("combination_rules", []):
        t = typed("combination", r["type"], ("add", "mul"))
        f, commutative = {"add": (lambda a, b: a + b, True), "mul": (lambda a, b: a * b, True)}.get(t["method"]) or (plugins.resolve(t["function"]), bool(t.get("commutative", False)))
        pairs.append((r["type"], f, r.get("key_left", "*"), r.get("key_right", "*"), commutative))
    size = config.get("hash_max_size")
    if size is not None and not size > 0:
        errors.append(".hash_max_size: must be positive")
    if errors:
        raise ConfigError(errors)
    return Converter(strings, nums, string_filters, num_filters, pairs, size, binaries)
