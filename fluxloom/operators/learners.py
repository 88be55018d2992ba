"""Online linear classifiers and regressions as ordered folds, and their merge over shards.

One shard gives the sequential rule exactly; with more, each shard folds its own rows and the weights are merged: means of
v1, the least v2. Scores are a join of features with the weight table.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxloom.operators.similarity import of_all_labels

MODEL = "feature string, label string, v1 double, v2 double"
CLASSIFIERS = ("perceptron", "PA", "PA1", "PA2", "CW", "AROW", "NHERD")


def _over(a: float, b: float) -> float:
    """a / b as processors and SQL divide: covariances of CW shrink by a factor a row and reach 0 after some hundred rows."""
    if b:
        return a / b
    return math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1.0, b)


def _root(x: float) -> float:
    """The square root, 0 for less than 0; nan stays."""
    return 0.0 if x <= 0 else math.sqrt(x)


class Classifier:
    """Weights (v1) and covariances (v2) by label and feature; train() takes rows in order."""

    def __init__(self, method: str, c: float = 1.0):
        if method not in CLASSIFIERS:
            raise ValueError(f"unknown method {method}")
        if c <= 0:
            raise ValueError("regularization_weight must be positive")
        self.method, self.c = method, c
        self.w: dict[str, dict[str, float]] = {}
        self.cov: dict[str, dict[str, float]] = defaultdict(dict)

    def scores(self, x: dict[str, float]) -> dict[str, float]:
        return {label: sum(v * w.get(f, 0.0) for f, v in x.items()) for label, w in self.w.items()}

    def train(self, y: str, x: dict[str, float]) -> None:
        self.w.setdefault(y, {})
        s = self.scores(x)
        wrong = min((label for label in s if label != y), key=lambda k: (-s[k], k), default=None)
        m = (s[wrong] if wrong is not None else 0.0) - s[y]
        c, sides = self.c, [(y, 1.0)] + ([(wrong, -1.0)] if wrong is not None else [])
        cov = lambda label, f: self.cov[label].get(f, 1.0)
        var = sum(cov(label, f) * v * v for label, _ in sides for f, v in x.items())
        norm = sum(v * v for v in x.values())
        if self.method == "perceptron":
            if wrong is not None and m >= 0 or wrong is None and not self.w[y]:
                self._add(sides, x, lambda label, f, v: v)
            return
        if self.method in ("PA", "PA1", "PA2"):
            loss = 1 + m
            if loss < 0 or norm == 0:
                return
            step = {"PA": loss / (2 * norm), "PA1": min(c, loss / (2 * norm)), "PA2": loss / (2 * norm + 1 / (2 * c))}[self.method]
            self._add(sides, x, lambda label, f, v: step * v)
            return
        margin = -m
        if self.method == "CW":
            b = 1 + 2 * c * margin
            root = b * b - 8 * c * (margin - c * var)
            gamma = 0.0 if root < 0 else -b + math.sqrt(root)
            if gamma <= 0 or var == 0:
                return
            gamma = _over(gamma, 4 * c * var)
            self._add(sides, x, lambda label, f, v: gamma * cov(label, f) * v)
            for label, _ in sides:
                for f, v in x.items():
                    self.cov[label][f] = _over(1.0, _over(1.0, cov(label, f)) + 2 * gamma * c * v * v)
            return
        if margin >= 1:
            return
        beta = 1 / (var + 1 / c)
        self._add(sides, x, lambda label, f, v: (1 - margin) * beta * cov(label, f) * v)
        for label, _ in sides:
            for f, v in x.items():
                k = cov(label, f)
                self.cov[label][f] = k - beta * k * k * v * v if self.method == "AROW" else _over(1.0, _over(1.0, k) + (2 * c + c * c * var) * v * v)

    def _add(self, sides, x, step) -> None:
        for label, sign in sides:
            w = self.w[label]
            for f, v in x.items():
                w[f] = w.get(f, 0.0) + sign * step(label, f, v)

    def load(self, model: pd.DataFrame) -> None:
        for f, label, v1, v2 in model[["feature", "label", "v1", "v2"]].itertuples(index=False):
            self.w.setdefault(label, {})[f] = v1
            self.cov[label][f] = v2

    def rows(self) -> pd.DataFrame:
        found = [(f, label, v, self.cov[label].get(f, 1.0)) for label, w in self.w.items() for f, v in w.items()]
        return pd.DataFrame(found, columns=["feature", "label", "v1", "v2"])


class Regression:
    """Weights of one target; duplicates of a feature count each in the norm."""

    def __init__(self, method: str, c: float = 1.0, sensitivity: float = 0.1, rate: float = 0.1, seen: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        self.method, self.c, self.eps, self.rate = method, c, sensitivity, rate
        self.w: dict[str, float] = {}
        self.cov: dict[str, float] = {}
        self.n, self.sum, self.sq = seen  # targets so far: how many, their sum and the sum of their squares

    def estimate(self, x: dict[str, float]) -> float:
        return sum(v * self.w.get(f, 0.0) for f, v in x.items())

    def train(self, y: float, x: dict[str, float]) -> None:
        e = y - self.estimate(x)
        sign, norm, c = (1.0 if e > 0 else -1.0), sum(v * v for v in x.values()), self.c
        cov = lambda f: self.cov.get(f, 1.0)
        if self.method == "perceptron":
            return self._add(x, lambda f, v: self.rate * e * v)
        if self.method in ("PA", "PA1", "PA2"):
            self.n, self.sum, self.sq = self.n + 1, self.sum + y, self.sq + y * y
            deviation = math.sqrt(max(0.0, self.sq / self.n - (self.sum / self.n) ** 2))
            loss = abs(e) - self.eps * deviation
            if loss <= 0 or norm == 0:
                return None
            step = loss / norm  # of PA2 too, whose constant has no effect
            return self._add(x, lambda f, v: sign * (min(c, step) if self.method == "PA1" else step) * v)
        loss, var = abs(e) - self.eps, sum(cov(f) * v * v for f, v in x.items())
        if loss <= 0 or var == 0:
            return None
        if self.method == "CW":
            b = 1 - 2 * c * abs(e)
            step = _over(-b + _root(b * b + 8 * c * (abs(e) + c * var)), 4 * c * var)
            more = 2 * step * c
        else:
            step, more = loss / (var + 1 / c), 2 * c + c * c * var
        self._add(x, lambda f, v: sign * step * cov(f) * v)
        for f, v in x.items():
            k = cov(f)
            self.cov[f] = k - k * k * v * v / (var + 1 / c) if self.method == "AROW" else _over(1.0, _over(1.0, k) + more * v * v)
        return None

    def _add(self, x, step) -> None:
        for f, v in x.items():
            self.w[f] = self.w.get(f, 0.0) + step(f, v)

    def load(self, model: pd.DataFrame) -> None:
        self.w, self.cov = dict(zip(model["feature"], model["v1"])), dict(zip(model["feature"], model["v2"]))

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame([(f, "+", v, self.cov.get(f, 1.0)) for f, v in self.w.items()], columns=["feature", "label", "v1", "v2"])


def train(rows: DataFrame, make, shards: int = 1, start: DataFrame | None = None) -> DataFrame:
    """The weight table from rows (seq, target, features: map of doubles), folded in order of seq within each shard.
    With ``start`` each shard goes on from that weight table.

    A shard is sorted by Spark and streams through its model in batches; its rows are never held together.
    """
    shard = F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int")
    target = rows.schema["target"].dataType.simpleString()
    blank = lambda **types: [F.lit(None).cast(t).alias(n) for n, t in types.items()]
    weights = {"feature": "string", "label": "string", "v1": "double", "v2": "double"}
    feed = rows.select(shard.alias("shard"), F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), "target", "features", *blank(**weights))
    if start is not None:
        every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        held = start.select(every, F.lit(0).alias("kind"), *blank(seq="long", target=target, features="map<string,double>"), *weights)
        feed = feed.unionByName(held)

    def fold(batches):
        model, of, loaded = None, None, []

        def ready():
            if loaded:
                model.load(pd.concat(loaded))
                loaded.clear()

        for pdf in batches:
            for key, part in pdf.groupby("shard", sort=True):
                if key != of:
                    if model is not None:
                        ready()
                        yield model.rows().assign(shard=of)
                    model, of = make(), key
                old, new = part[part["kind"] == 0], part[part["kind"] == 1]
                if len(old):
                    loaded.append(old[list(weights)])
                if len(new):
                    ready()
                for y, features in zip(new["target"], new["features"]):
                    model.train(y, dict(features))
        if model is not None:
            ready()
            yield model.rows().assign(shard=of)

    made = feed.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "seq").mapInPandas(fold, MODEL + ", shard int")
    made = made.withColumns({v: F.coalesce(v, F.lit(math.nan)) for v in ("v1", "v2")})  # pandas gives nan as null
    return mix(made, shards) if shards > 1 else made.drop("shard")


def mix(models: DataFrame, shards: int) -> DataFrame:
    """Weights are means over all shards (a shard without one counts 0), covariances the least (without one: 1)."""
    least = F.when(F.count("*") < shards, F.least(F.lit(1.0), F.min("v2"))).otherwise(F.min("v2"))
    return models.groupBy("feature", "label").agg((F.sum("v1") / shards).alias("v1"), least.alias("v2"))


def classify(features: DataFrame, model: DataFrame, known: DataFrame) -> DataFrame:
    """row_id, label, score for every known label, 0 without a common feature."""
    sums = features.join(model.select("feature", "label", "v1"), "feature").groupBy("row_id", "label").agg(F.sum(F.col("value") * F.col("v1")).alias("s"))
    return of_all_labels(features.select("row_id").distinct(), sums, known, "row_id")


def largest_incorrect(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """row_id, label, score: the best label of each row other than its own (row_id, label); ties go to the smaller label."""
    wrong = scores.join(truth.withColumnRenamed("label", "_own"), "row_id").filter("label <> _own")
    return wrong.groupBy("row_id").agg(F.max("score").alias("score"), F.min_by("label", F.struct(-F.col("score"), "label")).alias("label")).select("row_id", "label", "score")


def running_deviation(rows: DataFrame, by: str, order: list[str], value: str, span: int = 1 << 16) -> DataFrame:
    """Adds deviation: of the values so far, as PA regressions see them, the row's own included. Rows are numbered in spans;
    what lies in earlier spans is added as three sums, so that no key is one task's work."""
    place = F.floor(F.col(order[0]).cast("long") / span)
    x = F.col(value)
    sums = rows.groupBy(by, place.alias("_p")).agg(F.count(x).alias("_n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    earlier = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(by, "_p", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c + "b") for c in ("_n", "_s", "_q")])
    own = Window.partitionBy(by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumn("_p", place).withColumns({"_no": F.count(x).over(own), "_so": F.sum(x).over(own), "_qo": F.sum(x * x).over(own)}).join(before, [by, "_p"])
    n, s_, q = F.col("_no") + F.col("_nb"), F.col("_so") + F.col("_sb"), F.col("_qo") + F.col("_qb")
    return run.withColumn("deviation", F.sqrt(F.greatest(F.lit(0.0), q / n - (s_ / n) * (s_ / n)))).select(*rows.columns, "deviation")
