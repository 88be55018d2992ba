"""k-means, Gaussian mixtures and DBSCAN over weighted sparse or dense points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.lineage import cut, written


def unit(points: DataFrame, features: str = "x") -> DataFrame:
    """Points of norm 1; those of norm 0 stay as they are."""
    norm = f"sqrt(aggregate({features}, 0D, (s, v) -> s + v * v))"
    return points.withColumn(features, F.expr(f"transform({features}, v -> if({norm} = 0, v, v / {norm}))"))


def assign(points: DataFrame, centers: list[list[float]], features: str = "x", kind: str = "euclidean") -> DataFrame:
    """Adds center (the nearest, ties to the lowest) and distance: Euclidean, or cosine, which is 1 if a norm is 0; centers
    are few and part of the plan."""
    if kind == "cosine":
        own = f"sqrt(aggregate({features}, 0D, (s, v) -> s + v * v))"
        each = []
        for c in centers:
            norm = float(np.linalg.norm(c))
            dot = f"aggregate(zip_with({features}, array({', '.join(f'{v!r}D' for v in c)}), (a, b) -> a * b), 0D, (s, v) -> s + v)"
            each.append(F.lit(1.0) if norm == 0 else F.expr(f"if({own} = 0, 1D, 1 - greatest(-1D, least(1D, {dot} / ({own} * {norm!r}D))))"))
        nearest = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(each)]))
        return points.withColumn("_best", nearest).select(*points.columns, F.col("_best.k").alias("center"), F.col("_best.d").alias("distance"))
    squared = [F.expr(f"aggregate(zip_with({features}, array({', '.join(f'{v!r}D' for v in c)}), (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v)") for c in centers]
    best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(squared)]))
    return points.withColumn("_best", best).select(*points.columns, F.col("_best.k").alias("center"), F.sqrt("_best.d").alias("distance"))


def centroids(assigned: DataFrame, features: str = "x", weight: str = "weight") -> DataFrame:
    """center, at, value: weighted means of each center's points."""
    parts = assigned.select("center", F.col(weight).alias("_w"), F.posexplode(features).alias("at", "v"))
    return parts.groupBy("center", "at").agg((F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("value"))


def first_centers(points: DataFrame, k: int, order: str, seed: int = 0, features: str = "x", weight: str = "weight", kind: str = "euclidean") -> list[list[float]]:
    """The first point, then points drawn with odds weight * distance to the nearest center so far: of exponential
    races with these rates the winner is taken, a distributed minimum."""
    first = points.orderBy(order).select(features).first()
    if first is None:
        return []
    centers = [[float(v) for v in first[0]]]
    while len(centers) < k:
        odds = assign(points, centers, features, kind).filter("distance > 0")
        race = -F.log(1 - F.rand(seed + len(centers))) / (F.col(weight) * F.col("distance"))
        won = odds.select(features, race.alias("race")).orderBy("race").first()
        if won is None:
            break
        centers.append([float(v) for v in won[0]])
    return centers


def kmeans(points: DataFrame, k: int, order: str, rounds: int = 100, tolerance: float = 1e-9, seed: int = 0, features: str = "x", weight: str = "weight", start: list[list[float]] | None = None, kind: str = "euclidean") -> list[list[float]]:
    """Centers by Lloyd's steps until none moves; [] for fewer points than k. Empty clusters keep their center."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if points.limit(k).count() < k:
        return []
    points = written(points.select(*{order, features, weight}))  # each round reads it
    centers = start or first_centers(points, k, order, seed, features, weight, kind)
    for _ in range(rounds):
        new = [list(c) for c in centers]
        for r in centroids(assign(points, centers, features, kind), features, weight).collect():  # k times the dimensions
            new[r["center"]][r["at"]] = r["value"]
        moved = max(float(np.linalg.norm(np.subtract(a, b))) for a, b in zip(new, centers))
        centers = new
        if moved <= tolerance:
            break
    return centers


def gmm(points: DataFrame, k: int, order: str, rounds: int = 50, tolerance: float = 1e-6, seed: int = 0, features: str = "x", weight: str = "weight") -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances by EM with equal mixing; sums of each partition are added up, 0.1 is added to variances."""
    points = written(points.select(*{order, features, weight}))  # each round reads it
    means = np.array(first_centers(points, k, order, seed, features, weight))
    if len(means) < k:
        return np.zeros((0, 0)), np.zeros((0, 0, 0))
    d = means.shape[1]
    covariances = np.repeat(np.eye(d)[None], k, 0)
    for _ in range(rounds):
        inverse, logdet = np.linalg.inv(covariances), np.linalg.slogdet(covariances)[1]

        def sums(batches, means=means, inverse=inverse, logdet=logdet):
            import pandas as pd

            total = np.zeros((k, 1 + d + d * d))
            for pdf in batches:
                if not len(pdf):
                    continue
                x, w = np.stack(pdf[features].to_numpy()).astype(float), pdf[weight].to_numpy(float)
                gap = x[:, None] - means[None]
                log = -0.5 * (np.einsum("nki,kij,nkj->nk", gap, inverse, gap) + logdet)
                r = np.exp(log - log.max(1, keepdims=True))
                r = r / r.sum(1, keepdims=True) * w[:, None]
                total[:, 0] += r.sum(0)
                total[:, 1 : 1 + d] += r.T @ x
                total[:, 1 + d :] += np.einsum("nk,ni,nj->kij", r, x, x).reshape(k, -1)
            yield pd.DataFrame({"k": np.repeat(np.arange(k), total.shape[1]), "at": np.tile(np.arange(total.shape[1]), k), "v": total.ravel()})

        rows = points.select(features, weight).mapInPandas(sums, "k int, at int, v double").groupBy("k", "at").agg(F.sum("v")).collect()
        total = np.zeros((k, 1 + d + d * d))
        for c, at, v in rows:
            total[c, at] = v
        mass = np.maximum(total[:, :1], 1e-12)
        new = total[:, 1 : 1 + d] / mass
        covariances = (total[:, 1 + d :] / mass).reshape(k, d, d) - np.einsum("ki,kj->kij", new, new) + 0.1 * np.eye(d)
        moved = float(np.abs(new - means).max())
        means = new
        if moved < tolerance:
            break
    return means, covariances


def region_pairs(points: DataFrame, eps: float, features: str = "x", kind: str = "euclidean") -> DataFrame:
    """id, other: points nearer than eps, each with itself. Points meet in cells of side eps of their first two
    dimensions, each copied to the cells around it; no point is compared with all. Cosine distances are those of points
    of norm 1; one of norm 0 is at 1 from all, itself included, so eps may be 1 at most."""
    if kind == "cosine":
        if eps > 1:
            raise ValueError("eps of cosine distances must be at most 1")
        held = unit(points, features).filter(F.exists(features, lambda v: v != 0))
        pairs = region_pairs(held, float(np.sqrt(2 * eps)) * (1 + 1e-9), features).join(held.select("id", F.col(features).alias("x")), "id").join(held.select(F.col("id").alias("other"), F.col(features).alias("y")), "other")
        return pairs.filter(F.expr(f"1 - least(1D, aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, v) -> s + v)) < {eps}D")).select("id", "other")
    cell = lambda c, d: F.floor(F.coalesce(F.try_element_at(F.col(features), F.lit(c)), F.lit(0.0)) / eps) + d
    own = points.select(F.col("id"), F.col(features).alias("x"), cell(1, 0).alias("cx"), cell(2, 0).alias("cy"))
    around = points.select(F.col("id").alias("other"), F.col(features).alias("y"), F.explode(F.array(*[F.struct(cell(1, a).alias("cx"), cell(2, b).alias("cy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("c")).select("other", "y", "c.cx", "c.cy")
    near = F.expr(f"sqrt(aggregate(zip_with(x, y, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v)) < {eps}D")
    return own.join(around, ["cx", "cy"]).filter(near).select("id", "other")


def _forest(batches):
    """Of links (id, other) those of a spanning forest of what this task reads, each node with the least id of its tree."""
    import pandas as pd

    above: dict = {}

    def top(x):
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["id"].tolist(), pdf["other"].tolist()):
            above.setdefault(a, a)
            above.setdefault(b, b)
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    for at in range(0, len(nodes), 1 << 16):
        part = nodes[at : at + (1 << 16)]
        yield pd.DataFrame({"id": part, "other": [top(x) for x in part]})


def dbscan(points: DataFrame, eps: float, min_core_point: int, features: str = "x", kind: str = "euclidean") -> DataFrame:
    """id, cluster (the smallest id of its core points); noise and clusters below ``min_core_point`` points are left out.

    Equal points are one place, which counts as often as it has points, so copies make no pairs. Clusters are merged in two
    steps, whatever their shape: each task keeps a spanning forest of its links, one task merges these, a row a place and task.
    """
    spots = cut(points.groupBy(F.transform(features, lambda v: v + 0.0).alias("x")).agg(F.min("id").alias("id"), F.count("*").alias("n")))
    pairs = written(region_pairs(spots.select("id", "x"), eps, "x", kind))
    size = spots.select(F.col("id").alias("other"), "n")
    core = cut(pairs.join(size, "other").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_core_point).select("id"))
    links = pairs.join(core, "id").join(core.withColumnRenamed("id", "other"), "other").filter("id >= other").select("id", "other")
    kind_of = f"id {points.schema['id'].dataType.simpleString()}, other {points.schema['id'].dataType.simpleString()}"
    label = cut(links.mapInPandas(_forest, kind_of).coalesce(1).mapInPandas(_forest, kind_of).withColumnRenamed("other", "cluster"))
    border = pairs.join(label.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("cluster").alias("cluster"))
    sizes = border.join(spots.select("id", "n"), "id").groupBy("cluster").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_core_point).select("cluster")
    held = cut(border.join(sizes, "cluster").join(spots, "id").select("x", "cluster"))
    own = points.select("id", F.transform(features, lambda v: v + 0.0).alias("x"))
    return own.join(held, "x").select("id", "cluster")


def members(points: DataFrame, centers: list[list[float]], point: list[float], features: str = "x", kind: str = "euclidean") -> DataFrame:
    """The points of the cluster whose center is nearest to a given point."""
    gaps = [cosine_gap(c, point) if kind == "cosine" else float(np.linalg.norm(np.subtract(c, point))) for c in centers]
    if not gaps:
        raise ValueError("clustering has not been performed")
    return assign(points, centers, features, kind).filter(F.col("center") == int(np.argmin(gaps)))


def cosine_gap(a: list[float], b: list[float]) -> float:
    both = float(np.linalg.norm(a) * np.linalg.norm(b))
    return 1.0 if both == 0 else 1 - max(-1.0, min(1.0, float(np.dot(a, b)) / both))


def mix_coresets(*parts: DataFrame) -> DataFrame:
    """Coresets of many nodes (column node): of the same node those of the last part that has it."""
    every = None
    for turn, part in enumerate(parts):
        named = part.withColumn("_turn", F.lit(turn))
        every = named if every is None else every.unionByName(named)
    last = every.groupBy("node").agg(F.max("_turn").alias("_turn"))
    return every.join(last, ["node", "_turn"], "left_semi").drop("_turn")


def coreset(points: DataFrame, k: int, size: int, key: str, seed: int = 0, features: str = "x", weight: str = "weight", mixture: bool = False) -> DataFrame:
    """At most ``size`` weighted points that stand for all: odds are a point's share of the cost of k drawn centers and of
    its cluster's weight, and what is drawn weighs the inverse of its odds, scaled to the same total. ``mixture`` is for
    Gaussian mixtures: the share of the weight is that in the cluster's own cost as well, so far points of tight clusters
    are drawn more often.

    The draw is a race of exponential times, a distributed top-N; no more than ``size`` points are returned as they are.
    """
    if size < k:
        raise ValueError("compressed_bucket_size must be at least k")
    if points.limit(size + 1).count() <= size:
        return points
    points = written(points)  # each center, the sums and the draw read it
    centers = first_centers(points, k, key, seed, features, weight)
    own = assign(points, centers, features)
    w = F.col(weight)
    sums = own.groupBy("center").agg(F.sum(w).alias("_mass"), F.sum(w * F.col("distance") ** 2).alias("_cost")).collect()  # k rows
    cost, total = sum(r["_cost"] for r in sums), sum(r["_mass"] for r in sums)
    mass = F.element_at(F.create_map(*[v for r in sums for v in (F.lit(r["center"]), F.lit(float(r["_mass"])))]), F.col("center"))
    share = w * (F.col("distance") ** 2 / cost if cost else F.lit(0.0)) + w / mass / len(sums)
    if mixture and cost:
        own_cost = F.element_at(F.create_map(*[v for r in sums for v in (F.lit(r["center"]), F.lit(float(r["_cost"])))]), F.col("center"))
        share = (share + w * F.when(own_cost > 0, F.col("distance") ** 2 / own_cost).otherwise(0.0) / len(sums)) * (2 / 3)
    draw = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 1) / float(1 << 52)
    drawn = own.withColumn("_odds", share / (2 if cost else 1)).orderBy(-F.log(draw) / F.col("_odds"), key).limit(size)
    drawn = drawn.withColumn(weight, w / F.col("_odds"))
    scale = drawn.agg(F.sum(weight)).first()[0]
    return drawn.withColumn(weight, F.col(weight) * (total / scale)).select(*points.columns)


class Coresets:
    """Levels of coresets: a full bucket is compressed into level 0; a level of ``length`` coresets is compressed into one
    of the next level, and what moves up loses weight by exp(-forgetting)."""

    def __init__(self, k: int, key: str, size: int, length: int, forgetting: float = 0.0, threshold: float = 0.0, weight: str = "weight", mixture: bool = False, keep=lambda df, name: df):
        if length < 2:
            raise ValueError("bucket_length must be at least 2")
        self.k, self.key, self.size, self.length, self.forgetting, self.threshold, self.weight = k, key, size, length, forgetting, threshold, weight
        self.mixture, self.keep = mixture, keep  # keep(df, name) writes what is made and reads it again
        self.levels: list[list[DataFrame]] = []
        self.revision = 0

    def push(self, bucket: DataFrame) -> None:
        self.revision += 1
        self._add(0, self._made(bucket, 0))

    def _made(self, points: DataFrame, level: int) -> DataFrame:
        return self.keep(coreset(points, self.k, self.size, self.key, self.revision, weight=self.weight, mixture=self.mixture), f"level{level}-{self.revision}")

    def _add(self, level: int, made: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(made)
        if len(self.levels[level]) == self.length:
            every = self.levels[level][0]
            for df in self.levels[level][1:]:
                every = every.unionByName(df)
            self.levels[level] = []
            faded = every.withColumn(self.weight, F.col(self.weight) * float(np.exp(-self.forgetting)))
            kept = faded.filter(F.col(self.weight) >= self.threshold)
            self._add(level + 1, self._made(kept, level + 1))

    def points(self) -> DataFrame | None:
        """All levels' points, the newest last."""
        held = [df for level in reversed(self.levels) for df in level]
        out = None
        for df in held:
            out = df if out is None else out.unionByName(df)
        return out
