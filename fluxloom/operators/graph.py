"""Property graphs: nodes (id, props), edges (src, dst, props); centrality, bounded paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.lineage import cut


def has_properties(props: Column, wanted: dict[str, str]) -> Column:
    """Conjunction of equalities over a map; a missing key is false."""
    tests = [F.coalesce(F.element_at(props, k) == v, F.lit(False)) for k, v in wanted.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def centrality(nodes: DataFrame, edges: DataFrame, damping: float = 0.9, rounds: int = 1, start: DataFrame | None = None) -> DataFrame:
    """id, score after ``rounds`` updates; scores sum to the number of nodes after each. The score of nodes without
    outgoing edges is dealt out to all. Each round is kept by a checkpoint, so none is computed twice. ``start`` (id, score)
    is what earlier rounds have given; nodes that it doesn't know begin with 1."""
    if not 0 < damping < 1:
        raise ValueError("damping_factor must be in (0, 1)")
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    ranked = nodes.select("id").withColumn("score", F.lit(1.0))
    if start is not None:
        ranked = nodes.select("id").join(start.select("id", "score"), "id", "left").fillna(1.0, ["score"])
    n = nodes.count()
    for _ in range(rounds):
        held = ranked.join(out, F.col("id") == F.col("src"), "left")
        dangling = held.filter("degree IS NULL").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0] / max(n, 1)
        sent = edges.join(held.filter("degree IS NOT NULL").select("id", (F.col("score") / F.col("degree")).alias("share")), F.col("src") == F.col("id")).groupBy("dst").agg(F.sum("share").alias("got"))
        new = nodes.select("id").join(sent, F.col("id") == F.col("dst"), "left").select("id", (damping * F.coalesce("got", F.lit(0.0)) + (1 - damping) + damping * dangling).alias("score"))
        new = cut(new)
        total = new.agg(F.sum("score")).first()[0] or 1.0
        ranked = new.withColumn("score", F.col("score") * n / total)
    return ranked


def distances(edges: DataFrame, source: int, max_hop: int) -> DataFrame:
    """id, hops of what is within ``max_hop`` edges of a node: breadth first, a join a hop. Each front is kept by a
    checkpoint, so a plan never holds more than one hop, and the search ends with the first empty front."""
    spark = edges.sparkSession
    front = spark.range(source, source + 1).select("id", F.lit(0).alias("hops"))
    seen = front
    steps = edges.select("src", "dst").distinct()
    for hop in range(1, max_hop + 1):
        found = front.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = cut(found.withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _backwards(edges: DataFrame) -> DataFrame:
    return edges.selectExpr("dst AS src", "src AS dst")


def _walk(edges: DataFrame, left: DataFrame, source: int, hops: int) -> list[int]:
    """The nodes from ``source`` to where ``left`` (id, hops) is 0: at each step the smallest id that is one hop nearer."""
    path = [source]
    for rest in range(hops - 1, -1, -1):
        step = edges.filter(F.col("src") == path[-1]).join(left.filter(F.col("hops") == rest), F.col("dst") == F.col("id"))
        path.append(step.agg(F.min("dst")).first()[0])
    return path


def shortest_path(edges: DataFrame, source: int, target: int, max_hop: int) -> list[int]:
    """The nodes of a shortest path of at most ``max_hop`` edges, smallest ids first among equals; [] if none."""
    left = distances(_backwards(edges), target, max_hop)
    start = left.filter(F.col("id") == source).first()
    return [] if start is None else _walk(edges, left, source, start["hops"])


def landmark_distance(edges: DataFrame, landmark: int, max_hop: int) -> DataFrame:
    """id, to (hops to the landmark), from_ (hops from it): a path over the landmark is their sum, not always shortest."""
    away = distances(edges, landmark, max_hop).withColumnRenamed("hops", "from_")
    return distances(_backwards(edges), landmark, max_hop).withColumnRenamed("hops", "to").join(away, "id", "full_outer")


def landmark_trees(nodes: DataFrame, edges: DataFrame, landmarks: int, sweeps: int) -> DataFrame:
    """landmark, id, to, from_ for the first ``landmarks`` ids, as far as ``sweeps`` hops."""
    kind = "landmark long, id long, to int, from_ int"
    out = nodes.sparkSession.createDataFrame([], kind)
    for (root,) in nodes.select("id").orderBy("id").limit(landmarks).collect():  # a setting's number of them
        out = out.unionByName(landmark_distance(edges, root, sweeps).select(F.lit(root).cast("long").alias("landmark"), "id", "to", "from_"))
    return out


def landmark_path(trees: DataFrame, edges: DataFrame, source: int, target: int, max_hop: int) -> list[int]:
    """A path over the landmark with the fewest hops to and from it (ties: the smallest), cut after ``max_hop`` edges; it
    need not be a shortest one. [] if no landmark joins the two."""
    ends = trees.filter((F.col("id") == source) & F.col("to").isNotNull()).select("landmark", "to").join(trees.filter((F.col("id") == target) & F.col("from_").isNotNull()).select("landmark", "from_"), "landmark")
    best = ends.orderBy(F.col("to") + F.col("from_"), "landmark").first()
    if best is None:
        return []
    own = trees.filter(F.col("landmark") == best["landmark"])
    there = _walk(edges, own.select("id", F.col("to").alias("hops")), source, best["to"])
    back = _walk(_backwards(edges), own.select("id", F.col("from_").alias("hops")), target, best["from_"])
    return (there + back[-2::-1])[: max_hop + 1]


def create_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes are added; ids that exist already keep theirs."""
    return nodes.unionByName(new.dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti").select(*nodes.columns))


def update(items: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Properties of known nodes or edges are replaced as a whole; unknown ids raise."""
    if not changes.join(items.select(key), key, "left_anti").isEmpty():
        raise ValueError(f"unknown {key}")
    p = changes.select(key, F.col("props").alias("_props"), F.lit(True).alias("_hit"))
    return items.join(p, key, "left").withColumn("props", F.when(F.col("_hit"), F.col("_props")).otherwise(F.col("props"))).select(*items.columns)


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes without the ids of ``gone``, which must be known and have no edges."""
    if not gone.join(nodes.select("id"), "id", "left_anti").isEmpty():
        raise ValueError("unknown id")
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    if not gone.join(ends, "id", "left_semi").isEmpty():
        raise ValueError("a node with edges cannot be removed")
    return nodes.join(gone.select("id"), "id", "left_anti")


def create_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """New edges are added; each needs one known end at least."""
    known = nodes.select("id")
    lost = new.join(known, F.col("src") == F.col("id"), "left_anti").join(known, F.col("dst") == F.col("id"), "left_anti")
    if not lost.isEmpty():
        raise ValueError("an edge needs a known node")
    return edges.unionByName(new.select(*edges.columns))


def subgraph(nodes: DataFrame, edges: DataFrame, node_query: dict[str, str] | None = None, edge_query: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the wanted properties, edges between such nodes only; a node that is not in the table counts as
    one with them."""
    held = nodes.filter(has_properties(F.col("props"), node_query)) if node_query else nodes
    kept = edges.filter(has_properties(F.col("props"), edge_query)) if edge_query else edges
    if node_query:
        other = nodes.filter(~has_properties(F.col("props"), node_query)).select("id")
        kept = kept.join(other, F.col("src") == F.col("id"), "left_anti").join(other, F.col("dst") == F.col("id"), "left_anti")
    return held, kept


class Presets:
    """Registered pairs of node and edge queries; results are given for these alone."""

    def __init__(self) -> None:
        self._held: set = set()

    @staticmethod
    def _key(kind: str, node_query: dict, edge_query: dict) -> tuple:
        return kind, tuple(sorted(node_query.items())), tuple(sorted(edge_query.items()))

    def add(self, kind: str, node_query: dict, edge_query: dict) -> None:
        if kind not in ("centrality", "shortest_path"):
            raise ValueError(f"unknown kind of query {kind}")
        self._held.add(self._key(kind, node_query, edge_query))

    def remove(self, kind: str, node_query: dict, edge_query: dict) -> None:
        self._held.discard(self._key(kind, node_query, edge_query))

    def all(self) -> list[tuple[str, dict, dict]]:
        return [(kind, dict(nodes), dict(edges)) for kind, nodes, edges in sorted(self._held)]

    def check(self, kind: str, node_query: dict, edge_query: dict) -> None:
        if self._key(kind, node_query, edge_query) not in self._held:
            raise KeyError("unknown query")


def merge_graphs(master: DataFrame, *diffs: DataFrame) -> DataFrame:
    """Nodes or edges (id first): those of later differences replace earlier ones."""
    key = master.columns[0]
    rest = master.columns[1:]
    every = [df.select(*master.columns).withColumn("_turn", F.lit(k)) for k, df in enumerate((master, *diffs))]
    return reduce(DataFrame.unionByName, every).groupBy(key).agg(F.max_by(F.struct(*rest), "_turn").alias("_r")).select(key, "_r.*")
