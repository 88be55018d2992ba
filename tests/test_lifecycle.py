"""Burst windows, bucket indexes, coresets, graph and arm tables, versions and codes against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.functions import strings
from fluxloom.operators import bandit, burst, clustering, graph, lsh_index, similarity as S, state
from fluxloom.sources import ini


def plain_windows(arrivals, size):
    """Windows (newest first in time) by the rule itself, and the batches' counts in each."""
    windows, taken = [], []
    for seq, b in arrivals:
        if not windows or b >= windows[-1][0] + size:
            start = b - size // 2
            old = windows[-1][1] if windows else {}
            windows.append((start, {k: v for k, v in old.items() if start <= k < start + size}))
        if b >= windows[-1][0]:
            taken.append(seq)
        for start, counts in reversed(windows):
            if not start <= b < start + size:
                break
            counts[b] = counts.get(b, 0) + 1
    return windows, taken


@pytest.mark.parametrize("size", [2, 5, 8])
def test_windows_of_unordered_arrivals(spark, size):
    rng = random.Random(size)
    arrivals = [(k, max(0, k // 4 + rng.randint(-6, 6))) for k in range(200)] + [(200 + k, 90 + 3 * k) for k in range(10)]
    docs = spark.createDataFrame([(s, b * 10 + 3.0, "x") for s, b in arrivals], "seq long, pos double, text string")
    placed = burst.place(docs.select("seq", "pos"), 10.0, size)
    windows, taken = plain_windows(arrivals, size)
    kept = burst.on_time(docs, placed, 10.0)
    assert sorted(r.seq for r in kept.collect()) == taken
    words = spark.createDataFrame([("x",), ("y",)], "keyword string")
    got = burst.windowed(burst.batch_counts(kept, words, 10.0), placed).filter("keyword = 'x'").collect()
    assert {(r.start, r.batch): r.r for r in got} == {(s, b): n for s, c in windows for b, n in c.items()}


def test_counts_of_null_texts_and_many_keywords(spark):
    docs = spark.createDataFrame([(1.0, "a b"), (2.0, None), (3.0, "")], "pos double, text string")
    words = spark.createDataFrame([(f"w{k}",) for k in range(burst.PART + 3)] + [("a",)], "keyword string")
    got = burst.batch_counts(docs, words, 10.0)
    assert got.count() == burst.PART + 4
    assert [(r.d, r.r) for r in got.filter("r > 0").collect()] == [(3, 1)]
    assert burst.batch_counts(docs.limit(0), words, 10.0).count() == 0


def test_results_reuse_and_merge(spark):
    settings = spark.createDataFrame([("k", 2.0, 1.0)], "keyword string, scaling double, gamma double")
    rows = [("k", s, b, 10, 9 if b == 4 else 1) for s in (0, 3) for b in range(s, s + 5)]
    found = burst.results(spark.createDataFrame(rows, "keyword string, start long, batch long, d long, r long"), settings, 5, 2)
    w = {(r.start, r.batch): r.weight for r in found.collect()}
    assert w[3, 3] == w[0, 3] and w[3, 4] == w[0, 4] > 0
    assert [r.keyword for r in burst.bursted_at(found, 4).collect()] == ["k"] and burst.bursted_at(found, 6).count() == 0
    two = found.withColumn("shard", F.lit(0)).unionByName(found.withColumn("d", F.col("d") + 1).withColumn("shard", F.lit(1)))
    assert {r.d for r in burst.merge_results(two).collect()} == {11}


def test_perturbations_in_order_of_cost():
    rest = np.random.default_rng(1).uniform(0, 1, (2, 3))
    cost = lambda t, moves: sum((rest[t][i] if d < 0 else 1 - rest[t][i]) ** 2 for i, d in moves)
    every = []
    for t in range(2):
        for steps in itertools.product((-1, 0, 1), repeat=3):
            moves = tuple((i, s) for i, s in enumerate(steps) if s)
            if moves:
                every.append(cost(t, moves))
    got = lsh_index.perturbations(rest, 1000)
    assert len(got) == len(every) == len({(t, frozenset(m)) for t, m in got})
    assert [cost(t, m) for t, m in got] == pytest.approx(sorted(every))


def test_bucket_neighbours_find_the_nearest(spark):
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(20, 8)) * 5, 5, axis=0) + rng.normal(size=(100, 8)) * 0.05
    rows = spark.createDataFrame([(i, f"f{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r)], "row_id long, feature string, value double")
    got = lsh_index.neighbours(rows, rows.filter("row_id % 5 = 0"), 5, hashes=2, tables=6, width=4.0, bits=512)
    hits = sum(r.row_id // 5 == r.query_id // 5 for r in got.collect())
    assert got.count() == 100 and hits >= 90
    empty = rows.limit(0)
    assert S.lsh_signatures(empty).count() == 0 and S.minhash_signatures(empty).count() == 0


def test_signatures_do_not_depend_on_batches(spark):
    rows = spark.createDataFrame([(i, f"f{j}", float(i + j)) for i in range(40) for j in range(1 + i % 7)], "row_id long, feature string, value double")
    for make in (S.lsh_signatures, S.minhash_signatures):
        one, many = ({r.row_id: tuple(r.bits) for r in make(rows.repartition(n)).collect()} for n in (1, 7))
        assert one == many and len(one) == 40


def test_coresets(spark):
    p = spark.range(500).select("id", F.array((F.col("id") % 5 * 10.0), F.rand(1)).alias("x"), F.lit(2.0).alias("weight"))
    c = clustering.coreset(p, 5, 60, "id")
    assert c.count() == 60 and c.agg(F.sum("weight")).first()[0] == pytest.approx(1000)
    assert clustering.coreset(p.limit(10), 5, 60, "id").count() == 10
    held = clustering.Coresets(2, "id", 20, 2, forgetting=math.log(2))
    for k in range(3):
        held.push(p.filter(F.col("id") % 3 == k))
    assert held.revision == 3 and held.points().agg(F.sum("weight")).first()[0] == pytest.approx(332 + (334 + 334) / 2, rel=0.01)
    centers = [[0.0, 0.5], [40.0, 0.5]]
    assert {r.id % 5 for r in clustering.members(p, centers, [39.0, 0.0]).collect()} == {3, 4}
    with pytest.raises(ValueError):
        clustering.members(p, [], [0.0])


def test_graph_tables(spark):
    nodes = spark.createDataFrame([(1, {"a": "x"}), (2, {"a": "y"}), (3, {})], "id long, props map<string,string>")
    edges = spark.createDataFrame([(1, 2, {"k": "v"}), (2, 1, {})], "src long, dst long, props map<string,string>")
    assert graph.create_nodes(nodes, nodes.withColumn("id", F.col("id") + 1)).count() == 4
    assert graph.remove_nodes(nodes, edges, spark.range(3, 4)).count() == 2
    for bad in (lambda: graph.remove_nodes(nodes, edges, spark.range(1, 2)), lambda: graph.remove_nodes(nodes, edges, spark.range(9, 10))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        graph.update(nodes, spark.range(9, 10).withColumn("props", F.create_map(F.lit("a"), F.lit("b"))))
    with pytest.raises(ValueError):
        graph.create_edges(nodes, edges, edges.select((F.col("src") + 9).alias("src"), (F.col("dst") + 9).alias("dst"), "props"))
    n, e = graph.subgraph(nodes, edges, {"a": "x"}, {"k": "v"})
    assert (n.count(), e.count()) == (1, 0)
    presets = graph.Presets()
    presets.add("centrality", {}, {})
    presets.check("centrality", {}, {})
    with pytest.raises(KeyError):
        presets.check("shortest_path", {}, {})


def test_arms_and_versions(spark):
    sums = bandit.sums(spark.createDataFrame([("p", "a", "reward", 1.0), ("q", "b", "reward", 0.0)], "player string, arm string, kind string, reward double"))
    assert bandit.register_arms(sums, ["a", "b"]).count() == 4
    assert bandit.delete_arm(sums, "a").count() == bandit.reset(sums, "p").count() == 1
    mine = spark.createDataFrame([("k", "o", 3, "m"), ("l", "o", 5, "m")], "key string, owner string, clock long, v string")
    theirs = spark.createDataFrame([("k", "p", 3, "t"), ("l", "p", 4, "t"), ("n", "p", 1, "t")], "key string, owner string, clock long, v string")
    assert {r.key: r.v for r in state.accept(mine, theirs).collect()} == {"k": "t", "l": "m", "n": "t"}
    seen = spark.createDataFrame([("p", 3)], "owner string, clock long")
    assert [r.key for r in state.newer(theirs, seen).collect()] == ["l"]
    df, version, taken = state.apply_difference(mine, 1, mine, 0, ["key"], ["clock"])
    assert (version, taken) == (1, False)


def test_codes_and_settings(spark):
    row = spark.range(1).select(*[strings.gamma_code(F.lit(n)).alias(f"g{n}") for n in (0, 1, 5)], strings.delta_code(F.lit(10)).alias("d")).first()
    assert (row.g0, row.g1, row.g5, row.d) == (None, "1", "00101", "00100010")
    t = spark.createDataFrame([("banana",), ("",), (None,)], "t string").withColumn("s", strings.suffix_array("t"))
    assert [r[0] for r in t.select(strings.lcp_array("t", "s")).collect()] == [[0, 1, 3, 0, 0, 2], [], []]
    words = spark.createDataFrame([(w,) for w in ("b", "a", None, "c", "a")], "w string")
    assert {r.w: r.id for r in strings.intern(words, "w").collect()} == {"a": 0, "b": 1, "c": 2}
    assert ini.sections("[a]\nKey = 1\n[b]\nx: y%z\n") == {"a": {"Key": "1"}, "b": {"x": "y%z"}}
    with pytest.raises(ValueError):
        ini.sections("no section")


def test_bucket_neighbours_recall(spark, sf):
    from fluxloom.queries import lifecycle, similarity

    exact = similarity.nearest(spark, sf, "euclidean", 10).select("query_id", "row_id")
    got = lifecycle.k08(spark, sf)
    assert got.groupBy("query_id").count().filter("count <> 10").isEmpty()
    assert got.join(exact, ["query_id", "row_id"]).count() >= 0.9 * exact.count()


def test_query_by_ids_ranks_all(spark, sf):
    from fluxloom.operators import similarity
    from fluxloom.queries import catalogue
    from fluxloom.queries.similarity import rows

    bits = {r.row_id: [b & (1 << 64) - 1 for b in r.bits] for r in similarity.lsh_signatures(rows(spark, sf)).collect()}
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(bits[a], bits[b]))
    want = {(q, i, 1 - apart(q, i) / 64) for q in bits if q % 20 == 0 for i in sorted(bits, key=lambda i: (apart(q, i), i))[:10]}
    assert {tuple(r) for r in catalogue.queries()["n06_query_by_ids"](spark, sf).collect()} == want
