"""Neighbour methods, statistics that last, unlearners, plugins, buckets and landmarks against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom import services as V
from fluxloom.functions import plugins, rules as R
from fluxloom.operators import anomaly, burst, clustering, features as X, graph, learners, similarity as S, state
from fluxloom.plans import config


def features(spark, rows):
    return spark.createDataFrame([(i, f, float(v)) for i, x in rows.items() for f, v in x.items()], "row_id string, feature string, value double")


def two_clusters(n=40, seed=3):
    rng = random.Random(seed)
    return {str(i): {f"f{j}": rng.gauss(1 if i % 2 else -1, 0.4) for j in range(6)} for i in range(n)}


@pytest.mark.parametrize("engine", ["lsh", "euclid_lsh"])
def test_nearest_neighbor_methods(spark, tmp_path, engine):
    rows = two_clusters()
    f = features(spark, rows)
    labels = spark.createDataFrame([(i, "odd" if int(i) % 2 else "even", int(i)) for i in rows], "row_id string, label string, seq long")
    c = V.Classifier(spark, f"{tmp_path}/c", "nearest_neighbor", engine=engine, neighbours=5)
    c.train(f, labels)
    best = c.classify(f).groupBy("row_id").agg(F.max_by("label", "score").alias("label")).collect()
    assert np.mean([(int(r.row_id) % 2 == 1) == (r.label == "odd") for r in best]) > 0.95
    g = V.Regression(spark, f"{tmp_path}/g", "nearest_neighbor", {"nearest_neighbor_num": 3}, engine=engine)
    g.train(f, labels.select("row_id", F.when(F.col("label") == "odd", 10.0).otherwise(-10.0).alias("target"), "seq"))
    got = {r.row_id: r.estimate for r in g.estimate(f).collect()}
    assert np.mean([(v > 0) == (int(i) % 2 == 1) for i, v in got.items()]) > 0.95
    r = V.Recommender(spark, f"{tmp_path}/r", "nearest_neighbor_recommender", engine=engine)
    r.update_row(f)
    near = r.similar_row_from_id(spark.createDataFrame([("7",)], "row_id string"), 5).collect()
    assert len(near) == 5 and near[0].row_id == "7" and all(int(x.row_id) % 2 for x in near)
    assert r.complete_row_from_id(spark.createDataFrame([("7",)], "row_id string")).count() == 6
    with pytest.raises(ValueError):
        V.Classifier(spark, "x", "nearest_neighbor", engine="nope")


@pytest.mark.parametrize(("method", "engine"), [("lof", "exact"), ("light_lof", "euclid_lsh")])
def test_outliers_by_engine(spark, tmp_path, method, engine):
    rng = random.Random(1)
    points = [(str(i), [rng.gauss(10, 1), rng.gauss(10, 1)]) for i in range(80)] + [("out", [-30.0, 45.0])]
    s = V.Anomaly(spark, f"{tmp_path}/a", method, {"hash_num": 512}, engine=engine)
    got = {r.row_id: r.score for r in s.add(spark.createDataFrame(points, "row_id string, x array<double>")).collect()}
    assert len(got) == 81 and got.pop("out") > 2 > sorted(got.values())[40]


def test_same_points_are_ignored(spark, tmp_path):
    same = lambda ids: spark.createDataFrame([(str(i), [1.0, 2.0]) for i in ids], "row_id string, x array<double>")
    s = V.Anomaly(spark, f"{tmp_path}/a", "light_lof", {"nearest_neighbor_num": 4, "reverse_nearest_neighbor_num": 4, "ignore_kth_same_point": True})
    s.add(same(range(2)))
    s.add(same(range(2, 6)))
    assert sorted(r.row_id for r in s.get_all_rows().collect()) == ["0", "1", "2"] and s.get_status()["num_ignored"] == "3"
    assert anomaly.without_kth_same(same([]), same(range(9)), 5).count() == 4
    pairs = spark.createDataFrame([("a", "b", 0.0), ("b", "a", 0.0)], "row_id string, neighbour string, distance double")
    dense = anomaly.local_density(pairs, anomaly.k_distance(pairs, 1), 1)
    assert {r.lrd for r in dense.collect()} == {math.inf}
    assert [r.lrd for r in anomaly.local_density(pairs, anomaly.k_distance(pairs, 1), 1, 1e-15).collect()] == [pytest.approx(1e15)] * 2


def test_unlearners(spark, tmp_path):
    one = lambda i, label=None: features(spark, {i: {"a": 1.0, i: 1.0}})
    n = V.NearestNeighbor(spark, f"{tmp_path}/n", "lsh", unlearner={"max_size": 3})
    for i in "abcad":
        n.set_row(one(i))
    assert sorted(r.row_id for r in n.get_all_rows().collect()) == ["a", "c", "d"]
    r = V.Recommender(spark, f"{tmp_path}/r", unlearner={"max_size": 2, "sticky_pattern": "a*"})
    for i in "abcd":
        r.update_row(one(i))
    assert sorted(x.row_id for x in r.get_all_rows().collect()) == ["a", "d"]
    r = V.Recommender(spark, f"{tmp_path}/q", unlearner={"max_size": 3, "method": "random", "seed": 5})
    for i in "abcdef":
        r.update_row(one(i))
        left = {x.row_id for x in r.get_all_rows().collect()}
        assert i in left and len(left) <= 3
    c = V.Classifier(spark, f"{tmp_path}/c", "AROW", unlearner={"max_size": 2})
    for k, label in enumerate("xyz"):
        c.train(one(label), spark.createDataFrame([(label, label, k)], "row_id string, label string, seq long"))
    assert {x.label for x in c.get_labels().collect()} == {"y", "z"} >= {x.label for x in c.get("weights").collect()}
    c = V.Classifier(spark, f"{tmp_path}/k", "cosine", unlearner={"max_size": 2})
    for k, label in enumerate("xyz"):
        c.train(one(label), spark.createDataFrame([(label, label, k)], "row_id string, label string, seq long"))
    assert {x.row_id for x in c.get("rows").collect()} == {"y", "z"}
    a = V.Anomaly(spark, f"{tmp_path}/a", parameters={"nearest_neighbor_num": 2, "reverse_nearest_neighbor_num": 2}, unlearner={"max_size": 4})
    for k in range(6):
        a.add(spark.createDataFrame([(str(k), [float(k)])], "row_id string, x array<double>"))
    assert sorted(x.row_id for x in a.get_all_rows().collect()) == ["2", "3", "4", "5"]
    with pytest.raises(config.ConfigError):
        V.NearestNeighbor(spark, "x", unlearner={"max_size": 0})


RULES = {"string_rules": [{"key": "*", "type": "space", "sample_weight": "tf", "global_weight": w} for w in ("bm25", "idf")]}


def test_statistics_of_records_one_by_one(spark, tmp_path):
    """Learnt one by one, a record weighs as in the whole corpus; a query changes nothing."""
    texts = [("1", "t", "a b b c"), ("2", "t", "a a"), ("3", "t", "c d e f g"), ("4", "t", "b")]
    frame = lambda rows: spark.createDataFrame(rows, "row_id string, key string, value string")
    every = {(r.row_id, r.feature): r.value for r in config.converter(RULES).convert(frame(texts)).collect()}
    s = V.NearestNeighbor(spark, f"{tmp_path}/n", "lsh", converter=RULES)
    for row in texts:
        s.set_row(s.learn(frame([row])))
    for _ in range(2):
        got = {(r.row_id, r.feature): r.value for row in texts for r in s.convert(frame([row])).collect()}
        assert got.keys() == every.keys() and all(got[k] == pytest.approx(v) for k, v in every.items())
    plain = {"a": 2, "b": 2, "c": 2, "d": 1}
    length, average = 4, (4 + 2 + 5 + 1) / 4
    want = math.log((4 - plain["b"] + 0.5) / (plain["b"] + 0.5)) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * length / average))
    assert got.get(("1", "t$b@space#tf/bm25"), 0.0) == pytest.approx(want)
    s.save(f"{tmp_path}/saved")
    other = V.NearestNeighbor(spark, f"{tmp_path}/o", "lsh", converter=RULES)
    other.load(f"{tmp_path}/saved")
    assert other.get("size").first().n == 4
    for wrong in (V.NearestNeighbor(spark, f"{tmp_path}/w", "minhash", converter=RULES), V.NearestNeighbor(spark, f"{tmp_path}/v", "lsh"), V.Classifier(spark, f"{tmp_path}/u")):
        with pytest.raises(ValueError, match="another model"):
            wrong.load(f"{tmp_path}/saved")


def test_deviation_of_targets_lasts(spark, tmp_path):
    rng = random.Random(2)
    rows = {str(i): {"a": rng.gauss(0, 1), "one": 1.0} for i in range(40)}
    targets = spark.createDataFrame([(str(i), 3 * rows[str(i)]["a"] + rng.gauss(0, 0.1), i) for i in range(40)], "row_id string, target double, seq long")
    whole, parts = V.Regression(spark, f"{tmp_path}/w", "PA"), V.Regression(spark, f"{tmp_path}/p", "PA")
    whole.train(features(spark, rows), targets)
    for low in (0, 15, 30):
        parts.train(features(spark, rows), targets.filter(f"seq >= {low} AND seq < {low + 15}"))
    table = lambda s: {r.feature: pytest.approx(r.v1) for r in s.get("weights").collect()}
    assert {r.feature: r.v1 for r in parts.get("weights").collect()} == table(whole)
    assert parts.get("seen").first().n == 40


def test_tokens_of_groups():
    """Golden values of splitting by a group: what stands round it may be shared."""

    class Plain:
        def __init__(self, pattern, group):
            self.f = R.groups(pattern, group).func

        def __call__(self, text):
            import pandas as pd

            return list(self.f(pd.Series([text]))[0])

    assert Plain("([0-9]+)", 1)("aaa012bbb12ccc") == ["012", "12"]
    assert Plain("/([^/]+)/", 1)("/hoge/fuga/foo/hogee") == ["hoge", "fuga", "foo"]
    assert Plain("().", 1)("abc") == ["", "", ""]
    with pytest.raises(ValueError):
        R.groups("(.+)", 2)


def test_config_tells_all_errors():
    with pytest.raises(config.ConfigError) as e:
        config.converter({"num_types": {"odd": {"method": "nope"}}, "num_rules": [{"key": "*", "type": "odd"}, {"key": "*", "type": "unknown"}], "string_types": {"s": {"method": "nope"}}, "string_rules": [{"key": "*", "type": "s"}], "binary_types": {"b": {"method": "x"}}, "binary_rules": [{"key": "*", "type": "b"}]})
    assert len(e.value.errors) == 4


def test_plugins(spark):
    plugins.register("test halves", lambda value: F.array(F.struct(value.alias("value"), F.lit(0.5).alias("score"))))
    rules = config.converter({"string_types": {"h": {"method": "dynamic", "function": "test halves"}}, "string_rules": [{"key": "*", "type": "h", "sample_weight": "tf", "global_weight": "bin"}]})
    rows = spark.createDataFrame([("1", "k", "a"), ("1", "k", "a"), ("1", "k", "b")], "row_id string, key string, value string")
    assert {r.feature: r.value for r in rules.convert(rows).collect()} == {"k$a@h#tf/bin": 1.0, "k$b@h#tf/bin": 0.5}


def test_folds_stream(spark):
    """Rows in many batches and shards give what a plain fold gives, and the mean over shards."""
    rng = random.Random(0)
    rows = [(k, "a" if rng.random() < 0.5 else "b", {"x": rng.gauss(0, 1), "y": rng.gauss(0, 1)}) for k in range(300)]
    df = spark.createDataFrame(rows, "seq long, target string, features map<string,double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.feature, r.label): r.v1 for r in learners.train(df, lambda: learners.Classifier("AROW")).collect()}
        two = {(r.feature, r.label): r.v1 for r in learners.train(df, lambda: learners.Classifier("PA"), 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = learners.Classifier("AROW")
    for _, y, x in rows:
        plain.train(y, x)
    assert got == {(r.feature, r.label): pytest.approx(r.v1) for r in plain.rows().itertuples()}
    shard = {r.seq: r.s for r in df.select("seq", F.expr("pmod(xxhash64(seq), 2)").alias("s")).collect()}
    models = [learners.Classifier("PA"), learners.Classifier("PA")]
    for k, y, x in rows:
        models[shard[k]].train(y, x)
    want = {}
    for m in models:
        for r in m.rows().itertuples():
            want[r.feature, r.label] = want.get((r.feature, r.label), 0) + r.v1 / 2
    assert two == {k: pytest.approx(v) for k, v in want.items()}
    scores = spark.createDataFrame([("1", "a", 2.0), ("1", "b", 1.0), ("1", "c", 1.0)], "row_id string, label string, score double")
    truth = spark.createDataFrame([("1", "a")], "row_id string, label string")
    assert [tuple(r) for r in learners.largest_incorrect(scores, truth).collect()] == [("1", "b", 1.0)]


def test_clustering_life_cycle(spark, tmp_path):
    points = lambda lo, hi, shift=0.0: spark.createDataFrame([(i, [float(i % 2) * 10 + i / 1000 + shift, 1.0], 1.0) for i in range(lo, hi)], "id long, x array<double>, weight double")
    s = V.Clustering(spark, f"{tmp_path}/s", "kmeans", {"k": 2, "bucket_size": 20})
    s.push(points(0, 15))
    assert s.get_revision() == 0
    s.push(points(15, 30))
    assert s.get_revision() == 1 and sorted(round(x) for x, _ in s.get_k_center()) == [0, 10] and s.all_points().count() == 30
    c = V.Clustering(spark, f"{tmp_path}/c", "kmeans", {"k": 2, "bucket_size": 50, "compressed_bucket_size": 10, "compressor_method": "compressive", "forgetting_factor": 0.0, "forgetting_threshold": 0.0})
    for k in range(4):
        c.push(points(50 * k, 50 * k + 50))
    assert c.get_revision() == 4 and c.all_points().count() <= 30
    assert c.all_points().agg(F.sum("weight")).first()[0] == pytest.approx(200)
    c.put_diff("me", c.get_diff("me"), s.get_diff("you"), s.get_diff("you"))
    assert c.get("common").count() == 30 and c.get_revision() == 5
    cosine = V.Clustering(spark, f"{tmp_path}/k", "kmeans", {"k": 2, "distance": "cosine"})
    cosine.push(spark.createDataFrame([(i, [(1.0 + i), 0.1 * i] if i % 2 else [0.1, 1.0 + i], 1.0) for i in range(20)], "id long, x array<double>, weight double"))
    cosine.do_clustering()
    assert {r.id % 2 for r in cosine.get_nearest_members([5.0, 0.0]).collect()} == {1}
    with pytest.raises(ValueError):
        V.Clustering(spark, "x", "gmm", {"distance": "cosine"})
    odd = clustering.coreset(points(0, 400), 2, 50, "id", mixture=True)
    assert odd.count() == 50 and odd.agg(F.sum("weight")).first()[0] == pytest.approx(400)


@pytest.mark.parametrize("kind", ["euclidean", "cosine"])
@pytest.mark.parametrize("dimensions", [1, 2, 3])
def test_dbscan_by_brute_force(spark, kind, dimensions):
    rng = random.Random(dimensions)
    pts = {i: [rng.uniform(-3, 3) for _ in range(dimensions)] for i in range(60)} | {60: [0.0] * dimensions}
    eps = 0.4 if kind == "euclidean" else 0.02
    gap = (lambda a, b: math.dist(a, b)) if kind == "euclidean" else clustering.cosine_gap
    near = {i: [j for j in pts if gap(pts[i], pts[j]) < eps] for i in pts}
    core = {i for i in pts if len(near[i]) >= 3}
    label = {i: i for i in core}
    for _ in range(60):
        label = {i: min(label[j] for j in near[i] if j in core) for i in core}
    of = {i: min([label[j] for j in near[i] if j in core], default=None) for i in pts}
    want = {i: c for i, c in of.items() if c is not None and sum(v == c for v in of.values()) >= 3}
    df = spark.createDataFrame(list(pts.items()), "id long, x array<double>")
    assert {r.id: r.cluster for r in clustering.dbscan(df, eps, 3, kind=kind).collect()} == want


def test_landmarks_and_rounds(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1), (2, 5)], "src long, dst long")
    nodes = spark.range(1, 6)
    trees = graph.landmark_trees(nodes, edges, 1, 4)
    assert graph.landmark_path(trees, edges, 3, 5, 9) == [3, 4, 1, 2, 5] and graph.landmark_path(trees, edges, 3, 5, 2) == [3, 4, 1]
    assert graph.landmark_path(trees, edges, 5, 1, 9) == [] and graph.shortest_path(edges, 3, 5, 9) == [3, 4, 1, 2, 5]
    many = spark.range(400).select("id", (F.col("id") + 1).alias("next")).selectExpr("id AS src", "next AS dst")
    assert graph.distances(many, 0, 12).count() == 13
    one = graph.centrality(nodes, edges, 0.85, 2)
    again = graph.centrality(nodes, edges, 0.85, 1, graph.centrality(nodes, edges, 0.85, 1))
    assert {r.id: r.score for r in one.collect()} == {r.id: pytest.approx(r.score) for r in again.collect()}


def test_burst_settings(spark, tmp_path):
    d, r = [10] * 6, [1, 1, 9, 9, 1, 1]
    free = burst.detect(d, r, 2.0, 1.0)
    assert free[2] > 0 and free == burst.detect(d, r, 2.0, 1.0, costcut=1e9)
    assert sum(w > 0 for w in burst.detect(d, r, 2.0, 1.0, costcut=0.0)) <= sum(w > 0 for w in free)
    b = V.Burst(spark, f"{tmp_path}/b", {"window_batch_size": 5, "batch_interval": 10.0})
    b.add_keyword("x", 2.0, 1.0)
    b.add_keyword("y", 2.0, 1.0)
    b.set_processed_keywords(spark.createDataFrame([("x",)], "keyword string"))
    b.add_documents(spark.createDataFrame([(k, float(k), "x y") for k in range(30)], "seq long, pos double, text string"))
    b.calculate_results()
    assert {k.keyword for k in b.get("results").collect()} == {"x"} and b.get_all_keywords().count() == 2


def test_blocks_equal_plain_search(spark):
    rng = np.random.default_rng(4)
    x = {f"r{i:03}": rng.normal(size=5).round(1) for i in range(90)} | {"zero": np.zeros(5)}
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in x.items()], "row_id string, x array<double>")
    asked = df.filter("row_id < 'r020'")
    for kind in ("cosine", "euclidean"):
        score = (lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b))) if kind == "cosine" else (lambda a, b: -math.sqrt(max(0, a @ a + b @ b - 2 * (a @ b))))
        want = {}
        for q in sorted(x)[:20]:
            ok = [i for i in x if x[i] @ x[i] and (kind == "euclidean" or x[q] @ x[i])]
            want |= {(q, i): score(x[q], x[i]) for i in sorted(ok, key=lambda i: (score(x[q], x[i]), i), reverse=True)[:7]}
        got = S.in_blocks(df, asked, 7, S._dense(kind, False), row_block=13, query_block=6)
        assert {(r.query_id, r.row_id): pytest.approx(r.score, abs=1e-6) for r in got.collect()} == want
    assert S.dense_top_k(df.limit(0), asked, 3).count() == S.dense_top_k(df, asked.limit(0), 3).count() == 0


def test_versioned_rows_and_json(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y"), ("c", 2, "z")], "key string, clock long, v string")
    changed = state.update_rows(t, spark.createDataFrame([("b", "new"), ("q", "none")], "key string, v string"))
    assert {tuple(r) for r in changed.collect()} == {("a", 1, "x"), ("b", 6, "new"), ("c", 2, "z")}
    assert state.delete_rows(t, t.filter("key = 'a'")).count() == 2 and state.exact_match(t, t.filter("key = 'a'")).count() == 1
    j = spark.createDataFrame([('{"a":1,"b":{"c":[1,2]}}', '{"a":"x","d":null}')], "p string, q string")
    import json

    assert json.loads(j.select(state.merge_json(F.col("p"), F.col("q"))).first()[0]) == {"a": "x", "b": {"c": [1, 2]}, "d": None}
    assert state.load_model and X.record_ids(t.select(F.col("key").alias("row_id")), None).count() == 3


def test_numbers(spark):
    from fluxloom.functions import numbers as N

    one = lambda column: spark.range(1).select(column.alias("x")).first()[0]
    half, third = N.ratio(F.lit(3), F.lit(-6)), N.ratio(F.lit(4), F.lit(12))
    assert tuple(one(half)) == (-1, 2) and tuple(one(N.ratio_add(half, third))) == (-1, 6) and tuple(one(N.ratio_multiply(half, third))) == (-1, 6) and one(N.ratio(F.lit(1), F.lit(0))) is None
    x, y = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0), F.lit(0.0))
    assert one(N.cross(x, y)) == [0, 0, 2] and one(N.dot(x, y)) == 0 and one(N.length(y)) == 2 and one(N.scaled(y, 0.5)) == [0, 1, 0]
    ids = spark.range(4000)
    draws = ids.select(N.uniform(F.col("id"), 1).alias("u"), N.gaussian(F.col("id"), 2).alias("g"), N.drawn("gamma", 3.0)(F.col("id")).alias("m"), N.drawn("beta", 2.0, 2.0)(F.col("id")).alias("b"))
    mean = draws.agg(*[F.avg(c) for c in "ugmb"], F.stddev("g")).first()
    assert list(mean) == [pytest.approx(v, abs=0.15) for v in (0.5, 0, 3, 0.5, 1)]
    assert N.sample(ids, 50, "id", 1).collect() == N.sample(ids.repartition(7), 50, "id", 1).collect() != N.sample(ids, 50, "id", 2).collect()
    again = N.sample_again(ids.limit(3), 60, "id", 1)
    assert again.count() == 60 and again.select("id").distinct().count() == 3
    assert tuple(one(N.calendar(F.lit(86399)))) == (1970, 1, 1, 23, 59, 59)


def test_codes_transforms_and_markup(spark):
    from fluxloom.functions import strings
    from fluxloom.sources import records

    one = lambda column: spark.range(1).select(column.alias("x")).first()[0]
    assert one(strings.word_code(F.lit(6), 4)) == "0110" and one(strings.byte_code(F.lit(1))) == "10000000" and one(strings.word_code(F.lit(255), 4)) == "1111"
    t = spark.createDataFrame([("banana",)], "t string").withColumn("s", strings.suffix_array("t"))
    r = t.select("s", strings.inverse_suffix_array("s").alias("i")).first()
    assert [r.s[k] for k in r.i] == list(range(6))
    assert one(strings.range_minimum(F.array(*map(F.lit, [3, 1, 2, 1])), 1, 3)) == 1 and one(strings.range_minimum(F.array(*map(F.lit, [3, 1, 2, 1])), 2, 3)) == 3
    x = spark.createDataFrame([([1.0, 2.0, 0.5, -1.0], [[1.0, 0.0], [0.0, 1.0]])], "x array<double>, y array<array<double>>")
    back = x.select("x", strings.inverse_fft(strings.fft("x")).alias("b"), strings.fft2_magnitude("y").alias("m")).first()
    assert back.b == pytest.approx(back.x) and np.array(back.m) == pytest.approx(np.abs(np.fft.fft2(np.eye(2))))
    assert one(records.html_element("a", {"href": F.lit("x'y"), "b": F.lit("")}, records.html_encode(F.lit("<&")))) == '<a b href="x&#039;y">&lt;&amp;</a>'
    nodes = spark.createDataFrame([(1, {"a": "x"}), (2, {"a": "y"})], "id long, props map<string,string>")
    edges = spark.createDataFrame([(1, 9, {}), (1, 2, {}), (9, 8, {})], "src long, dst long, props map<string,string>")
    assert sorted((r.src, r.dst) for r in graph.subgraph(nodes, edges, {"a": "x"})[1].collect()) == [(1, 9), (9, 8)]
