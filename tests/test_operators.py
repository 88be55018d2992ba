"""Golden values and properties of the operators."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxloom.functions import plugins, rules as R, strings
from fluxloom.operators import anomaly, bandit, burst, clustering, features as X, graph, learners, similarity as S, stat, state
from fluxloom.plans import config
from fluxloom.sources import records
from fluxloom.streaming import processors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def strings_of(spark, *rows):
    return spark.createDataFrame(list(rows), "row_id string, key string, value string")


def nums_of(spark, *rows):
    return spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "row_id string, key string, value double")


def as_dict(df):
    return {r.feature: r.value for r in df.collect()}


def test_stat(spark):
    pushes = spark.createDataFrame([(k, "t", float(v)) for k, v in enumerate([1, 5, 3, 2, 4])], "seq long, key string, value double")
    r = stat.window_summary(stat.last_pushes(pushes.filter("seq < 3"), ["seq"], 3), "key", "value").first()
    assert (r["sum"], r["max"], r["min"], r.moment1, round(r.moment2, 2), r.moment3, round(r.stddev, 2)) == (9, 5, 1, 3, 11.67, 51, 1.63)
    r = stat.window_summary(stat.last_pushes(pushes, ["seq"], 3), "key", "value").first()
    assert (r["sum"], r["max"], r["min"], round(r.stddev, 2)) == (9, 4, 2, 0.82)
    three = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert stat.entropy(three, "key").first()[0] == pytest.approx(math.log(3))
    assert stat.entropy(three.limit(0), "key").first()[0] == 0
    with pytest.raises(ValueError):
        stat.last_pushes(pushes, ["seq"], 0)


def test_number_features(spark):
    n = nums_of(spark, ("r", "/val1", 1.1), ("r", "/val2", 0))
    got = as_dict(X.Converter(num_rules=[X.NumRule("num"), X.NumRule("log")]).convert(nums=n))
    assert got == {"/val1@num": 1.1, "/val1@log": pytest.approx(math.log(1.1))}
    n = nums_of(spark, ("r", "/age", 20))
    chain = [("/age", None, lambda v: R.add(v, 5), "+5"), ("/age*", None, lambda v: R.add(v, 2), "+2")]
    got = as_dict(X.Converter(num_rules=[X.NumRule("str")], num_filters=chain).convert(nums=n))
    assert got == {"/age@str$20": 1, "/age+5@str$25": 1, "/age+2@str$22": 1, "/age+5+2@str$27": 1}
    assert [one(spark, R.six_digits(F.lit(v))) for v in (1.5, 0.25, 123456.0, 3.14159265)] == ["1.5", "0.25", "123456", "3.14159"]


def test_tf_idf(spark):
    text = strings_of(spark, ("0", "/title", " this is "), ("1", "/title", " this is it . it is it ."))
    for sample, tf in (("bin", 1), ("tf", 3), ("log_tf", math.log(4))):
        got = as_dict(X.Converter([X.StringRule("space", "space", sample, "idf")]).convert(text))
        assert got[f"/title$it@space#{sample}/idf"] == pytest.approx(tf * math.log(1.5))
        assert len(got) == 2


def test_other_weights(spark):
    text = strings_of(spark, ("0", "/id", "a b"))
    w = spark.createDataFrame([("/id$a@space", 3.0)], "feature string, weight double")
    assert as_dict(X.Converter([X.StringRule("space", "space", "bin", "weight")]).convert(text, weights=w)) == {"/id$a@space#bin/weight": 3}
    f = spark.createDataFrame([("r", "x", 5.0, "g"), ("r", "y", 4.0, "g")], "row_id string, feature string, value double, group_key string")
    df = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "feature string, df double")
    got = as_dict(X.global_weight(f, "bm25", 3, df))
    assert got == {k: pytest.approx(math.log(2.5 / 1.5) * tf * 2.2 / (tf + 1.2)) for k, tf in (("x", 5), ("y", 4))}


def test_combinations(spark):
    n = nums_of(spark, ("r", "val1", 1.0), ("r", "val2", 1.1))
    rules = [("add", lambda a, b: a + b, "*", "*", True), ("mul", lambda a, b: a * b, "*", "*", True)]
    got = as_dict(X.Converter(num_rules=[X.NumRule()], combination_rules=rules).convert(nums=n))
    assert got["val1@num&val2@num/add"] == pytest.approx(2.1) and got["val1@num&val2@num/mul"] == pytest.approx(1.1)
    n = nums_of(spark, ("r", "val1", 2), ("r", "val2", 0.5))
    got = as_dict(X.Converter(num_rules=[X.NumRule()], combination_rules=[("div", lambda a, b: a / b, "*", "*", False)]).convert(nums=n))
    assert got["val1@num&val2@num/div"] == 4 and got["val2@num&val1@num/div"] == 0.25


def test_hashing_and_bad_keys(spark):
    f = spark.createDataFrame([("r", f"k{i}é", 1.0) for i in range(10)], "row_id string, feature string, value double")
    assert {r.feature for r in X.hash_features(f, 1).collect()} == {"0"}
    assert {r.feature for r in X.hash_features(f, 1000).collect()} == {str(R.fnv1_64(f"k{i}é") % 1000) for i in range(10)}
    with pytest.raises(Exception, match="contains"):
        X.Converter(num_rules=[X.NumRule()]).convert(nums=nums_of(spark, ("r", "a$b", 1))).collect()


def test_normalisers_and_filters(spark):
    values = [-100, -50, 0, 50, 100, 200]
    assert [one(spark, R.linear_normalization(F.lit(float(v)), -100, 100)) for v in values] == [0, 0.25, 0.5, 0.75, 1, 1]
    assert one(spark, R.linear_normalization(F.lit(200.0), -100, 100, False)) == 1.5
    assert one(spark, R.gaussian_normalization(F.lit(50.0), 100, 100)) == -0.5
    assert one(spark, R.sigmoid_normalization(F.lit(0.0))) == 0.5
    assert one(spark, R.regexp_filter(F.lit("ab12"), "([a-z]+)([0-9]+)", "\\2$\\1\\\\")) == "12$ab\\"
    assert one(spark, R.key_matches(F.lit("xa*"), "*a*")) and not one(spark, R.key_matches(F.lit("ab"), "*a*"))
    assert one(spark, R.key_matches(F.lit("abc"), "/ab/")) and not one(spark, R.key_matches(F.lit("abc"), "/ab/", True))
    assert one(spark, R.tokens(F.lit("日本語"), "ngram", char_num=2)) == ["日本", "本語"] and one(spark, R.tokens(F.lit("a"), "ngram", char_num=2)) == []


def test_json_msgpack_libsvm(spark):
    j = spark.createDataFrame([(1, '{"text":"Hello","user":{"name":"Taro","age":20},"key":[1,null,true],"e":{}}')], "id int, j string")
    got = {(r.key, r.string_value, r.num_value) for r in records.from_json(j, "id", "j").collect()}
    assert got == {("/text", "Hello", None), ("/user/name", "Taro", None), ("/user/age", None, 20), ("/key[0]", None, 1), ("/key[1]", "null", None), ("/key[2]", None, 1)}
    m = spark.createDataFrame([(1, bytearray(b"\x83\xa1a\x01\xa1b\xc0\xa1c\x92\xcb" + np.array([1.5], ">f8").tobytes() + b"\xa2hi"))], "id int, b binary")
    assert {(r.key, r.string_value, r.num_value) for r in records.from_msgpack(m, "id", "b").collect()} == {("/a", None, 1), ("/b", "NULL", None), ("/c[0]", None, 1.5), ("/c[1]", "hi", None)}
    s = spark.createDataFrame([(1, "-1 1:100 2:-1.5")], "id int, l string")
    assert {(r.label, r.key, r.num_value) for r in records.from_libsvm(s, "id", "l").collect()} == {("-1", "1", 100), ("-1", "2", -1.5)}
    with pytest.raises(Exception, match="id:value"):
        records.from_libsvm(spark.createDataFrame([(1, "1 1,100")], "id int, l string"), "id", "l").collect()


def test_revert(spark):
    f = spark.createDataFrame([("r", "age@str$25", 1.0), ("r", "size@num", 25.0), ("r", "/name$doc1@str#bin/bin", 1.0), ("r", "age@log", 1.0), ("r", "t$a@space#tf/idf", 1.0)], "row_id string, feature string, value double")
    assert {(r.key, r.num_value, r.string_value) for r in X.revert(f).collect()} == {("age", 25, None), ("size", 25, None), ("/name", None, "doc1")}


def rows_of(spark, table):
    return spark.createDataFrame([(r, f"c{k}", float(v)) for r, vs in table.items() for k, v in enumerate(vs) if v], "row_id string, feature string, value double")


def test_exact_scores(spark):
    rows = rows_of(spark, {"r1": (1, 1, 1, 0, 0), "r2": (1, 0, 1, 1, 0), "r3": (0, 1, 0, 0, 1)})
    q = rows_of(spark, {"q": (1, 1, 0, 0, 0)})
    assert {r.row_id: r.score for r in S.cosine_scores(rows, q).collect()} == {"r1": pytest.approx(2 / 6**0.5), "r2": pytest.approx(1 / 6**0.5), "r3": pytest.approx(0.5)}
    assert {r.row_id: r.score for r in S.euclidean_scores(rows, q).collect()} == {"r1": pytest.approx(-1), "r2": pytest.approx(-(3**0.5)), "r3": pytest.approx(-(2**0.5))}
    same = rows_of(spark, {"1": (1,), "2": (1,), "3": (1,), "4": (1, 1), "5": (1, 1)})
    from1 = S.cosine_scores(same, same.filter("row_id = '1'"))
    from4 = S.cosine_scores(same, same.filter("row_id = '4'"))
    assert S.at_least(from1, 0.8).count() == 3 and S.at_least(from4, 0.8).count() == 2
    assert S.top_rate(from1, 0.6, 5).count() == 3 and S.top_rate(from4, 0.2, 5).count() == 1


def test_hashed_neighbours_find_their_cluster(spark):
    rng = np.random.default_rng(0)
    table = {f"p{k}": rng.normal(1, 0.4, 12) for k in range(40)} | {f"n{k}": rng.normal(-1, 0.4, 12) for k in range(40)}
    rows = rows_of(spark, table)
    for make, r in ((S.lsh_signatures, rows), (S.minhash_signatures, rows.withColumn("feature", F.concat("feature", F.when(F.col("value") > 0, "+").otherwise("-"))).withColumn("value", F.abs("value")))):
        s = make(r)
        near = S.top_k(S.signature_scores(s, s.filter("row_id = 'p3'")), 10).collect()
        assert sum(x.row_id.startswith("p") for x in near) > 8


def test_outliers(spark):
    points = {"a": -1.0, "b": 0.0, "c": 1.0, "d": 10.0}
    pairs = spark.createDataFrame([(x, y, abs(points[x] - points[y])) for x in points for y in points if x != y], "row_id string, neighbour string, distance double")
    kd = anomaly.k_distance(pairs, 2)
    assert {r.row_id: r.kdist for r in kd.collect()} == {"a": 2, "b": 1, "c": 2, "d": 10}
    lrd = anomaly.local_density(pairs, kd, 2)
    assert {r.row_id: r.lrd for r in lrd.collect()} == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 2), "c": pytest.approx(2 / 3), "d": pytest.approx(2 / 19)}


def test_dbscan_and_kmeans(spark):
    xy = [(1, 1), (2, 2), (4, 4), (5, 5), (50, 0), (51, 0), (-100, -100)]
    p = spark.createDataFrame([(k, [float(a), float(b)], 1.0) for k, (a, b) in enumerate(xy)], "id long, x array<double>, weight double")
    found = {r.id: r.cluster for r in clustering.dbscan(p, 4.0, 2).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4}
    rng = np.random.default_rng(1)
    blobs = spark.createDataFrame([(k, (rng.normal(0, 1, 2) + (2.5 if k % 2 else -2.5)).tolist(), 1.0) for k in range(400)], "id long, x array<double>, weight double")
    for centers in (np.array(clustering.kmeans(blobs, 2, "id")), clustering.gmm(blobs, 2, "id")[0]):
        assert np.abs(centers[centers[:, 0].argsort()] - [[-2.5, -2.5], [2.5, 2.5]]).max() < 0.35
    assert clustering.kmeans(p, 10, "id") == []


def test_burst():
    assert burst.detect([10] * 5, [0] * 5, 2, 1) == [0] * 5
    w = burst.detect([10] * 5, [10, 0, 0, 0, 10], 2, 1)
    assert w[0] > 6 and w[4] > 6 and w[1] == w[2] == w[3] == 0
    w = burst.detect([10] * 5, [10, 0, 0, 0, 10], 2, 1, reuse=[0, 0])
    assert w[:2] == [0, 0] and w[4] > 6


def test_graph(spark):
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "src long, dst long")
    nodes = spark.range(1, 5)
    assert {round(r.score, 9) for r in graph.centrality(nodes, cycle, 0.9, 3).collect()} == {1.0}
    edges = spark.createDataFrame([(1, 3), (2, 1)], "src long, dst long")
    assert graph.shortest_path(edges, 2, 3, 3) == [2, 1, 3]
    assert graph.shortest_path(edges, 3, 2, 3) == [] and graph.shortest_path(edges, 2, 3, 1) == []


def test_bandit(spark):
    e = spark.createDataFrame([(1, "p", "a", "select", None), (2, "p", "a", "reward", 1.0), (3, "p", "a", "select", None), (4, "p", "b", "select", None)], "seq long, player string, arm string, kind string, reward double")
    assert {(r.arm, r.trial_count, r.weight, r.expectation) for r in bandit.sums(e, True).collect()} == {("a", 2, 1, 0.5), ("b", 1, 0, 0)}
    assert {(r.arm, r.trial_count, r.expectation) for r in bandit.sums(e).collect()} == {("a", 1, 1.0), ("b", 0, 0)}
    assert bandit.ucb1(bandit.sums(e)).first().arm == "b" and bandit.greedy(bandit.sums(e)).first().arm == "a"
    w = {r.arm: r.weight for r in bandit.exp3(e.filter("kind = 'reward'"), ["a", "b"], 0.1).collect()}
    assert w == {"a": pytest.approx(1 / 0.5 * 0.1 / 2), "b": 0}


@pytest.mark.parametrize("method", learners.CLASSIFIERS)
@pytest.mark.parametrize("shards", [1, 3])
def test_classifiers(spark, method, shards):
    rng = np.random.default_rng(0)
    draw = lambda n, at: [(at + k, y := ("OK" if k % 2 else "NG"), {f"f{j}": float(v) for j, v in enumerate(rng.normal(1 if y == "OK" else -1, 1.5, 10))}) for k in range(n)]
    rows = spark.createDataFrame(draw(400, 0), "seq long, target string, features map<string,double>")
    model = learners.train(rows, lambda: learners.Classifier(method, 0.1 if method == "NHERD" else 1.0), shards)
    fresh = draw(200, 1000)
    f = spark.createDataFrame([(i, k, v) for i, _, x in fresh for k, v in x.items()], "row_id long, feature string, value double")
    best = learners.classify(f, model, model).groupBy("row_id").agg(F.max_by("label", "score").alias("label")).collect()
    want = {i: y for i, y, _ in fresh}
    assert np.mean([want[r.row_id] == r.label for r in best]) > 0.9


@pytest.mark.parametrize("method", ["perceptron", "PA", "PA1", "PA2", "CW", "AROW", "NHERD"])
def test_regressions(method):
    rng = np.random.default_rng(2)
    w, model = rng.normal(0, 1, 5), learners.Regression(method, c=0.1 if method == "NHERD" else 1.0, sensitivity=0.01, rate=0.05)
    draw = lambda: (lambda x: (float(x @ w), {f"f{k}": float(v) for k, v in enumerate(x)}))(rng.normal(0, 1, 5))
    for _ in range(1500):
        model.train(*draw())
    errors = [abs(y - model.estimate(x)) for y, x in (draw() for _ in range(100))]
    assert np.mean(errors) < 0.35


def test_mix(spark):
    parts = spark.createDataFrame([("f", "a", 2.0, 0.5), ("f", "a", 4.0, 0.25), ("g", "a", 3.0, 2.0)], learners.MODEL.replace(", v2", ", v2"))
    assert {(r.feature, r.v1, r.v2) for r in learners.mix(parts, 2).collect()} == {("f", 3, 0.25), ("g", 1.5, 1)}


def test_state(spark, tmp_path):
    t = spark.createDataFrame([(k, f"u{k % 5}") for k in range(20)] + [(20, "u1")], "seq long, id string")
    assert {r.id for r in state.keep_recent(t, "id", "seq", 3).collect()} == {"u1", "u4", "u3"}
    assert {r.id for r in state.keep_recent(t, "id", "seq", 3, "u0").collect()} == {"u0", "u1", "u4"}
    assert state.keep_random(t, "id", 2).count() == 2
    state.save_model({"m": t}, str(tmp_path))
    assert sorted(map(tuple, state.load_model(spark, str(tmp_path), ["m"])["m"].collect())) == sorted(map(tuple, t.collect()))
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("j", 2, "x")], "key string, clock long, v string")
    assert {(r.key, r.v) for r in state.latest(rows, "key", "clock").collect()} == {("k", "new"), ("j", "x")}


def test_config(spark):
    assert config.parameters("clustering")["k"] == 2
    with pytest.raises(config.ConfigError) as e:
        config.parameters("clustering", {"k": 0, "eps": -1, "nope": 1})
    assert len(e.value.errors) == 3
    made = config.converter({"string_filter_types": {"detag": {"method": "regexp", "pattern": "<[^>]*>", "replace": ""}}, "string_filter_rules": [{"key": "text", "type": "detag", "suffix": "-detagged"}], "num_filter_types": {"add_1": {"method": "add", "value": "1"}}, "num_filter_rules": [{"key": "age", "type": "add_1", "suffix": "+1"}], "string_rules": [{"key": "text-detagged", "type": "str", "sample_weight": "bin", "global_weight": "bin"}], "num_rules": [{"key": "age+1", "type": "num"}]})
    got = as_dict(made.convert(strings_of(spark, ("r", "text", "<b>hi</b>")), nums_of(spark, ("r", "age", 19))))
    assert got == {"text-detagged$hi@str#bin/bin": 1, "age+1@num": 20}
    with pytest.raises(config.ConfigError, match="unknown type"):
        config.converter({"string_rules": [{"key": "*", "type": "mecab"}]})
    plugins.register("twice", lambda v: v * 2)
    assert plugins.resolve("math:sqrt")(4) == 2
    made = config.converter({"num_filter_types": {"d": {"method": "dynamic", "function": "twice"}}, "num_filter_rules": [{"key": "*", "type": "d", "suffix": "x2"}], "num_rules": [{"key": "*x2", "type": "num"}]})
    assert as_dict(made.convert(nums=nums_of(spark, ("r", "a", 4)))) == {"ax2@num": 8}


def test_strings(spark):
    df = spark.createDataFrame([("ABCBDAB", "BDCABA", [3, 1, 2, 5, 4], "banana")], "a string, b string, n array<int>, t string")
    r = df.select(strings.lcs("a", "b").alias("l"), strings.lis("n").alias("i"), strings.find_any(["an", "nan"])("t").alias("f"), strings.suffix_array("t").alias("s"), strings.contains_at(F.col("t"), "nan").alias("c")).first()
    assert (r.l, r.i, r.s, r.c) == (4, 3, [5, 3, 1, 0, 4, 2], 2)
    assert [(x.start, x.pattern) for x in r.f] == [(1, "an"), (2, "nan"), (3, "an")]


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = processors.last_values(stream(), "event_type", "value", "event_id", 10_000).writeStream.format("memory").queryName("last_values").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_type: (r.n, round(r.total, 6)) for r in spark.table("last_values").groupBy("event_type").agg(F.max(F.struct("n", "total")).alias("m")).select("event_type", "m.*").collect()}
    assert got == {r[0]: (r[1], round(r[2], 6)) for r in events.groupBy("event_type").agg(F.count("*"), F.sum("value")).collect()}
    add = lambda master, diff: state.add_up(diff if master is None else master.unionByName(diff), ["event_type"], ["n"])
    processors.merge_each_batch(stream(), lambda b: b.groupBy("event_type").agg(F.count("*").alias("n")), add, str(tmp_path / "model"), str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "model/version=2")).collect()} == {(k, n) for k, (n, _) in got.items()}
    w = processors.tumbling(stream(), "ts", "event_type", "value", "1 hour", "30 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()
