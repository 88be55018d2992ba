"""Services end to end: what they hold, what they answer, what they refuse."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fluxloom import services as V


def features(spark, rows):
    return spark.createDataFrame([(i, f, float(v)) for i, x in rows.items() for f, v in x.items()], "row_id string, feature string, value double")


def test_classifier_goes_on_from_its_model(spark, tmp_path):
    rng = random.Random(3)
    rows = {str(i): {"a": rng.gauss(1 if i % 2 else -1, 0.5), "b": rng.gauss(-1 if i % 2 else 1, 0.5)} for i in range(60)}
    f, labels = features(spark, rows), spark.createDataFrame([(str(i), "odd" if i % 2 else "even", i) for i in range(60)], "row_id string, label string, seq long")
    whole, parts = V.Classifier(spark, f"{tmp_path}/w"), V.Classifier(spark, f"{tmp_path}/p")
    whole.train(f, labels)
    parts.train(f, labels.filter("seq < 30"))
    parts.train(f, labels.filter("seq >= 30"))
    table = lambda s: {(r.feature, r.label): (round(r.v1, 9), round(r.v2, 9)) for r in s.get("weights").collect()}
    assert table(whole) == table(parts)
    best = whole.classify(f).groupBy("row_id").agg(F.max_by("label", "score").alias("label")).collect()
    assert sum((int(r.row_id) % 2 == 1) == (r.label == "odd") for r in best) > 54
    assert {r.label: r.n for r in whole.get_labels().collect()} == {"odd": 30, "even": 30}
    assert whole.set_label("new") and not whole.set_label("new") and whole.delete_label("odd") and not whole.delete_label("odd")
    whole.save(f"{tmp_path}/saved")
    parts.load(f"{tmp_path}/saved")
    assert {r.label for r in parts.get_labels().collect()} == {"even", "new"} and parts.get_versions()["labels"] == 3
    assert whole.get_status()["num_labels"] == "2"
    near = V.Classifier(spark, f"{tmp_path}/n", "cosine", neighbours=5)
    near.train(f, labels)
    assert near.classify(f.filter("row_id = '1'")).orderBy(F.desc("score")).first().label == "odd"
    with pytest.raises(ValueError):
        V.Classifier(spark, "x", "nope")


def test_regression(spark, tmp_path):
    rows = {str(i): {"a": float(i % 10), "one": 1.0} for i in range(50)}
    targets = spark.createDataFrame([(str(i), 2.0 * (i % 10) + 1, i) for i in range(50)], "row_id string, target double, seq long")
    for method in ("PA", "euclidean"):
        s = V.Regression(spark, f"{tmp_path}/{method}", method, {"nearest_neighbor_num": 3})
        s.train(features(spark, rows), targets)
        got = {r.row_id: r.estimate for r in s.estimate(features(spark, {"q": {"a": 4.0, "one": 1.0}})).collect()}
        assert got["q"] == pytest.approx(9, abs=1.5)


def test_recommender_and_neighbours(spark, tmp_path):
    rows = {"r1": {"a": 1, "b": 1, "c": 1}, "r2": {"a": 1, "c": 1, "d": 1}, "r3": {"b": 1, "e": 1}}
    q = features(spark, {"q": {"a": 1, "b": 1}})
    s = V.Recommender(spark, f"{tmp_path}/r")
    s.update_row(features(spark, rows))
    assert [(r.row_id, round(r.score, 6)) for r in s.similar_row_from_datum(q, 3).orderBy("rank").collect()] == [("r1", round(2 / 6**0.5, 6)), ("r3", 0.5), ("r2", round(1 / 6**0.5, 6))]
    assert s.similar_row_from_datum_and_score(q, 0.45).count() == 2 and s.similar_row_from_datum_and_rate(q, 0.3).count() == 1
    ids = spark.createDataFrame([("r1",)], "row_id string")
    assert s.similar_row_from_id(ids, 1).first().row_id == "r1" and s.complete_row_from_id(ids).count() > 0
    s.clear_row(ids)
    assert {r.row_id for r in s.get_all_rows().collect()} == {"r2", "r3"}
    assert s.calc_similarity(q, q) == pytest.approx(1) and s.calc_l2norm(q).first().norm == pytest.approx(2**0.5)
    for method in ("lsh", "minhash", "euclid_lsh"):
        n = V.NearestNeighbor(spark, f"{tmp_path}/{method}", method)
        n.set_row(features(spark, rows))
        n.set_row(features(spark, {"r3": {"z": 1}}))
        first = n.neighbor_row_from_id(ids, 3).orderBy("rank").first()
        assert first.row_id == "r1" and first.distance == pytest.approx(0)
    e = V.Recommender(spark, f"{tmp_path}/e", "euclid_lsh")
    e.update_row(features(spark, rows))
    assert e.similar_row_from_id(ids, 1).first().row_id == "r1"


def test_anomaly_and_clustering(spark, tmp_path):
    rng = random.Random(0)
    pts = [(str(i), [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(60)] + [("far", [30.0, 30.0])]
    s = V.Anomaly(spark, f"{tmp_path}/a")
    got = {r.row_id: r.score for r in s.add(spark.createDataFrame(pts, "row_id string, x array<double>")).collect()}
    assert len(got) == 61 and got["far"] > 2 > 1.6 > sorted(got.values())[30]
    lof = {r.query_id: r.lof for r in s.calc_score(spark.createDataFrame([("n", [0.0, 0.0]), ("o", [-40.0, 9.0])], "query_id string, x array<double>")).collect()}
    assert lof["n"] < 1.5 and lof["o"] > 2
    s.clear_row(spark.createDataFrame([("far",)], "row_id string"))
    assert s.get_all_rows().count() == 60
    c = V.Clustering(spark, f"{tmp_path}/c", "kmeans", {"k": 2})
    with pytest.raises(RuntimeError):
        c.get_k_center()
    c.push(spark.createDataFrame([(i, [float(i % 2) * 10 + i / 100, 0.0], 1.0) for i in range(40)], "id long, x array<double>, weight double"))
    c.do_clustering()
    assert sorted(round(x) for x, _ in c.get_k_center()) == [0, 10] and c.get_nearest_members([9.0, 0.0]).count() == 20 and c.get_revision() == 1


def test_burst_and_stat(spark, tmp_path):
    b = V.Burst(spark, f"{tmp_path}/b", {"window_batch_size": 5, "batch_interval": 10.0})
    assert b.add_keyword("x", 2.0, 1.0) and not b.add_keyword("x", 2.0, 1.0)
    with pytest.raises(ValueError):
        b.add_keyword("y", 1.0, 1.0)
    docs = [(k, float(k), "x" if k >= 40 or k % 9 == 0 else "none") for k in range(50)]
    b.add_documents(spark.createDataFrame(docs, "seq long, pos double, text string"))
    b.calculate_results()
    assert [r.keyword for r in b.get_all_bursted_results_at(45.0).collect()] == ["x"] and b.get_all_bursted_results_at(5.0).count() == 0
    assert b.get_result("x").count() == b.get_result_at("x", 45.0).count() == 5
    assert b.remove_keyword("x") and not b.remove_keyword("x")
    s = V.Stat(spark, f"{tmp_path}/s", {"window_size": 3})
    for k, v in enumerate([1, 5, 3, 2, 4]):
        s.push(spark.createDataFrame([(k, "t", float(v))], "seq long, key string, value double"))
    assert (s.sum("t"), s.max("t"), s.min("t"), round(s.stddev("t"), 2), round(s.moment("t", 2, 3.0), 2), s.moment("t", 0, 0), s.entropy()) == (9, 4, 2, 0.82, 0.67, 1, 0)
    with pytest.raises(KeyError):
        s.sum("unknown")


def test_graph_bandit_weight(spark, tmp_path):
    g = V.Graph(spark, f"{tmp_path}/g", {"damping_factor": 0.75})
    none = F.create_map().cast("map<string,string>")
    g.create_node(spark.range(1, 5).withColumn("props", none))
    g.create_edge(spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4)], "eid long, src long, dst long").withColumn("props", none))
    with pytest.raises(KeyError):
        g.get_centrality({}, {})
    g.add_centrality_query({}, {})
    g.add_shortest_path_query({}, {})
    g.update_index()
    g.update_index()
    assert sum(r.score for r in g.get_centrality({}, {}).collect()) == pytest.approx(4)
    assert g.get_shortest_path(1, 4, 3, {}, {}) == [1, 2, 3, 4] and g.get_shortest_path(1, 4, 2, {}, {}) == [1, 2, 3]
    assert g.get_shortest_path(1, 4, 3, {}, {}, exact=True) == [1, 2, 3, 4] and g.get_shortest_path(1, 4, 2, {}, {}, exact=True) == [] == g.get_shortest_path(4, 1, 3, {}, {})
    players = spark.createDataFrame([("p",), ("q",)], "player string")
    for method in ("epsilon_greedy", "epsilon_decreasing", "ucb1", "softmax", "exp3", "ts"):
        s = V.Bandit(spark, f"{tmp_path}/{method}", method)
        assert s.register_arm("a") and s.register_arm("b") and not s.register_arm("a")
        chosen = s.select_arm(players)
        assert chosen.count() == 2 and {r.arm for r in chosen.collect()} <= {"a", "b"}
        s.register_reward(chosen.withColumn("reward", F.lit(1.0)))
        assert s.get_arm_info().agg(F.sum("trial_count")).first()[0] == 2
        assert s.delete_arm("a") and not s.delete_arm("a")
    w = V.Weight(spark, f"{tmp_path}/weight", {"string_rules": [{"key": "*", "type": "space", "sample_weight": "tf", "global_weight": "idf"}]})
    text = lambda i, k, t: spark.createDataFrame([(i, k, t)], "row_id string, key string, value string")
    assert w.update(text("1", "key1", "a1 b1 b1")).count() == 0
    got = w.update(text("2", "key2", "a1 a1")).collect()
    assert [round(r.value, 6) for r in got] == [round(2 * math.log(1.5), 6)]
    assert sorted(round(r.value, 6) for r in w.calc_weight(text("1", "key1", "a1 b1 b1")).collect()) == [round(math.log(1.5), 6), round(2 * math.log(1.5), 6)]
