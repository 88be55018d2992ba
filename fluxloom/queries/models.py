"""Queries of sources, joins, graphs, clusters, bandits, bursts, learners, merges and bounded state."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxloom import services as V
from fluxloom.lineage import scratch
from fluxloom.operators import bandit, burst, clustering, features as X, graph, learners, state
from fluxloom.queries.catalogue import Registry
from fluxloom.sources import records
from fluxloom.sources.tables import rounded, table
from fluxloom.streaming import processors

query = Registry()


@query("s01_json_datum", "SELECT event_id AS row_id, '/k' AS key, (props->>'$.k')::DOUBLE AS num_value FROM events")
def s01(spark, d):
    return records.from_flat_json(table(spark, d, "events"), "event_id", "props").drop("string_value")


@query("s01_json_datum_deep", "SELECT event_id AS row_id, '/a/k' AS key, (props->>'$.k')::DOUBLE AS num_value, NULL::VARCHAR AS string_value FROM events UNION ALL SELECT event_id, '/a/l[1]', NULL, event_type FROM events UNION ALL SELECT event_id, '/a/l[0]', 1, NULL FROM events")
def s01b(spark, d):
    e = table(spark, d, "events").withColumn("j", F.concat(F.lit('{"a":{"k":'), F.get_json_object("props", "$.k"), F.lit(',"l":[true,"'), "event_type", F.lit('"]}}')))
    return records.from_json(e, "event_id", "j")


@query("s03_libsvm", "SELECT p_partkey AS row_id, p_brand AS label, unnest(['1', '2']) AS key, unnest([p_size::DOUBLE, p_retailprice]) AS num_value FROM part")
def s03(spark, d):
    p = table(spark, d, "part").withColumn("line", F.concat_ws(" ", F.translate("p_brand", " ", "_"), F.concat(F.lit("1:"), "p_size"), F.concat(F.lit("2:"), "p_retailprice")))
    return records.from_libsvm(p, "p_partkey", "line")


@query("s04_csv", "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def s04(spark, d):
    c = table(spark, d, "customer").withColumn("line", F.concat(F.lit('"'), "c_name", F.lit('",'), "c_mktsegment"))
    return c.withColumn("f", records.csv_fields(F.col("line"), 2)).select("c_custkey", F.col("f.c0").alias("name"), F.col("f.c1").alias("segment"))


@query("s05_json_merge", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 7 ELSE (props->>'$.k')::BIGINT END AS k, event_type AS t FROM events")
def s05(spark, d):
    """Two objects of each event; of a key that both have the second's value stays."""
    other = F.concat(F.lit('{"t":"'), F.col("event_type"), F.lit('"'), F.when(F.col("event_id") % 2 == 0, ',"k":7').otherwise(""), F.lit("}"))
    return table(spark, d, "events").select("event_id", state.merge_json(F.col("props"), other).alias("j")).select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"), F.get_json_object("j", "$.t").alias("t"))


@query("s10_status", "SELECT 'num_rows' AS key, count(*)::VARCHAR AS value FROM customer UNION ALL SELECT 'rows_version', '1'")
def s10(spark, d):
    held = V.Recommender(spark, scratch(spark, "s10"))
    held.update_row(table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.lit("balance").alias("feature"), F.col("c_acctbal").alias("value")))
    return spark.createDataFrame(sorted(held.get_status().items()), "key string, value string")


@query("s13_html_encode", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#039;')) AS h FROM pages")
def s13(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(records.html_encode(F.col("html"))).alias("h"))


@query("s13_element", "SELECT n_nationkey, '<li class=\"n' || n_regionkey || '\"><b>' || n_name || '</b><br /></li>' AS markup FROM nation")
def s13b(spark, d):
    inner = records.html_element("b", {}, records.html_encode(F.col("n_name")))
    item = records.html_element("li", {"class": F.concat(F.lit("n"), F.col("n_regionkey").cast("string"))}, inner, records.html_element("br", {}))
    return table(spark, d, "nation").select("n_nationkey", item.alias("markup"))


@query("s14_table_upsert", "SELECT o_custkey AS key, max(o_orderkey) AS clock, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY o_custkey")
def s14(spark, d):
    return state.latest(table(spark, d, "orders").selectExpr("o_custkey AS key", "o_orderkey AS clock", "o_totalprice AS value"), "key", "clock")


@query("s14_exact_match", "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey % 20 = 0")
def s14b(spark, d):
    held = table(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS name")
    return state.exact_match(held, held.filter("key % 20 = 0"))


@query("s14_update_delete", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 101 ELSE o_orderkey % 100 + CASE WHEN o_orderkey % 100 = 0 THEN 100 ELSE 0 END END::BIGINT AS clock, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS value FROM orders WHERE o_orderkey % 5 <> 0")
def s14c(spark, d):
    held = table(spark, d, "orders").selectExpr("o_orderkey AS key", "cast(if(o_orderkey % 100 = 0, 100, o_orderkey % 100) AS bigint) AS clock", "o_totalprice AS value")
    changed = state.update_rows(held, held.filter("key % 3 = 0").selectExpr("key", "-value AS value"))
    return state.delete_rows(changed, held.filter("key % 5 = 0"))


@query("p09_property_predicate", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def p09(spark, d):
    props = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").filter(graph.has_properties(props, {"segment": "BUILDING", "nation": "3"})).select("c_custkey")


@query("a06_labels_count", "SELECT quality::VARCHAR AS label, count(*) AS n FROM labels GROUP BY ALL")
def a06(spark, d):
    known = V.Classifier(spark, scratch(spark, "a06"), "cosine")
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("row_id"), F.col("quality").cast("string").alias("label"), F.col("doc_id").alias("seq"))
    known.train(rows.select("row_id", F.lit("one").alias("feature"), F.lit(1.0).alias("value")), rows)
    return known.get_labels()


# bandits: players are users, arms are event types
ARMS = "a AS (SELECT user_id AS player, event_type AS arm, count(*) AS n, sum((value > 50)::INT)::DOUBLE AS w FROM events GROUP BY ALL), x AS (SELECT *, w / n AS e FROM a)"


def arms(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("player"), F.col("event_type").alias("arm"), F.lit("reward").alias("kind"), (F.col("value") > 50).cast("double").alias("reward"))
    return bandit.sums(e)


@query("a08_bandit_sums", f"WITH {ARMS} SELECT player, arm, n AS trial_count, w AS weight, round(e, 6) AS expectation FROM x")
def a08(spark, d):
    return rounded(arms(spark, d), expectation=6)


@query("m03_greedy_arm", f"WITH {ARMS} SELECT player, arm FROM x QUALIFY row_number() OVER (PARTITION BY player ORDER BY e DESC, arm) = 1")
def m03(spark, d):
    return bandit.greedy(arms(spark, d))


@query("m03_epsilon_zero", f"WITH {ARMS} SELECT player, arm FROM x QUALIFY row_number() OVER (PARTITION BY player ORDER BY e DESC, arm) = 1")
def m03c(spark, d):
    return bandit.epsilon_greedy(arms(spark, d), 0.0)


@query("m04_decreasing_epsilon", f"WITH {ARMS} SELECT player, round(least(1.0, 5 * count(*) * (ln(sum(n) + 1) / (sum(n) + 1)) / 0.81), 6)::DOUBLE AS epsilon FROM x GROUP BY player")
def m04(spark, d):
    return rounded(bandit.decreasing_epsilon(arms(spark, d), 0.9), epsilon=6)


@query("m05_ucb1_arm", f"WITH {ARMS} SELECT player, arm FROM (SELECT *, round(e + sqrt(2 * ln(sum(n) OVER (PARTITION BY player)) / n), 9) AS v FROM x) QUALIFY row_number() OVER (PARTITION BY player ORDER BY v DESC, arm) = 1")
def m05(spark, d):
    return bandit.ucb1(arms(spark, d))


@query("m06_softmax", f"WITH {ARMS} SELECT player, arm, round(exp(e / 0.5) / sum(exp(e / 0.5)) OVER (PARTITION BY player), 6) AS probability FROM x")
def m06(spark, d):
    return rounded(bandit.softmax(arms(spark, d), 0.5), probability=6)


@query("m07_exp3_probability", f"WITH {ARMS} SELECT player, arm, round(0.9 * exp(w) / sum(exp(w)) OVER (PARTITION BY player) + 0.1 / count(*) OVER (PARTITION BY player), 6) AS probability FROM x")
def m07(spark, d):
    return rounded(bandit.exp3_probabilities(arms(spark, d), 0.1), probability=6)


@query("m08_thompson_arm")
def m08(spark, d):
    return bandit.thompson(arms(spark, d))


@query("m03_epsilon_greedy")
def m03b(spark, d):
    return bandit.epsilon_greedy(arms(spark, d), 0.1)


# bursts: positions are document ids, batches of 100
WORDS = "k AS (SELECT unnest(['the', 'der', 'que', 'token']) AS keyword)"


def counts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("double").alias("pos"), "text")
    return burst.batch_counts(docs, spark.createDataFrame([("the",), ("der",), ("que",), ("token",)], "keyword string"), 100.0)


@query("a07_burst_counts", f"WITH {WORDS} SELECT keyword, floor(doc_id / 100)::BIGINT AS batch, count(*) AS d, sum(contains(text, keyword)::INT)::BIGINT AS r FROM documents, k GROUP BY ALL")
def a07(spark, d):
    return counts(spark, d)


@query("b03_burst_detection")
def b03(spark, d):
    settings = spark.createDataFrame([(w, 1.2, 1.0) for w in ("the", "der", "que", "token")], "keyword string, scaling double, gamma double")
    return burst.window_bursts(counts(spark, d), settings)


@query("b05_result_retention", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3")
def b05(spark, d):
    return state.top_results(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


# the graph of nations: an edge for each pair of customer's and supplier's nation in an order
EDGES = "e AS (SELECT DISTINCT (c_custkey % 25)::BIGINT AS src, ((c_custkey * 7 + c_nationkey) % 25)::BIGINT AS dst FROM customer WHERE c_custkey % 25 <> 4)"


def net(spark, d):
    nodes = table(spark, d, "nation").selectExpr("cast(n_nationkey AS bigint) AS id")
    edges = table(spark, d, "customer").filter("c_custkey % 25 <> 4").selectExpr("c_custkey % 25 AS src", "(c_custkey * 7 + c_nationkey) % 25 AS dst").distinct()
    return nodes, edges


def _round_sql(prior, name):
    return f"""dn{name} AS (SELECT coalesce(sum(s), 0) / 25 AS g FROM {prior} WHERE id NOT IN (SELECT src FROM e)),
    sh{name} AS (SELECT dst AS id, sum(s / deg) AS got FROM e JOIN (SELECT src, count(*) AS deg FROM e GROUP BY src) USING (src) JOIN {prior} ON id = src GROUP BY dst),
    un{name} AS (SELECT n.id, 0.9 * coalesce(got, 0) + 0.1 + 0.9 * g AS s FROM n LEFT JOIN sh{name} USING (id), dn{name}),
    r{name} AS (SELECT id, s * 25 / sum(s) OVER () AS s FROM un{name})"""


@query("h03_centrality", f"WITH {EDGES}, n AS (SELECT n_nationkey::BIGINT AS id FROM nation), r0 AS (SELECT id, 1.0::DOUBLE AS s FROM n), {_round_sql('r0', '1')}, {_round_sql('r1', '2')}, {_round_sql('r2', '3')} SELECT id, round(s, 6) AS score FROM r3")
def h03(spark, d):
    return rounded(graph.centrality(*net(spark, d), 0.9, 3), score=6)


@query("h04_bounded_distances", f"WITH RECURSIVE {EDGES}, b(id, hops) AS (SELECT 2::BIGINT, 0 UNION SELECT dst, hops + 1 FROM b JOIN e ON src = id WHERE hops < 4) SELECT id, min(hops) AS hops FROM b GROUP BY id")
def h04(spark, d):
    return graph.distances(net(spark, d)[1], 2, 4)


@query("h04_landmark_distance", f"WITH RECURSIVE {EDGES}, b(id, hops) AS (SELECT 2::BIGINT, 0 UNION SELECT dst, hops + 1 FROM b JOIN e ON src = id WHERE hops < 4), c(id, hops) AS (SELECT 2::BIGINT, 0 UNION SELECT src, hops + 1 FROM c JOIN e ON dst = id WHERE hops < 4) SELECT id, min(b.hops) AS from_, min(c.hops) AS \"to\" FROM b FULL JOIN c USING (id) GROUP BY id")
def h04b(spark, d):
    return graph.landmark_distance(net(spark, d)[1], 2, 4)


@query("h01_remove_node", "SELECT n_nationkey AS id FROM nation UNION ALL SELECT n_nationkey + 100 FROM nation WHERE n_nationkey % 3 <> 0")
def h01(spark, d):
    """Nodes without edges go; those of the graph of nations stay."""
    nodes, edges = net(spark, d)
    more = nodes.unionByName(nodes.selectExpr("id + 100 AS id"))
    return graph.remove_nodes(more, edges, nodes.filter("id % 3 = 0").selectExpr("id + 100 AS id"))


@query("h04_ten_hops", f"WITH RECURSIVE {EDGES}, b(id, hops) AS (SELECT 2::BIGINT, 0 UNION SELECT dst, hops + 1 FROM b JOIN e ON src = id WHERE hops < 10) SELECT id, min(hops) AS hops FROM b GROUP BY id")
def h04c(spark, d):
    return graph.distances(net(spark, d)[1], 2, 10)


@query("h04_landmark_trees", f"WITH RECURSIVE {EDGES}, b(root, id, hops) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0 FROM nation WHERE n_nationkey < 2 UNION SELECT root, dst, hops + 1 FROM b JOIN e ON src = id WHERE hops < 3), c(root, id, hops) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0 FROM nation WHERE n_nationkey < 2 UNION SELECT root, src, hops + 1 FROM c JOIN e ON dst = id WHERE hops < 3) SELECT root AS landmark, id, min(b.hops) AS from_, min(c.hops) AS \"to\" FROM b FULL JOIN c USING (root, id) GROUP BY ALL")
def h04d(spark, d):
    return graph.landmark_trees(*net(spark, d), 2, 3)


def points(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array(F.max("l_quantity"), F.max("l_discount") * 100).alias("x")).withColumn("weight", F.lit(1.0))


PTS = "p AS (SELECT l_orderkey AS id, max(l_quantity) AS a, max(l_discount) * 100 AS b FROM lineitem GROUP BY 1)"
CENTERS = [[10.0, 2.0], [25.0, 8.0], [40.0, 5.0]]
NEAREST = f"{PTS}, m AS (SELECT id, a, b, list_position(l, list_min(l)) - 1 AS center FROM (SELECT *, [round((a - 10) * (a - 10) + (b - 2) * (b - 2), 9), round((a - 25) * (a - 25) + (b - 8) * (b - 8), 9), round((a - 40) * (a - 40) + (b - 5) * (b - 5), 9)] AS l FROM p))"


@query("j07_nearest_center", f"WITH {NEAREST} SELECT center, count(*) AS n FROM m GROUP BY center")
def j07(spark, d):
    p = points(spark, d).withColumn("x", F.transform("x", lambda v: F.round(v, 6)))
    return clustering.assign(p, CENTERS).groupBy("center").agg(F.count("*").alias("n"))


@query("a10_centroids", f"WITH {NEAREST} SELECT center, 0 AS \"at\", round(avg(a), 4) AS value FROM m GROUP BY center UNION ALL SELECT center, 1, round(avg(b), 4) FROM m GROUP BY center")
def a10(spark, d):
    p = points(spark, d).withColumn("x", F.transform("x", lambda v: F.round(v, 6)))
    return rounded(clustering.centroids(clustering.assign(p, CENTERS)), value=4)


@query("k20_kmeans")
def k20(spark, d):
    centers = clustering.kmeans(points(spark, d), 3, "id")
    return spark.createDataFrame([(k, c) for k, c in enumerate(centers)], "center int, x array<double>")


@query("k20_lloyd_step", f"WITH {NEAREST} SELECT center, round(avg(a), 4) AS x0, round(avg(b), 4) AS x1 FROM m GROUP BY center")
def k20b(spark, d):
    """One step from given centers."""
    p = points(spark, d).withColumn("x", F.transform("x", lambda v: F.round(v, 6)))
    centers = clustering.kmeans(p, 3, "id", rounds=1, start=CENTERS)
    return spark.createDataFrame([(k, round(x, 4), round(y, 4)) for k, (x, y) in enumerate(centers)], "center int, x0 double, x1 double")


@query("j07_nearest_center_cosine", f"WITH {PTS}, q AS (SELECT id, [round(1 - (10 * a + 2 * b) / (sqrt(104) * sqrt(a * a + b * b)), 9), round(1 - (25 * a + 8 * b) / (sqrt(689) * sqrt(a * a + b * b)), 9), round(1 - (40 * a + 5 * b) / (sqrt(1625) * sqrt(a * a + b * b)), 9)] AS l FROM p) SELECT list_position(l, list_min(l)) - 1 AS center, count(*) AS n FROM q GROUP BY 1")
def j07b(spark, d):
    return clustering.assign(points(spark, d), CENTERS, kind="cosine").groupBy("center").agg(F.count("*").alias("n"))


@query("k21_gmm")
def k21(spark, d):
    means, _ = clustering.gmm(points(spark, d), 2, "id")
    return spark.createDataFrame([(k, m.tolist()) for k, m in enumerate(means)], "center int, mean array<double>")


def _dbscan(name, x, gap, eps, made, kind="euclidean"):
    sql = f"""WITH RECURSIVE p AS (SELECT s_suppkey AS id, {x} FROM supplier), g AS (SELECT q.id, r.id AS o FROM p q, p r WHERE {gap} < {eps}),
  core AS (SELECT id FROM g GROUP BY id HAVING count(*) >= 4), l AS (SELECT g.id, g.o FROM g JOIN core USING (id) JOIN core c2 ON c2.id = o), t(id, o) AS (SELECT id, id FROM core UNION SELECT t.id, l.o FROM t JOIN l ON l.id = t.o),
  c AS (SELECT id, min(o) AS cluster FROM t GROUP BY id), b AS (SELECT g.id, min(cluster) AS cluster FROM g JOIN c ON c.id = g.o GROUP BY g.id) SELECT id, cluster FROM b WHERE cluster IN (SELECT cluster FROM b GROUP BY cluster HAVING count(*) >= 4)"""

    @query(name, sql)
    def run(spark, d):
        p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array(*map(F.expr, made)).alias("x"))
        return clustering.dbscan(p, eps, 4, kind=kind)


BALANCE, NATION = "s_acctbal / 100", "cast(s_nationkey AS double)"
_dbscan("k22_dbscan", "s_acctbal / 100 AS a, s_nationkey::DOUBLE AS b", "sqrt((q.a - r.a) * (q.a - r.a) + (q.b - r.b) * (q.b - r.b))", 6.0, [BALANCE, NATION])
_dbscan("k22_dbscan_one_dimension", "s_acctbal / 100 AS a", "abs(q.a - r.a)", 0.5, [BALANCE])
_dbscan("k22_dbscan_cosine", "s_acctbal / 100 AS a, s_nationkey + 1.0 AS b", "1 - (q.a * r.a + q.b * r.b) / (sqrt(q.a * q.a + q.b * q.b) * sqrt(r.a * r.a + r.b * r.b))", 0.0003, [BALANCE, NATION + " + 1D"], "cosine")


# learners: quality and price
def quality_rows(spark, d):
    """Labelled documents with the features of a converter: language, length and share of signs."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    n = F.greatest(F.lit(1), F.char_length("text"))
    nums = docs.select(F.col("doc_id").alias("row_id"), F.explode(F.create_map(F.lit("signs"), (n - F.char_length(F.translate("text", "#*$%&|", ""))) / n * 10, F.lit("length"), F.char_length("text").cast("double"))).alias("key", "value"))
    made = X.Converter([X.StringRule("str")], [X.NumRule("num", "signs"), X.NumRule("log", "length")]).convert(docs.select(F.col("doc_id").alias("row_id"), F.lit("lang").alias("key"), F.col("lang").alias("value")), nums)
    held = made.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("features"))
    return docs.select(F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("target")).join(held, "row_id").withColumnRenamed("row_id", "seq")


def _learner(name, method, shards=1):
    @query(name)
    def run(spark, d):
        return learners.train(quality_rows(spark, d), lambda: learners.Classifier(method), shards)


_learner("c06_train_arow_documents", "AROW")
_learner("t02_train_mixed", "AROW", 4)


@query("g02_train_pa_parts")
def g02(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), (F.col("p_retailprice") / 1000).alias("target"), F.create_map(F.lit("size"), F.col("p_size") / 50, F.lit("bias"), F.lit(1.0)).alias("features"))
    return learners.train(rows, lambda: learners.Regression("PA"))


MODEL = "m AS (SELECT 'f' || i AS feature, j::VARCHAR AS label, (((i * 7 + j * 3) % 11) - 5)::DOUBLE AS v1 FROM range(64) a(i), range(3) b(j) WHERE (i + j) % 2 = 0)"


def model(spark):
    return spark.range(64).selectExpr("id AS i", "explode(array(0L, 1L, 2L)) AS j").filter("(i + j) % 2 = 0").selectExpr("concat('f', i) AS feature", "cast(j AS string) AS label", "cast((i * 7 + j * 3) % 11 - 5 AS double) AS v1", "1D AS v2")


@query("c11_classify_linear", f"WITH {MODEL}, f AS (SELECT vec_id AS row_id, 'f' || (i - 1) AS feature, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i)), s AS (SELECT row_id, label, sum(value * v1) AS s FROM f JOIN m USING (feature) GROUP BY ALL) SELECT vec_id AS row_id, k.label, round(coalesce(s, 0), 4) AS score FROM embeddings CROSS JOIN (SELECT unnest(['0', '1', '2', '9']) AS label) k LEFT JOIN s ON s.row_id = vec_id AND s.label = k.label")
def c11(spark, d):
    from fluxloom.queries.similarity import rows

    known = spark.range(4).selectExpr("if(id = 3, '9', cast(id AS string)) AS label")
    return rounded(learners.classify(rows(spark, d), model(spark), known), score=4)


@query("c12_delete_label", f"WITH {MODEL} SELECT feature, label FROM m WHERE label <> '1'")
def c12(spark, d):
    held = V.Classifier(spark, scratch(spark, "c12"), "AROW")
    held.put("weights", model(spark))
    held.put("labels", model(spark).groupBy("label").agg(F.count("*").alias("n")))
    held.delete_label("1")
    return held.get("weights").select("feature", "label")


@query("k10_largest_incorrect", f"WITH {MODEL}, f AS (SELECT vec_id AS row_id, label AS own, 'f' || (i - 1) AS feature, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i)), s AS (SELECT row_id, own, label, sum(value * v1) AS s FROM f JOIN m USING (feature) GROUP BY ALL) SELECT row_id, arg_max(label, s) AS label, round(max(s), 4) AS score FROM s WHERE label <> (own % 3)::VARCHAR GROUP BY row_id")
def k10(spark, d):
    from fluxloom.queries.similarity import rows

    scores = learners.classify(rows(spark, d), model(spark), spark.range(3).selectExpr("cast(id AS string) AS label"))
    return rounded(learners.largest_incorrect(scores, table(spark, d, "embeddings").selectExpr("vec_id AS row_id", "cast(label % 3 AS string) AS label")), score=4)


@query("t02_linear_mix", "SELECT event_type AS feature, '+' AS label, round(sum(v) / 4, 4) AS v1, round(least(1, min(c)), 6) AS v2 FROM (SELECT event_type, user_id % 4 AS shard, sum(value) AS v, min(value) / 1000 AS c FROM events GROUP BY ALL) GROUP BY event_type")
def t02(spark, d):
    parts = table(spark, d, "events").groupBy(F.col("event_type").alias("feature"), F.expr("user_id % 4").alias("shard")).agg(F.sum("value").alias("v1"), (F.min("value") / 1000).alias("v2")).withColumn("label", F.lit("+"))
    return rounded(learners.mix(parts, 4), v1=4, v2=6)


@query("t04_additive_mix", "SELECT event_type, sum(n)::BIGINT AS n, round(sum(s), 3) AS s FROM (SELECT event_type, user_id % 8 AS shard, count(*) AS n, sum(value) AS s FROM events GROUP BY ALL) GROUP BY event_type")
def t04(spark, d):
    parts = table(spark, d, "events").groupBy("event_type", F.expr("user_id % 8").alias("shard")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return rounded(state.add_up(parts, ["event_type"], ["n", "s"]), s=3)


@query("t05_overwrite_mix", "SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, -c_acctbal FROM customer WHERE c_custkey % 6 = 0")
def t05(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_acctbal AS v")
    return state.overlay(c, c.filter("id % 3 = 0").selectExpr("id", "-v AS v", "id % 6 <> 0 AS gone"), "id", "gone")


@query("t14_unlearner_lru", "WITH l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY 1), s AS (SELECT * FROM l WHERE prefix(user_id::VARCHAR, '1')) SELECT * FROM s UNION ALL (SELECT * FROM l WHERE NOT prefix(user_id::VARCHAR, '1') ORDER BY last DESC, user_id LIMIT (SELECT greatest(0, 60 - count(*)) FROM s))")
def t14(spark, d):
    return state.keep_recent(table(spark, d, "events"), "user_id", "event_id", 60, "1*")


@query("t15_unlearner_random")
def t15(spark, d):
    return state.keep_random(table(spark, d, "events"), "user_id", 25)


@query("t11_tumbling_windows", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def t11(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = processors.tumbling(e, "ts", "event_type", "value", "1 hour", "1 day")
    return rounded(w.withColumn("start", F.unix_timestamp("start")), total=3)


@query("w03_running_deviation", "SELECT event_id, round(stddev_pop(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 3) AS deviation FROM events")
def w03(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    return rounded(learners.running_deviation(e, "event_type", ["ts", "event_id"], "value").select("event_id", "deviation"), deviation=3)


@query("t05_first_kept", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS v FROM customer WHERE c_custkey % 5 <> 0")
def t05b(spark, d):
    """Of outlier entries the first one stays, unless a tombstone comes from anywhere."""
    c = table(spark, d, "customer").selectExpr("c_custkey AS id")
    first, second = c.filter("id % 2 = 0").selectExpr("id", "'a' AS v", "false AS gone"), c.selectExpr("id", "'b' AS v", "id % 5 = 0 AS gone")
    return state.first_kept(first, second, key="id", tombstone="gone")


@query("t07_clustering_mix", "SELECT node, count(*) AS n, min(v) AS v FROM (SELECT c_nationkey % 3 AS node, c_custkey AS id, CASE WHEN c_nationkey % 3 = 1 THEN 'new' ELSE 'old' END AS v FROM customer) GROUP BY ALL")
def t07(spark, d):
    old = table(spark, d, "customer").selectExpr("c_nationkey % 3 AS node", "c_custkey AS id", "'old' AS v")
    return clustering.mix_coresets(old, old.filter("node = 1").withColumn("v", F.lit("new"))).groupBy("node").agg(F.count("*").alias("n"), F.min("v").alias("v"))


@query("z02_edit_distance", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b USING (n_regionkey)")
def z02(spark, d):
    n = table(spark, d, "nation")
    return n.alias("a").join(n.alias("b"), "n_regionkey").select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), F.levenshtein("a.n_name", "b.n_name").cast("long").alias("distance"))


@query("z05_digests", "SELECT c_custkey, md5(c_name) AS m, base64(c_name::BLOB) AS b FROM customer")
def z05(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.base64("c_name").alias("b"))


@query("z01_strings", "SELECT c_custkey, array_to_string(string_split(c_name, '#'), '-') AS joined, trim(c_name || '  ') AS stripped, starts_with(c_name, 'C') AS starts FROM customer")
def z01(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.split("c_name", "#"), "-").alias("joined"), F.trim(F.concat("c_name", F.lit("  "))).alias("stripped"), F.startswith("c_name", F.lit("C")).alias("starts"))


@query("z08_prefix_sums", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 3) AS s FROM events")
def z08(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(Window.partitionBy("user_id").orderBy("event_id")), 3).alias("s"))
