"""Queries of burst windows, bucket indexes, coresets, graph and arm tables, versioned rows and codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fluxloom.functions import strings
from fluxloom.lineage import cut
from fluxloom.operators import bandit, burst, clustering, graph, lsh_index, similarity as S, state
from fluxloom.queries import models as M
from fluxloom.queries.catalogue import Registry
from fluxloom.queries.similarity import asked, rows
from fluxloom.sources.tables import rounded, table

query = Registry()
WINDOWS = "RECURSIVE k AS (SELECT unnest(['the', 'der', 'que', 'token']) AS keyword), o AS (SELECT DISTINCT floor(doc_id / 10)::BIGINT AS b FROM documents), w(s) AS (SELECT min(b) - 2 FROM o UNION ALL SELECT min(b) - 2 FROM w JOIN o ON b >= s + 5 GROUP BY s)"


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("double").alias("pos"), "text")


def _windowed(spark, d):
    docs = _documents(spark, d)
    placed = burst.place(docs.select("seq", "pos"), 10.0, 5)
    words = spark.createDataFrame([("the",), ("der",), ("que",), ("token",)], "keyword string")
    return burst.windowed(burst.batch_counts(burst.on_time(docs, placed, 10.0), words, 10.0), placed)


@query("w04_burst_windows", f"WITH {WINDOWS}, c AS (SELECT keyword, floor(doc_id / 10)::BIGINT AS batch, count(*) AS d, sum(contains(text, keyword)::INT)::BIGINT AS r FROM documents, k GROUP BY ALL) SELECT keyword, s AS start, batch, d, r FROM c JOIN w ON batch >= s AND batch < s + 5")
def w04(spark, d):
    return _windowed(spark, d)


@query("b02_late_documents", "SELECT doc_id AS seq FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id FROM documents WHERE doc_id = (SELECT max(doc_id) FROM documents)) l WHERE d.doc_id <> l.doc_id AND floor(d.doc_id / 10) < floor(l.doc_id / 10) - 2)")
def b02(spark, d):
    """The last document arrives first, so only those near it are on time."""
    docs = _documents(spark, d).drop("text")
    last = docs.agg(F.max("pos")).first()[0]
    docs = docs.withColumn("seq", F.when(F.col("pos") == last, -1).otherwise(F.col("seq")).cast("long"))
    return burst.on_time(docs, burst.place(docs, 10.0, 5), 10.0).select(F.col("pos").cast("long").alias("seq"))


@query("b04_reused_results")
def b04(spark, d):
    settings = spark.createDataFrame([(w, 1.2, 1.0) for w in ("the", "der", "que", "token")], "keyword string, scaling double, gamma double")
    return burst.results(_windowed(spark, d), settings, 5, 2)


@query("b06_bursted_at")
def b06(spark, d):
    found = cut(b04(spark, d))  # read for each batch asked for
    last = found.agg(F.max("batch")).first()[0]
    every = [burst.bursted_at(found, b).withColumn("batch", F.lit(b)) for b in range(0, last + 1, max(1, last // 20))]
    return reduce(lambda a, b: a.unionByName(b), every)


@query("j12_window_overlap", f"WITH {WINDOWS} SELECT a.s AS a_start, b.s + 1 AS b_start, greatest(a.s, b.s + 1) AS begin, least(a.s, b.s + 1) + 5 AS \"end\" FROM w a JOIN w b ON abs(a.s - b.s - 1) < 5")
def j12(spark, d):
    starts = burst.place(_documents(spark, d).select("seq", "pos"), 10.0, 5).select(F.explode("starts").alias("start")).distinct()
    return burst.overlap(starts, starts.select((F.col("start") + 1).alias("start")), 5)


@query("t08_burst_mix", "SELECT user_id::VARCHAR AS keyword, event_id // 500 AS start, max(n) AS d FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, event_id // 500, event_id % 3) AS n FROM events) GROUP BY ALL")
def t08(spark, d):
    found = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("keyword"), F.expr("event_id div 500").alias("start"), F.expr("event_id % 3").alias("shard")).agg(F.count("*").alias("d"))
    return burst.merge_results(found)


@query("k08_bucket_neighbours")
def k08(spark, d):
    return lsh_index.neighbours(rows(spark, d), asked(spark, d), 10, hashes=3, tables=8, width=2.0, exact=True)


@query("r05_bucket_index")
def r05(spark, d):
    return lsh_index.index(rows(spark, d)).select("row_id", "norm", F.size("buckets").alias("n_buckets"))


@query("n06_query_by_ids")
def n06(spark, d):
    """The nearest ten of every id divisible by 20, by their own signatures."""
    signed = S.lsh_signatures(rows(spark, d)).select(F.col("row_id").cast("long").alias("row_id"), "bits")
    return S.signature_top_k(signed, signed.filter("row_id % 20 = 0"), 10, ties="asc").select("query_id", "row_id", "score")


@query("k24_coreset")
def k24(spark, d):
    return clustering.coreset(M.points(spark, d), 3, 100, "id").select("id", F.col("weight"))


@query("k26_core_members", f"WITH {M.NEAREST} SELECT id FROM m WHERE center = 1")
def k26(spark, d):
    p = M.points(spark, d).withColumn("x", F.transform("x", lambda v: F.round(v, 6)))
    return clustering.members(p, M.CENTERS, [24.0, 7.5]).select("id")


def _props(name, column):
    return F.create_map(F.lit(name), F.col(column).cast("string")).alias("props")


@query("h01_update_node", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS name, CASE WHEN n_nationkey % 5 = 0 THEN n_regionkey::VARCHAR END AS region FROM nation")
def h01b(spark, d):
    n = table(spark, d, "nation")
    changed = graph.update(n.select(F.col("n_nationkey").alias("id"), _props("name", "n_name")), n.filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("id"), _props("region", "n_regionkey")))
    return changed.select("id", F.element_at("props", "name").alias("name"), F.element_at("props", "region").alias("region"))


@query("h01_create_edge", f"WITH {M.EDGES} SELECT src, dst FROM e UNION ALL SELECT n_nationkey, (n_regionkey + 20)::BIGINT FROM nation")
def h01c(spark, d):
    nodes, edges = M.net(spark, d)
    new = table(spark, d, "nation").selectExpr("cast(n_nationkey AS bigint) AS src", "cast(n_regionkey + 20 AS bigint) AS dst")
    return graph.create_edges(nodes, edges, new)


@query("h02_subgraph", "SELECT s_suppkey AS src, c_custkey AS dst FROM supplier JOIN customer ON s_suppkey = c_custkey % 7 WHERE c_nationkey = s_nationkey % 5")
def h02(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    edges = s.join(c, F.col("s_suppkey") == F.col("c_custkey") % 7).select(F.col("s_suppkey").alias("src"), F.col("c_custkey").alias("dst"), F.create_map(F.lit("same"), (F.col("c_nationkey") == F.col("s_nationkey") % 5).cast("string")).alias("props"))
    return graph.subgraph(spark.range(0).withColumn("props", F.create_map(F.lit("a"), F.lit("b"))), edges, None, {"same": "true"})[1].select("src", "dst")


@query("t09_graph_mix", "SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'two' WHEN c_custkey % 2 = 0 THEN 'one' ELSE c_name END AS name FROM customer")
def t09(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return graph.merge_graphs(c, c.filter("id % 2 = 0").withColumn("name", F.lit("one")), c.filter("id % 6 = 0").withColumn("name", F.lit("two")))


@query("m01_register_arm", f"WITH {M.ARMS} SELECT player, arm, n AS trial_count FROM x UNION ALL SELECT DISTINCT player, 'new', 0 FROM x")
def m01(spark, d):
    return bandit.register_arms(M.arms(spark, d), ["new"]).select("player", "arm", "trial_count")


@query("m01_delete_arm", f"WITH {M.ARMS} SELECT player, sum(n)::BIGINT AS trials FROM x WHERE arm <> 'click' GROUP BY player")
def m01b(spark, d):
    return bandit.delete_arm(M.arms(spark, d), "click").groupBy("player").agg(F.sum("trial_count").alias("trials"))


@query("t06_push_pull", "SELECT o_orderkey AS key, o_custkey AS owner, o_orderkey % 97 + CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 97 > 40 THEN 1 ELSE 0 END AS clock FROM orders")
def t06(spark, d):
    mine = table(spark, d, "orders").selectExpr("o_orderkey AS key", "o_custkey AS owner", "o_orderkey % 97 AS clock")
    theirs = mine.filter("key % 3 = 0").withColumn("clock", F.col("clock") + F.expr("if(key % 97 > 40, 1, -1)"))
    return state.accept(mine, theirs)


@query("t03_apply_difference", "SELECT c_mktsegment AS feature, count(*) + 10 * sum((c_nationkey = 3)::INT)::BIGINT AS n FROM customer GROUP BY ALL")
def t03(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_mktsegment", "feature")
    master, diff = c.groupBy("feature").agg(F.count("*").alias("n")), c.filter("c_nationkey = 3").groupBy("feature").agg((F.count("*") * 10).alias("n"))
    return state.apply_difference(master, 4, diff, 4, ["feature"], ["n"])[0]


@query("z06_bit_codes", "SELECT p_partkey, repeat('0', length(bin(p_partkey + 1)) - 1) || bin(p_partkey + 1) AS gamma FROM part")
def z06(spark, d):
    return table(spark, d, "part").select("p_partkey", strings.gamma_code(F.col("p_partkey") + 1).alias("gamma"))


@query("z09_intern", "SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS id FROM (SELECT DISTINCT c_name FROM customer)")
def z09(spark, d):
    return strings.intern(table(spark, d, "customer"), "c_name")


@query("z14_lexical_cast", "SELECT c_custkey, c_custkey::VARCHAR AS text, (c_custkey::VARCHAR)::DOUBLE AS number FROM customer")
def z14(spark, d):
    return rounded(table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("text"), F.col("c_custkey").cast("string").cast("double").alias("number")), number=6)
