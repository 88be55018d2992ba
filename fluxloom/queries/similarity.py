"""Queries of similarity search, neighbour learners and outliers over embeddings. Queries are ids divisible by 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom import services
from fluxloom.lineage import cut, scratch
from fluxloom.operators import anomaly, similarity as S
from fluxloom.queries.catalogue import Registry
from fluxloom.sources.tables import rounded, table

query = Registry()
V = "v AS (SELECT vec_id AS row_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
PAIRS = f"""{V}, p AS (SELECT q.row_id AS query_id, r.row_id, r.label, list_dot_product(q.e, r.e) AS dot, sqrt(list_dot_product(q.e, q.e)) AS qn, sqrt(list_dot_product(r.e, r.e)) AS rn
  FROM v q, v r WHERE q.row_id % 20 = 0)"""
COS = f"WITH {PAIRS}, s AS (SELECT query_id, row_id, label, greatest(-1, least(1, dot / (qn * rn))) AS score FROM p WHERE dot <> 0)"
EUC = f"WITH {PAIRS}, s AS (SELECT query_id, row_id, label, -sqrt(greatest(0, qn * qn + rn * rn - 2 * dot)) AS score FROM p)"
TOP = ", t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id DESC) AS rank FROM s)"


def rows(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("at", "x")).select("row_id", F.concat(F.lit("f"), "at").alias("feature"), F.col("x").cast("double").alias("value"))


def asked(spark, d):
    return rows(spark, d).filter("row_id % 20 = 0")


def labels(spark, d):
    return table(spark, d, "embeddings").selectExpr("vec_id AS row_id", "label")


def dense(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"))


def nearest(spark, d, kind, k, **more):
    """query_id, row_id, score, rank (with a k) for the ids divisible by 20, against all rows."""
    points = dense(spark, d)
    return S.dense_top_k(points, points.filter("row_id % 20 = 0"), k, kind, **more)


@query("f28_l2_norm", f"WITH {V} SELECT row_id, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM v")
def f28(spark, d):
    return rounded(S.norms(rows(spark, d)), norm=6)


def next_rows(spark, d):
    """Each row under the id before it."""
    return rows(spark, d).withColumn("row_id", F.col("row_id") - 1)


@query("f29_pair_cosine", f"WITH {V} SELECT a.row_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON b.row_id = a.row_id + 1")
def f29(spark, d):
    return rounded(S.pair_cosines(rows(spark, d), next_rows(spark, d)), similarity=6)


@query("f30_distances", f"{EUC}{TOP} SELECT query_id, row_id, round(-score, 4) AS distance FROM t WHERE rank <= 11 AND row_id <> query_id")
def f30(spark, d):
    return nearest(spark, d, "euclidean", 11).filter("row_id <> query_id").select("query_id", "row_id", F.round(-F.col("score"), 4).alias("distance"))


@query("f30_cosine_distance", f"WITH {V} SELECT a.row_id, round(1 - list_cosine_similarity(a.e, b.e), 6) AS distance FROM v a JOIN v b ON b.row_id = a.row_id + 1")
def f30b(spark, d):
    pairs = S.pair_cosines(rows(spark, d), next_rows(spark, d))
    return rounded(pairs.select("row_id", S.cosine_distance(F.col("similarity")).alias("distance")), distance=6)


@query("f31_sparse_algebra", f"WITH {V} SELECT a.row_id, 'f' || (i - 1) AS feature, round(a.e[i] + 2 * b.e[i], 6) AS value FROM v a JOIN v b ON b.row_id = a.row_id + 1, range(1, 65) t(i) WHERE a.e[i] + 2 * b.e[i] <> 0")
def f31(spark, d):
    r = rows(spark, d)
    last = r.agg(F.max("row_id")).first()[0]
    return rounded(S.combine(r.filter(F.col("row_id") < last), next_rows(spark, d).filter("row_id >= 0"), 1.0, 2.0), value=6)


@query("k02_cosine_top_k", f"{COS}{TOP} SELECT query_id, row_id, rank, round(score, 6) AS score FROM t WHERE rank <= 10")
def k02(spark, d):
    return rounded(nearest(spark, d, "cosine", 10).select("query_id", "row_id", F.col("rank").cast("long").alias("rank"), "score"), score=6)


@query("j02_sparse_cosine", f"{COS}{TOP} SELECT query_id, row_id, round(score, 6) AS score FROM t WHERE rank <= 10")
def j02(spark, d):
    """The same for sparse rows."""
    return rounded(S.cosine_scores(rows(spark, d), asked(spark, d), 10).select("query_id", "row_id", "score"), score=6)


@query("k03_euclid_top_k", f"{EUC}{TOP} SELECT query_id, row_id, rank FROM t WHERE rank <= 10")
def k03(spark, d):
    return nearest(spark, d, "euclidean", 10).select("query_id", "row_id", F.col("rank").cast("long").alias("rank"))


@query("k04_euclid_ignore_orthogonal", f"{EUC}{TOP} SELECT query_id, row_id, round(score, 4) AS score FROM t WHERE rank <= 5 AND row_id <> query_id")
def k04(spark, d):
    return rounded(nearest(spark, d, "euclidean", 5, ignore_orthogonal=True).filter("row_id <> query_id").select("query_id", "row_id", "score"), score=4)


@query("k09_similar_rate", f"{COS}{TOP} SELECT query_id, row_id FROM t WHERE rank <= ceil((SELECT count(*) FROM embeddings) * 0.03)")
def k09(spark, d):
    return nearest(spark, d, "cosine", S.rate_k(0.03, table(spark, d, "embeddings").count())).select("query_id", "row_id")


@query("p10_similar_score", f"{COS} SELECT query_id, row_id FROM s WHERE score >= 0.25")
def p10(spark, d):
    return nearest(spark, d, "cosine", None, least=0.25).select("query_id", "row_id")


def recommender(spark, d, name):
    """A recommender that holds the embeddings, with features f0 to f63."""
    held = services.Recommender(spark, scratch(spark, name))
    held.update_row(rows(spark, d).withColumn("feature", F.concat("feature", F.lit("@num"))))
    return held


@query("p12_all_rows", "SELECT vec_id::VARCHAR AS row_id FROM embeddings")
def p12(spark, d):
    return recommender(spark, d, "p12").get_all_rows()


@query("p13_decode_row", "SELECT vec_id::VARCHAR AS row_id, 'f' || (i - 1) AS key, round(embedding[i]::DOUBLE, 6) AS num_value FROM embeddings, range(1, 65) t(i)")
def p13(spark, d):
    held = recommender(spark, d, "p13")
    return rounded(held.decode_row(held.get_all_rows()).select("row_id", "key", "num_value"), num_value=6)


@query("r09_clear_row", "SELECT vec_id::VARCHAR AS row_id FROM embeddings WHERE vec_id % 7 <> 0")
def r09(spark, d):
    held = recommender(spark, d, "r09")
    held.clear_row(table(spark, d, "embeddings").filter("vec_id % 7 = 0").selectExpr("vec_id AS row_id"))
    return held.get_all_rows()


@query("a09_complete_row", f"{COS}{TOP}, m AS (SELECT t.query_id, i, avg(v.e[i]) AS value FROM t JOIN v USING (row_id), range(1, 65) g(i) WHERE rank <= 128 GROUP BY ALL) SELECT query_id, 'f' || (i - 1) AS feature, round(value, 5) AS value FROM m")
def a09(spark, d):
    return rounded(S.complete(nearest(spark, d, "cosine", 128), rows(spark, d)), value=5)


def _vote(name, head, kind, distance):
    @query(name, f"{head}{TOP}, l AS (SELECT DISTINCT label FROM embeddings), q AS (SELECT DISTINCT query_id FROM t), n AS (SELECT query_id, label, sum(exp(-2 * ({distance}))) AS s FROM t WHERE rank <= 12 GROUP BY ALL) SELECT query_id, label, round(coalesce(s, 0), 5) AS score FROM q CROSS JOIN l LEFT JOIN n USING (query_id, label)")
    def run(spark, d):
        lab = labels(spark, d)
        return rounded(S.vote(nearest(spark, d, kind, 12), lab, lab, 2.0, kind), score=5)


_vote("c09_classify_cosine", COS, "cosine", "1 - score")
_vote("c10_classify_euclidean", EUC, "euclidean", "-score")


def _mean(name, head, kind, weight, sql):
    @query(name, f"{head}{TOP}, n AS (SELECT query_id, label::DOUBLE AS y, greatest({'1 - score' if kind == 'cosine' else '-score'}, 0) AS dist FROM t WHERE rank <= 10 AND row_id <> query_id) SELECT query_id, round({sql}, 4) AS estimate FROM n GROUP BY query_id")
    def run(spark, d):
        near = nearest(spark, d, kind, 10).filter("row_id <> query_id")
        return rounded(S.neighbour_mean(near, labels(spark, d).selectExpr("row_id", "cast(label AS double) AS target"), weight, kind), estimate=4)


_mean("g09_estimate_cosine", COS, "cosine", "uniform", "avg(y)")
_mean("g09_estimate_cosine_distance", COS, "cosine", "distance", "sum(y / dist) / sum(1 / dist)")
_mean("g10_estimate_euclidean", EUC, "euclidean", "uniform", "avg(y)")

SIGN = "g AS (SELECT vec_id AS row_id, list_sum([CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END FOR i IN range(1, 65)])::BIGINT AS ones, embedding AS e FROM embeddings)"


def signs(spark, d):
    """Deterministic signatures: the signs of the components, as two words of 32 bits, and the norm."""
    word = lambda low: F.expr(f"aggregate(sequence({low}, {low + 31}), 0L, (a, i) -> a * 2 + if(embedding[i] > 0, 1, 0))")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.array(word(0), word(32)).alias("bits"), F.expr("sqrt(aggregate(embedding, 0D, (a, x) -> a + cast(x AS double) * x))").alias("norm"))


HAM = "h AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] > 0) <> (r.embedding[i] > 0))::INT))::BIGINT AS ham, sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS a, sqrt(list_dot_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[])) AS b FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0)"


def _hamming(name, ties):
    @query(name, f"WITH {HAM} SELECT query_id, row_id, 1 - ham / 64 AS score FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ham, row_id {ties}) <= 10")
    def run(spark, d):
        s = signs(spark, d)
        return S.signature_top_k(s, s.filter("row_id % 20 = 0"), 10, ties=ties).select("query_id", "row_id", "score")


_hamming("k05_hamming_top_k", "asc")
_hamming("k06_bit_index_top_k", "desc")


ANGLE = "-CASE WHEN ham = 0 THEN abs(a - b) ELSE sqrt(greatest(0, a * a + b * b - 2 * a * b * cos(pi() * ham / 64))) END"


@query("k07_euclid_lsh_top_k", f"WITH {HAM} SELECT query_id, row_id, round({ANGLE}, 5) AS score FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {ANGLE} DESC, row_id DESC) <= 10")
def k07(spark, d):
    s = signs(spark, d)
    return rounded(S.signature_top_k(s, s.filter("row_id % 20 = 0"), 10, euclid=True).select("query_id", "row_id", "score"), score=5)


def _hashed(name, make, euclid_score=False):
    @query(name)
    def run(spark, d):
        s = make(rows(spark, d).withColumn("value", F.abs("value")) if make is S.minhash_signatures else rows(spark, d))
        return S.signature_top_k(s, s.filter("row_id % 20 = 0"), 10, 64, euclid_score).select("query_id", "row_id", "score")


_hashed("n03_lsh_neighbours", S.lsh_signatures)
_hashed("n04_minhash_neighbours", S.minhash_signatures)
_hashed("n05_euclid_lsh_neighbours", S.lsh_signatures, True)

# neighbours by signatures, as the nearest_neighbor methods of the services use them
SIGNED = f"WITH {HAM}, t AS (SELECT h.*, label, row_number() OVER (PARTITION BY query_id ORDER BY ham, h.row_id) AS rank FROM h JOIN embeddings e ON e.vec_id = h.row_id)"


def by_signature(spark, d, k):
    s = signs(spark, d)
    return S.signature_top_k(s, s.filter("row_id % 20 = 0"), k, ties="asc")


@query("c08_classify_by_signature", f"{SIGNED}, l AS (SELECT DISTINCT label FROM embeddings), q AS (SELECT DISTINCT query_id FROM t), n AS (SELECT query_id, label, sum(exp(-2 * ham / 64)) AS s FROM t WHERE rank <= 12 GROUP BY ALL) SELECT query_id, label, round(coalesce(s, 0), 5) AS score FROM q CROSS JOIN l LEFT JOIN n USING (query_id, label)")
def c08(spark, d):
    lab = labels(spark, d)
    return rounded(S.vote(by_signature(spark, d, 12), lab, lab, 2.0, "cosine"), score=5)


@query("g08_estimate_by_signature", f"{SIGNED} SELECT query_id, round(avg(label::DOUBLE), 4) AS estimate FROM t WHERE rank <= 10 GROUP BY query_id")
def g08(spark, d):
    return rounded(S.neighbour_mean(by_signature(spark, d, 10), labels(spark, d).selectExpr("row_id", "cast(label AS double) AS target")), estimate=4)


@query("r07_complete_by_signature", f"{SIGNED} SELECT query_id, 'f' || (i - 1) AS feature, round(avg(e.embedding[i]::DOUBLE), 5) AS value FROM t JOIN embeddings e ON e.vec_id = t.row_id, range(1, 65) g(i) WHERE rank <= 128 GROUP BY ALL")
def r07(spark, d):
    return rounded(S.complete(by_signature(spark, d, 128), rows(spark, d)), value=5)


SIGNED_PAIRS = "WITH d AS (SELECT q.vec_id AS row_id, r.vec_id AS nb, list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] > 0) <> (r.embedding[i] > 0))::INT)) / 64 AS dist FROM embeddings q, embeddings r)"
STORED = """, w AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, nb) AS k FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, nb) AS k FROM d WHERE nb <> row_id),
  kd AS (SELECT row_id, max(dist) AS kdist FROM w WHERE k <= 10 GROUP BY 1), lr AS (SELECT w.row_id, count(*) / sum(greatest(dist, kdist)) AS lrd FROM w JOIN kd ON kd.row_id = nb WHERE k <= 10 GROUP BY 1),
  own AS (SELECT o.row_id, count(*) / sum(greatest(dist, kdist)) AS lrd FROM o JOIN kd ON kd.row_id = nb WHERE k <= 10 GROUP BY 1)
  SELECT o.row_id, round(avg(lr.lrd) / any_value(own.lrd), 4) AS lof FROM o JOIN lr ON lr.row_id = nb JOIN own ON own.row_id = o.row_id WHERE k <= 10 GROUP BY 1"""


def with_itself(spark, d, pairs):
    """Each row is its own neighbour too, which counts for its k-distance. Written, since scores read it several times."""
    return cut(pairs.select("row_id", "neighbour", "distance").unionByName(labels(spark, d).select("row_id", F.col("row_id").alias("neighbour"), F.lit(0.0).alias("distance"))))


@query("l07_outliers_by_signature", SIGNED_PAIRS + STORED)
def l07(spark, d):
    s = signs(spark, d)
    near = S.signature_top_k(s, s, 11, ties="asc", others_only=True)
    pairs = near.select(F.col("query_id").alias("row_id"), F.col("row_id").alias("neighbour"), (1 - F.col("score")).alias("distance"))
    return rounded(anomaly.stored_scores(with_itself(spark, d, pairs), 10), lof=4)


@query("l02_stored_scores", f"WITH {V}, d AS (SELECT a.row_id, b.row_id AS nb, CASE WHEN a.row_id = b.row_id THEN 0 ELSE sqrt(greatest(0, list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e))) END AS dist FROM v a, v b){STORED}")
def l02(spark, d):
    return rounded(anomaly.stored_scores(with_itself(spark, d, S.nearest_of_all(dense(spark, d), 11)), 10), lof=4)


NEAR = f"WITH {V}, d AS (SELECT a.row_id, b.row_id AS nb, sqrt(greatest(0, list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(a.e, b.e))) AS dist FROM v a, v b WHERE a.row_id <> b.row_id AND a.row_id < 200 AND b.row_id < 200), n AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dist, nb) AS k FROM d), kd AS (SELECT row_id, max(dist) AS kdist FROM n WHERE k <= 10 GROUP BY 1), lr AS (SELECT n.row_id, count(*) / sum(greatest(dist, kdist)) AS lrd FROM n JOIN kd ON kd.row_id = nb WHERE k <= 10 GROUP BY 1)"


def _lof(spark, d):
    pairs = cut(S.nearest_of_all(dense(spark, d), 10))  # read several times
    kd = anomaly.k_distance(pairs, 10)
    return pairs, kd, anomaly.local_density(pairs, kd, 10)


NEAR = NEAR.replace(" AND a.row_id < 200 AND b.row_id < 200", "")


@query("l03_local_density", f"{NEAR} SELECT row_id, round(kdist, 4) AS kdist, round(lrd, 5) AS lrd FROM kd JOIN lr USING (row_id)")
def l03(spark, d):
    _, kd, lrd = _lof(spark, d)
    return rounded(kd.join(lrd, "row_id"), kdist=4, lrd=5)


@query("l01_lof_scores", f"{NEAR} SELECT n.row_id AS query_id, round(avg(b.lrd) / any_value(a.lrd), 4) AS lof FROM n JOIN lr b ON b.row_id = nb JOIN lr a ON a.row_id = n.row_id WHERE k <= 10 GROUP BY 1")
def l01(spark, d):
    pairs, kd, lrd = _lof(spark, d)
    return rounded(anomaly.scores(pairs.withColumnRenamed("row_id", "query_id"), kd, lrd, 10), lof=4)


@query("l05_same_points", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n <= 4")
def l05(spark, d):
    """Points come twice, one half of them first; of a point's rows k - 1 are taken, the stored ones counted."""
    rows_ = table(spark, d, "events").select("event_id", F.array(F.col("user_id").cast("double"), F.crc32(F.col("event_type").cast("binary")).cast("double")).alias("x"))
    middle = rows_.agg(F.max("event_id")).first()[0] // 2
    first = anomaly.without_kth_same(rows_.limit(0), rows_.filter(F.col("event_id") <= middle), 5, order="event_id")
    return first.unionByName(anomaly.without_kth_same(first, rows_.filter(F.col("event_id") > middle), 5, order="event_id")).select("event_id")


@query("a13_max_int_id", "SELECT max(try_cast(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT)) AS id FROM customer WHERE c_custkey % 2 = 0")
def a13(spark, d):
    """Of half the names only the digits are left; the others are no numbers."""
    names = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.regexp_replace("c_name", "[^0-9]", "")).otherwise(F.col("c_name")).alias("id"))
    return S.largest_int_id(names, "id")
