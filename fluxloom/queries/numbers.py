"""Queries of fractions, vectors, matrices, samples and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.functions import numbers as N
from fluxloom.queries.catalogue import Registry
from fluxloom.sources.tables import rounded, table

query = Registry()


@query("z10_transpose", "SELECT o_orderpriority AS row, o_custkey AS \"column\", round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL")
def z10(spark, d):
    cells = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("row"), F.col("o_orderpriority").alias("column")).agg(F.sum("o_totalprice").alias("value"))
    return rounded(N.transpose(cells), value=2)


@query("z12_fractions", "SELECT p_partkey, ((p_size * 6 + p_partkey) // gcd(p_size * 6 + p_partkey, 6 * p_partkey))::BIGINT AS n, ((6 * p_partkey) // gcd(p_size * 6 + p_partkey, 6 * p_partkey))::BIGINT AS d FROM part WHERE p_partkey > 0")
def z12(spark, d):
    """p_size / p_partkey + 1 / 6."""
    p = table(spark, d, "part").filter("p_partkey > 0").select("p_partkey", N.ratio_add(N.ratio(F.col("p_size"), F.col("p_partkey")), N.ratio(F.lit(1), F.lit(6))).alias("r"))
    return p.select("p_partkey", "r.n", "r.d")


@query("z12_vectors", "SELECT vec_id, round(e[2] * e[6] - e[3] * e[5], 6) AS c0, round(e[3] * e[4] - e[1] * e[6], 6) AS c1, round(e[1] * e[5] - e[2] * e[4], 6) AS c2, round(sqrt(list_dot_product(e[1:3], e[1:3])), 6) AS length FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def z12b(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    a, b = F.slice("e", 1, 3), F.slice("e", 4, 3)
    v = e.select("vec_id", N.cross(a, b).alias("c"), N.length(a).alias("length"))
    return rounded(v.select("vec_id", *[F.col("c")[k].alias(f"c{k}") for k in range(3)], "length"), c0=6, c1=6, c2=6, length=6)


@query("z13_sample_sizes", "SELECT 'once' AS kind, 100 AS n, 100 AS different UNION ALL SELECT 'again', 100, NULL")
def z13(spark, d):
    """Rows drawn without replacement are different ones; with replacement they need not be."""
    o = table(spark, d, "orders").select("o_orderkey")
    once, again = N.sample(o, 100, "o_orderkey", 3), N.sample_again(o, 100, "o_orderkey", 3)
    size = lambda df, kind, different: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), (F.countDistinct("o_orderkey") if different else F.lit(None).cast("long")).alias("different"))
    return size(once, "once", True).unionByName(size(again, "again", False))


@query("z15_calendar", "SELECT event_id, year(t) AS year, month(t) AS month, day(t) AS day, hour(t) AS hour FROM (SELECT event_id, make_timestamp(event_id * 86461 * 1000000) AS t FROM events)")
def z15(spark, d):
    return table(spark, d, "events").select("event_id", N.calendar(F.col("event_id") * 86461).alias("c")).select("event_id", *[F.col(f"c.{x}").cast("long").alias(x) for x in ("year", "month", "day", "hour")])
