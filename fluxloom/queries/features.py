"""Queries of rules and feature extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom import services as V
from fluxloom.functions import plugins
from fluxloom.functions import rules as R
from fluxloom.lineage import scratch
from fluxloom.operators import burst
from fluxloom.operators import features as X
from fluxloom.plans import config
from fluxloom.queries.catalogue import Registry
from fluxloom.sources.tables import rounded, table

query = Registry()
COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MELT = f"""SELECT row_id, key, value FROM (SELECT l_orderkey * 10 + l_linenumber AS row_id, {", ".join(COLUMNS)} FROM lineitem) UNPIVOT (value FOR key IN ({", ".join(COLUMNS)}))"""
TEXTS = "SELECT item_id AS row_id, 'text' AS key, text AS value FROM benchmark"


def nums(spark, d):
    return X.melt(table(spark, d, "lineitem").withColumn("id", F.expr("l_orderkey * 10 + l_linenumber")), "id", COLUMNS)


def words_of(d, spark):
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.lit("text").alias("key"), F.col("text").alias("value"))


def texts(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("row_id"), F.lit("text").alias("key"), F.col("text").alias("value"))


def _matcher(name, pattern, sql, but=None):
    @query(name, f"SELECT key, count(*) AS n FROM ({MELT}) WHERE {sql} GROUP BY key")
    def run(spark, d):
        return nums(spark, d).filter(R.rule_matches(F.col("key"), pattern, but)).groupBy("key").agg(F.count("*").alias("n"))


_matcher("p01_match_all", "*", "true")
_matcher("p02_match_suffix", "*price", "suffix(key, 'price')")
_matcher("p03_match_prefix", "l_d*", "prefix(key, 'l_d')")
_matcher("p04_match_regexp", "/l_[dt]/", "regexp_matches(key, '^(l_[dt])')")
_matcher("p05_match_exact", "l_tax", "key = 'l_tax'")
_matcher("p06_match_except", "l_*", "prefix(key, 'l_') AND key <> 'l_tax'", "l_tax")


@query("p07_zero_elimination", f"SELECT row_id, key || '@num' AS feature, value FROM ({MELT}) WHERE value <> 0")
def p07(spark, d):
    return X.global_weight(X.num_features(nums(spark, d)), "bin")


@query("p11_keyword_containment", "SELECT doc_id, contains(text, 'the') AS hit FROM documents")
def p11(spark, d):
    return table(spark, d, "documents").select("doc_id", burst.holds(F.col("text"), "the").alias("hit"))


@query("f01_filter_regexp", "SELECT page_id AS row_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS h FROM pages")
def f01(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("row_id"), F.md5(R.regexp_filter(F.col("html"), "<[^>]*>", "")).alias("h"))


@query("f01_filter_groups", "SELECT c_custkey, regexp_replace(c_name, '([A-Za-z]+)#0*([0-9]+)', '\\2:$\\1', 'g') AS v FROM customer")
def f01b(spark, d):
    return table(spark, d, "customer").select("c_custkey", R.regexp_filter(F.col("c_name"), "([A-Za-z]+)#0*([0-9]+)", "\\2:$\\1").alias("v"))


@query("f02_filter_chain", f"""WITH a AS ({MELT}), b AS (SELECT * FROM a UNION ALL SELECT row_id, key || '+5', value + 5 FROM a WHERE key = 'l_tax'),
  c AS (SELECT * FROM b UNION ALL SELECT row_id, key || '+2', value + 2 FROM b WHERE prefix(key, 'l_tax'))
  SELECT key, count(*) AS n, round(sum(value), 3) AS total FROM c GROUP BY key""")
def f02(spark, d):
    chain = [("l_tax", None, lambda v: R.add(v, 5), "+5"), ("l_tax*", None, lambda v: R.add(v, 2), "+2")]
    return rounded(X.apply_filters(nums(spark, d), chain).groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total")), total=3)


def _number(name, function, sql):
    @query(name, f"SELECT l_orderkey, l_linenumber, round({sql}, 6) AS v FROM lineitem")
    def run(spark, d):
        return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(function(F.col("l_quantity")), 6).alias("v"))


_number("f03_filter_add", lambda v: R.add(v, 3), "l_quantity + 3")
_number("f04_filter_linear", lambda v: R.linear_normalization(v, 10, 40), "CASE WHEN l_quantity > 40 THEN 1 WHEN l_quantity < 10 THEN 0 ELSE (l_quantity - 10) / 30 END")
_number("f04_filter_linear_free", lambda v: R.linear_normalization(v, 10, 40, False), "(l_quantity - 10) / 30")
_number("f05_filter_gaussian", lambda v: R.gaussian_normalization(v, 25, 14), "(l_quantity - 25) / 14")
_number("f06_filter_sigmoid", lambda v: R.sigmoid_normalization(v, 0.1, 25), "1 / (1 + exp(-0.1 * (l_quantity - 25)))")
_number("f22_num_log", lambda v: R.num_feature(F.lit("k"), v, "log")[1], "ln(greatest(1, l_quantity))")


def _tokens(name, kind, sql, tab="documents", key="doc_id", **options):
    @query(name, f"SELECT {key}, len(t)::BIGINT AS n, md5(array_to_string(t, '|')) AS h FROM (SELECT {key}, {sql} AS t FROM {tab})")
    def run(spark, d):
        t = table(spark, d, tab).select(key, R.tokens(F.col("text"), kind, **options).alias("t"))
        return t.select(key, F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|")).alias("h"))


_tokens("f07_tokens_str", "str", "[text]")
_tokens("f08_tokens_space", "space", "list_filter(regexp_split_to_array(text, '[ \\t\\f\\n\\r\\x0B]+'), lambda x: x <> '')")
_tokens("f09_tokens_split", "split", "list_filter(regexp_split_to_array(text, '[.,|]'), lambda x: x <> '')", separators=".,|")
_tokens("f10_tokens_ngram", "ngram", "CASE WHEN length(text) >= 3 THEN list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)) ELSE [] END", tab="benchmark", key="item_id", char_num=3)
_tokens("f11_tokens_regexp", "regexp", "regexp_extract_all(text, '[0-9]+')", pattern="[0-9]+")

COUNTS = f"SELECT row_id, key, t, count(*)::DOUBLE AS tf FROM (SELECT row_id, key, unnest(list_filter(regexp_split_to_array(value, '[ \\t\\f\\n\\r\\x0B]+'), lambda x: x <> '')) AS t FROM ({TEXTS})) GROUP BY ALL"
DF = f"c AS ({COUNTS}), df AS (SELECT t, count(*)::DOUBLE AS df FROM c GROUP BY t), n AS (SELECT count(DISTINCT row_id)::DOUBLE AS n FROM c)"


def _weighted(name, sample, gw, sql, **more):
    @query(name, f"WITH {DF} SELECT row_id, key || '$' || t || '@space#{sample}/{gw}' AS feature, round({sql}, 6) AS value FROM c JOIN df USING (t), n WHERE {sql} <> 0")
    def run(spark, d):
        return rounded(X.Converter([X.StringRule("space", "space", sample, gw)]).convert(texts(spark, d)), value=6)


_weighted("f12_token_counts", "tf", "bin", "tf")
_weighted("f13_sample_bin", "bin", "bin", "1.0::DOUBLE")
_weighted("f13_sample_log_tf", "log_tf", "bin", "ln(1 + tf)")
_weighted("f15_global_idf", "tf", "idf", "tf * ln((n + 1) / (df + 1))")
_weighted("f16_global_idf1", "tf", "idf1", "tf * (ln((n + 1) / (df + 1)) + 1)")


@query("f17_global_bm25", f"""WITH {DF}, l AS (SELECT row_id, sum(tf) AS len FROM c GROUP BY row_id), a AS (SELECT avg(len) AS al FROM l)
  SELECT row_id, key || '$' || t || '@space#tf/bm25' AS feature, round(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al)), 6) AS value
  FROM c JOIN df USING (t) JOIN l USING (row_id), n, a WHERE n - df <> df""")
def f17(spark, d):
    return rounded(X.Converter([X.StringRule("space", "space", "tf", "bm25")]).convert(texts(spark, d)), value=6)


@query("f18_user_weight", f"WITH {DF} SELECT row_id, key || '$' || t || '@space#bin/weight' AS feature, round(df / 7, 6) AS value FROM c JOIN df USING (t) WHERE df > 2")
def f18(spark, d):
    rule = X.StringRule("space", "space", "bin", "weight")
    bare = X.string_features(texts(spark, d), "space", "space").groupBy(F.regexp_replace("feature", "#[^#]*$", "").alias("feature")).agg((F.count("*") / 7).alias("weight"), F.count("*").alias("n")).filter("n > 2").drop("n")
    return rounded(X.Converter([rule]).convert(texts(spark, d), weights=bare), value=6)


@query("f19_add_weight", f"WITH c AS ({COUNTS}) SELECT row_id, 'text$' || t || '@space#bin/weight' AS feature, CASE WHEN length(t) > 3 THEN length(t) ELSE 1 END::DOUBLE AS value FROM c")
def f19(spark, d):
    """Every token has weight 1; those of over three characters then get their length."""
    weigh = V.Weight(spark, scratch(spark, "f19"), {"string_rules": [{"key": "*", "type": "space", "sample_weight": "bin", "global_weight": "weight"}]})
    bare = X.string_features(texts(spark, d), "space", "space").select(F.regexp_replace("feature", "#[^#]*$", "").alias("feature")).distinct()
    weigh.add_weight(bare.withColumn("weight", F.lit(1.0)))
    length = F.char_length(F.regexp_extract("feature", "(?s)^text\\$(.*)@space$", 1))
    weigh.add_weight(bare.withColumn("weight", length).filter("weight > 3"))
    return weigh.calc_weight(texts(spark, d))


@query("f17_bm25_of_stored_corpus", f"""WITH {DF}, l AS (SELECT row_id, sum(tf) AS len FROM c GROUP BY row_id), a AS (SELECT avg(len) AS al FROM l)
  SELECT row_id, key || '$' || t || '@space#tf/bm25' AS feature, round(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al)), 6) AS value
  FROM c JOIN df USING (t) JOIN l USING (row_id), n, a WHERE n - df <> df AND row_id % 20 = 0""")
def f17b(spark, d):
    """Records learnt in three parts; then those with ids divisible by 20 are weighed alone, with what is stored of all."""
    weigh = V.Weight(spark, scratch(spark, "f17"), {"string_rules": [{"key": "*", "type": "space", "sample_weight": "tf", "global_weight": "bm25"}]})
    for part in range(3):
        weigh.update_statistics(texts(spark, d).filter(F.col("row_id") % 3 == part))
    return rounded(weigh.calc_weight(texts(spark, d).filter("row_id % 20 = 0")), value=6)


DOC_WORDS = COUNTS.replace(f"({TEXTS})", "(SELECT doc_id AS row_id, 'text' AS key, text AS value FROM documents)")


@query("f15_global_idf_documents", f"WITH c AS ({DOC_WORDS}), df AS (SELECT t, count(*)::DOUBLE AS df FROM c GROUP BY t), n AS (SELECT count(*)::DOUBLE AS n FROM documents) SELECT row_id, count(*) AS n, round(sum(tf * ln((n + 1) / (df + 1))), 3) AS total FROM c JOIN df USING (t), n GROUP BY row_id")
def f15b(spark, d):
    made = X.Converter([X.StringRule("space", "space", "tf", "idf")]).convert(words_of(d, spark))
    return rounded(made.groupBy("row_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), total=3)


@query("f20_document_frequency", f"WITH {DF} SELECT 'text$' || t || '@space#bin/idf' AS feature, df FROM df")
def f20(spark, d):
    return X.document_frequency(X.string_features(texts(spark, d), "space", "space", "bin", "idf"))


@query("f21_running_frequency", f"WITH c AS ({COUNTS}) SELECT row_id, t AS token, count(*) OVER (PARTITION BY t ORDER BY row_id RANGE UNBOUNDED PRECEDING)::DOUBLE AS df FROM c")
def f21(spark, d):
    f = X.string_features(texts(spark, d), "space", "space").withColumn("seq", F.col("row_id"))
    return X.running_frequency(f).select("row_id", F.regexp_extract("feature", "^text\\$(.*)@space#bin/bin$", 1).alias("token"), "df")


@query("f22_num_str", "SELECT p_partkey AS row_id, 'p_size@str$' || p_size AS feature, 1.0::DOUBLE AS value FROM part")
def f22(spark, d):
    return X.num_features(X.melt(table(spark, d, "part"), "p_partkey", ["p_size"]), "str")


def _combined(name, op, function):
    sql = f"""WITH l AS (SELECT row_number() OVER () AS row_id, {", ".join(COLUMNS)} FROM lineitem), v AS (SELECT row_id, key || '@num' AS f, value FROM l UNPIVOT (value FOR key IN ({", ".join(COLUMNS)})) WHERE value <> 0)
      SELECT a.f || '&' || b.f || '/{name}' AS feature, count(*) AS n, round(sum(a.value {op} b.value), 0) AS total FROM v a JOIN v b ON a.row_id = b.row_id AND a.f < b.f WHERE a.value {op} b.value <> 0 GROUP BY 1"""

    @query(f"f23_combination_{name}", sql)
    def run(spark, d):
        """Pairs of features of each line of an order; lines have no key of their own."""
        lines = X.melt(table(spark, d, "lineitem").withColumn("id", F.monotonically_increasing_id()), "id", COLUMNS)
        f = X.global_weight(X.num_features(lines), "bin").withColumn("pos", F.col("feature"))
        return rounded(X.combinations(f, name, function).groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total")), total=0)


_combined("add", "+", lambda a, b: a + b)
_combined("mul", "*", lambda a, b: a * b)


@query("f11_tokens_regexp_group", "SELECT c_custkey AS row_id, 'name$' || regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2) || '@number#bin/bin' AS feature, 1.0::DOUBLE AS value FROM customer")
def f11b(spark, d):
    rules = config.converter({"string_types": {"number": {"method": "regexp", "pattern": "([A-Za-z]+)#0*([0-9]+)", "group": "2"}}, "string_rules": [{"key": "*", "type": "number", "sample_weight": "bin", "global_weight": "bin"}]})
    return rules.convert(table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.lit("name").alias("key"), F.col("c_name").alias("value")))


plugins.register("pairs of letters", lambda value, weight="1": F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(value) - 1)), lambda i: F.struct(F.substring(value, i, F.lit(2)).alias("value"), (i * 0 + float(weight)).alias("score"))))
plugins.register("sign and size", lambda key, value: F.array(F.struct(F.concat(key, F.lit("@sign")).alias("feature"), F.signum(value).alias("value")), F.struct(F.concat(key, F.lit("@size")).alias("feature"), F.abs(value).alias("value"))))
plugins.register("bytes", lambda key, value: F.array(F.struct(F.concat(key, F.lit("@bytes")).alias("feature"), F.octet_length(value).cast("double").alias("value")), F.struct(F.concat(key, F.lit("@crc"), F.crc32(value)).alias("feature"), F.lit(1.0).alias("value"))))


@query("x01_splitter_plugin", "SELECT n_nationkey AS row_id, 'name$' || t || '@two#tf/bin' AS feature, 0.5 * count(*) AS value FROM (SELECT n_nationkey, unnest([substr(n_name, i, 2) FOR i IN range(1, length(n_name))]) AS t FROM nation) GROUP BY ALL")
def x01(spark, d):
    rules = config.converter({"string_types": {"two": {"method": "dynamic", "function": "pairs of letters", "weight": "0.5"}}, "string_rules": [{"key": "*", "type": "two", "sample_weight": "tf", "global_weight": "bin"}]})
    return rules.convert(table(spark, d, "nation").select(F.col("n_nationkey").alias("row_id"), F.lit("name").alias("key"), F.col("n_name").alias("value")))


@query("x04_num_plugin", "SELECT c_custkey AS row_id, 'a@sign' AS feature, sign(c_acctbal)::DOUBLE AS value FROM customer UNION ALL SELECT c_custkey, 'a@size', abs(c_acctbal) FROM customer UNION ALL SELECT c_custkey, 'a@log', ln(greatest(1, c_acctbal)) FROM customer WHERE c_acctbal > 1")
def x04(spark, d):
    """A plugin, and a built-in type under a name of its own."""
    rules = config.converter({"num_types": {"both": {"method": "dynamic", "function": "sign and size"}, "mylog": {"method": "log"}}, "num_rules": [{"key": "*", "type": "both"}, {"key": "*", "type": "mylog"}]})
    found = rules.convert(nums=table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.lit("a").alias("key"), F.col("c_acctbal").alias("value")))
    return found.filter("value <> 0 OR feature <> 'a@log'")


@query("f27_binary_features", "SELECT page_id AS row_id, 'html@bytes' AS feature, strlen(html)::DOUBLE AS value FROM pages")
def f27(spark, d):
    rules = config.converter({"binary_types": {"bytes": {"method": "dynamic", "function": "bytes"}}, "binary_rules": [{"key": "html", "type": "bytes"}]})
    rows = table(spark, d, "pages").select(F.col("page_id").alias("row_id"), F.lit("html").alias("key"), F.col("html").cast("binary").alias("value"))
    return rules.convert(binaries=rows).filter(F.col("feature") == "html@bytes")


@query("f24_feature_hashing")
def f24(spark, d):
    f = X.string_features(texts(spark, d), "space", "space", "tf")
    return X.merge(X.hash_features(f, 1000))


@query("f25_revert", f"SELECT row_id, key, value AS num_value, NULL::VARCHAR AS string_value FROM ({MELT}) UNION ALL SELECT item_id, 'text', NULL, text FROM benchmark WHERE text <> ''")
def f25(spark, d):
    strings = X.string_features(texts(spark, d), "str").select("row_id", "feature", "value")
    return X.revert(X.num_features(nums(spark, d)).unionByName(strings))


@query("f26_weight_driver", f"WITH {DF} SELECT row_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT row_id, tf * ln((n + 1) / (df + 1)) AS value FROM c JOIN df USING (t), n WHERE df <> n UNION ALL SELECT item_id, length(text) FROM benchmark WHERE length(text) > 0) GROUP BY row_id")
def f26(spark, d):
    numbers = table(spark, d, "benchmark").select(F.col("item_id").alias("row_id"), F.lit("length").alias("key"), F.char_length("text").cast("double").alias("value"))
    made = X.Converter([X.StringRule("space", "space", "tf", "idf")], [X.NumRule()]).convert(texts(spark, d), numbers)
    return rounded(made.groupBy("row_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), total=4)


@query("f00_converter", "SELECT count(*) AS n, sum(value)::BIGINT AS total FROM (SELECT row_id, k, g, 1 AS value FROM (SELECT i AS row_id, j AS k, unnest([substr(t, p, 3) FOR p IN range(1, 99)]) AS g FROM (SELECT i, j, substr(repeat(md5(i || '-' || j), 4), 1, 100) AS t FROM range(1000) a(i), range(100) b(j))) GROUP BY ALL)")
def f00(spark, d):
    """1,000 records of 100 keys with 100 characters each, as trigrams: a converter's throughput."""
    held = spark.range(1000).selectExpr("id AS i", "explode(sequence(0L, 99L)) AS j")
    rows = held.select(F.col("i").alias("row_id"), F.concat(F.lit("k"), "j").alias("key"), F.expr("substring(repeat(md5(cast(concat(i, '-', j) AS binary)), 4), 1, 100)").alias("value"))
    made = X.Converter([X.StringRule("3", "ngram", "bin", "bin", options={"char_num": 3})]).convert(rows)
    return made.agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total"))


@query("d03_sort_and_merge", "SELECT o_custkey AS row_id, o_orderpriority AS feature, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL")
def d03(spark, d):
    return rounded(X.merge(table(spark, d, "orders").selectExpr("o_custkey AS row_id", "o_orderpriority AS feature", "o_totalprice AS value")), value=2)


@query("d03_merge_vector", """WITH a AS (SELECT c_custkey AS row_id, 'acct' AS feature, c_acctbal AS value FROM customer), b AS (SELECT o_custkey AS row_id, 'acct' AS feature, max(o_totalprice) AS value FROM orders GROUP BY 1)
  SELECT coalesce(a.row_id, b.row_id) AS row_id, 'acct' AS feature, coalesce(b.value, a.value) AS value FROM a FULL JOIN b USING (row_id, feature)""")
def d03b(spark, d):
    old = table(spark, d, "customer").selectExpr("c_custkey AS row_id", "'acct' AS feature", "c_acctbal AS value")
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("row_id")).agg(F.max("o_totalprice").alias("value")).withColumn("feature", F.lit("acct"))
    return X.upsert(old, new)
