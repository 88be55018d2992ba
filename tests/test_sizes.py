"""What larger tables showed: queries over copies of tables with shifted keys, and steps whose memory or rows grew too fast."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from conftest import plain
from fluxloom.operators import clustering, lsh_index, similarity as S
from fluxloom.queries import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture
def copied(spark, tmp_path):
    """Rows of a query, and of its SQL, over a table that is written n times with shifted keys."""

    def run(name, table, key, n, sf="/root/testdata/sf0.1"):
        con = duckdb.connect()
        con.sql(f"COPY (SELECT t.* REPLACE ({key} + i * (SELECT max({key}) + 1 FROM '{sf}/{table}.parquet') AS {key}) FROM '{sf}/{table}.parquet' t, range({n}) r(i)) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        found = con.sql(SQL[name])
        at = [found.columns.index(c) for c in sorted(df.columns)]
        got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
        return got, [tuple(r[k] for k in at) for r in found.fetchall()]

    return run


def same(got, want):
    order = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=repr)
    return repr(order(got)) == repr(order(want))  # as text, so that nan is equal to itself


@pytest.mark.parametrize("name", ["g05_train_cw", "c05_train_cw"])
def test_covariances_that_reach_zero(copied, name):
    """Confidence-weighted covariances reach 0 after a thousand rows; then SQL divides by 0 and goes on."""
    assert same(*copied(name, "supplier", "s_suppkey", 2))


def plain_scores(rows, queries, kind, ignore_orthogonal=False):
    """Of rows and queries {id: {feature: value}}."""
    out = {}
    for q, x in queries.items():
        for r, y in rows.items():
            shared = x.keys() & y.keys()
            dot, xx, yy = sum(x[f] * y[f] for f in shared), sum(v * v for v in x.values()), sum(v * v for v in y.values())
            if kind == "cosine" and dot and xx and yy:
                out[q, r] = max(-1.0, min(1.0, dot / (xx * yy) ** 0.5))
            elif kind == "euclidean" and yy and (shared or not ignore_orthogonal):
                out[q, r] = -(max(0.0, xx + yy - 2 * dot) ** 0.5)
    return out


def best(scores, k):
    out = {}
    for (q, r), s in sorted(scores.items(), key=lambda x: (x[0][0], -x[1], -x[0][1])):
        out.setdefault(q, []).append((r, pytest.approx(s, abs=1e-7)))
    return {q: x[:k] for q, x in out.items()}


@pytest.mark.parametrize(("kind", "alone"), [("cosine", False), ("euclidean", False), ("euclidean", True)])
def test_sparse_rows_in_blocks(spark, kind, alone):
    """Common and rare features; the plan has no join on the feature, which made a row for each pair and shared feature."""
    rng = random.Random(4)
    rows = {i: {f"f{min(int(rng.expovariate(0.05)), 90) if rng.random() < 0.5 else 1000 + rng.randrange(500)}": rng.gauss(0, 1) for _ in range(12)} for i in range(150)} | {150: {"f0": 0.0}, 151: {"far": 2.0}}
    df = spark.createDataFrame([(i, f, v) for i, x in rows.items() for f, v in x.items()], "row_id long, feature string, value double")
    asked = df.filter("row_id % 10 = 0")
    got = S.cosine_scores(df, asked, 7) if kind == "cosine" else S.euclidean_scores(df, asked, alone, 7)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = best(plain_scores(rows, {i: x for i, x in rows.items() if i % 10 == 0}, kind, alone), 7)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.row_id, r.score))
    assert {q: sorted(x, key=lambda v: (-round(v[1], 9), -v[0])) for q, x in found.items()} == want


def test_rare_features_pair_by_pair():
    """The same products whether a feature is multiplied densely or pair by pair; a duplicate counts twice."""
    rng = np.random.default_rng(5)
    make = lambda n: pa.table({"names": [[f"f{x}" for x in rng.integers(0, 40, 6)] for _ in range(n)], "values": [rng.normal(size=6).tolist() for _ in range(n)]})
    s, q, r = S.Sparse("cosine"), make(9), make(50)
    want = [[sum(a * b for f, a in zip(x["names"], x["values"]) for g, b in zip(y["names"], y["values"]) if f == g) for y in r.to_pylist()] for x in q.to_pylist()]
    for s.DENSE in (1024, 5, 0):
        assert np.allclose(s.products(s.take(q), s.take(r), False), want)


def test_bucket_pairs_are_not_listed(spark):
    """Pairs of a bucket are those of the index, scored where they meet."""
    rng = random.Random(6)
    points = {i: {f"f{j}": rng.gauss(0, 1) for j in range(4)} for i in range(200)}
    rows = spark.createDataFrame([(i, f, v) for i, x in points.items() for f, v in x.items()], "row_id long, feature string, value double")
    asked = rows.filter("row_id % 8 = 0")
    listed = lambda df: df.selectExpr("row_id", "buckets.table AS b_table", "buckets.name AS b_name").join(S.packed(rows), "row_id")
    index, wanted = lsh_index.index(rows, 2, 3, 1.5), lsh_index.index(asked, 2, 3, 1.5, probes=4)
    named = {r.row_id: {tuple(b) for b in r.buckets} for r in index.collect()}
    looked = {r.row_id: {tuple(b) for b in r.buckets} for r in wanted.collect()}
    got = {(r.query_id, r.row_id): r.score for r in S.in_blocks(listed(index), listed(wanted), None, lsh_index.InBuckets(S.Sparse("euclidean", zero_rows=True))).collect()}
    want = {k: s for k, s in plain_scores(points, {q: points[q] for q in looked}, "euclidean").items() if looked[k[0]] & named[k[1]]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want) and len(want) < 25 * 200


@pytest.mark.parametrize("k", [3, 40, 700])
@pytest.mark.parametrize("kind", ["euclidean", "cosine"])
def test_kept_rows_of_blocks(k, kind):
    """What a task keeps are exactly the k best, ties by the id, copies and rows near one another among them, in chunks."""
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.normal(size=(300, 5)), rng.normal(size=(300, 5)) * 1e-4 + 7, np.ones((100, 5))]).round(6)
    x[600:650] = x[:50]
    score, ids = S.Dense(kind, zero_rows=True), np.arange(len(x))
    work = S.Blocks(score, k, None, True, True, None, 0)
    work.start(ids, score.take(pa.table({"x": x.tolist()})))
    for at in range(0, len(x), 128):
        assert not list(work.chunk(ids[at : at + 128], score.take(pa.table({"x": x[at : at + 128].tolist()}))))
    q, r, s = (np.concatenate(c) for c in zip(*work.end()))
    dot, xx = np.array([[np.einsum("i,i->", a, b) for b in x] for a in x]), np.einsum("ij,ij->i", x, x)
    want = np.clip(dot / np.sqrt(np.outer(xx, xx)), -1, 1) if kind == "cosine" else -np.sqrt(np.maximum(xx[:, None] + xx[None] - 2 * dot, 0))
    np.fill_diagonal(want, -np.inf)
    for i in range(len(x)):
        own = q == i
        assert own.sum() == min(k, len(x) - 1) and np.allclose(np.sort(s[own])[::-1], np.sort(want[i])[::-1][: own.sum()], atol=1e-7)
        assert len(set(r[own].tolist())) == own.sum() and np.allclose(want[i][r[own]], s[own], atol=1e-7)


@pytest.mark.parametrize("name", ["l01_lof_scores", "l02_stored_scores", "l03_local_density", "l07_outliers_by_signature"])
def test_pairs_are_compared_once(spark, sf, name):
    """Scores read the neighbours several times; they are written, so the plan compares no pairs."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("MapInArrow", "MapInPandas", "CoGroups") if x in plan]


def test_logarithms_are_sql_s_to_the_last_bit(copied):
    got, want = copied("x04_num_plugin", "customer", "c_custkey", 1)
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["k22_dbscan", "k22_dbscan_one_dimension", "k22_dbscan_cosine"])
def test_copies_of_points_make_no_pairs(spark, copied, monkeypatch, name):
    """Thirty copies of each point: the pairs are those of different points, and clusters are as in SQL."""
    made, real = [], clustering.region_pairs
    monkeypatch.setattr(clustering, "region_pairs", lambda *a, **b: made.append(real(*a, **b)) or made[-1])
    got, want = copied(name, "supplier", "s_suppkey", 30, "/root/testdata/sf0.001")
    assert same(got, want) and got
    assert made[0].count() <= 100


def test_long_chains_take_two_steps(spark):
    """A chain of 3,000 points is one cluster; rounds of least labels needed ever more plans in the driver."""
    p = spark.range(3000).selectExpr("id", "array(cast(id AS double)) AS x")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    assert [tuple(r) for r in clustering.dbscan(p, 1.5, 3).groupBy("cluster").count().collect()] == [(1, 3000)]
    assert jobs() - before < 40
