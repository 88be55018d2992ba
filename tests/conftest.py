import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoint')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def plain(v):
    """A value that compares alike from Spark and from DuckDB."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="session")
def against_sql(spark, sf):
    """Runs a query and its SQL over the same tables and compares columns and rows."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")

    def compare(function, sql, one_row=False):
        """``one_row``: a join with one row, which needs no key, is as it should be."""
        df = function(spark, sf)
        names = sorted(df.columns)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and (one_row or "BroadcastNestedLoopJoin" not in plan)
        got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
        found = con.sql(sql)
        at = {c: k for k, c in enumerate(found.columns)}
        assert sorted(at) == names
        want = sorted((tuple(plain(r[at[c]]) for c in names) for r in found.fetchall()), key=repr)
        assert len(got) == len(want)
        assert got == want

    return compare
