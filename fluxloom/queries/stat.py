"""Queries of windowed statistics over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import stat
from fluxloom.queries.catalogue import Registry
from fluxloom.sources.tables import rounded, table

query = Registry()
LAST = "(SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)"


def _window(spark, d, n=1000):
    return stat.last_pushes(table(spark, d, "events").select("ts", "event_id", "event_type", "user_id", "value"), ["ts", "event_id"], n)


@query("a01_stat_window", f"""SELECT event_type, count(*) AS n, round(sum(value), 4) AS "sum", round(max(value), 4) AS "max", round(min(value), 4) AS "min",
  round(stddev_pop(value), 4) AS stddev, round(avg(value), 4) AS moment1, round(avg(value * value), 3) AS moment2, round(avg(pow(value - 10, 3)), 1) AS moment3 FROM {LAST} GROUP BY event_type""")
def a01(spark, d):
    return rounded(stat.window_summary(_window(spark, d), "event_type", "value", 10.0), sum=4, max=4, min=4, stddev=4, moment1=4, moment2=3, moment3=1)


@query("a05_stat_entropy", f"SELECT round(ln(sum(c)) - sum(c * ln(c)) / sum(c), 6) AS entropy FROM (SELECT count(*) AS c FROM {LAST} GROUP BY event_type)")
def a05(spark, d):
    return rounded(stat.entropy(_window(spark, d), "event_type"), entropy=6)


@query("w01_stat_running", """SELECT event_id, count(*) OVER w AS run_n, round(sum(value) OVER w, 4) AS run_sum, round(max(value) OVER w, 4) AS run_max, round(min(value) OVER w, 4) AS run_min
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def w01(spark, d):
    return rounded(stat.running(table(spark, d, "events"), "user_id", "value", ["ts", "event_id"], 50).select("event_id", "run_n", "run_sum", "run_max", "run_min"), run_sum=4, run_max=4, run_min=4)
