"""Queries of the ordered folds, held against SQL that goes through the same rows one by one (a recursion), so they run over
a small whole table; c06_train_arow_documents and t02_train_mixed run the same folds over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import learners
from fluxloom.queries.catalogue import Registry
from fluxloom.sources.tables import rounded, table

query = Registry()
ROWS = "r AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, s_nationkey % 2 AS y, s_acctbal / 5000 AS a, (s_nationkey % 5) / 5 AS b, s_acctbal / 3000 + s_nationkey % 3 AS z FROM supplier)"
LAST = "i = (SELECT max(i) FROM t)"


def _rows(spark, d, target):
    x = F.create_map(F.lit("a"), F.col("s_acctbal") / 5000, F.lit("b"), (F.col("s_nationkey") % 5) / 5)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq"), target.alias("target"), x.alias("features"))


def classifier_sql(method: str, c: float = 1.0) -> str:
    """Two labels and two features: weights w and covariances c of label and feature, known labels k."""
    cells = [(label, f) for label in (0, 1) for f in "ab"]
    # of the row's own label and of the other one
    own = ", ".join(f"CASE WHEN r.y = 0 THEN {n}0{f} ELSE {n}1{f} END AS {n}o{f}, CASE WHEN r.y = 0 THEN {n}1{f} ELSE {n}0{f} END AS {n}x{f}" for n in "wc" for f in "ab")
    sums = "CASE WHEN kx THEN wxa * a + wxb * b ELSE 0 END - (woa * a + wob * b) AS m, coa * a * a + cob * b * b + CASE WHEN kx THEN cxa * a * a + cxb * b * b ELSE 0 END AS var, a * a + b * b AS norm"
    plain = {"PA": "(1 + m) / (2 * norm)", "PA1": f"least({c}, (1 + m) / (2 * norm))", "PA2": f"(1 + m) / (2 * norm + 1 / (2 * {c}))", "perceptron": "1.0"}
    fires = {"perceptron": "(kx AND m >= 0) OR (NOT kx AND NOT touched)", "CW": "coalesce(g > 0 AND var <> 0, false)", "AROW": "m > -1", "NHERD": "m > -1"}.get(method, "1 + m >= 0 AND norm <> 0")
    if method == "CW":
        b = f"(1 - 2 * {c} * m)"
        root = f"({b} * {b} - 8 * {c} * (-m - {c} * var))"
        size, g = f"g / (4 * {c} * var)", f"CASE WHEN {root} >= 0 THEN -{b} + sqrt({root}) ELSE 0 END AS g"
    else:
        size, g = plain.get(method, f"(1 + m) / (var + 1 / {c})"), "0 AS g"
    moves, covers = [], []
    for label, f in cells:
        sign = f"CASE WHEN y = {label} THEN 1 WHEN kx THEN -1 ELSE 0 END"
        scale = "1" if method in plain else f"c{label}{f}"
        moves.append(f"w{label}{f} + CASE WHEN fires THEN {sign} * size * {scale} * {f} ELSE 0 END AS w{label}{f}")
        k = f"c{label}{f}"
        new = {"CW": f"1 / (1 / {k} + 2 * size * {c} * {f} * {f})", "AROW": f"{k} - {k} * {k} * {f} * {f} / (var + 1 / {c})", "NHERD": f"1 / (1 / {k} + (2 * {c} + {c} * {c} * var) * {f} * {f})"}.get(method, k)
        covers.append(f"CASE WHEN fires AND (y = {label} OR kx) THEN {new} ELSE {k} END AS {k}")
    begin = ", ".join([f"0.0::DOUBLE AS w{label}{f}" for label, f in cells] + [f"1.0::DOUBLE AS c{label}{f}" for label, f in cells])
    state = ", ".join([f"w{label}{f}" for label, f in cells] + [f"c{label}{f}" for label, f in cells])
    out = " UNION ALL ".join(f"SELECT '{f}' AS feature, '{label}' AS label, round(w{label}{f}, 5) AS v1, round(c{label}{f}, 5) AS v2 FROM t WHERE {LAST}" for label, f in cells)
    return f"""WITH RECURSIVE {ROWS}, t AS (SELECT 0::BIGINT AS i, false AS k0, false AS k1, false AS t0, false AS t1, {begin} UNION ALL
      SELECT i, k0 OR y = 0, k1 OR y = 1, t0 OR (fires AND (y = 0 OR kx)), t1 OR (fires AND (y = 1 OR kx)), {", ".join(moves)}, {", ".join(covers)} FROM (SELECT *, {fires} AS fires, {size} AS size FROM (SELECT *, {g} FROM (SELECT *, {sums} FROM
      (SELECT r.i, r.y, r.a, r.b, k0, k1, t0, t1, CASE WHEN r.y = 0 THEN k1 ELSE k0 END AS kx, CASE WHEN r.y = 0 THEN t0 ELSE t1 END AS touched, {state}, {own} FROM t JOIN r ON r.i = t.i + 1)))))
      {out}"""


def regression_sql(method: str, c: float, eps: float = 0.1, rate: float = 0.1) -> str:
    """Two features: weights w, covariances c, and of targets so far how many, their sum and that of their squares."""
    kind = "PA" if method.startswith("PA") else method
    deviation = "sqrt(greatest(0, (q + z * z) / (n + 1) - ((s + z) / (n + 1)) * ((s + z) / (n + 1))))"
    loss = {"PA": f"abs(e) - {eps} * {deviation}", "perceptron": "1"}.get(kind, f"abs(e) - {eps}")
    fires = {"perceptron": "true", "PA": "loss > 0 AND norm <> 0"}.get(kind, "loss > 0 AND var <> 0")
    b = f"(1 - 2 * {c} * abs(e))"
    size = {"perceptron": f"{rate} * e", "PA": f"sign(e) * {f'least({c}, loss / norm)' if method == 'PA1' else 'loss / norm'}", "CW": f"sign(e) * (-{b} + sqrt(greatest(0, {b} * {b} + 8 * {c} * (abs(e) + {c} * var)))) / (4 * {c} * var)"}.get(kind, f"sign(e) * loss / (var + 1 / {c})")
    moves, covers = [], []
    for f in "ab":
        scale = "1" if kind in ("PA", "perceptron") else f"c{f}"
        moves.append(f"w{f} + CASE WHEN fires THEN size * {scale} * {f} ELSE 0 END AS w{f}")
        new = {"CW": f"1 / (1 / c{f} + 2 * abs(size) * {c} * {f} * {f})", "AROW": f"c{f} - c{f} * c{f} * {f} * {f} / (var + 1 / {c})", "NHERD": f"1 / (1 / c{f} + (2 * {c} + {c} * {c} * var) * {f} * {f})"}.get(kind, f"c{f}")
        covers.append(f"CASE WHEN fires THEN {new} ELSE c{f} END AS c{f}")
    out = " UNION ALL ".join(f"SELECT '{f}' AS feature, '+' AS label, round(w{f}, 5) AS v1, round(c{f}, 5) AS v2 FROM t WHERE {LAST}" for f in "ab")
    return f"""WITH RECURSIVE {ROWS}, t AS (SELECT 0::BIGINT AS i, 0.0::DOUBLE AS n, 0.0::DOUBLE AS s, 0.0::DOUBLE AS q, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 1.0::DOUBLE AS ca, 1.0::DOUBLE AS cb UNION ALL
      SELECT i, n + 1, s + z, q + z * z, {", ".join(moves)}, {", ".join(covers)} FROM (SELECT *, {fires} AS fires, {size} AS size FROM (SELECT *, {loss} AS loss FROM
      (SELECT r.i, r.a, r.b, r.z, n, s, q, wa, wb, ca, cb, r.z - (wa * r.a + wb * r.b) AS e, r.a * r.a + r.b * r.b AS norm, ca * r.a * r.a + cb * r.b * r.b AS var FROM t JOIN r ON r.i = t.i + 1))))
      {out}"""


def _classifier(name: str, method: str) -> None:
    @query(name, classifier_sql(method))
    def run(spark, d):
        rows = _rows(spark, d, (F.col("s_nationkey") % 2).cast("string"))
        return rounded(learners.train(rows, lambda: learners.Classifier(method)), v1=5, v2=5)


def _regression(name: str, method: str) -> None:
    c = 0.5 if method == "PA1" else 1.0

    @query(name, regression_sql(method, c))
    def run(spark, d):
        rows = _rows(spark, d, F.col("s_acctbal") / 3000 + F.col("s_nationkey") % 3)
        return rounded(learners.train(rows, lambda: learners.Regression(method, c)), v1=5, v2=5)


for _k, _m in enumerate(learners.CLASSIFIERS, 1):
    _classifier(f"c0{_k}_train_{_m.lower()}", _m)
    _regression(f"g0{_k}_train_{_m.lower()}", _m)
