"""Run-to-run differences: each user's run against the next user's."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import diff as K
from causeway.sources import fixtures as X
from causeway.suite import query
from causeway.suite.duck import cte
from causeway.suite.facts import FACTS
from causeway.suite.history import VER, versions

PR = """SELECT a.run_id AS run_a, b.run_id AS run_b FROM (SELECT DISTINCT run_id FROM ev) a JOIN (SELECT DISTINCT run_id FROM ev) b
  ON CAST(b.run_id AS INTEGER) = CAST(a.run_id AS INTEGER) + 1"""


def pairs(spark, sf):
    users = X.table(spark, sf, "events").select("user_id").distinct()
    nxt = users.select((F.col("user_id") - 1).alias("user_id"))
    return users.join(nxt, "user_id", "left_semi").select(
        F.col("user_id").cast("string").alias("run_a"), (F.col("user_id") + 1).cast("string").alias("run_b"))


def sided(table, key):
    """Both runs' rows of a table, full outer on the key, as SQL."""
    return f"""(SELECT p.run_a, p.run_b, t.* FROM pr p JOIN {table} t ON t.run_id = p.run_a) a
    FULL JOIN (SELECT p.run_a, p.run_b, t.* FROM pr p JOIN {table} t ON t.run_id = p.run_b) b
    ON a.run_a = b.run_a AND a.run_b = b.run_b AND {' AND '.join(f'a.{k} = b.{k}' for k in key)}"""


PA = "coalesce(a.run_a, b.run_a) AS run_a, coalesce(a.run_b, b.run_b) AS run_b"
K1 = f"""
  SELECT run_a, run_b, 'topology' AS category, CASE WHEN n < 5 THEN 'info' ELSE 'warning' END AS severity, 'steps_' || what || ':' || n AS item,
    CAST(na AS VARCHAR) AS a, CAST(nb AS VARCHAR) AS b
  FROM (SELECT run_a, run_b, unnest(['added', 'removed']) AS what, unnest([count(*) FILTER (sa IS NULL), count(*) FILTER (sb IS NULL)]) AS n, count(sa) AS na, count(sb) AS nb
        FROM (SELECT {PA}, a.step AS sa, b.step AS sb FROM {sided('st', ['step'])}) GROUP BY run_a, run_b) WHERE n > 0
  UNION ALL
  SELECT run_a, run_b, 'topology', CASE WHEN abs(y.n - x.n) > x.n * 0.3 AND y.n > x.n THEN 'regression' WHEN abs(y.n - x.n) > x.n * 0.3 THEN 'improvement' ELSE 'info' END,
    'edges', CAST(x.n AS VARCHAR), CAST(y.n AS VARCHAR)
  FROM pr JOIN ec x ON x.run_id = run_a JOIN ec y ON y.run_id = run_b WHERE x.n <> y.n"""
EC = "SELECT run_id, count(*) AS n FROM ed GROUP BY run_id"
DD = f"SELECT {PA}, coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, coalesce(a.var, b.var) AS var, a.run_id IS NULL AS gained FROM {sided('de', ['src', 'dst', 'var'])} WHERE a.run_id IS NULL OR b.run_id IS NULL"
K2 = """
  SELECT run_a, run_b, 'dependency' AS category, CASE WHEN gained THEN 'warning' ELSE 'regression' END AS severity,
    CASE WHEN gained THEN 'gained:' ELSE 'lost:' END || var AS item, CASE WHEN NOT gained THEN CAST(count(*) AS VARCHAR) END AS a,
    CASE WHEN gained THEN CAST(count(*) AS VARCHAR) END AS b FROM dd GROUP BY run_a, run_b, var, gained"""
VV = "SELECT run_id, var, max(version) AS top, max_by(value, step) AS final FROM ver GROUP BY run_id, var"
VP = f"SELECT {PA}, coalesce(a.var, b.var) AS var, a.run_id AS ra, b.run_id AS rb, a.top AS ta, b.top AS tb, a.final AS fa, b.final AS fb FROM {sided('vv', ['var'])}"
K3 = """
  SELECT run_a, run_b, 'variable' AS category, 'info' AS severity, 'appeared:' || var AS item, NULL AS a, NULL AS b FROM vp WHERE ra IS NULL
  UNION ALL SELECT run_a, run_b, 'variable', 'warning', 'vanished:' || var, NULL, NULL FROM vp WHERE rb IS NULL
  UNION ALL SELECT run_a, run_b, 'variable', CASE WHEN tb > ta * 1.5 THEN 'warning' ELSE 'info' END, 'versions:' || var, CAST(ta AS VARCHAR), CAST(tb AS VARCHAR)
    FROM vp WHERE ta <> tb
  UNION ALL SELECT run_a, run_b, 'variable', 'regression', 'final:' || var, fa, fb FROM vp WHERE fa <> fb"""
RT = "SELECT run_id, step FROM st WHERE NOT EXISTS (SELECT 1 FROM de WHERE de.run_id = st.run_id AND de.dst = st.step)"
K4 = f"""
  SELECT run_a, run_b, 'root_cause' AS category, CASE what WHEN 'gained' THEN 'warning' ELSE 'info' END AS severity, what AS item,
    CASE WHEN what = 'lost' THEN CAST(n AS VARCHAR) END AS a, CASE WHEN what = 'gained' THEN CAST(n AS VARCHAR) END AS b
  FROM (SELECT run_a, run_b, unnest(['gained', 'lost']) AS what, unnest([count(*) FILTER (sa IS NULL), count(*) FILTER (sb IS NULL)]) AS n
        FROM (SELECT {PA}, a.step AS sa, b.step AS sb FROM {sided('rt', ['step'])}) GROUP BY run_a, run_b) WHERE n > 0"""
FK = "SELECT run_id, kind, count(*) AS n FROM fa GROUP BY run_id, kind"
FD = "SELECT DISTINCT run_id, description FROM fa"
K5 = f"""
  SELECT run_a, run_b, 'fact' AS category, CASE WHEN starts_with(kind, 'causal.') AND y < x THEN 'improvement'
    WHEN starts_with(kind, 'variable.mutation') AND y - x > x * 0.5 THEN 'warning' ELSE 'info' END AS severity, kind AS item, CAST(x AS VARCHAR) AS a, CAST(y AS VARCHAR) AS b
  FROM (SELECT {PA}, coalesce(a.kind, b.kind) AS kind, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM {sided('fk', ['kind'])}) WHERE x <> y
  UNION ALL
  SELECT run_a, run_b, 'fact', 'info', 'descriptions', CAST(count(*) FILTER (db IS NULL) AS VARCHAR), CAST(count(*) FILTER (da IS NULL) AS VARCHAR)
  FROM (SELECT {PA}, a.description AS da, b.description AS db FROM {sided('fd', ['description'])}) GROUP BY run_a, run_b
  HAVING count(*) FILTER (db IS NULL) > 0 OR count(*) FILTER (da IS NULL) > 0"""
CM = """
  SELECT run_id, unnest(['nodes', 'edges', 'max_fan_in', 'max_fan_out', 'depth', 'data_density']) AS metric,
    unnest([nodes * 1.0::DOUBLE, edges, fi, fo, depth, round(data * 1.0::DOUBLE / nodes, 2)]) AS v
  FROM (SELECT run_id, count(*) AS nodes, max(depth) AS depth FROM st GROUP BY run_id)
  JOIN (SELECT run_id, count(*) AS edges, count(*) FILTER (kind = 'data') AS data FROM ed GROUP BY run_id) USING (run_id)
  JOIN (SELECT run_id, max(n) AS fi FROM (SELECT run_id, dst, count(*) AS n FROM ed GROUP BY ALL) GROUP BY run_id) USING (run_id)
  JOIN (SELECT run_id, max(n) AS fo FROM (SELECT run_id, src, count(*) AS n FROM ed GROUP BY ALL) GROUP BY run_id) USING (run_id)"""
K6 = """
  SELECT run_a, run_b, 'complexity' AS category, CASE WHEN x.metric = 'max_fan_in' AND y.v - x.v > 3 THEN 'regression' WHEN x.metric = 'depth' AND y.v - x.v > 2 THEN 'regression'
    WHEN x.metric = 'data_density' AND y.v - x.v > 0.5 THEN 'warning' ELSE 'info' END AS severity, x.metric AS item, CAST(x.v AS VARCHAR) AS a, CAST(y.v AS VARCHAR) AS b
  FROM pr JOIN cm x ON x.run_id = run_a JOIN cm y ON y.run_id = run_b AND x.metric = y.metric WHERE x.v <> y.v"""
ALL = {**FACTS, "pr": PR, "ec": EC, "dd": DD, "ver": VER, "vv": VV, "vp": VP, "rt": RT, "fk": FK, "fd": FD, "cm": CM,
       "k1": K1, "k2": K2, "k3": K3, "k4": K4, "k5": K5, "k6": K6}
REPORT = " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(1, 7))


@query("k1_topology", cte("SELECT * FROM k1", **ALL))
def k1(spark, sf):
    return K.topology(X.steps(spark, sf), X.edges(spark, sf), pairs(spark, sf))


@query("k2_dependencies", cte("SELECT * FROM k2", **ALL))
def k2(spark, sf):
    return K.dependencies(X.edges(spark, sf), pairs(spark, sf))


@query("k3_variables", cte("SELECT * FROM k3", **ALL))
def k3(spark, sf):
    return K.variables(versions(spark, sf), pairs(spark, sf))


@query("k4_root_causes", cte("SELECT * FROM k4", **ALL))
def k4(spark, sf):
    return K.root_causes(X.steps(spark, sf), X.edges(spark, sf), pairs(spark, sf))


@query("k5_facts", cte("SELECT * FROM k5", **ALL))
def k5(spark, sf):
    return K.facts(X.facts(spark, sf), pairs(spark, sf))


@query("k6_complexity", cte("SELECT * FROM k6", **ALL))
def k6(spark, sf):
    return K.complexity(X.steps(spark, sf), X.edges(spark, sf), pairs(spark, sf))


@query("k7_report_rollup", cte(f"""
  SELECT run_a, run_b, category, severity, count(*) AS items FROM ({REPORT})
  GROUP BY GROUPING SETS ((run_a, run_b, category, severity), (run_a, run_b, category), (run_a, run_b))""", **ALL))
def k7(spark, sf):
    report = K.compare_runs(X.steps(spark, sf), X.edges(spark, sf), versions(spark, sf), X.facts(spark, sf), pairs(spark, sf))
    return K.rollup(report)
