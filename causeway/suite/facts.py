"""Facts of the event trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.values import joined
from causeway.operators import facts as H
from causeway.sources import fixtures as X
from causeway.suite import query
from causeway.suite.duck import cte
from causeway.suite.preparing import DF

# facts as rows of (run_id, kind, anchor, subject, description, evidence text)
EVO = """
  SELECT run_id, var, count(*) AS total, min_by(value, dst) AS fv, max_by(value, dst) AS lv,
    string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS evidence,
    count(*) FILTER (num IS NULL AND value <> 'None') AS others, count(num) AS numbers,
    bool_and(num > pn) FILTER (num IS NOT NULL AND pn IS NOT NULL) AS strict,
    bool_and(num >= pn) FILTER (num IS NOT NULL AND pn IS NOT NULL) AS up,
    bool_and(num <= pn) FILTER (num IS NOT NULL AND pn IS NOT NULL) AS down
  FROM (SELECT *, last_value(num IGNORE NULLS) OVER (PARTITION BY run_id, var ORDER BY dst
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pn
        FROM (SELECT de.run_id, de.var, de.dst, sn.value, TRY_CAST(sn.value AS DOUBLE) AS num
              FROM de JOIN sn ON sn.run_id = de.run_id AND sn.step = de.dst AND sn.var = de.var))
  GROUP BY run_id, var HAVING count(*) >= 2"""
EVO2 = """
  SELECT *, CASE WHEN others > 0 OR numbers < 2 THEN 'changing' WHEN strict THEN 'strictly_increasing'
      WHEN up THEN 'monotonic_increasing' WHEN down THEN 'monotonic_decreasing' ELSE 'changing' END AS pattern FROM evo"""
FACT_EVO = """
  SELECT run_id, 'variable.evolution' AS kind, 'variable.evolution#' || var AS fact_id, var AS subject,
    CASE pattern
      WHEN 'changing' THEN '`' || var || '` evolves through ' || total || ' versions: ' || fv || ' → ... → ' || lv
      ELSE '`' || var || CASE pattern WHEN 'strictly_increasing' THEN '` grows: '
             WHEN 'monotonic_increasing' THEN '` increases monotonically: ' ELSE '` decreases monotonically: ' END
           || fv || ' → ... → ' || lv || ' (' || total || ' versions)' END AS description, evidence
  FROM evo2"""
FACT_MUT = """
  SELECT run_id, 'variable.' || how, 'variable.' || how || '#' || var || ':' || dst, var,
    '`' || var || CASE how WHEN 'mutation' THEN '` mutated in place at step #' ELSE '` rebound to new object at step #' END || dst,
    CAST(dst AS VARCHAR)
  FROM (SELECT de.run_id, de.var, de.dst, CASE WHEN d.n.memory_id = s.memory_id THEN 'mutation' ELSE 'rebind' END AS how
        FROM de JOIN df d ON d.run_id = de.run_id AND d.step = de.dst AND d.var = de.var AND d.change = 'changed'
        JOIN sn s ON s.run_id = de.run_id AND s.step = de.src AND s.var = de.var
        JOIN evo e ON e.run_id = de.run_id AND e.var = de.var)"""
FACT_FAN = """
  SELECT run_id, 'data_flow.fan_in', 'data_flow.fan_in#' || dst, code,
    'Step #' || dst || ' converges ' || n || ' data flows from ' || v || ' variables', CAST(dst AS VARCHAR)
  FROM (SELECT run_id, dst, count(*) AS n, count(DISTINCT var) AS v FROM de GROUP BY ALL) f
  JOIN (SELECT run_id, step AS dst, code FROM st) USING (run_id, dst) WHERE n >= 3 AND v >= 2
  UNION ALL
  SELECT run_id, 'data_flow.fan_out', 'data_flow.fan_out#' || src, code,
    'Step #' || src || ' fans out to ' || n || ' downstream steps', CAST(src AS VARCHAR)
  FROM (SELECT run_id, src, count(*) AS n, count(DISTINCT var) AS v FROM de GROUP BY ALL) f
  JOIN (SELECT run_id, step AS src, code FROM st) USING (run_id, src) WHERE n >= 3 AND v >= 2"""
LB = """SELECT ce.run_id, ce.src, ce.dst, h.code AS head, b.line, b.code, b.t FROM ce
  JOIN st h ON h.run_id = ce.run_id AND h.step = ce.src AND h.t IN (0, 7)
  JOIN st b ON b.run_id = ce.run_id AND b.step = ce.dst"""
FACT_LOOP = """
  SELECT run_id, 'loop.iteration', 'loop.iteration#' || src, any_value(head),
    'Loop executes ' || (count(*) // greatest(1, count(DISTINCT line))) || ' iterations',
    array_to_string(list_sort(list_distinct(list_append(list(dst), src))), ',')
  FROM lb GROUP BY run_id, src
  UNION ALL
  SELECT run_id, 'loop.accumulation', 'loop.accumulation#' || src || ':' || var, var,
    '`' || var || '` is written ' || count(*) || ' times across loop iterations',
    string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst)
  FROM lb JOIN (SELECT run_id, step AS dst, var FROM wr) USING (run_id, dst) GROUP BY run_id, src, var HAVING count(*) >= 2
  UNION ALL
  SELECT run_id, 'loop.filter', 'loop.filter#' || src || ':' || dst, code, 'Loop filters items via `' || code || '`', dst || ',' || src
  FROM lb WHERE t = 1"""
FACT_CTL = """
  SELECT run_id, 'control.branch', 'control.branch#' || src, any_value(code),
    'Branch `' || any_value(code) || '` controls ' || count(*) || ' steps', array_to_string(list_sort(list_distinct(list_append(list(dst), src))), ',')
  FROM ce JOIN (SELECT run_id, step AS src, code FROM st WHERE t = 1) USING (run_id, src) GROUP BY run_id, src
  UNION ALL
  SELECT run_id, 'control.early_return', 'control.early_return#' || step, code, 'Early return at step #' || step || ': `' || code || '`',
    CAST(step AS VARCHAR) FROM st WHERE t = 2 AND indent > 0"""
FACT_CAUSE = """
  SELECT run_id, 'causal.root_cause', 'causal.root_cause#' || step, code, 'Root cause: `' || code || '` — source of data flow', CAST(step AS VARCHAR)
  FROM st WHERE EXISTS (SELECT 1 FROM wr WHERE wr.run_id = st.run_id AND wr.step = st.step)
    AND NOT EXISTS (SELECT 1 FROM de WHERE de.run_id = st.run_id AND de.dst = st.step)
  UNION ALL
  SELECT run_id, 'causal.convergence', 'causal.convergence#' || dst, code,
    'Convergence point: `' || code || '` receives ' || n || ' data flows', CAST(dst AS VARCHAR)
  FROM (SELECT run_id, dst, count(*) AS n FROM de GROUP BY ALL) JOIN (SELECT run_id, step AS dst, code FROM st) USING (run_id, dst)
  WHERE n >= 3"""
FA = f"""{FACT_EVO} UNION ALL {FACT_MUT} UNION ALL {FACT_FAN} UNION ALL {FACT_LOOP} UNION ALL {FACT_CTL} UNION ALL {FACT_CAUSE}"""
FACTS = {"df": DF, "evo": EVO, "evo2": EVO2, "lb": LB, "fa": FA}


def shown(df):
    return df.select("run_id", "kind", "fact_id", "subject", "description",
                     F.concat_ws(",", F.col("evidence").cast("array<string>")).alias("evidence"))


def _register(name, where, build):
    @query(name, cte(f"SELECT * FROM fa WHERE {where}", **FACTS))
    def run(spark, sf):
        return shown(build(spark, sf))


_register("h1_evolution", "kind = 'variable.evolution'",
          lambda s, d: H.evolution(X.edges(s, d), X.snapshots(s, d), **X.fit(s, d)))
_register("h2_mutation_rebind", "kind IN ('variable.mutation', 'variable.rebind')",
          lambda s, d: H.mutations(X.edges(s, d), X.diff(s, d), X.snapshots(s, d)))
_register("h3_fan_in_out", "starts_with(kind, 'data_flow.')", lambda s, d: H.fans(X.steps(s, d), X.edges(s, d)))
for n, k in (("h4_loop_iteration", "iteration"), ("h5_loop_accumulation", "accumulation"), ("h6_loop_filter", "filter")):
    _register(n, f"kind = 'loop.{k}'",
              lambda s, d, k=k: H.loops(X.steps(s, d), X.edges(s, d)).filter(F.col("kind") == f"loop.{k}"))
for n, k in (("h7_branch", "branch"), ("h8_early_return", "early_return")):
    _register(n, f"kind = 'control.{k}'",
              lambda s, d, k=k: H.controls(X.steps(s, d), X.edges(s, d)).filter(F.col("kind") == f"control.{k}"))
for n, k in (("h9_root_cause", "root_cause"), ("h10_convergence", "convergence")):
    _register(n, f"kind = 'causal.{k}'",
              lambda s, d, k=k: H.causes(X.steps(s, d), X.edges(s, d)).filter(F.col("kind") == f"causal.{k}"))


@query("h1_orders_evolution", cte("""
  SELECT run_id, var, CASE WHEN strict THEN 'strictly_increasing' WHEN up THEN 'monotonic_increasing'
    WHEN down THEN 'monotonic_decreasing' ELSE 'changing' END AS pattern, total
  FROM (SELECT run_id, var, count(*) AS total, bool_and(num > p) AS strict, bool_and(num >= p) AS up, bool_and(num <= p) AS down
        FROM (SELECT *, lag(num) OVER (PARTITION BY run_id, var ORDER BY step) AS p
              FROM (SELECT *, TRY_CAST(value AS DOUBLE) AS num FROM oh WHERE step > 0)) GROUP BY run_id, var HAVING count(*) >= 2)"""))
def h1b(spark, sf):
    # every order reads the customer's previous one
    h = X.orders_history(spark, sf)
    edges = h.filter("step > 0").select(
        "run_id", (F.col("step") - 1).alias("src"), F.col("step").alias("dst"), F.lit("data").alias("kind"), "var")
    return H.evolution(edges, h).select(
        "run_id", F.col("subject").alias("var"), F.col("metadata")["pattern"].alias("pattern"),
        F.col("metadata")["total_versions"].cast("long").alias("total"))


@query("f14_fact_profile", cte("""
  SELECT kind, count(*) AS facts, round(avg(len(string_split(evidence, ','))), 3) AS avg_evidence FROM fa GROUP BY kind""", **FACTS))
def f14b(spark, sf):
    from causeway.operators.traverse import fact_profile
    return fact_profile(X.facts(spark, sf)).select("kind", "facts", F.round("avg_evidence", 3).alias("avg_evidence"))


@query("d15_subproblem_nodes", cte("""
  SELECT run_id, type, count(*) AS nodes, sum(iterations) AS iterations FROM (
    SELECT DISTINCT run_id, func, 'function' AS type, 0 AS iterations FROM st
    UNION ALL SELECT run_id, fact_id, 'loop', coalesce(TRY_CAST(regexp_extract(description, 'executes ([0-9]+)', 1) AS INTEGER), 0)
    FROM fa WHERE starts_with(kind, 'loop.')) GROUP BY ALL""", **FACTS))
def d15c(spark, sf):
    from causeway.operators.graph import subproblems
    nodes, _ = subproblems(X.steps(spark, sf), X.edges(spark, sf), X.facts(spark, sf))
    return nodes.groupBy("run_id", "type").agg(
        F.count("*").alias("nodes"), F.sum(F.coalesce("iterations", F.lit(0))).alias("iterations"))
