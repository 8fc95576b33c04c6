"""Importance scores, findings and agent state over the event trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.values import joined, round3
from causeway.operators import agent as A
from causeway.operators import findings as N
from causeway.operators import scores as L
from causeway.sources import fixtures as X
from causeway.suite import query
from causeway.suite.duck import cte
from causeway.suite.graphs import VG, version_graph
from causeway.suite.preparing import DF

ST = """CASE t WHEN 0 THEN 0.6 WHEN 1 THEN 0.6 WHEN 2 THEN 0.65 WHEN 3 THEN 0.35 WHEN 7 THEN 0.6 ELSE 0.15 END::DOUBLE"""
DELTA = """
  CASE WHEN n.type <> o.type THEN 0.4
    WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a = 0 AND b = 0 THEN 0 WHEN abs(b - a) / greatest(abs(a), 1) > 10 THEN 0.45
      WHEN abs(b - a) / greatest(abs(a), 1) > 2 THEN 0.3 WHEN abs(b - a) / greatest(abs(a), 1) > 0.5 THEN 0.15 ELSE 0.05 END
    WHEN abs(length(n.value) - length(o.value)) > 10 THEN 0.2 WHEN abs(length(n.value) - length(o.value)) > 0 THEN 0.05
    WHEN abs(len(string_split(n.value, ',')) - len(string_split(o.value, ','))) >= 2 THEN 0.25 ELSE 0.05 END::DOUBLE"""
DY = f"""
  SELECT run_id, step, n_new, n_changed, least(least(n_new * 0.1::DOUBLE, 0.3::DOUBLE) + coalesce(d, 0) + CASE WHEN n_changed >= 3 THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS dynamic
  FROM (SELECT run_id, step, count(*) FILTER (change = 'new') AS n_new, count(*) FILTER (change = 'changed') AS n_changed,
          max(CASE WHEN change = 'changed' THEN {DELTA} END) AS d
        FROM (SELECT *, TRY_CAST(o.value AS DOUBLE) AS a, TRY_CAST(n.value AS DOUBLE) AS b FROM df) WHERE change IN ('new', 'changed') GROUP BY run_id, step)"""
FU = """
  SELECT run_id, step, max(ahead) AS reach, string_agg(DISTINCT CAST(step + ahead AS VARCHAR), ',') AS affects,
    CASE max(ahead) WHEN 3 THEN 0.25 WHEN 2 THEN 0.2 ELSE 0.15 END::DOUBLE AS future
  FROM (SELECT c.run_id, c.step, s.step - c.step AS ahead FROM (SELECT * FROM df WHERE change = 'changed') c
        JOIN st s ON s.run_id = c.run_id AND s.step BETWEEN c.step + 1 AND c.step + 3
        LEFT JOIN df x ON x.run_id = s.run_id AND x.step = s.step AND x.var = c.var AND x.change IN ('new', 'changed')
        WHERE x.run_id IS NOT NULL OR regexp_matches(s.code, '\\b' || c.var || '\\b')) GROUP BY run_id, step"""
SCORE = {"df": DF, "dy": DY, "fu": FU}


@query("l1_structural_score", cte(f"SELECT DISTINCT code, {ST} AS structural FROM st"))
def l1(spark, sf):
    return L.structural_scores(X.steps(spark, sf)).select("code", "structural")


@query("l2_dynamic_score", cte("SELECT run_id, step, n_new, n_changed, round(dynamic, 3) AS dynamic FROM dy", **SCORE))
def l2(spark, sf):
    return L.dynamic_scores(X.diff(spark, sf)).withColumn("dynamic", round3(F.col("dynamic")))


@query("l2_orders_dynamic", cte("""
  SELECT run_id, step, round(max(CASE WHEN a IS NULL THEN CASE WHEN abs(length(value) - length(p)) > 10 THEN 0.2 ELSE 0.05 END
      WHEN abs(b - a) / greatest(abs(a), 1) > 10 THEN 0.45 WHEN abs(b - a) / greatest(abs(a), 1) > 2 THEN 0.3
      WHEN abs(b - a) / greatest(abs(a), 1) > 0.5 THEN 0.15 ELSE 0.05 END)::DOUBLE + CASE WHEN count(*) >= 3 THEN 0.1::DOUBLE ELSE 0 END, 3) AS dynamic
  FROM (SELECT *, lag(value) OVER w AS p, TRY_CAST(lag(value) OVER w AS DOUBLE) AS a, TRY_CAST(value AS DOUBLE) AS b FROM oh
        WINDOW w AS (PARTITION BY run_id, var ORDER BY step)) WHERE p IS NOT NULL AND p <> value GROUP BY run_id, step"""))
def l2b(spark, sf):
    from causeway.operators.prepare import step_diff
    h = X.orders_history(spark, sf)
    d = step_diff(h, h.select("run_id", "step").distinct()).filter("change = 'changed'")
    return L.dynamic_scores(d).select("run_id", "step", round3(F.col("dynamic")).alias("dynamic"))


@query("l3_future_impact", cte("SELECT run_id, step, reach, future FROM fu", **SCORE))
def l3(spark, sf):
    return L.future_impact(X.steps(spark, sf), X.diff(spark, sf)).select("run_id", "step", "reach", "future")


@query("l4_importance", cte(f"""
  SELECT run_id, step, round(s, 3) AS score, CASE WHEN s >= 0.55 THEN 'high' WHEN s >= 0.3 THEN 'medium' ELSE 'low' END AS importance FROM (
    SELECT run_id, step, least(least(0.55::DOUBLE * a + 0.45::DOUBLE * d + CASE WHEN a >= 0.3 AND d >= 0.2 THEN 0.15::DOUBLE WHEN d >= 0.4 THEN 0.1::DOUBLE ELSE 0 END, 1) + f, 1) AS s
    FROM (SELECT st.run_id, st.step, {ST} AS a, coalesce(dynamic, 0) AS d, coalesce(future, 0) AS f FROM st LEFT JOIN dy USING (run_id, step) LEFT JOIN fu USING (run_id, step)))""", **SCORE))
def l4(spark, sf):
    return L.importance(X.steps(spark, sf), X.diff(spark, sf)).select("run_id", "step", "score", "importance")


@query("l4_importance_with_labels", cte(f"""
  SELECT run_id, step, round(s, 3) AS score FROM (
    SELECT run_id, step, least(least(0.4::DOUBLE * a + 0.4::DOUBLE * d + 0.2::DOUBLE * l + CASE WHEN a >= 0.3 AND d >= 0.2 THEN 0.15::DOUBLE WHEN d >= 0.4 THEN 0.1::DOUBLE ELSE 0 END, 1) + f, 1) AS s
    FROM (SELECT st.run_id, st.step, {ST} AS a, coalesce(dynamic, 0) AS d, coalesce(future, 0) AS f,
            greatest(CASE line % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 0.5 ELSE 0.2 END, CASE WHEN line % 5 = 0 THEN 0.85 ELSE 0 END)::DOUBLE AS l
          FROM st LEFT JOIN dy USING (run_id, step) LEFT JOIN fu USING (run_id, step)))""", **SCORE))
def l4b(spark, sf):
    s = X.steps(spark, sf)
    labels = s.select("run_id", "step", F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("line") % 3 + 1).alias("label"),
                      (F.col("line") % 5 == 0).alias("turning_point"))
    return L.importance(s, X.diff(spark, sf), labels).select("run_id", "step", "score")


@query("l5_repeated_states", cte("""
  SELECT run_id, count(*) AS count, min(step) AS first_step FROM (
    SELECT st.run_id, st.step, coalesce(string_agg(var || '=' || sn.value, ';' ORDER BY var), '') AS state FROM st LEFT JOIN sn USING (run_id, step) GROUP BY st.run_id, st.step)
  GROUP BY run_id, state HAVING count(*) >= 3"""))
def l5(spark, sf):
    return N.repeated_states(X.steps(spark, sf), X.snapshots(spark, sf)).select("run_id", "count", "first_step")


@query("l6_recursion", cte("""
  SELECT run_id, CASE WHEN top > 5 AND down = 0 THEN 'recursion_no_base' ELSE 'deep_recursion' END AS type, CASE WHEN top > 5 AND down = 0 THEN 'critical' ELSE 'warning' END AS severity,
    top AS count, s AS first_step
  FROM (SELECT run_id, max(depth) AS top, count(*) FILTER (depth > p) AS up, count(*) FILTER (depth < p) AS down, min(CASE WHEN depth > 3 THEN step END) AS s
        FROM (SELECT *, lag(depth) OVER (PARTITION BY run_id ORDER BY step) AS p FROM st) GROUP BY run_id)
  WHERE (top > 5 AND down = 0) OR (top > 3 AND down < up * 0.3)"""))
def l6(spark, sf):
    return N.recursion(X.steps(spark, sf), **X.fit(spark, sf)).select("run_id", "type", "severity", "count", "first_step")


@query("l7_stale_mutations", cte("""
  SELECT run_id, var AS subject, count(*) AS count FROM df WHERE change IN ('new', 'changed') AND NOT EXISTS (
    SELECT 1 FROM rdx WHERE rdx.run_id = df.run_id AND rdx.var = df.var) GROUP BY run_id, var HAVING count(*) >= 2""",
    df=DF, rdx="SELECT run_id, var FROM vr WHERE var <> 'signup'", vr=VG["vr"]))
def l7(spark, sf):
    unread = X.steps(spark, sf).withColumn("code", F.replace("code", F.lit("signup"), F.lit("other")))  # a trace in which one variable is never read
    return N.stale_mutations(unread, X.snapshots(spark, sf), X.diff(spark, sf)).select("run_id", "subject", "count")


@query("l8_type_instability", cte("""
  SELECT run_id, var || ':' || ty AS subject FROM (SELECT run_id, var, string_agg(DISTINCT type, ',' ORDER BY type) AS ty, count(DISTINCT type) AS n FROM sn GROUP BY run_id, var)
  WHERE n = 2 AND ty NOT IN ('float,int', 'NoneType,int', 'NoneType,str')"""))
def l8(spark, sf):
    return N.type_instability(X.snapshots(spark, sf)).select("run_id", "subject")


@query("l8_orders_types", cte("SELECT run_id, var || ':float,str' AS subject FROM (SELECT run_id, 'all' AS var FROM oh GROUP BY run_id)"))
def l8b(spark, sf):
    h = X.orders_history(spark, sf).withColumn("var", F.lit("all"))
    return N.type_instability(h).select("run_id", "subject")


FI = """
  SELECT run_id, CASE WHEN top > 5 AND down = 0 THEN 4 WHEN top > 3 AND down < up * 0.3 THEN 2 ELSE 1 END AS r FROM (
    SELECT run_id, max(depth) AS top, count(*) FILTER (depth > p) AS up, count(*) FILTER (depth < p) AS down
    FROM (SELECT *, lag(depth) OVER (PARTITION BY run_id ORDER BY step) AS p FROM st) GROUP BY run_id)"""


@query("l9_health", cte("""
  SELECT run_id, n AS total_steps, top AS max_depth,
    (['healthy', 'warning', 'error', 'critical'])[greatest(r, CASE WHEN n > 80 THEN 2 ELSE 1 END, CASE WHEN ls > 0 THEN 3 ELSE 1 END)] AS severity
  FROM (SELECT run_id, count(*) AS n, max(depth) AS top FROM st GROUP BY run_id) JOIN fi USING (run_id)
  JOIN (SELECT run_id, max(CASE WHEN c >= 3 THEN 1 ELSE 0 END) AS ls FROM (SELECT run_id, state, count(*) AS c FROM (
    SELECT st.run_id, st.step, coalesce(string_agg(var || '=' || sn.value, ';' ORDER BY var), '') AS state FROM st LEFT JOIN sn USING (run_id, step) GROUP BY st.run_id, st.step)
    GROUP BY ALL) GROUP BY run_id) USING (run_id)""", fi=FI))
def l9(spark, sf):
    s = X.steps(spark, sf)
    found = (N.repeated_states(s, X.snapshots(spark, sf)).unionByName(N.recursion(s, **X.fit(spark, sf)))
             .unionByName(N.long_runs(s, 80)))
    return N.health(s, found).select("run_id", "total_steps", "max_depth", "severity")


@query("l9_findings", cte("""
  SELECT run_id, 'infinite_loop' AS type, 'error' AS severity, CASE WHEN state IS NULL THEN '' ELSE substr(sha256(state), 1, 8) END AS subject, count(*) AS count, min(step) AS first_step FROM (
    SELECT st.run_id, st.step, CASE WHEN count(sn.var) > 0 THEN CAST(to_json(list({'var': sn.var, 'value': sn.value} ORDER BY sn.var)) AS VARCHAR) END AS state
    FROM st LEFT JOIN sn USING (run_id, step) GROUP BY st.run_id, st.step)
  GROUP BY run_id, state HAVING count(*) >= 3
  UNION ALL SELECT run_id, CASE WHEN top > 5 AND down = 0 THEN 'recursion_no_base' ELSE 'deep_recursion' END, CASE WHEN top > 5 AND down = 0 THEN 'critical' ELSE 'warning' END, 'depth', top, s
  FROM (SELECT run_id, max(depth) AS top, count(*) FILTER (depth > p) AS up, count(*) FILTER (depth < p) AS down, min(CASE WHEN depth > 3 THEN step END) AS s
        FROM (SELECT *, lag(depth) OVER (PARTITION BY run_id ORDER BY step) AS p FROM st) GROUP BY run_id)
  WHERE (top > 5 AND down = 0) OR (top > 3 AND down < up * 0.3)
  UNION ALL SELECT run_id, 'stale_mutation', 'warning', var, count(*), min(step) FROM df WHERE change IN ('new', 'changed') AND NOT EXISTS (
    SELECT 1 FROM vr WHERE vr.run_id = df.run_id AND vr.var = df.var) GROUP BY run_id, var HAVING count(*) >= 2
  UNION ALL SELECT run_id, 'type_instability', 'warning', var || ':' || ty, n, s FROM (
    SELECT run_id, var, string_agg(DISTINCT type, ',' ORDER BY type) AS ty, count(DISTINCT type) AS n, min(step) AS s FROM sn GROUP BY run_id, var)
  WHERE n = 2 AND ty NOT IN ('float,int', 'NoneType,int', 'NoneType,str')
  UNION ALL SELECT run_id, 'performance', 'warning', 'steps', count(*), NULL FROM st GROUP BY run_id HAVING count(*) > 80""", df=DF, vr=VG["vr"]))
def l9b(spark, sf):
    return N.all_findings(X.steps(spark, sf), X.snapshots(spark, sf), X.diff(spark, sf), 80, **X.fit(spark, sf))


@query("l10_failure_points", cte("""
  SELECT run_id, step, CASE WHEN t = 2 THEN 'return' ELSE 'end' END AS type, code FROM st JOIN (SELECT run_id, max(step) AS step FROM st GROUP BY run_id) USING (run_id, step)"""))
def l10(spark, sf):
    return N.failure_points(X.steps(spark, sf)).select("run_id", "step", "type", "code")


@query("l10_exception_points", cte("""
  SELECT run_id, max(step) AS step FROM (SELECT run_id, step, w, max(step) OVER (PARTITION BY run_id) AS last FROM st)
  WHERE step > last - 5 AND w = 'error' GROUP BY run_id"""))
def l10b(spark, sf):
    from causeway.sources.fixtures import indexed_events
    ev = X.stored(spark, sf, "events", lambda: indexed_events(spark, sf))
    code = F.when(F.col("w") == "error", "raise ValueError()").otherwise(F.col("w"))
    return N.failure_points(ev.select("run_id", "step", F.col("k").alias("line"), code.alias("code"))).filter(
        "type = 'exception'").select("run_id", "step")


@query("l10_causal_analysis")
def l10c(spark, sf):
    nodes, edges = version_graph(spark, sf)
    t = N.failure_targets(N.failure_points(X.steps(spark, sf)), X.snapshots(spark, sf), X.diff(spark, sf))
    return N.causal_analysis(nodes, edges, t)


VSTATE = """
  SELECT run_id, var, count(*) AS values, min(step) AS first_step, max(step) AS last_step,
    max_by(CASE WHEN change = 'changed' THEN n.value ELSE '?' END, step) AS last_value, count(*) FILTER (m = var) AS mutations
  FROM (SELECT *, min(CASE WHEN change = 'changed' AND n.memory_id = o.memory_id THEN var END) OVER (PARTITION BY run_id, step) AS m FROM df WHERE change IN ('new', 'changed'))
  GROUP BY run_id, var"""


@query("l11_variable_state", cte("SELECT * FROM vs", df=DF, vs=VSTATE))
def l11(spark, sf):
    return A.variable_state(X.diff(spark, sf))


@query("l11_merged_state", cte("SELECT * FROM vs", df=DF, vs=VSTATE))
def l11b(spark, sf):
    d = X.diff(spark, sf)
    return A.merge_states(A.variable_state(d.filter("step < 30")).unionByName(A.variable_state(d.filter("step >= 30"))))


@query("l12_observations", cte("""
  SELECT run_id, step, 'change' AS kind, NULL AS branch_taken FROM df WHERE change <> 'same' GROUP BY run_id, step
  UNION ALL SELECT run_id, step, 'branch', CASE WHEN t = 1 THEN 'if_true' ELSE 'loop_enter' END FROM st WHERE t IN (0, 1, 7)
  UNION ALL SELECT run_id, step, 'step', NULL FROM st WHERE t NOT IN (0, 1, 7) AND NOT EXISTS (
    SELECT 1 FROM df WHERE df.run_id = st.run_id AND df.step = st.step AND change <> 'same')""", df=DF))
def l12(spark, sf):
    return A.observations(X.steps(spark, sf), X.diff(spark, sf)).select("run_id", "step", "kind", "branch_taken")


@query("l12_observation_slices", cte("""
  SELECT run_id, 'touching' AS what, count(*) AS n FROM df WHERE change IN ('new', 'changed') AND var = 'click' AND step BETWEEN 5 AND 40 GROUP BY run_id
  UNION ALL SELECT run_id, 'touched', count(DISTINCT var) FROM df WHERE change IN ('new', 'changed') AND step BETWEEN 5 AND 40 GROUP BY run_id""", df=DF))
def l12b(spark, sf):
    o = A.between(A.observations(X.steps(spark, sf), X.diff(spark, sf)), 5, 40)
    a = A.touching(o, "click").groupBy("run_id").agg(F.lit("touching").alias("what"), F.count("*").alias("n"))
    return a.unionByName(A.touched_variables(o).groupBy("run_id").agg(F.lit("touched").alias("what"), F.count("*").alias("n")))


HY = """
  SELECT run_id, 'monotonic_increase' AS pattern, var AS subject, n AS support, 0.7::DOUBLE AS confidence FROM (
    SELECT run_id, var, count(*) AS n, bool_and(d >= 0) AS up FROM (SELECT *, v - lag(v) OVER (PARTITION BY run_id, var ORDER BY step) AS d
      FROM (SELECT run_id, var, step, TRY_CAST(n.value AS DOUBLE) AS v FROM df WHERE change = 'changed') WHERE v IS NOT NULL) GROUP BY run_id, var) WHERE n >= 3 AND up
  UNION ALL SELECT run_id, 'heavy_mutation', var, mutations, 0.6 FROM vs WHERE mutations > 2
  UNION ALL SELECT run_id, 'complex_control_flow', '', count(*), 0.8 FROM st WHERE t IN (0, 1, 7) GROUP BY run_id HAVING count(*) > 3 AND count(*) FILTER (t IN (0, 7)) > 0"""


@query("l13_hypotheses", cte("SELECT * FROM hy", df=DF, vs=VSTATE, hy=HY))
def l13(spark, sf):
    return A.hypotheses(X.diff(spark, sf), X.steps(spark, sf), **X.fit(spark, sf))


@query("l13_confidence", "SELECT conv_id, round(least(user_turns * 1.0::DOUBLE / (user_turns + other), 0.95), 3) AS confidence FROM "
                         "(SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role <> 'user') AS other FROM conversations GROUP BY conv_id)")
def l13b(spark, sf):
    c = X.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("s"), F.count_if(F.col("role") != "user").alias("c"))
    return c.select("conv_id", round3(A.confidence(F.col("s"), F.col("c"))).alias("confidence"))


@query("l14_cross_run_knowledge", cte("SELECT var, count(*) AS runs, sum(mutations) AS mutations, max(mutations) AS most FROM vs WHERE mutations > 1 GROUP BY var", df=DF, vs=VSTATE))
def l14(spark, sf):
    return A.cross_run_knowledge(A.variable_state(X.diff(spark, sf)), 1)


@query("l23_agent_quality", cte("""
  SELECT run_id, coalesce(hypotheses, 0) AS hypotheses, evidence_density, actions, succeeded, failed
  FROM (SELECT run_id, count(*) AS hypotheses, round(avg(support), 3) AS evidence_density FROM hy GROUP BY run_id)
  RIGHT JOIN (SELECT run_id, count(*) AS actions, count(*) FILTER (value > 20) AS succeeded, count(*) FILTER (value <= 20) AS failed FROM ev GROUP BY run_id) USING (run_id)""", df=DF, vs=VSTATE, hy=HY))
def l23(spark, sf):
    h = A.hypotheses(X.diff(spark, sf), X.steps(spark, sf), **X.fit(spark, sf))
    acts = X.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"), (F.col("value") > 20).alias("success"))
    return A.agent_quality(h, acts).withColumn("evidence_density", round3(F.col("evidence_density")))
