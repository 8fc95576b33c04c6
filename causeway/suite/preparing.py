"""Trace preparation over the event trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.values import joined
from causeway.operators import prepare as P
from causeway.sources import fixtures as X
from causeway.suite import query
from causeway.suite.duck import cte

# every variable of a step against the step before
DF = """
  SELECT run_id, step, var, n, o,
    CASE WHEN n IS NULL THEN 'removed' WHEN o IS NULL THEN 'new'
         WHEN n.value <> o.value OR n.memory_id <> o.memory_id THEN 'changed' ELSE 'same' END AS change
  FROM (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.step, b.step + 1) AS step,
               coalesce(a.var, b.var) AS var,
               CASE WHEN a.run_id IS NOT NULL THEN a END AS n, CASE WHEN b.run_id IS NOT NULL THEN b END AS o
        FROM sn a FULL JOIN sn b ON a.run_id = b.run_id AND a.var = b.var AND a.step = b.step + 1)
  WHERE n IS NOT NULL OR EXISTS (SELECT 1 FROM st WHERE st.run_id = x.run_id AND st.step = x.step)"""
DF = DF.replace("a.step = b.step + 1)\n", "a.step = b.step + 1) x\n")


def _diff(spark, sf):
    t = X.trace(spark, sf)
    return t, P.step_diff(t.snapshots, t.steps)


@query("c1_step_diff", cte("SELECT run_id, step, var, change, o.value AS old_value, n.value AS new_value FROM df "
                           "WHERE change <> 'same'", df=DF))
def c1(spark, sf):
    _, d = _diff(spark, sf)
    return d.filter("change <> 'same'").select(
        "run_id", "step", "var", "change", F.col("old.value").alias("old_value"), F.col("now.value").alias("new_value"))


@query("c2_mutation_rebind", cte(
    "SELECT run_id, step, var, CASE WHEN n.memory_id = o.memory_id THEN 'mutated' ELSE 'rebound' END AS how "
    "FROM df WHERE change = 'changed'", df=DF))
def c2(spark, sf):
    _, d = _diff(spark, sf)
    return d.filter("change = 'changed'").select("run_id", "step", "var", "how")


@query("c3_alias_groups", cte(
    "SELECT run_id, step, memory_id, string_agg(var, ',' ORDER BY var) AS vars FROM sn "
    "GROUP BY run_id, step, memory_id HAVING count(*) > 1"))
def c3(spark, sf):
    return P.alias_groups(X.snapshots(spark, sf)).select("run_id", "step", "memory_id", joined("vars").alias("vars"))


@query("c3_alias_references", cte(
    "SELECT a.run_id, a.step, a.var, min(b.var) AS is_reference_to FROM sn a JOIN sn b ON a.run_id = b.run_id "
    "AND a.step = b.step AND a.memory_id = b.memory_id AND a.var <> b.var GROUP BY a.run_id, a.step, a.var"))
def c3b(spark, sf):
    return P.alias_references(X.snapshots(spark, sf))


@query("c4_container_deltas", cte("""
  SELECT * FROM (SELECT run_id, step, var, n.type AS type,
    array_to_string(list_sort(list_distinct(list_filter(n.container_keys, lambda x: NOT list_contains(o.container_keys, x)))), ',') AS added,
    array_to_string(list_sort(list_distinct(list_filter(o.container_keys, lambda x: NOT list_contains(n.container_keys, x)))), ',') AS removed
  FROM df WHERE change = 'changed' AND n.memory_id = o.memory_id
    AND n.container_keys IS NOT NULL AND o.container_keys IS NOT NULL) WHERE added <> '' OR removed <> ''""", df=DF))
def c4(spark, sf):
    _, d = _diff(spark, sf)
    return P.container_deltas(d).select(
        "run_id", "step", "var", "type", joined("added").alias("added"), joined("removed").alias("removed"))


@query("c5_drop_repeats", cte("""
  SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS index
  FROM (SELECT *, lag(line) OVER w AS pl, lag(depth) OVER w AS pd, lag(func) OVER w AS pf
        FROM (SELECT run_id, step, line % 2 AS line, depth // 4 AS depth, 'fn' AS func FROM st WHERE t <> 2)
        WINDOW w AS (PARTITION BY run_id ORDER BY step))
  WHERE NOT (pl IS NOT NULL AND pl = line AND pd = depth AND pf = func)"""))
def c5(spark, sf):
    # returns play the part of definition lines, coarse lines make repeats common
    s = X.steps(spark, sf).select(
        "run_id", "step", (F.col("line") % 2).alias("line"), F.floor(F.col("depth") / 4).alias("depth"),
        F.lit("fn").alias("func"), F.regexp_replace("code", "^return", "def").alias("code"))
    return P.drop_repeats(s, **X.fit(spark, sf)).select("run_id", "step", "index")


@query("c6_reads_writes", cte("""
  SELECT code, CASE t WHEN 0 THEN CASE WHEN w = r THEN '' ELSE r END WHEN 7 THEN a WHEN 8 THEN a WHEN 1 THEN r
      WHEN 2 THEN r WHEN 3 THEN array_to_string(list_sort(list_distinct([w, r])), ',')
      WHEN 4 THEN array_to_string(list_sort(list_distinct([w, r, r2])), ',')
      WHEN 6 THEN r ELSE array_to_string(list_sort(list_distinct([w, r])), ',') END AS reads,
    CASE WHEN t IN (0, 3, 6, 8) THEN w WHEN t = 9 THEN array_to_string(list_sort(list_distinct([w, r])), ',')
      ELSE '' END AS writes
  FROM (SELECT DISTINCT t, w, CASE WHEN t = 7 THEN r END AS unused, r, r2, code,
          CASE WHEN t = 7 THEN '' ELSE array_to_string(list_sort(list_distinct([r, r2, r3])), ',') END AS a
        FROM (SELECT e.*, s.code FROM ev e JOIN st s USING (run_id, step)))
  WHERE t NOT IN (1, 7)
  GROUP BY ALL
  UNION SELECT code, '', '' FROM st WHERE t IN (1, 7)"""))
def c6(spark, sf):
    return P.reads_writes(X.steps(spark, sf)).select("code", joined("reads").alias("reads"), joined("writes").alias("writes"))


@query("c7_block_structure", cte("""
  SELECT p.run_id, p.step, coalesce(b.block_id, 0) AS block_id, CASE WHEN b.first = p.step THEN coalesce(u.block_id, 0) END AS parent_block_id,
    CASE WHEN b.first = p.step THEN p.indent END AS block_indent, CASE WHEN b.first = p.step THEN coalesce(p.test, -1) END AS condition_step
  FROM pa p LEFT JOIN bl b ON b.run_id = p.run_id AND b.path = p.path LEFT JOIN bl u ON u.run_id = p.run_id AND u.path = p.up""",
  pa="""
    SELECT s.run_id, s.step, s.indent, arg_max_null(c.test, c.indent) FILTER (c.step IS NOT NULL) AS test,
      coalesce(string_agg(c.name, '/' ORDER BY c.indent), '') AS path,
      coalesce(string_agg(c.name, '/' ORDER BY c.indent) FILTER (c.indent < s.top), '') AS up
    FROM (SELECT st.*, (SELECT max(h.indent) FROM en h WHERE h.run_id = st.run_id AND h.step = st.step) AS top FROM st) s
    LEFT JOIN (SELECT en.run_id, en.step AS at, en.head AS step, en.indent, h.code, CASE WHEN regexp_matches(trim(h.code), '^(for|while) ') THEN 'line ' || h.line ELSE 'step ' || h.step END AS name,
        CASE WHEN regexp_matches(trim(h.code), '^(for|while|if|elif) ') THEN h.step END AS test FROM en JOIN st h ON h.run_id = en.run_id AND h.step = en.head) c
      ON c.run_id = s.run_id AND c.at = s.step
    GROUP BY s.run_id, s.step, s.indent""",
  bl="SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first) AS block_id FROM (SELECT run_id, path, min(step) AS first FROM pa WHERE path <> '' GROUP BY run_id, path)",
  en="""
    SELECT s.run_id, s.step, c.step AS head, c.indent FROM st s JOIN st c ON c.run_id = s.run_id AND c.step < s.step AND c.indent < s.indent
    WHERE NOT EXISTS (SELECT 1 FROM st j WHERE j.run_id = s.run_id AND j.step > c.step AND j.step < s.step AND j.indent <= c.indent)"""))
def c7(spark, sf):
    return P.block_structure(X.steps(spark, sf), **X.fit(spark, sf))


@query("c8_enclosing_control", cte("""
  SELECT s.run_id, s.step, max(c.step) AS control_step
  FROM st s JOIN st c ON c.run_id = s.run_id AND c.step < s.step AND c.ctl AND c.indent < s.indent
  WHERE NOT EXISTS (SELECT 1 FROM st j WHERE j.run_id = s.run_id AND j.step > c.step AND j.step < s.step
                    AND j.indent <= c.indent)
  GROUP BY s.run_id, s.step"""))
def c8(spark, sf):
    return P.enclosing_control(X.steps(spark, sf), **X.fit(spark, sf))


@query("c9_loop_groups", cte("""
  SELECT run_id, line, first_step, last_step, steps,
    row_number() OVER (PARTITION BY run_id, stretch ORDER BY island) - 1 AS iteration
  FROM (SELECT *, sum(CASE WHEN steps < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY island) AS stretch
        FROM (SELECT run_id, island, min(line) AS line, min(step) AS first_step, max(step) AS last_step, count(*) AS steps
              FROM (SELECT *, sum(CASE WHEN pl IS NULL OR pl <> line OR t IN (0, 7) THEN 1 ELSE 0 END)
                      OVER (PARTITION BY run_id ORDER BY step) AS island
                    FROM (SELECT run_id, step, t, line // 40 AS line,
                            lag(line // 40) OVER (PARTITION BY run_id ORDER BY step) AS pl FROM st))
              GROUP BY run_id, island))
  WHERE steps >= 3"""))
def c9(spark, sf):
    s = X.steps(spark, sf).withColumn("line", F.floor(F.col("line") / 40))
    return P.loop_groups(s, **X.fit(spark, sf))


@query("c10_timeline_summary", cte("""
  SELECT run_id, total_steps, files, variables FROM
    (SELECT run_id, count(*) AS total_steps, count(DISTINCT file) AS files FROM st GROUP BY run_id)
    JOIN (SELECT run_id, count(DISTINCT var) AS variables FROM sn GROUP BY run_id) USING (run_id)"""))
def c10(spark, sf):
    t = X.trace(spark, sf)
    return P.timeline_summary(t.steps, t.snapshots)


@query("c10_block_summary", cte("""
  SELECT run_id, block_id, min(line) AS first_line, max(line) AS last_line, count(*) AS steps
  FROM st GROUP BY run_id, block_id"""))
def c10b(spark, sf):
    return P.block_summary(X.steps(spark, sf))


@query("c11_variable_rollup", cte("""
  SELECT run_id, var, min_by(n.value, step) AS first_value, max_by(n.value, step) AS last_value,
    min(step) AS first_step, max(step) AS last_step, count(*) FILTER (change = 'changed') AS changes
  FROM df WHERE n IS NOT NULL GROUP BY run_id, var""", df=DF))
def c11(spark, sf):
    return P.variable_rollup(_diff(spark, sf)[1])


@query("c11_orders_rollup", cte("""
  SELECT run_id, var, min_by(value, step) AS first_value, max_by(value, step) AS last_value, min(step) AS first_step,
    max(step) AS last_step, count(*) FILTER (p IS NOT NULL AND p <> value) AS changes
  FROM (SELECT *, lag(value) OVER (PARTITION BY run_id, var ORDER BY step) AS p FROM oh) GROUP BY run_id, var"""))
def c11b(spark, sf):
    h = X.orders_history(spark, sf)
    return P.variable_rollup(P.step_diff(h, h.select("run_id", "step").distinct()))


@query("c12_key_timeline", cte("""
  SELECT s.run_id, s.step, s.line, s.code, coalesce(ch, '') AS changed_vars,
    CASE WHEN t IN (0, 7) THEN 'loop' WHEN t = 2 THEN 'return' ELSE 'changed' END AS event
  FROM st s LEFT JOIN (SELECT run_id, step, string_agg(var, ',' ORDER BY var) AS ch FROM df WHERE change = 'changed'
                       GROUP BY run_id, step) c USING (run_id, step)
  WHERE ch IS NOT NULL OR t IN (0, 2, 7)""", df=DF))
def c12(spark, sf):
    t, d = _diff(spark, sf)
    return P.key_timeline(t.steps, P.step_changes(d)).withColumn("changed_vars", joined("changed_vars"))


HO = "SELECT DISTINCT run_id, step, memory_id AS obj_id FROM sn"
HR = """SELECT a.run_id, a.step, a.memory_id AS obj_id, CASE a.var WHEN 'view' THEN 'next' ELSE 'left' END AS attr,
    b.memory_id AS target_id FROM sn a JOIN sn b ON a.run_id = b.run_id AND a.step = b.step
    AND ((a.var = 'view' AND b.var = 'click') OR (a.var = 'signup' AND b.var = 'error'))"""
HC = """
  SELECT run_id, step, obj_id, 'new' AS change, NULL AS attr, NULL AS target_id FROM ho n
  WHERE NOT EXISTS (SELECT 1 FROM ho p WHERE p.run_id = n.run_id AND p.step = n.step - 1 AND p.obj_id = n.obj_id)
    AND EXISTS (SELECT 1 FROM ho p WHERE p.run_id = n.run_id AND p.step = n.step - 1)
  UNION ALL
  SELECT run_id, step, obj_id, 'refs', attr, target_id FROM hr n
  WHERE EXISTS (SELECT 1 FROM ho p WHERE p.run_id = n.run_id AND p.step = n.step - 1 AND p.obj_id = n.obj_id)
    AND NOT EXISTS (SELECT 1 FROM hr p WHERE p.run_id = n.run_id AND p.step = n.step - 1 AND p.obj_id = n.obj_id
                    AND p.attr = n.attr AND p.target_id = n.target_id)
  UNION ALL
  SELECT run_id, step + 1, obj_id, 'refs', '', NULL FROM hr p
  WHERE EXISTS (SELECT 1 FROM ho n WHERE n.run_id = p.run_id AND n.step = p.step + 1 AND n.obj_id = p.obj_id)
    AND NOT EXISTS (SELECT 1 FROM hr n WHERE n.run_id = p.run_id AND n.step = p.step + 1 AND n.obj_id = p.obj_id
                    AND n.attr = p.attr)"""


def heap(spark, sf):
    """Objects and references of the heap, from the object ids of the snapshots."""
    s = X.snapshots(spark, sf).select("run_id", "step", "var", "memory_id")
    objects = s.select("run_id", "step", F.col("memory_id").alias("obj_id")).distinct()
    held = s.groupBy("run_id", "step").agg(*[
        F.max(F.when(F.col("var") == v, F.col("memory_id"))).alias(v) for v in ("view", "click", "signup", "error")])
    refs = held.select("run_id", "step", F.inline(F.array(
        F.struct(F.col("view").alias("obj_id"), F.lit("next").alias("attr"), F.col("click").alias("target_id")),
        F.struct(F.col("signup").alias("obj_id"), F.lit("left").alias("attr"), F.col("error").alias("target_id")),
    ))).filter("obj_id IS NOT NULL AND target_id IS NOT NULL")
    return s, objects, refs


@query("c13_heap_diff", cte("SELECT * FROM hc", ho=HO, hr=HR, hc=HC))
def c13(spark, sf):
    _, objects, refs = heap(spark, sf)
    return P.heap_changes(objects, refs)


@query("c14_heap_edges", cte("""
  SELECT r.*, EXISTS (SELECT 1 FROM hc WHERE hc.run_id = r.run_id AND hc.step = r.step AND hc.obj_id = r.obj_id
                      AND hc.attr = r.attr) AS changed FROM hr r""", ho=HO, hr=HR, hc=HC))
def c14(spark, sf):
    _, objects, refs = heap(spark, sf)
    return P.heap_graph(objects, refs)[1]


@query("c14_heap_nodes", cte("""
  SELECT o.*, EXISTS (SELECT 1 FROM hc WHERE hc.run_id = o.run_id AND hc.step = o.step AND hc.obj_id = o.obj_id) AS changed
  FROM ho o""", ho=HO, hr=HR, hc=HC))
def c14b(spark, sf):
    _, objects, refs = heap(spark, sf)
    return P.heap_graph(objects, refs)[0]


@query("c14_heap_bindings", cte("SELECT run_id, step, var, memory_id AS obj_id FROM sn"))
def c14c(spark, sf):
    s, objects, _ = heap(spark, sf)
    return P.heap_bindings(s, objects)
