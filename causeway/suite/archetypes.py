"""Archetypes, normal form and fingerprints of the event trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.values import joined
from causeway.operators import hierarchy as H
from causeway.operators import identity as I
from causeway.operators import prepare as P
from causeway.sources import fixtures as X
from causeway.suite import query
from causeway.suite.duck import cte
from causeway.suite.facts import FACTS
from causeway.suite.preparing import DF

ACC = """
  SELECT a.run_id, a.step, a.var, s.code, s.nw, bool_or(ir) AS ir, bool_or(iw) AS iw
  FROM (SELECT *, true AS ir, false AS iw FROM rd UNION ALL SELECT *, false, true FROM wr) a
  JOIN (SELECT st.run_id, st.step, st.code, count(wr.var) AS nw FROM st LEFT JOIN wr USING (run_id, step) GROUP BY ALL) s USING (run_id, step)
  GROUP BY ALL"""
CS = """
  SELECT run_id, var, bool_or(ir AND contains(code, 'for') AND contains(code, 'range')) AS head,
    bool_or(ir AND contains(code, '[') AND contains(code, ']')) AS idx,
    bool_or(ir AND iw AND (contains(code, var || ' +=') OR contains(code, var || ' ='))) AS selfup,
    bool_or(ir AND regexp_matches(code, var || '\\[.+\\]\\s*=')) AS iwrite,
    bool_or(ir AND regexp_matches(code, var || '\\[.+\\]') AND NOT contains(substr(code, 1, strpos(code, var) - 1), '=')) AS iread,
    count(*) FILTER (ir AND iw AND contains(code, ',') AND contains(code, '=') AND contains(split_part(code, '=', 1), var)
                     AND contains(substr(code, strpos(code, '=') + 1), var)) AS unpacks,
    count(*) FILTER (iw AND nw > 1) AS paired,
    bool_or(ir AND (contains(code, 'if') OR contains(code, 'while'))) AS cond,
    bool_or(ir AND (contains(code, 'in ' || var) OR contains(code, 'not in'))) AS member, bool_or(ir AND contains(code, '.add(')) AS adds
  FROM acc GROUP BY run_id, var"""
VSIG = """
  SELECT * FROM (SELECT run_id, var, count(*) AS rows, min_by(type, step) AS ft FROM sn GROUP BY run_id, var HAVING count(*) >= 2)
  LEFT JOIN (SELECT run_id, var, count(*) AS wholes, bool_and(d = 1) AS by1, bool_and(d >= 0) AS up
    FROM (SELECT *, v - lag(v) OVER (PARTITION BY run_id, var ORDER BY step) AS d
          FROM (SELECT run_id, var, step, CAST(value AS BIGINT) AS v FROM sn WHERE regexp_full_match(value, '-?[0-9]+'))) GROUP BY run_id, var) USING (run_id, var)
  LEFT JOIN (SELECT run_id, var, count(*) AS nums, bool_and(d >= 0) AS nup
    FROM (SELECT *, v - lag(v) OVER (PARTITION BY run_id, var ORDER BY step) AS d
          FROM (SELECT run_id, var, step, TRY_CAST(value AS DOUBLE) AS v FROM sn) WHERE v IS NOT NULL) GROUP BY run_id, var) USING (run_id, var)
  LEFT JOIN (SELECT run_id, var, bool_and(d >= 0) AS grows
    FROM (SELECT *, v - lag(v) OVER (PARTITION BY run_id, var ORDER BY step) AS d
          FROM (SELECT run_id, var, step, CASE WHEN starts_with(value, '{') THEN 1 ELSE 0 END AS v FROM sn)) GROUP BY run_id, var) USING (run_id, var)"""
VA = """
  SELECT run_id, archetype, 'variable' AS category, var AS subject, round(CAST(least(c, 1.0) AS DOUBLE), 3) AS confidence FROM (
    SELECT run_id, var, unnest(['loop_counter', 'accumulator', 'memo_table', 'state_transition', 'boundary_condition', 'visited_set']) AS archetype,
      unnest([
        CASE WHEN wholes >= 3 AND by1 THEN 0.4 WHEN wholes >= 3 AND up THEN 0.2 ELSE 0 END + CASE WHEN head THEN 0.4 ELSE 0 END + CASE WHEN idx THEN 0.1 ELSE 0 END,
        CASE WHEN selfup THEN 0.5 ELSE 0 END + CASE WHEN nums >= 3 AND nup THEN 0.3 ELSE 0 END + CASE WHEN ft IN ('int', 'float') THEN 0.1 ELSE 0 END,
        CASE WHEN ft = 'dict' THEN 0.3 ELSE 0 END + CASE WHEN iwrite THEN 0.4 ELSE 0 END + CASE WHEN iread THEN 0.2 ELSE 0 END + CASE WHEN grows THEN 0.2 ELSE 0 END,
        coalesce(unpacks, 0) * 0.5 + coalesce(paired, 0) * 0.3,
        CASE WHEN cond THEN 0.4 ELSE 0 END + CASE WHEN ft = 'bool' THEN 0.3 ELSE 0 END,
        CASE WHEN ft = 'set' THEN 0.3 ELSE 0 END + CASE WHEN member THEN 0.4 ELSE 0 END + CASE WHEN adds THEN 0.2 ELSE 0 END]) AS c
    FROM vsig LEFT JOIN cs USING (run_id, var)) WHERE c > 0.399"""
CA = """
  SELECT run_id, 'early_termination' AS archetype, 'control' AS category, 'step#' || step AS subject, CAST(0.6 AS DOUBLE) AS confidence FROM st
  JOIN (SELECT run_id, max(step) AS last, min(CASE WHEN t = 1 THEN indent END) AS fi FROM st GROUP BY run_id) USING (run_id)
  WHERE t = 2 AND step < last AND fi < indent"""
SA = """
  SELECT run_id, archetype, 'structure' AS category, 'execution' AS subject, CAST(c AS DOUBLE) AS confidence FROM (
    SELECT run_id, unnest(['stack_dfs', 'hash_lookup']) AS archetype, unnest([0.8, 0.6]) AS c,
      unnest([count(*) FILTER (t = 5) > 0 AND count(*) FILTER (t = 6) > 0, count(*) FILTER (t = 4) >= 3]) AS ok FROM st GROUP BY run_id) WHERE ok"""
AA = """
  SELECT run_id, archetype, 'algorithm' AS category, 'execution' AS subject, round(CAST(least(base + n * 0.15, cap) AS DOUBLE), 3) AS confidence FROM (
    SELECT run_id, unnest(['dynamic_programming', 'greedy_selection']) AS archetype, unnest([0.5, 0.4]) AS base, unnest([0.95, 0.85]) AS cap,
      unnest([coalesce(memo, 0) + coalesce(trans, 0) + coalesce(accs, 0) + coalesce(iw, 0), coalesce(br, 0) + mm]) AS n
    FROM (SELECT run_id, max(CASE WHEN t = 8 THEN 1 ELSE 0 END) AS mm FROM st GROUP BY run_id)
    LEFT JOIN (SELECT run_id, max(CASE WHEN archetype = 'memo_table' THEN 1 ELSE 0 END) AS memo,
                 max(CASE WHEN archetype = 'state_transition' THEN 1 ELSE 0 END) AS trans FROM va GROUP BY run_id) USING (run_id)
    LEFT JOIN (SELECT run_id, max(CASE WHEN kind = 'loop.accumulation' THEN 1 ELSE 0 END) AS accs,
                 max(CASE WHEN kind = 'control.branch' THEN 1 ELSE 0 END) AS br FROM fa GROUP BY run_id) USING (run_id)
    LEFT JOIN (SELECT run_id, max(CASE WHEN n > 2 THEN 1 ELSE 0 END) AS iw FROM (SELECT run_id, w, count(DISTINCT r) AS n FROM st WHERE t = 4 GROUP BY ALL) GROUP BY run_id) USING (run_id))
  WHERE n >= 2"""
ID = "SELECT * FROM va UNION ALL SELECT * FROM ca UNION ALL SELECT * FROM sa UNION ALL SELECT * FROM aa"
CAN = """
  SELECT i.*, m.canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, archetype ORDER BY confidence DESC, subject) AS rn FROM id) i
  JOIN (SELECT unnest(['loop_counter', 'accumulator', 'memo_table', 'state_transition', 'boundary_condition', 'visited_set', 'early_termination', 'stack_dfs',
          'hash_lookup', 'dynamic_programming', 'greedy_selection']) AS archetype,
        unnest(['bounded_iterator', 'monotonic_accumulator', 'dict_state_write', 'parallel_state_transition', 'boolean_guard', 'membership_guard', 'short_circuit',
          'lifo_traversal', 'constant_time_lookup', 'dp_optimization', 'greedy_optimization']) AS canonical_id) m USING (archetype) WHERE rn = 1"""
CX = """
  SELECT run_id, CASE WHEN list_contains(ids, 'dp_optimization') AND list_contains(ids, 'bounded_iterator') THEN 'linear_iterative_dp'
      WHEN nested THEN 'nested_iterative' WHEN list_contains(ids, 'bounded_iterator') THEN 'linear_iterative'
      WHEN list_contains(ids, 'lifo_traversal') THEN 'recursive_dfs' ELSE 'sequential' END AS complexity
  FROM (SELECT run_id, list(canonical_id) AS ids FROM can GROUP BY run_id)
  LEFT JOIN (SELECT a.run_id, true AS nested FROM st a JOIN st b ON a.run_id = b.run_id AND a.step < b.step AND a.t IN (0, 7) AND b.t IN (0, 7)
             AND b.indent > a.indent GROUP BY a.run_id) USING (run_id)"""
FP = """
  SELECT run_id, complexity, algorithm, substr(sha256('{"algorithms": [' || alg || '], "complexity": "' || complexity || '", "control": [' || ctl ||
      '], "structures": [' || str || '], "variables": [' || var || ']}'), 1, 16) AS hash
  FROM (SELECT run_id, coalesce(string_agg('"' || canonical_id || '"', ', ' ORDER BY canonical_id) FILTER (category = 'algorithm'), '') AS alg,
          coalesce(string_agg('"' || canonical_id || '"', ', ' ORDER BY canonical_id) FILTER (category = 'control'), '') AS ctl,
          coalesce(string_agg('"' || canonical_id || '"', ', ' ORDER BY canonical_id) FILTER (category = 'structure'), '') AS str,
          coalesce(string_agg('"' || canonical_id || '"', ', ' ORDER BY canonical_id) FILTER (category = 'variable'), '') AS var,
          coalesce((list(canonical_id ORDER BY confidence DESC, archetype) FILTER (category = 'algorithm'))[1], 'unknown') AS algorithm
        FROM can GROUP BY run_id) JOIN cx USING (run_id)"""
ID_CTES = {**FACTS, "acc": ACC, "cs": CS, "vsig": VSIG, "va": VA, "ca": CA, "sa": SA, "aa": AA, "id": ID, "can": CAN, "cx": CX, "fp": FP}


def shown(df):
    return df.filter("part = 0").select("run_id", "archetype", "category", "subject", F.round("confidence", 3).alias("confidence"))


def normal(spark, sf):
    return I.normalize(X.identities(spark, sf), X.steps(spark, sf))


def shapes(spark, sf):
    return I.complexity_shape(normal(spark, sf), X.steps(spark, sf), **X.fit(spark, sf))


def fingerprints(spark, sf):
    return X.stored(spark, sf, "fingerprints", lambda: I.fingerprints(normal(spark, sf), shapes(spark, sf)))


@query("i1_variable_archetypes", cte("SELECT * FROM va", **ID_CTES))
def i1(spark, sf):
    return shown(I.variable_archetypes(X.steps(spark, sf), X.snapshots(spark, sf), **X.fit(spark, sf)))


@query("i2_control_archetypes", cte("SELECT * FROM ca", **ID_CTES))
def i2(spark, sf):
    return shown(I.control_archetypes(X.steps(spark, sf), X.facts(spark, sf)))


@query("i3_structure_archetypes", cte("SELECT * FROM sa", **ID_CTES))
def i3(spark, sf):
    return shown(I.structure_archetypes(X.steps(spark, sf)))


@query("i4_algorithm_archetypes", cte("SELECT * FROM aa", **ID_CTES))
def i4(spark, sf):
    v = I.variable_archetypes(X.steps(spark, sf), X.snapshots(spark, sf), **X.fit(spark, sf))
    return shown(I.algorithm_archetypes(X.steps(spark, sf), X.facts(spark, sf), v))


@query("i5_identities", cte("SELECT * FROM id", **ID_CTES))
def i5(spark, sf):
    return shown(X.identities(spark, sf))


@query("i5_relationships", cte("""
  SELECT a.run_id, m.src, m.dst, m.relation, count(*) AS pairs
  FROM (SELECT unnest(['memo_table', 'loop_counter', 'state_transition', 'visited_set']) AS src,
          unnest(['dynamic_programming', 'accumulator', 'dynamic_programming', 'stack_dfs']) AS dst,
          unnest(['enables', 'drives', 'implements', 'guards']) AS relation) m
  JOIN id a ON a.archetype = m.src JOIN id b ON b.archetype = m.dst AND a.run_id = b.run_id GROUP BY ALL""", **ID_CTES))
def i5b(spark, sf):
    return I.relationships(X.identities(spark, sf))


@query("i6_normal_form", cte("SELECT run_id, archetype, canonical_id, category, subject, confidence FROM can", **ID_CTES))
def i6(spark, sf):
    return normal(spark, sf).filter("part = 0").select("run_id", "archetype", "canonical_id", "category", "subject", F.round("confidence", 3).alias("confidence"))


@query("i6_parameters")
def i6b(spark, sf):
    return normal(spark, sf).filter("part = 0").filter(F.col("archetype").isin("memo_table", "accumulator", "state_transition")).select(
        "run_id", "canonical_id", "subject", "semantic_role", "operator", "direction", "transition_vars", "arity")


@query("i7_complexity_shape", cte("SELECT run_id, complexity FROM cx", **ID_CTES))
def i7(spark, sf):
    return shapes(spark, sf)


@query("i7_signatures", cte("""
  SELECT run_id, coalesce(string_agg(canonical_id, '+' ORDER BY canonical_id) FILTER (category = 'algorithm'), 'none') AS algorithm_signature,
    coalesce(string_agg(canonical_id, '+' ORDER BY canonical_id) FILTER (category = 'structure'), 'none') AS structure_signature,
    coalesce(string_agg(canonical_id, '+' ORDER BY canonical_id) FILTER (category = 'control'), 'none') AS control_signature
  FROM can GROUP BY run_id""", **ID_CTES))
def i7b(spark, sf):
    return I.signatures(normal(spark, sf))


@query("i8_fingerprints", cte("SELECT run_id, hash, algorithm, complexity FROM fp", **ID_CTES))
def i8(spark, sf):
    return fingerprints(spark, sf).select("run_id", "hash", "algorithm", "complexity")


@query("i9_behavior_patterns", cte("""
  SELECT run_id, name, CAST(c AS DOUBLE) AS confidence FROM (SELECT run_id, unnest(['loop.accumulation', 'in_place_mutation']) AS name, unnest([0.85, 0.75]) AS c,
    unnest([bool_or(starts_with(kind, 'loop.')), bool_or(contains(kind, 'mutation'))]) AS ok FROM fa GROUP BY run_id) WHERE ok""", **FACTS))
def i9(spark, sf):
    return I.behavior_patterns(X.facts(spark, sf))


TP = """
  SELECT DISTINCT run_id, 'accumulation' AS name, CAST(0.9 AS DOUBLE) AS confidence FROM (
    SELECT run_id, var, count(*) AS n, count(num) AS nums, min_by(num, step) AS lo, max_by(num, step) AS hi, bool_and(starts_with(v, '{')) AS dd,
      bool_and(starts_with(v, '[')) AS ll, min_by(length(v), step) AS l0, max_by(length(v), step) AS l1
    FROM (SELECT run_id, var, step, n.value AS v, TRY_CAST(trim(split_part(regexp_replace(n.value, '^[\\[\\](){}]+|[\\[\\](){}]+$', '', 'g'), ',', 1)) AS DOUBLE) AS num
          FROM df WHERE change = 'changed') GROUP BY run_id, var HAVING count(*) >= 3)
  WHERE CASE WHEN n = nums THEN hi > lo ELSE (dd OR ll) AND l1 > l0 END
  UNION ALL SELECT DISTINCT run_id, 'building', 0.85 FROM df JOIN st USING (run_id, step) WHERE change = 'changed' AND n.type IN ('dict', 'list') AND t IN (4, 5)
  UNION ALL SELECT run_id, 'selection', 0.8 FROM st JOIN (SELECT run_id, min(step) AS lp FROM st SEMI JOIN sn USING (run_id, step) WHERE t IN (0, 7) GROUP BY run_id) USING (run_id)
    WHERE t = 1 AND step > lp GROUP BY run_id HAVING count(*) >= 2
  UNION ALL SELECT DISTINCT run_id, 'swap', 0.85 FROM st WHERE t = 9"""


@query("i10_timeline_patterns", cte("SELECT * FROM tp", df=DF, tp=TP))
def i10(spark, sf):
    return I.timeline_patterns(X.steps(spark, sf), X.snapshots(spark, sf), X.diff(spark, sf))


PH = """
  SELECT run_id, phase, a AS start_step, b AS end_step FROM (
    SELECT run_id, unnest(CASE WHEN lp IS NOT NULL AND (rt IS NULL OR lp < rt) THEN CASE WHEN dn IS NOT NULL THEN ['Initialization', 'Iteration', 'Return']
        ELSE ['Initialization', 'Iteration (continued)'] END WHEN rt IS NOT NULL THEN ['Computation', 'Return'] ELSE ['Computation'] END) AS phase,
      unnest(CASE WHEN lp IS NOT NULL AND (rt IS NULL OR lp < rt) THEN CASE WHEN dn IS NOT NULL THEN [0, lp, dn] ELSE [0, lp] END
        WHEN rt IS NOT NULL THEN [0, rt] ELSE [0] END) AS a,
      unnest(CASE WHEN lp IS NOT NULL AND (rt IS NULL OR lp < rt) THEN CASE WHEN dn IS NOT NULL THEN [lp - 1, dn - 1, last] ELSE [lp - 1, last] END
        WHEN rt IS NOT NULL THEN [rt - 1, last] ELSE [last] END) AS b
    FROM (SELECT *, (SELECT min(step) FROM st x WHERE x.run_id = m.run_id AND x.t = 2 AND x.step > m.lp) AS dn FROM
      (SELECT run_id, max(step) AS last, min(CASE WHEN t IN (0, 7) THEN step END) AS lp, min(CASE WHEN t = 2 THEN step END) AS rt FROM st GROUP BY run_id) m))"""


@query("i11_phases", cte("SELECT *, end_step - start_step + 1 AS steps FROM ph", ph=PH))
def i11(spark, sf):
    return I.phases(X.steps(spark, sf))


@query("i11_phase_variables", cte("""
  SELECT run_id, phase, var, points, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, phase ORDER BY points DESC, var) AS rank FROM (
      SELECT run_id, phase, var, sum(CASE WHEN change = 'new' THEN 3 ELSE 2 END) AS points FROM df JOIN ph USING (run_id)
      WHERE change IN ('new', 'changed') AND step BETWEEN start_step AND end_step GROUP BY ALL)) WHERE rank <= 5""", ph=PH, df=DF))
def i11b(spark, sf):
    return I.phase_variables(I.phases(X.steps(spark, sf)), X.diff(spark, sf))


@query("i11_step_types", cte("""
  SELECT run_id, step, CASE WHEN t IN (0, 7) THEN 'loop_header' WHEN t = 1 THEN 'condition' WHEN t = 2 THEN 'return'
    WHEN nw > 0 AND coalesce(ch, 0) = 0 THEN 'init' WHEN ch > 0 THEN 'mutation' ELSE 'other' END AS step_type
  FROM st LEFT JOIN (SELECT run_id, step, count(*) FILTER (change = 'changed') AS ch, count(*) FILTER (change = 'new') AS nw FROM df GROUP BY ALL) USING (run_id, step)""", df=DF))
def i11c(spark, sf):
    return I.step_types(X.steps(spark, sf), P.step_changes(X.diff(spark, sf)))


@query("i12_run_insight", cte("""
  SELECT run_id, CASE WHEN list_contains(n, 'accumulation') AND list_contains(n, 'selection') THEN 'filter_accumulate'
    WHEN list_contains(n, 'accumulation') THEN 'accumulate' WHEN list_contains(n, 'building') THEN 'construction' ELSE 'general' END AS algorithm_type,
    CAST(coalesce(c, 0.5) AS DOUBLE) AS confidence
  FROM (SELECT DISTINCT run_id FROM st) LEFT JOIN (SELECT run_id, list(name) AS n, max(confidence) AS c FROM tp GROUP BY run_id) USING (run_id)""", df=DF, tp=TP))
def i12(spark, sf):
    p = I.timeline_patterns(X.steps(spark, sf), X.snapshots(spark, sf), X.diff(spark, sf))
    return I.run_insight(X.steps(spark, sf), p)


@query("f16_enrichment", cte("""
  SELECT run_id, archetype, subject, CASE archetype WHEN 'memo_table' THEN 'key_value_storage,state_cache,state_management'
      WHEN 'visited_set' THEN 'key_value_storage,state_cache,state_management' WHEN 'state_transition' THEN 'state_management'
      WHEN 'stack_dfs' THEN 'depth_first,traversal' WHEN 'dynamic_programming' THEN 'optimization' ELSE '' END AS ancestors,
    CASE archetype WHEN 'memo_table' THEN 'lookup_table,visited_set' WHEN 'visited_set' THEN 'lookup_table,memo_table' WHEN 'state_transition' THEN 'state_cache'
      WHEN 'dynamic_programming' THEN 'brute_force,greedy,sliding_window' ELSE '' END AS siblings
  FROM id WHERE archetype <> 'lookup_table'""", **ID_CTES))
def f16(spark, sf):
    e = H.enrich(X.identities(spark, sf).filter("part = 0"), H.concepts(spark))
    return e.select("run_id", "archetype", "subject", joined("ancestors").alias("ancestors"), joined("siblings").alias("siblings"))
