"""Typed events, patterns, predicates and rules over the event trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.values import round3
from causeway.operators import events as E
from causeway.operators import rules as R
from causeway.session import ensure_checkpoint_dir
from causeway.sources import fixtures as X
from causeway.streaming import state as S
from causeway.suite import query
from causeway.suite.duck import cte
from causeway.suite.preparing import DF
from causeway.suite.scoring import VSTATE

EVT = """
  SELECT run_id, step, k, depth, call_id, CASE WHEN t = 8 AND u % 2 = 0 THEN 'recursive_call' WHEN t = 0 THEN 'loop' WHEN t IN (1, 7) THEN 'condition' WHEN t = 2 THEN 'return'
      WHEN t = 5 THEN 'list_op' WHEN t = 6 THEN 'pointer_move' ELSE 'assignment' END AS event_type,
    CASE WHEN t = 0 THEN 'iteration,loop' WHEN t = 1 AND k % 4 = 0 THEN 'base_case,null_check' WHEN t IN (1, 7) THEN 'branch' WHEN t = 2 THEN 'return' WHEN t = 3 THEN 'accumulation'
      WHEN t = 4 THEN CASE WHEN held IN ('0', '1', 'None', 'True', 'False', '{}', '[]') THEN 'initialization' ELSE '' END WHEN t = 5 THEN 'append,list_mutation' WHEN t = 6 THEN 'pointer,traversal'
      WHEN t = 8 AND u % 2 = 0 THEN 'function_call,recursion' WHEN t = 8 THEN 'function_call' ELSE 'tuple_unpack' END AS tags,
    CASE WHEN t IN (0, 3, 4, 5, 6, 8, 9) THEN w WHEN t = 2 THEN NULL ELSE r END AS target_var,
    coalesce(depth - lag(depth) OVER (PARTITION BY run_id ORDER BY step), 0) AS depth_delta
  FROM (SELECT st.*, CAST(st.run_id AS INTEGER) AS u, sn.value AS held FROM st LEFT JOIN sn ON sn.run_id = st.run_id AND sn.step = st.step AND sn.var = st.w)"""


def steps(spark, sf):
    """The event trace with pointers in place of pops and some null checks."""
    s = X.steps(spark, sf)
    code = F.regexp_replace("code", r"\.pop\(\)$", ".next")
    guard = F.col("code").startswith("if ") & (F.col("line") % 4 == 0)
    return s.withColumn("code", F.when(guard, F.regexp_replace("code", r"^if (\w+) > 3:$", "if not $1:")).otherwise(code))


def derive_events(spark, sf):
    s = steps(spark, sf)
    own = s.select("run_id").distinct().filter(F.col("run_id").cast("int") % 2 == 0).withColumn("callee", F.lit("max"))
    return E.typed_events(s, X.snapshots(spark, sf), own, **X.fit(spark, sf))


def events(spark, sf):
    return X.stored(spark, sf, "typed-events", lambda: derive_events(spark, sf))


@query("m1_typed_events", cte("SELECT run_id, step, event_type, tags, depth, call_id, depth_delta, target_var FROM evt", evt=EVT))
def m1(spark, sf):
    return derive_events(spark, sf).select("run_id", "step", "event_type", F.array_join(F.array_sort("tags"), ",").alias("tags"), "depth", "call_id", "depth_delta", "target_var")


EVENT_EDGES = """
  SELECT run_id, src, step AS dst, 'data_dependency' AS kind, target_var AS var FROM (SELECT *, lag(step) OVER (PARTITION BY run_id, target_var ORDER BY step) AS src FROM evt WHERE target_var IS NOT NULL) WHERE src IS NOT NULL
  UNION ALL SELECT run_id, src, step, 'state_change', target_var FROM (SELECT *, lag(step) OVER (PARTITION BY run_id, target_var ORDER BY step) AS src FROM evt WHERE event_type IN ('assignment', 'pointer_move')) WHERE src IS NOT NULL
  UNION ALL SELECT run_id, step, nx, 'control_dependency', target_var FROM (SELECT *, lead(step) OVER (PARTITION BY run_id ORDER BY step) AS nx FROM evt) WHERE event_type = 'condition' AND nx IS NOT NULL
  UNION ALL SELECT c.run_id, c.step, min(r.step), 'recursive_invocation', NULL FROM evt c JOIN evt r ON r.run_id = c.run_id AND r.step > c.step AND r.event_type = 'return'
    WHERE c.event_type = 'recursive_call' GROUP BY c.run_id, c.step"""


@query("d9_event_edges", cte(EVENT_EDGES, evt=EVT))
def d9(spark, sf):
    return E.event_edges(events(spark, sf), **X.fit(spark, sf)).select("run_id", "src", "dst", "kind", "var")


@query("d9_event_roles", cte("""
  SELECT run_id, step, CASE WHEN event_type = 'return' THEN 'result' WHEN causes AND NOT caused THEN 'trigger' WHEN causes AND caused THEN 'propagation' WHEN caused THEN 'convergence' ELSE 'isolated' END AS role
  FROM evt LEFT JOIN (SELECT run_id, step, bool_or(cause) AS causes, bool_or(NOT cause) AS caused
    FROM (SELECT run_id, src AS step, TRUE AS cause FROM ed UNION ALL SELECT run_id, dst, FALSE FROM ed) GROUP BY run_id, step) USING (run_id, step)""", evt=EVT, ed=EVENT_EDGES))
def d9b(spark, sf):
    e = events(spark, sf)
    return E.event_roles(e, E.event_edges(e, **X.fit(spark, sf)))


def _has(tag):
    return f"list_contains(string_split(x.tags, ','), '{tag}')"


def _candidate_sql():
    """The same candidates by nested look-ups, one statement per path and prefix."""
    parts = []
    for p in E.BUILTIN:
        nodes = {n.name: n for n in p.nodes}
        for path in p.paths:
            total, got, roles = sum(nodes[n].weight for n in path), 0.0, set()
            source, where = "(SELECT run_id, step AS s, step - 1 AS p0 FROM evt)", ""
            for i, name in enumerate(path, 1):
                node = nodes[name]
                got, roles = got + node.weight, roles | {node.role}
                cond = " OR ".join("(" + " AND ".join([f"x.event_type = '{s[0]}'", *[_has(t) for t in s[1]]]) + ")" for s in node.specs)
                source = (f"(SELECT l.run_id, l.s, min(x.step) AS p{i} FROM {source} l JOIN evt x ON x.run_id = l.run_id AND x.step > l.p{i - 1} "
                          f"AND x.step <= l.s + 28 AND ({cond}) GROUP BY l.run_id, l.s)")
                share = got / total
                if p.parallel:
                    share = min(share + 0.1, 1.0)
                if share >= p.min_confidence:
                    parts.append(f"SELECT run_id, '{p.name}' AS pattern, s AS start_step, p{i} AS end_step, {min(share + len(roles) / len(p.nodes) * 0.15, 1.0):.6f}::DOUBLE AS confidence FROM {source}")
    return " UNION ALL ".join(f"({p})" for p in parts)


@query("m3_pattern_candidates", cte("SELECT run_id, pattern, start_step, end_step, round(confidence, 3) AS confidence FROM (" + _candidate_sql() + ")", evt=EVT))
def m3(spark, sf):
    return E.candidates(events(spark, sf), **X.fit(spark, sf)).select("run_id", "pattern", "start_step", "end_step", round3(F.col("confidence")).alias("confidence"))


@query("m3_best_matches")
def m3b(spark, sf):
    return E.best_matches(E.candidates(events(spark, sf), **X.fit(spark, sf)), **X.fit(spark, sf)).select(
        "run_id", "pattern", "start_step", "end_step", "confidence")


@query("m4_composites")
def m4(spark, sf):
    return E.compose(E.best_matches(E.candidates(events(spark, sf), **X.fit(spark, sf)), **X.fit(spark, sf)))


@query("m5_detected_patterns")
def m5(spark, sf):
    return E.detect(events(spark, sf), **X.fit(spark, sf))


SP = """
  SELECT run_id, step // 20 AS span_id, min(step) AS start_step, max(step) AS end_step, (['search', 'traverse', 'accumulate'])[(step // 20) % 3 + 1] AS op,
    CASE WHEN (step // 20) % 2 = 0 THEN 'convergence' ELSE 'exhaustion' END AS terminates, CASE WHEN (step // 20) % 2 = 1 THEN 'memoization' ELSE 'binary_search' END AS pattern
  FROM st GROUP BY run_id, step // 20"""
IE = "SELECT e.*, p.span_id, p.op, p.terminates, p.pattern FROM evt e JOIN sp p ON p.run_id = e.run_id AND e.step BETWEEN p.start_step AND p.end_step"


def spans(spark, sf):
    return X.stored(spark, sf, "spans", lambda: derive_spans(spark, sf))


def derive_spans(spark, sf):
    s = F.floor(F.col("step") / 20).cast("long")
    g = X.steps(spark, sf).groupBy("run_id", s.alias("span_id")).agg(F.min("step").alias("start_step"), F.max("step").alias("end_step"))
    n = F.col("span_id")
    return g.select("*", F.element_at(F.array(F.lit("search"), F.lit("traverse"), F.lit("accumulate")), (n % 3 + 1).cast("int")).alias("op"),
                    F.when(n % 2 == 0, "convergence").otherwise("exhaustion").alias("terminates"),
                    F.when(n % 2 == 1, "memoization").otherwise("binary_search").alias("pattern"))


TP = """
  SELECT run_id, span_id, 'always' AS predicate, 'bounded_depth' AS subject, 0.8::DOUBLE AS confidence, count(*) AS count FROM ie GROUP BY run_id, span_id HAVING count(*) >= 3 AND max(depth) - min(depth) <= 3
  UNION ALL SELECT run_id, span_id, 'always', 'focuses_' || target_var, round(n * 1.0::DOUBLE / t, 3), n FROM (SELECT *, sum(n) OVER (PARTITION BY run_id, span_id) AS t,
      row_number() OVER (PARTITION BY run_id, span_id ORDER BY n DESC, target_var DESC) AS rn FROM (SELECT run_id, span_id, target_var, count(*) AS n FROM ie WHERE target_var IS NOT NULL GROUP BY ALL)) WHERE rn = 1 AND n * 1.0 / t >= 0.5
  UNION ALL SELECT run_id, span_id, 'eventually', 'returns', 0.9, count(*) FROM ie WHERE event_type = 'return' GROUP BY run_id, span_id
  UNION ALL SELECT run_id, span_id, 'eventually', 'base_case', 0.85, count(*) FROM ie WHERE tags = 'base_case,null_check' GROUP BY run_id, span_id
  UNION ALL SELECT run_id, span_id, 'until', 'traversal_termination', 0.85, 2 FROM ie WHERE op = 'traverse' GROUP BY run_id, span_id HAVING bool_or(event_type = 'pointer_move') AND bool_or(tags = 'base_case,null_check')
  UNION ALL SELECT run_id, span_id, 'until', 'search_convergence', 0.8, 2 FROM ie WHERE op = 'search' GROUP BY run_id, span_id HAVING bool_or(event_type = 'assignment') AND bool_or(event_type = 'return')
  UNION ALL SELECT run_id, span_id, 'converges', 'pointer_position', 0.75, count(*) FROM ie WHERE terminates = 'convergence' AND event_type = 'pointer_move' GROUP BY run_id, span_id HAVING count(*) >= 2
  UNION ALL SELECT run_id, span_id, 'converges', 'search_bounds', 0.7, count(*) FROM ie WHERE op = 'search' AND event_type = 'assignment' GROUP BY run_id, span_id HAVING count(*) >= 2
  UNION ALL SELECT run_id, span_id, 'repeats', event_type, round(least(0.5::DOUBLE + count(*) * 0.1::DOUBLE, 0.9), 3), count(*) FROM ie WHERE event_type IN ('pointer_move', 'assignment', 'recursive_call') GROUP BY run_id, span_id, event_type HAVING count(*) >= 3"""


@query("m6_temporal_predicates", cte("SELECT * FROM tp", evt=EVT, sp=SP, ie=IE, tp=TP))
def m6(spark, sf):
    return R.temporal_predicates(events(spark, sf), spans(spark, sf)).select("run_id", "span_id", "predicate", "subject", round3(F.col("confidence")).alias("confidence"), "count")


IV = """
  SELECT run_id, span_id, 'loop_invariant' AS predicate, 'loop_guard' AS subject, 0.85::DOUBLE AS confidence, count(*) AS count, 0 AS violated FROM ie WHERE op IN ('search', 'traverse') AND event_type = 'condition' GROUP BY run_id, span_id
  UNION ALL SELECT run_id, span_id, 'progress', 'monotonic_progress', 0.75, count(*), 0 FROM ie WHERE op = 'search' AND event_type = 'assignment' GROUP BY run_id, span_id HAVING count(*) >= 2
  UNION ALL SELECT run_id, span_id, 'progress', 'pointer_advance', 0.8, count(*), 0 FROM ie WHERE op = 'traverse' AND event_type = 'pointer_move' GROUP BY run_id, span_id HAVING count(*) >= 2
  UNION ALL SELECT run_id, span_id, 'progress', 'accumulator_growth', 0.7, count(*), 0 FROM ie WHERE op = 'accumulate' AND tags = 'accumulation' GROUP BY run_id, span_id
  UNION ALL SELECT run_id, span_id, 'loop_invariant', 'pointer_validity', 0.7, count(*), 0 FROM ie WHERE op = 'traverse' AND event_type = 'pointer_move' GROUP BY run_id, span_id
  UNION ALL SELECT run_id, span_id, 'loop_invariant', 'bounds_ordering', 0.8, count(*) FILTER (event_type = 'condition'), 0 FROM ie WHERE op = 'search' GROUP BY run_id, span_id
  UNION ALL SELECT run_id, span_id, 'termination', 'bounded_depth', CASE WHEN hi - lo > 5 THEN 0.6 ELSE 0.9 END, CASE WHEN hi - lo > 5 THEN n - bad ELSE n END, CASE WHEN hi - lo > 5 THEN bad ELSE 0 END
    FROM (SELECT run_id, span_id, min(lo) AS lo, max(depth) AS hi, count(*) AS n, count(*) FILTER (depth > lo + 3) AS bad FROM (SELECT *, min(depth) OVER (PARTITION BY run_id, span_id) AS lo FROM ie) GROUP BY run_id, span_id)
  UNION ALL SELECT run_id, span_id, 'postcondition', 'result_reachability', 0.95, 1, 0 FROM ie WHERE event_type = 'return' GROUP BY run_id, span_id
  UNION ALL SELECT run_id, span_id, 'termination', 'base_case_reachability', 0.85, count(*), 0 FROM ie WHERE tags = 'base_case,null_check' GROUP BY run_id, span_id"""


@query("m7_invariants", cte("SELECT * FROM iv", evt=EVT, sp=SP, ie=IE, iv=IV))
def m7(spark, sf):
    return invariants(spark, sf).select("run_id", "span_id", "predicate", "subject", "confidence", "count", "violated")


PAIRS = [("view", "click"), ("signup", "error")]
CO = """
  SELECT run_id, span_id, var, count(*) AS n, min_by(v, step) AS first, max_by(v, step) AS last, coalesce(bool_and(v >= b), true) AS up, coalesce(bool_and(v <= b), true) AS down,
    list(v ORDER BY step) AS vs FROM (
    SELECT *, lag(v) OVER (PARTITION BY run_id, span_id, var ORDER BY step) AS b FROM (
      SELECT sn.run_id, p.span_id, sn.var, sn.step, TRY_CAST(sn.value AS DOUBLE) AS v FROM sn JOIN sp p ON p.run_id = sn.run_id AND sn.step BETWEEN p.start_step AND p.end_step) WHERE v IS NOT NULL)
  GROUP BY run_id, span_id, var"""
PQ = "SELECT x.run_id, x.span_id, x.var AS a, y.var AS b, x.n AS xn, y.n AS yn, x.up AS xu, y.down AS yd, x.first AS xf, y.first AS yf, x.last AS xl, y.last AS yl FROM co x JOIN co y ON x.run_id = y.run_id AND x.span_id = y.span_id AND ((x.var = 'view' AND y.var = 'click') OR (x.var = 'signup' AND y.var = 'error'))"
GO = """
  SELECT run_id, span_id, 'minimize' AS goal, '[' || a || ', ' || b || ']' AS target, CASE WHEN xn >= 2 AND xu AND yn >= 2 AND yd THEN 0.85 ELSE 0.65 END::DOUBLE AS confidence FROM pq WHERE (xn >= 2 AND xu) OR (yn >= 2 AND yd)
  UNION ALL SELECT run_id, span_id, 'minimize', var, 0.6 FROM co WHERE n >= 3 AND down
  UNION ALL SELECT run_id, span_id, 'maximize', var, 0.55 FROM co WHERE n >= 3 AND up
  UNION ALL SELECT run_id, span_id, 'converge', a || '=' || b, 0.85 FROM pq WHERE xn >= 2 AND yn >= 2 AND abs(xf - yf) > 0 AND abs(xl - yl) < abs(xf - yf) * 0.3
  UNION ALL SELECT run_id, span_id, 'converge', var || '_fixed_point', 0.7 FROM co WHERE n >= 4 AND vs[n] = vs[n - 1] AND vs[n - 1] = vs[n - 2] AND first <> last
  UNION ALL SELECT run_id, span_id, 'compress', 'state_space', 0.6 FROM sp WHERE pattern = 'memoization'"""
MG = {"evt": EVT, "sp": SP, "ie": IE, "iv": IV, "co": CO, "pq": PQ, "go": GO}


def courses(spark, sf):
    return X.stored(spark, sf, "courses", lambda: R.trajectories(X.snapshots(spark, sf), spans(spark, sf), **X.fit(spark, sf)))


def aims(spark, sf):
    return X.stored(spark, sf, "goals", lambda: R.goal_parts(events(spark, sf), courses(spark, sf), spans(spark, sf), PAIRS, PAIRS))


def invariants(spark, sf):
    return X.stored(spark, sf, "invariants", lambda: R.invariants(events(spark, sf), spans(spark, sf)))


@query("m8_goals", cte("SELECT * FROM go", **MG))
def m8(spark, sf):
    return aims(spark, sf)


CFS = """
  SELECT run_id, span_id, 'without loop_guard' AS condition, subject AS affected, 'major' AS severity, confidence * 0.8::DOUBLE AS confidence FROM iv WHERE subject = 'monotonic_progress'
  UNION ALL SELECT run_id, span_id, 'no progress: ' || subject, subject, 'critical', confidence * 0.9::DOUBLE FROM iv WHERE predicate = 'progress'
  UNION ALL SELECT run_id, span_id, 'not ' || goal || ': ' || target, target, CASE goal WHEN 'converge' THEN 'critical' ELSE 'major' END,
    confidence * CASE goal WHEN 'minimize' THEN 0.7 WHEN 'converge' THEN 0.8 ELSE 0.85 END::DOUBLE FROM go WHERE goal <> 'maximize'"""


@query("m9_counterfactuals", cte("SELECT run_id, span_id, condition, affected, severity, round(max(confidence), 3) AS confidence FROM cf GROUP BY ALL", **MG, cf=CFS))
def m9(spark, sf):
    return R.counterfactuals(invariants(spark, sf), aims(spark, sf)).select(
        "run_id", "span_id", "condition", "affected", "severity", round3(F.col("confidence")).alias("confidence"))


MO = """
  SELECT run_id, span_id, motif, score FROM (SELECT run_id, span_id, unnest(['uncertainty_reduction', 'state_compression', 'frontier_expansion', 'fixed_point_convergence']) AS motif,
    unnest([CASE WHEN pattern = 'binary_search' THEN 0.3 ELSE 0 END + 0.15 * mi, CASE WHEN pattern = 'memoization' THEN 0.3 ELSE 0 END + 0.2 * cp, 0.1 * ma, 0.15 * cv])::DOUBLE AS score
    FROM (SELECT sp.run_id, sp.span_id, any_value(sp.pattern) AS pattern, count(*) FILTER (goal = 'minimize') AS mi, count(*) FILTER (goal = 'maximize') AS ma, count(*) FILTER (goal = 'converge') AS cv,
            count(*) FILTER (goal = 'compress') AS cp FROM sp LEFT JOIN go ON go.run_id = sp.run_id AND go.span_id = sp.span_id GROUP BY sp.run_id, sp.span_id)) WHERE score >= 0.2499"""


@query("m10_motifs", cte("SELECT run_id, span_id, motif, round(least(score, 1), 3) AS confidence FROM mo", **MG, mo=MO))
def m10(spark, sf):
    return R.motifs(events(spark, sf), aims(spark, sf), spans(spark, sf)).select("run_id", "span_id", "motif", round3(F.col("confidence")).alias("confidence"))


OB = """
  SELECT run_id, span_id, 'monotonic' AS kind, var AS subject, CASE WHEN up THEN 'increasing' ELSE 'decreasing' END AS relation FROM co WHERE n >= 2 AND (up OR down)
  UNION ALL SELECT run_id, span_id, 'changes', var, '' FROM co WHERE n >= 2
  UNION ALL SELECT run_id, span_id, 'paired', a || ',' || b, 'interval' FROM pq
  UNION ALL SELECT run_id, span_id, 'converges', a || ',' || b, 'converges_with' FROM pq WHERE xn >= 2 AND yn >= 2 AND abs(xf - yf) > 0 AND abs(xl - yl) < abs(xf - yf) * 0.3
  UNION ALL SELECT run_id, span_id, 'looping', CAST(step AS VARCHAR), '' FROM ie WHERE event_type IN ('loop', 'condition')
  UNION ALL SELECT DISTINCT run_id, span_id, 'recursive', target_var, '' FROM ie WHERE event_type = 'recursive_call'
  UNION ALL SELECT run_id, span_id, 'base_case', CAST(step AS VARCHAR), '' FROM ie WHERE tags = 'base_case,null_check'"""


def observed(spark, sf):
    return X.stored(spark, sf, "observed", lambda: R.observed_facts(events(spark, sf), courses(spark, sf), spans(spark, sf), PAIRS, PAIRS, X.parts(spark, sf)))


@query("m11_observed_facts", cte("SELECT * FROM ob", **MG, ob=OB))
def m11(spark, sf):
    return observed(spark, sf).select("run_id", "span_id", "kind", "subject", "relation")


DE = """
  SELECT run_id, span_id, 'shrinks' AS kind, subject, '' AS relation FROM ob o WHERE kind = 'paired' AND EXISTS (SELECT 1 FROM ob WHERE ob.run_id = o.run_id AND ob.span_id = o.span_id AND kind = 'monotonic' AND relation = 'increasing')
    AND EXISTS (SELECT 1 FROM ob WHERE ob.run_id = o.run_id AND ob.span_id = o.span_id AND kind = 'monotonic' AND relation = 'decreasing')"""
DV = """
  SELECT * FROM sh
  UNION ALL SELECT DISTINCT run_id, span_id, 'invariant', 'loop_invariant', 'guard_holds' FROM ob WHERE kind = 'looping'
  UNION ALL SELECT DISTINCT a.run_id, a.span_id, 'invariant', 'termination', 'base_case_reached' FROM ob a JOIN ob b ON a.run_id = b.run_id AND a.span_id = b.span_id AND a.kind = 'recursive' AND b.kind = 'base_case'
  UNION ALL SELECT DISTINCT s.run_id, s.span_id, 'invariant', 'progress', 'interval_shrinks' FROM sh s JOIN ob b ON s.run_id = b.run_id AND s.span_id = b.span_id AND b.kind = 'looping'
  UNION ALL SELECT DISTINCT s.run_id, s.span_id, 'objective', 'minimize', 'search_space' FROM sh s JOIN ob b ON s.run_id = b.run_id AND s.span_id = b.span_id AND b.kind = 'looping'
  UNION ALL SELECT DISTINCT s.run_id, s.span_id, 'counterfactual', 'progress_violated', 'infinite_loop' FROM sh s JOIN ob b ON s.run_id = b.run_id AND s.span_id = b.span_id AND b.kind = 'looping'
  UNION ALL SELECT DISTINCT s.run_id, s.span_id, 'invariant', 'termination', 'convergence' FROM sh s JOIN ob b ON s.run_id = b.run_id AND s.span_id = b.span_id AND b.kind = 'converges'
  UNION ALL SELECT DISTINCT b.run_id, b.span_id, 'objective', 'converge', b.subject FROM sh s JOIN ob b ON s.run_id = b.run_id AND s.span_id = b.span_id AND b.kind = 'converges'"""


def derived(spark, sf):
    return R.derive(observed(spark, sf), parts=X.parts(spark, sf))


@query("m12_derived_facts", cte("SELECT * FROM dv", **MG, ob=OB, sh=DE, dv=DV))
def m12(spark, sf):
    return derived(spark, sf)[0].select("run_id", "span_id", "kind", "subject", "relation")


@query("m13_contradictions", cte("""
  SELECT a.run_id, a.subject, 'contradictory_monotonicity' AS type FROM (SELECT DISTINCT run_id, subject FROM ob WHERE kind = 'monotonic' AND relation = 'increasing') a
  JOIN (SELECT DISTINCT run_id, subject FROM ob WHERE kind = 'monotonic' AND relation = 'decreasing') b USING (run_id, subject)""", **MG, ob=OB))
def m13(spark, sf):
    # the spans of a run taken together
    return R.contradictions(observed(spark, sf).withColumn("span_id", F.lit(0))).select("run_id", "subject", "type")


def _rests(conclusion, given, *sources):
    """Links from one conclusion (as SQL over ``x``) to each of its sources, where all are there."""
    there = " AND ".join(f"EXISTS (SELECT 1 FROM fi y WHERE y.run_id = x.run_id AND y.span_id = x.span_id AND {w.replace('s.', 'y.')})" for w in (given, *sources))
    return " UNION ".join(f"""SELECT x.run_id, x.span_id, {conclusion} AS id, s.id AS source_id FROM fi x JOIN fi s ON s.run_id = x.run_id AND s.span_id = x.span_id AND {w}
      WHERE {given.replace('s.', 'x.')} AND {there}""" for w in (*sources,))


FI = """SELECT run_id, span_id, kind, subject, relation, kind || ':' || subject || ':' || relation || ':None' AS id FROM ob
  UNION SELECT run_id, span_id, kind, subject, relation, kind || ':' || subject || ':' || relation || ':None' FROM dv"""
UP, DOWN = "s.kind = 'monotonic' AND s.relation = 'increasing'", "s.kind = 'monotonic' AND s.relation = 'decreasing'"
LOOPS, SHRINKS, MEETS = "s.kind = 'looping'", "s.kind = 'shrinks'", "s.kind = 'converges'"
RESTS = " UNION ".join([
    _rests("'shrinks:' || x.subject || '::None'", "s.kind = 'paired' AND s.relation = 'interval'", UP, DOWN),
    "SELECT run_id, span_id, 'shrinks:' || subject || '::None', 'paired:' || subject || ':interval:None' FROM dv WHERE kind = 'shrinks'",
    _rests("'invariant:loop_invariant:guard_holds:None'", LOOPS, LOOPS),
    _rests("'invariant:termination:base_case_reached:None'", "s.kind = 'recursive'", "s.kind = 'recursive'", "s.kind = 'base_case'"),
    _rests("'invariant:progress:interval_shrinks:None'", SHRINKS, SHRINKS, LOOPS),
    _rests("'objective:minimize:search_space:None'", SHRINKS, SHRINKS, LOOPS),
    _rests("'invariant:termination:convergence:None'", MEETS, MEETS, SHRINKS),
    _rests("'objective:converge:' || x.subject || ':None'", MEETS, SHRINKS),
    f"SELECT s.run_id, s.span_id, 'objective:converge:' || subject || ':None', id FROM fi s WHERE {MEETS} AND EXISTS (SELECT 1 FROM dv d WHERE d.run_id = s.run_id AND d.span_id = s.span_id AND d.kind = 'shrinks')",
    _rests("'counterfactual:progress_violated:infinite_loop:None'", "s.kind = 'invariant' AND s.subject = 'progress'", "s.kind = 'invariant' AND s.subject = 'progress'", LOOPS)])
PROOF = """SELECT run_id, span_id, id, source_id, 1 AS depth FROM rests
  UNION SELECT p.run_id, p.span_id, p.id, r.source_id, p.depth + 1 FROM proof p JOIN rests r ON r.run_id = p.run_id AND r.span_id = p.span_id AND r.id = p.source_id"""


@query("m14_proofs", cte("SELECT run_id, CAST(span_id AS VARCHAR) AS span_id, id, source_id, min(depth) AS depth FROM proof GROUP BY ALL",
                         recursive=True, **MG, ob=OB, sh=DE, dv=DV, fi=FI, rests=RESTS, proof=PROOF))
def m14(spark, sf):
    return R.proofs(derived(spark, sf)[1])


@query("m15_merged_goals", cte("""
  SELECT run_id, span_id, subject AS goal, relation AS target FROM dv WHERE kind = 'objective'
  UNION ALL SELECT g.run_id, g.span_id, g.goal, g.target FROM go g WHERE NOT EXISTS (SELECT 1 FROM dv d WHERE d.run_id = g.run_id AND d.span_id = g.span_id AND d.kind = 'objective' AND d.subject = g.goal AND d.relation = g.target)""",
    **MG, ob=OB, sh=DE, dv=DV))
def m15(spark, sf):
    return R.merge_conclusions(R.derived_goals(derived(spark, sf)[0]), aims(spark, sf), ["goal", "target"]).select("run_id", "span_id", "goal", "target")


@query("m16_suggested_actions", cte("""
  SELECT run_id, span_id, action_type, title, round(max(p), 3) AS priority FROM (
    SELECT run_id, span_id, CASE goal WHEN 'converge' THEN 'verify' ELSE 'optimize' END AS action_type,
      CASE goal WHEN 'minimize' THEN 'optimize the computation of ' || target WHEN 'maximize' THEN 'optimize the accumulation of ' || target ELSE 'verify that ' || target || ' converges' END AS title,
      confidence * CASE goal WHEN 'minimize' THEN 0.8 WHEN 'maximize' THEN 0.7 ELSE 0.6 END::DOUBLE AS p FROM go WHERE goal <> 'compress'
    UNION ALL SELECT run_id, span_id, 'debug', 'repair the violated invariant bounded_depth', 0.6::DOUBLE * 0.9 FROM iv WHERE violated > 0) GROUP BY ALL""", **MG))
def m16(spark, sf):
    e, sp = events(spark, sf), spans(spark, sf)
    g = aims(spark, sf)
    iv = invariants(spark, sf)
    acts = R.suggest_actions(g, iv, R.counterfactuals(iv, g), R.motifs(e, g, sp))
    return acts.withColumn("priority", round3(F.col("priority")))


@query("m17_run_metrics", cte("""
  SELECT run_id, count(*) AS steps, max(depth) AS depth, count(*) FILTER (event_type = 'recursive_call') AS calls,
    (SELECT coalesce(sum(violated), 0) FROM iv WHERE iv.run_id = evt.run_id) AS violations FROM evt GROUP BY run_id""", evt=EVT, sp=SP, ie=IE, iv=IV))
def m17(spark, sf):
    e = events(spark, sf)
    return E.run_metrics(e, invariants(spark, sf))


def changes_path(spark, sf):
    """The changes of variables with the time of their step, as four files that arrive one after another."""
    d = X.diff(spark, sf)
    first = d.filter("how = 'mutated'").groupBy("run_id", "step").agg(F.min("var").alias("var")).withColumn("mutated", F.lit(True))
    X.stored(spark, sf, "timed_changes", lambda: d.filter("change IN ('new', 'changed')").join(first, ["run_id", "step", "var"], "left").join(
        X.steps(spark, sf).select("run_id", "step", "ts"), ["run_id", "step"]).select(
        "run_id", "step", "var", F.when(F.col("change") == "changed", F.col("now.value")).otherwise("?").alias("value"),
        F.coalesce("mutated", F.lit(False)).alias("mutated"), F.col("ts").cast("timestamp").alias("ts")).repartition(4, "run_id"))
    return X.stored_path(spark, sf, "timed_changes")


CHANGES = "run_id string, step long, var string, value string, mutated boolean, ts timestamp"


@query("m2_streamed_state", cte("SELECT * FROM vs", df=DF, vs=VSTATE))
def m2(spark, sf):
    path = changes_path(spark, sf)
    root = "/".join([spark.sparkContext.getCheckpointDir(), "stream", sf.strip("/").replace("/", "-")])
    q = S.keep_updated(S.variable_state(S.read_changes(spark, path, CHANGES, 2)), f"{root}/state", f"{root}/offsets", available_now=True)
    q.awaitTermination()
    return S.latest(spark, f"{root}/state")


@query("m2_expiring_state", cte("SELECT *, false AS closed FROM vs", df=DF, vs=VSTATE))
def m2_expiring(spark, sf):
    """Files of one trace come in any order of time, so nothing may be late and no run idle."""
    path = changes_path(spark, sf)
    root = "/".join([spark.sparkContext.getCheckpointDir(), "expiring", sf.strip("/").replace("/", "-")])
    state = S.expiring_state(S.read_changes(spark, path, CHANGES, 2), "ts", "20000 days")
    q = S.keep_updated(state, f"{root}/state", f"{root}/offsets", available_now=True, mode="append", compact_every=2)
    q.awaitTermination()
    return S.latest(spark, f"{root}/state")

