"""Evidence and explanations over the event trace, and the questions that have no query elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import diff as K
from causeway.operators import evidence as E
from causeway.operators import traverse as T
from causeway.plans import ask
from causeway.sources import fixtures as X
from causeway.suite import query
from causeway.suite.diffs import PR, pairs
from causeway.suite.duck import cte
from causeway.suite.facts import FACTS
from causeway.suite.history import PICK, PIMPACT, PSLICE, runs
from causeway.suite.traversing import IMPACT, SEED, SEED0, SLICE, first_views, purchases


def evidence_sql(found: str, impact: bool) -> dict[str, str]:
    """The rows of evidence behind the search ``found`` as SQL."""
    loops = """
      SELECT run_id, seed, CASE kind WHEN 'loop.iteration' THEN 'loop' ELSE 'accumulation' END AS unit, any_value(subject) AS subject, min(step) AS step,
        any_value(description) AS detail
      FROM (SELECT f.*, sl.seed FROM (SELECT run_id, kind, fact_id, subject, description, CAST(unnest(string_split(evidence, ',')) AS BIGINT) AS step FROM fa
              WHERE kind IN ('loop.iteration', 'loop.accumulation')) f JOIN sl ON sl.run_id = f.run_id AND sl.node = f.step)
      GROUP BY run_id, seed, kind, fact_id"""
    if impact:
        rows = f"""
      SELECT run_id, seed, 'source' AS unit, '' AS subject, node AS step, '' AS detail FROM sl WHERE node = seed
      UNION ALL SELECT run_id, seed, 'output', '', node, '' FROM sl WHERE NOT EXISTS
        (SELECT 1 FROM ed WHERE ed.run_id = sl.run_id AND ed.src = sl.node AND ed.kind IN ('data', 'control', 'call'))
      UNION ALL SELECT DISTINCT run_id, seed, 'flow', '', step, '' FROM (
        SELECT b.run_id, b.seed, unnest([d.src, d.dst]) AS step FROM de d JOIN sl a ON a.run_id = d.run_id AND a.node = d.src
        JOIN sl b ON b.run_id = d.run_id AND b.node = d.dst AND b.seed = a.seed)
      UNION ALL {loops}"""
    else:
        rows = f"""
      SELECT run_id, seed, 'target' AS unit, '' AS subject, node AS step, '' AS detail FROM sl WHERE node = seed
      UNION ALL SELECT run_id, seed, 'root_cause', '', node, '' FROM sl WHERE NOT EXISTS
        (SELECT 1 FROM ed WHERE ed.run_id = sl.run_id AND ed.dst = sl.node AND ed.kind IN ('data', 'control'))
      UNION ALL SELECT DISTINCT run_id, seed, 'flow', var, step, '' FROM (SELECT run_id, seed, var, unnest([src, dst]) AS step FROM fd)
        JOIN (SELECT run_id, seed, var FROM fd GROUP BY ALL HAVING count(*) >= 2) USING (run_id, seed, var)
      UNION ALL SELECT DISTINCT run_id, seed, 'version', var, step, CAST(version AS VARCHAR) FROM (SELECT *, unnest([src, dst]) AS step FROM fd)
      UNION ALL SELECT DISTINCT sl.run_id, seed, 'control', '', ce.src, '' FROM sl JOIN ce ON ce.run_id = sl.run_id AND ce.dst = sl.node
      UNION ALL {loops}"""
    return FACTS | {
        "sl": f"SELECT DISTINCT run_id, seed, node FROM {found}",
        "fd": "SELECT sl.run_id, sl.seed, de.src, de.dst, de.var, de.version FROM sl JOIN de ON de.run_id = sl.run_id AND de.dst = sl.node",
        "evi": rows,
        "evr": "SELECT e.run_id, e.seed, e.unit, e.subject, e.step, e.detail, st.line, st.code FROM evi e LEFT JOIN st ON st.run_id = e.run_id AND st.step = e.step",
    }


SAY = """
  SELECT run_id, seed, list_position(['target', 'source', 'root_cause', 'flow', 'loop', 'accumulation', 'control', 'output', 'result'], unit)::BIGINT AS position,
    unit AS role, count(*) AS items,
    CASE unit WHEN 'target' THEN 'Explaining ' WHEN 'source' THEN 'Starting from ' WHEN 'root_cause' THEN 'Originates at ' WHEN 'flow' THEN 'Data flows through '
      WHEN 'control' THEN 'Depends on ' WHEN 'output' THEN 'Ends in ' ELSE '' END || string_agg(say, '; ' ORDER BY r) FILTER (r <= 5) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seed, unit ORDER BY step, subject, detail) AS r,
          CASE WHEN detail <> '' THEN detail WHEN subject <> '' THEN '`' || subject || '` at step #' || step ELSE 'step #' || step || ' `' || trim(code) || '`' END AS say
        FROM evr WHERE unit <> 'version') GROUP BY run_id, seed, unit"""
EVIDENCE = "SELECT * FROM evr"
WHY = {"pick": PICK.replace("signup", "purchase"), "pslice": PSLICE, **evidence_sql("pslice", False), "expl": SAY}
FROM_VIEW = {"pick": PICK.replace("signup", "view"), "pimpact": PIMPACT, **evidence_sql("pimpact", True), "expl": SAY}


@query("h11_slice_evidence", cte(EVIDENCE, recursive=True, seed=SEED, slice=SLICE, **evidence_sql("slice", False)))
def h11(spark, sf):
    e = X.edges(spark, sf)
    found = T.backward_slice(e, purchases(spark, sf))
    return E.slice_evidence(found, T.slice_edges(e, found), X.steps(spark, sf), X.facts(spark, sf))


@query("h11_impact_evidence", cte(EVIDENCE, recursive=True, seed0=SEED0, impact=IMPACT, **evidence_sql("impact", True)))
def h11b(spark, sf):
    e = X.edges(spark, sf)
    return E.impact_evidence(T.forward_impact(e, first_views(spark, sf)), e, X.steps(spark, sf), X.facts(spark, sf))


@query("h12_explain_why", cte("SELECT * FROM expl", recursive=True, **WHY))
def h12(spark, sf):
    return ask.explain_why(runs(spark, sf), "purchase")


@query("h12_explain_impact", cte("SELECT * FROM expl", recursive=True, **FROM_VIEW))
def h12b(spark, sf):
    return ask.explain_impact(runs(spark, sf), "view")


SPANS = """
  SELECT run_id, var, span, behavior, min(ps) AS first_step, max(step) AS last_step, count(*) AS steps, arg_min(pv, step) AS first_value, arg_max(value, step) AS last_value
  FROM (SELECT *, sum(CASE WHEN behavior IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, var ORDER BY step)::BIGINT AS span
        FROM (SELECT *, lag(behavior) OVER (PARTITION BY run_id, var ORDER BY step) AS before
              FROM (SELECT *, CASE WHEN pt IS DISTINCT FROM type THEN 'retyped' WHEN pv = value THEN 'steady' WHEN TRY_CAST(pv AS DOUBLE) < TRY_CAST(value AS DOUBLE) THEN 'rises'
                              WHEN TRY_CAST(pv AS DOUBLE) > TRY_CAST(value AS DOUBLE) THEN 'falls' WHEN TRY_CAST(pv AS DOUBLE) = TRY_CAST(value AS DOUBLE) THEN 'steady'
                              ELSE 'changes' END AS behavior
                    FROM (SELECT run_id, var, step, value, type, lag(step) OVER w AS ps, lag(value) OVER w AS pv, lag(type) OVER w AS pt FROM sn
                          WINDOW w AS (PARTITION BY run_id, var ORDER BY step)) WHERE ps IS NOT NULL)))
  GROUP BY run_id, var, span, behavior"""
VEV = """
  SELECT run_id, var, 'span' AS unit, span AS position, behavior, first_step, last_step, steps, first_value, last_value FROM spans
  UNION ALL SELECT run_id, var, 'origin', 0, '', min(step), min(step), 1, arg_min(value, step), arg_min(value, step) FROM sn GROUP BY run_id, var
  UNION ALL SELECT run_id, var, 'final', coalesce(any_value(n), 0) + 1, '', max(step), max(step), count(*), arg_max(value, step), arg_max(value, step)
    FROM sn LEFT JOIN (SELECT run_id, var, max(span) AS n FROM spans GROUP BY run_id, var) USING (run_id, var) GROUP BY run_id, var"""


@query("h11_variable_evidence", cte("SELECT * FROM vev", spans=SPANS, vev=VEV))
def h11c(spark, sf):
    """All variables of all runs at once."""
    return E.variable_evidence(X.snapshots(spark, sf), **X.fit(spark, sf))


@query("h12_explain_variable", cte("""
  SELECT run_id, var, 1::BIGINT AS position, 'origin' AS role, 1::BIGINT AS items,
    '`' || var || '` is first seen at step #' || first_step || ' with value `' || first_value || '`' AS text FROM vev WHERE unit = 'origin' AND var = 'purchase'
  UNION ALL SELECT run_id, var, 2, 'evolution', count(*),
    string_agg(behavior || ' from `' || first_value || '` to `' || last_value || '` over ' || steps || ' steps', '; ' ORDER BY position) FILTER (position <= 5)
    FROM vev WHERE unit = 'span' AND var = 'purchase' GROUP BY run_id, var
  UNION ALL SELECT run_id, var, 3, 'final', steps,
    '`' || var || '` ends at step #' || last_step || ' with value `' || last_value || '`, seen ' || steps || ' times' FROM vev WHERE unit = 'final' AND var = 'purchase'""",
    spans=SPANS, vev=VEV))
def h12c(spark, sf):
    return ask.explain_variable(runs(spark, sf), "purchase")


@query("k8_narrative", cte("""
  SELECT p.run_a, p.run_b, 'narrative' AS category, 'info' AS severity, item, a, b
  FROM pr p JOIN told x ON x.run_id = p.run_a JOIN told y ON y.run_id = p.run_b,
    LATERAL (SELECT unnest(['title', 'units', 'roles']) AS item, unnest([x.title, x.units, x.roles]) AS a, unnest([y.title, y.units, y.roles]) AS b)
  WHERE a IS DISTINCT FROM b""", recursive=True, pr=PR,
    told="""SELECT run_id, count(*)::VARCHAR AS units, arg_min(text, position) AS title, string_agg(role, '>' ORDER BY position) AS roles FROM expl GROUP BY run_id""", **WHY))
def k8(spark, sf):
    return K.narrative(ask.explain_why(runs(spark, sf), "purchase"), pairs(spark, sf))


# ---- questions of a user, as rows

ASKED = {"pick": PICK, "pslice": PSLICE, "pimpact": PIMPACT}


@query("g10_roots", cte("""
  SELECT s.run_id, s.seed, s.node AS step, min(s.depth) AS depth, any_value(st.code) AS code FROM pslice s JOIN st ON st.run_id = s.run_id AND st.step = s.node
  WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.run_id = s.run_id AND ed.dst = s.node AND ed.kind IN ('data', 'control')) GROUP BY s.run_id, s.seed, s.node""",
    recursive=True, **ASKED))
def g10_roots(spark, sf):
    return ask.roots(runs(spark, sf), "signup").select("run_id", "seed", "step", "depth", "code")


@query("g10_impact", cte("""
  SELECT s.run_id, s.seed, s.node AS step, min(s.depth) AS depth, any_value(st.code) AS code,
    NOT EXISTS (SELECT 1 FROM ed WHERE ed.run_id = s.run_id AND ed.src = s.node AND ed.kind IN ('data', 'control', 'call')) AS is_leaf
  FROM pimpact s JOIN st ON st.run_id = s.run_id AND st.step = s.node GROUP BY s.run_id, s.seed, s.node""", recursive=True, **ASKED))
def g10_impact(spark, sf):
    return ask.impact(runs(spark, sf), "signup").select("run_id", "seed", "step", "depth", "code", "is_leaf")


@query("g10_stats", cte("""
  SELECT run_id, nodes, max_depth, functions, edges, data_edges, control_edges, call_edges, parameter_edges, variables
  FROM (SELECT run_id, count(*) AS nodes, max(depth) AS max_depth, count(DISTINCT func) AS functions FROM st GROUP BY run_id)
  JOIN (SELECT run_id, count(*) AS edges, count(*) FILTER (kind = 'data') AS data_edges, count(*) FILTER (kind = 'control') AS control_edges,
          count(*) FILTER (kind = 'call') AS call_edges, count(*) FILTER (kind = 'parameter') AS parameter_edges FROM ed GROUP BY run_id) USING (run_id)
  JOIN (SELECT run_id, count(DISTINCT var) AS variables FROM sn GROUP BY run_id) USING (run_id)"""))
def g10_stats(spark, sf):
    return ask.stats(runs(spark, sf))
