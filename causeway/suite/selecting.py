"""Selections over the event trace, conversations and the key graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import select as S
from causeway.operators import traverse as T
from causeway.sources import fixtures as X
from causeway.suite import query
from causeway.suite.duck import cte
from causeway.suite.facts import FACTS
from causeway.suite.graphs import FUSE, fused_sources
from causeway.suite.traversing import SEED, SLICE, purchases


@query("b1_select_variable", cte("""
  SELECT run_id, step FROM rd WHERE var = 'signup' UNION SELECT run_id, step FROM wr WHERE var = 'signup'"""))
def b1(spark, sf):
    return S.select_nodes(X.steps(spark, sf), var="signup").select("run_id", "step")


@query("b1_select_code_fallback", cte("""
  SELECT run_id, step FROM st JOIN (SELECT run_id, count(*) FILTER (contains(lower(code), 'view.append(view')) AS n, max(step) AS last
                                    FROM st GROUP BY run_id) USING (run_id)
  WHERE (n > 0 AND contains(lower(code), 'view.append(view')) OR (n = 0 AND step = last)"""))
def b1b(spark, sf):
    return S.select_nodes(X.steps(spark, sf), var="VIEW.append(view").select("run_id", "step")


@query("b1_select_conversation_text", """
  WITH c AS (SELECT *, contains(text, 'the') AS hit FROM conversations)
  SELECT CAST(conv_id AS VARCHAR) AS run_id, turn AS step FROM c
  JOIN (SELECT conv_id, bool_or(hit) AS any_hit, max(turn) AS last FROM c GROUP BY conv_id) USING (conv_id)
  WHERE (any_hit AND hit) OR (NOT any_hit AND turn = last)""")
def b1c(spark, sf):
    c = X.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("run_id"), F.col("turn").alias("step"), F.col("text").alias("code"))
    return S.select_nodes(c, pattern="the").select("run_id", "step")


@query("b2_select_facts", cte("""
  SELECT run_id, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY kind, fact_id) AS rn FROM fa
    WHERE contains(kind, 'view') OR contains(lower(description), 'view') OR contains(lower(subject), 'view')) WHERE rn <= 20""", **FACTS))
def b2(spark, sf):
    return S.select_facts(X.facts(spark, sf), "View").select("run_id", "fact_id")


@query("b2_select_facts_where", cte("""
  SELECT run_id, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY kind, fact_id) AS rn FROM fa
    WHERE len(string_split(evidence, ',')) > 2) WHERE rn <= 5""", **FACTS))
def b2b(spark, sf):
    return S.select_facts(X.facts(spark, sf), limit=5, where=("evidence", ">", 2)).select("run_id", "fact_id")


@query("b3_filter_facts", cte("""
  SELECT run_id, fact_id, 'iterations' AS filter FROM fa WHERE kind = 'loop.iteration'
    AND CAST(regexp_extract(description, 'executes ([0-9]+)', 1) AS INTEGER) >= 2
  UNION ALL SELECT run_id, fact_id, 'subject' FROM fa WHERE contains(lower(subject), 'purchase')
  UNION ALL SELECT run_id, fact_id, 'kind' FROM fa WHERE kind <> 'causal.root_cause'
  UNION ALL SELECT run_id, fact_id, 'pattern' FROM fa JOIN (SELECT run_id, var AS subject, pattern FROM evo2) USING (run_id, subject)
    WHERE kind = 'variable.evolution' AND pattern = 'changing'""", **FACTS))
def b3(spark, sf):
    f = X.facts(spark, sf)
    out = None
    for name, field, op, value in (("iterations", "iterations", ">=", 2), ("subject", "subject", "contains", "Purchase"),
                                   ("kind", "kind", "!=", "causal.root_cause"), ("pattern", "pattern", "==", "changing")):
        part = S.filter_facts(f, field, op, value).select("run_id", "fact_id", F.lit(name).alias("filter"))
        out = part if out is None else out.unionByName(part)
    return out


@query("b4_filter_slice", cte("""
  SELECT run_id, step, 'deep' AS filter FROM (SELECT run_id, node AS step, min(depth) AS depth FROM slice GROUP BY ALL) WHERE depth > 3
  UNION ALL SELECT run_id, step, 'near' FROM (SELECT run_id, node AS step, min(depth) AS depth FROM slice GROUP BY ALL) WHERE depth < 2""",
    recursive=True, seed=SEED, slice=SLICE))
def b4(spark, sf):
    s = T.backward_slice(X.edges(spark, sf), purchases(spark, sf))
    deep = S.filter_slice(s, "depth_gt", 3).withColumn("filter", F.lit("deep"))
    return deep.unionByName(S.filter_slice(s, "depth_lt", 2).withColumn("filter", F.lit("near"))).select("run_id", "step", "filter")


@query("b5_sort_facts", cte("SELECT run_id, fact_id, coalesce(TRY_CAST(regexp_extract(description, 'executes ([0-9]+)', 1) AS INTEGER), 0) AS iterations FROM fa "
                            "WHERE kind IN ('loop.iteration', 'control.early_return') ORDER BY iterations DESC", **FACTS))
def b5(spark, sf):
    f = X.facts(spark, sf).filter("kind IN ('loop.iteration', 'control.early_return')")
    value = F.coalesce(F.col("metadata")["iterations"].cast("int"), F.lit(0))
    return S.sort_rows(f.select("run_id", "fact_id", value.alias("iterations")), "iterations", desc=True)


@query("b6_limit_per_run", cte("""
  SELECT run_id, step, code FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY depth DESC, step) AS rn FROM st) WHERE rn <= 3"""))
def b6(spark, sf):
    return S.limit_per_run(X.steps(spark, sf), 3, [F.col("depth").desc(), "step"]).select("run_id", "step", "code")


@query("b7_project", cte("SELECT run_id, step, code, func FROM st"))
def b7(spark, sf):
    return S.project(X.steps(spark, sf), ["run_id", "step", "code", "func", "no_such_field"])


@query("b8_lookups", cte("""
  SELECT run_id, step, 'reads' AS found FROM rd WHERE var = 'click' UNION ALL SELECT run_id, step, 'writes' FROM wr WHERE var = 'click'
  UNION ALL SELECT run_id, step, 'contains' FROM st WHERE contains(code, 'max(') UNION ALL
  SELECT run_id, step, 'matches' FROM st WHERE regexp_matches(code, '^\\w+\\[\\w+\\] =')"""))
def b8(spark, sf):
    s = X.steps(spark, sf)
    out = None
    for name, rows in (("reads", S.reading(s, "click")), ("writes", S.writing(s, "click")),
                       ("contains", S.code_contains(s, "max(")), ("matches", S.code_matches(s, r"^\w+\[\w+\] ="))):
        part = rows.select("run_id", "step", F.lit(name).alias("found"))
        out = part if out is None else out.unionByName(part)
    return out


@query("b9_classify", cte("""
  SELECT run_id, step, CASE WHEN t = 1 THEN 'branch' WHEN t = 2 THEN 'early_return' ELSE 'loop_header' END AS role
  FROM st JOIN (SELECT run_id, max(step) AS last FROM st GROUP BY run_id) USING (run_id)
  WHERE t IN (0, 1, 7) OR (t = 2 AND step < last)"""))
def b9(spark, sf):
    return S.classify(X.steps(spark, sf)).select("run_id", "step", "role")


@query("b10_config_influenced", cte("""
  SELECT src, dst AS node_id, code_content FROM ke JOIN kn ON kn.node_id = ke.dst WHERE edge_type = 'CONFIG_INFLUENCE'"""))
def b10(spark, sf):
    n, e = X.key_graph(spark, sf)
    regions = n.filter("file_path = 'region'").select("graph_id", F.col("node_id").alias("src"))
    return S.influenced_by(n, e, regions).select("src", "node_id", "code_content")


@query("b10_error_nodes", cte("SELECT node_id FROM gx WHERE node_type = 'ERROR'", **FUSE))
def b10b(spark, sf):
    return S.error_nodes(fused_sources(spark, sf)[3]).select("node_id")


@query("b5_sort_places", cte("""
  SELECT run_id, fact_id, 'versions' AS by, row_number() OVER (PARTITION BY run_id ORDER BY total DESC, fact_id) AS place
  FROM (SELECT run_id, 'variable.evolution#' || var AS fact_id, total FROM evo2)
  UNION ALL SELECT run_id, fact_id, 'evidence', row_number() OVER (PARTITION BY run_id ORDER BY len(string_split(evidence, ',')), fact_id) FROM fa""", **FACTS))
def b5_places(spark, sf):
    f = X.facts(spark, sf)
    versions = S.ranked_per_run(f.filter("kind = 'variable.evolution' AND part = 0"), "total_versions", desc=True).withColumn("by", F.lit("versions"))
    evidence = S.ranked_per_run(f, "evidence").filter("part = 0").withColumn("by", F.lit("evidence"))
    return versions.unionByName(evidence).select("run_id", "fact_id", "by", "place")
