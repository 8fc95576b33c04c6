"""Dependence graphs of the event trace; merges of the key graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import graph as G
from causeway.operators import prepare as P
from causeway.sources import fixtures as X
from causeway.suite import query
from causeway.suite.duck import cte
from causeway.suite.preparing import DF


@query("d1_versions", cte("""
  SELECT s.run_id, s.step, s.var, count(w.var) AS version
  FROM (SELECT sn.*, call_id FROM sn JOIN st USING (run_id, step)) s
  LEFT JOIN (SELECT wr.*, call_id FROM wr JOIN st USING (run_id, step)) w
    ON w.run_id = s.run_id AND w.call_id = s.call_id AND w.var = s.var AND w.step <= s.step
  GROUP BY s.run_id, s.step, s.var"""))
def d1(spark, sf):
    t = X.trace(spark, sf)
    return G.snapshot_versions(t.steps, t.snapshots, **X.fit(spark, sf)).select("run_id", "step", "var", "version")


@query("d2_data_edges", cte("SELECT run_id, src, dst, var, version AS src_version FROM de"))
def d2(spark, sf):
    t = X.trace(spark, sf)
    return G.data_edges(t.steps, t.snapshots, **X.fit(spark, sf)).select("run_id", "src", "dst", "var", "src_version")


@query("d3_control_edges", cte("SELECT run_id, src, dst FROM ce"))
def d3(spark, sf):
    t = X.trace(spark, sf)
    return G.control_edges(t.steps, t.blocks).select("run_id", "src", "dst")


@query("d4_call_edges", cte("SELECT run_id, caller_step AS src, first_step AS dst, func FROM cl"))
def d4(spark, sf):
    return G.call_edges(X.trace(spark, sf).calls).select("run_id", "src", "dst", F.col("metadata")["func"].alias("func"))


@query("d5_parameter_edges", cte("SELECT run_id, caller_step AS src, caller_step AS dst, var, 'arg' AS param FROM pb"))
def d5(spark, sf):
    t = X.trace(spark, sf)
    return G.parameter_edges(G.parameter_bindings(t.calls, t.snapshots)).select(
        "run_id", "src", "dst", "var", F.col("metadata")["param"].alias("param"))


@query("d6_parameter_bindings", cte("SELECT run_id, call_id, caller_step, 'arg' AS param, var AS caller_var FROM pb"))
def d6(spark, sf):
    t = X.trace(spark, sf)
    return G.parameter_bindings(t.calls, t.snapshots)


@query("d7_return_bindings", cte("""
  SELECT run_id, call_id, return_step, caller_step, assigned_to FROM (
    SELECT c.run_id, c.call_id, c.return_step, d.step AS caller_step, d.var AS assigned_to,
      row_number() OVER (PARTITION BY c.run_id, c.call_id ORDER BY d.step, d.var) AS rn
    FROM cl c JOIN df d ON d.run_id = c.run_id AND d.step > c.return_step AND d.n.memory_id = c.ret_mem
      AND (d.change = 'new' OR (d.change = 'changed' AND d.n.memory_id <> d.o.memory_id))) WHERE rn = 1""", df=DF))
def d7(spark, sf):
    t = X.trace(spark, sf)
    return G.return_bindings(t.calls, X.diff(spark, sf), **X.fit(spark, sf))


VW = "SELECT run_id, step, var, n.value AS value, row_number() OVER (PARTITION BY run_id, var ORDER BY step) AS n FROM df WHERE change IN ('new', 'changed')"
VR = """
  SELECT DISTINCT s.run_id, s.step, x.var FROM st s JOIN sn x USING (run_id, step)
  WHERE regexp_matches(CASE WHEN contains(s.code, '=') THEN substr(s.code, strpos(s.code, '=') + 1) ELSE s.code END,
                       '\\b' || x.var || '\\b')"""
VE = """
  SELECT r.run_id, r.var || '#' || r.n AS src, w.var || '#' || w.n AS dst, r.src_step, w.step AS dst_step
  FROM (SELECT vr.run_id, vr.step, vr.var, count(*) AS n, max(vw.step) AS src_step FROM vr JOIN vw
        ON vw.run_id = vr.run_id AND vw.var = vr.var AND vw.step < vr.step GROUP BY ALL) r
  JOIN vw w ON w.run_id = r.run_id AND w.step = r.step"""
VG = {"df": DF, "vw": VW, "vr": VR, "ve": VE}


def version_graph(spark, sf):
    t = X.trace(spark, sf)
    return G.version_graph(t.steps, t.snapshots, X.diff(spark, sf), **X.fit(spark, sf))


@query("d8_version_graph", cte("SELECT * FROM ve", **VG))
def d8(spark, sf):
    return version_graph(spark, sf)[1]


@query("d8_version_nodes", cte("SELECT run_id, var || '#' || n AS version, var, n, step, value FROM vw", **VG))
def d8b(spark, sf):
    return version_graph(spark, sf)[0]


@query("d13_path_edges", cte("""
  SELECT run_id, src, dst FROM (SELECT run_id, lag(line) OVER (PARTITION BY run_id ORDER BY step) AS src, line AS dst
  FROM st) WHERE src <> dst"""))
def d13(spark, sf):
    return G.path_edges(X.steps(spark, sf), "line", "step", **X.fit(spark, sf))


@query("d13_conversation_path", """
  SELECT run_id, src, dst, count(*) AS times FROM (SELECT CAST(conv_id AS VARCHAR) AS run_id,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS src, role AS dst FROM conversations)
  WHERE src <> dst GROUP BY ALL""")
def d13b(spark, sf):
    c = X.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("run_id"), "turn", "role")
    return G.path_edges(c, "role", "turn").groupBy("run_id", "src", "dst").agg(F.count("*").alias("times"))


@query("d15_function_calls", cte("""
  SELECT c.run_id, 'func_' || a.func AS src, 'func_' || c.func AS dst FROM cl c
  JOIN st a ON a.run_id = c.run_id AND a.step = c.caller_step WHERE a.func <> c.func"""))
def d15(spark, sf):
    e = X.edges(spark, sf)
    from causeway.operators.facts import no_facts
    return G.subproblems(X.steps(spark, sf), e, no_facts(spark))[1]


@query("d15_shared_variables", cte("""
  SELECT run_id, var, count(DISTINCT func) AS access_count FROM sn JOIN st USING (run_id, step)
  GROUP BY run_id, var HAVING count(DISTINCT func) > 1"""))
def d15b(spark, sf):
    t = X.trace(spark, sf)
    return G.shared_variables(t.steps, t.snapshots)


# four sources over the key graph
GS = """SELECT node_id, file_path, CASE WHEN hash3 = 0 THEN '' ELSE code_content END AS code_content, 'CONFIG' AS node_type, '' AS semantic_label
  FROM (SELECT *, length(node_id) % 3 AS hash3 FROM kn) WHERE file_path IN ('region', 'nation', 'customer')"""
GC = "SELECT node_id, file_path, 'cfg ' || code_content AS code_content, node_type, 'cfg' AS semantic_label FROM kn WHERE file_path IN ('region', 'nation')"
GD = "SELECT node_id, file_path, code_content, 'RUNTIME' AS node_type, 'run' AS semantic_label FROM kn WHERE file_path IN ('customer', 'order')"
GX = """SELECT node_id, file_path, code_content, CASE WHEN code_content = 'F' OR length(node_id) % 2 = 0 THEN 'ERROR' ELSE 'CODE' END AS node_type,
  'failed' AS semantic_label FROM kn WHERE file_path IN ('customer', 'order', 'supplier')"""
FUSE = {"gs": GS, "gc": GC, "gd": GD, "gx": GX}


def fused_sources(spark, sf):
    n, _ = X.key_graph(spark, sf)
    size = F.length("node_id")

    def part(kinds, **cols):
        out = n.filter(F.col("file_path").isin(*kinds))
        for c, v in cols.items():
            out = out.withColumn(c, v)
        return out

    static = part(["region", "nation", "customer"], node_type=F.lit("CONFIG"),
                  code_content=F.when(size % 3 == 0, "").otherwise(F.col("code_content")))
    config = part(["region", "nation"], code_content=F.concat(F.lit("cfg "), "code_content"), semantic_label=F.lit("cfg"))
    dynamic = part(["customer", "order"], node_type=F.lit("RUNTIME"), semantic_label=F.lit("run"))
    exception = part(["customer", "order", "supplier"], semantic_label=F.lit("failed"),
                     node_type=F.when((F.col("code_content") == "F") | (size % 2 == 0), "ERROR").otherwise("CODE"))
    return static, config, dynamic, exception


@query("e1_merge_nodes", cte("""
  SELECT coalesce(a.node_id, b.node_id) AS node_id,
    CASE WHEN coalesce(a.code_content, '') <> '' THEN a.code_content ELSE coalesce(b.code_content, a.code_content) END AS code_content,
    coalesce(a.node_type, b.node_type) AS node_type,
    CASE WHEN coalesce(a.semantic_label, '') <> '' THEN a.semantic_label ELSE coalesce(b.semantic_label, '') END AS semantic_label
  FROM gs a FULL JOIN gd b ON a.node_id = b.node_id""", **FUSE))
def e1(spark, sf):
    s, _, d, _ = fused_sources(spark, sf)
    return G.merge_nodes([s, d]).select("node_id", "code_content", "node_type", "semantic_label")


@query("e1_merge_edges", cte("SELECT DISTINCT src, dst, edge_type FROM (SELECT * FROM ke UNION ALL SELECT src, dst, 'CALL_RELATION' FROM ke WHERE edge_type = 'THROWS' OR edge_type = 'CALL_RELATION')"))
def e1b(spark, sf):
    _, e = X.key_graph(spark, sf)
    other = e.filter("edge_type IN ('THROWS', 'CALL_RELATION')").withColumn("edge_type", F.lit("CALL_RELATION"))
    return G.merge_edges([e, other]).select("src", "dst", "edge_type")


@query("e2_fuse_graphs", cte("""
  SELECT i.node_id,
    CASE WHEN s.node_id IS NOT NULL OR c.node_id IS NOT NULL
         THEN coalesce(nullif(s.code_content, ''), nullif(c.code_content, ''), '')
         ELSE coalesce(d.code_content, x.code_content) END AS code_content,
    CASE WHEN x.node_type = 'ERROR' AND coalesce(s.node_id, c.node_id, d.node_id) IS NOT NULL THEN 'ERROR'
         WHEN d.node_id IS NOT NULL AND coalesce(s.node_id, c.node_id) IS NOT NULL THEN 'CODE'
         ELSE coalesce(s.node_type, c.node_type, d.node_type, x.node_type) END AS node_type,
    CASE WHEN x.node_type = 'ERROR' THEN x.semantic_label
         WHEN coalesce(s.node_id, c.node_id, d.node_id) IS NULL THEN x.semantic_label
         ELSE coalesce(nullif(s.semantic_label, ''), nullif(c.semantic_label, ''), nullif(d.semantic_label, ''), '') END AS semantic_label
  FROM (SELECT node_id FROM kn) i LEFT JOIN gs s USING (node_id) LEFT JOIN gc c USING (node_id)
  LEFT JOIN gd d USING (node_id) LEFT JOIN gx x USING (node_id)""", **FUSE))
def e2(spark, sf):
    s, c, d, x = fused_sources(spark, sf)
    return G.fuse_nodes(s, c, [d], x).select("node_id", "code_content", "node_type", "semantic_label")


@query("e3_incremental_update", cte("""
  SELECT edge_type, count(*) AS edges FROM (
    SELECT * FROM ke WHERE NOT starts_with(src, 'customer:') AND NOT starts_with(dst, 'customer:')
    UNION SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'DATA_DEPENDENCY' FROM customer WHERE c_acctbal > 0)
  GROUP BY edge_type"""))
def e3(spark, sf):
    n, e = X.key_graph(spark, sf)
    changed = spark.createDataFrame([("customer",)], "file_path string")
    rich = X.table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("src"),
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("dst"),
        F.lit("DATA_DEPENDENCY").alias("edge_type"), F.lit("keys").alias("graph_id"))
    sub = n.join(rich.select(F.col("dst").alias("node_id")), "node_id", "left_semi")
    return G.incremental_update(n, e, changed, sub, rich)[1].groupBy("edge_type").agg(F.count("*").alias("edges"))


@query("e4_graph_stats", cte("""
  SELECT edge_type, count(*) AS type_edges, (SELECT count(*) FROM ke) AS edges, (SELECT count(*) FROM kn) AS nodes
  FROM ke GROUP BY edge_type"""))
def e4(spark, sf):
    return G.causal_stats(*X.key_graph(spark, sf)).drop("graph_id")
