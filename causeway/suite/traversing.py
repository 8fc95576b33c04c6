"""Slices, impact, chains and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import chains as CH
from causeway.operators import graph as G
from causeway.operators import hierarchy as H
from causeway.operators import traverse as T
from causeway.session import checkpointed
from causeway.sources import fixtures as X
from causeway.suite import query
from causeway.suite.duck import cte
from causeway.suite.graphs import VG, version_graph

SEED = "SELECT run_id, max(step) AS step FROM wr WHERE var = 'purchase' GROUP BY run_id"
SLICE = """
  SELECT run_id, step AS seed, step AS node, 0 AS depth FROM seed
  UNION SELECT s.run_id, s.seed, e.src, s.depth + 1 FROM slice s
  JOIN ed e ON e.run_id = s.run_id AND e.dst = s.node AND e.kind IN ('data', 'control')"""
IMPACT = """
  SELECT run_id, step AS seed, step AS node, 0 AS depth FROM seed0
  UNION SELECT s.run_id, s.seed, e.dst, s.depth + 1 FROM impact s
  JOIN ed e ON e.run_id = s.run_id AND e.src = s.node AND e.kind IN ('data', 'control', 'call')"""
SEED0 = "SELECT run_id, min(step) AS step FROM wr WHERE var = 'view' GROUP BY run_id"


def purchases(spark, sf):
    """Last step of each run that writes ``purchase``."""
    return X.steps(spark, sf).filter(F.array_contains("writes", "purchase")).groupBy("run_id").agg(F.max("step").alias("step"))


def first_views(spark, sf):
    return X.steps(spark, sf).filter(F.array_contains("writes", "view")).groupBy("run_id").agg(F.min("step").alias("step"))


@query("f1_backward_slice", cte("""
  SELECT run_id, seed, node AS step, min(depth) AS depth,
    NOT EXISTS (SELECT 1 FROM ed WHERE ed.run_id = slice.run_id AND ed.dst = slice.node AND ed.kind IN ('data', 'control')) AS is_root
  FROM slice GROUP BY run_id, seed, node""", recursive=True, seed=SEED, slice=SLICE))
def f1(spark, sf):
    return T.backward_slice(X.edges(spark, sf), purchases(spark, sf))


@query("f1_slice_edges", cte("""
  SELECT DISTINCT s.run_id, e.src, e.dst, e.kind, e.var FROM (SELECT DISTINCT run_id, node FROM slice) s
  JOIN ed e ON e.run_id = s.run_id AND e.dst = s.node AND e.kind <> 'call'""", recursive=True, seed=SEED, slice=SLICE))
def f1b(spark, sf):
    e = X.edges(spark, sf)
    return T.slice_edges(e, T.backward_slice(e, purchases(spark, sf))).select("run_id", "src", "dst", "kind", "var")


@query("f2_slice_roots", cte("""
  SELECT DISTINCT run_id, seed, node AS step FROM slice WHERE NOT EXISTS
    (SELECT 1 FROM ed WHERE ed.run_id = slice.run_id AND ed.dst = slice.node AND ed.kind IN ('data', 'control'))""",
    recursive=True, seed=SEED, slice=SLICE))
def f2(spark, sf):
    return T.backward_slice(X.edges(spark, sf), purchases(spark, sf)).filter("is_root").select("run_id", "seed", "step")


@query("f3_forward_impact", cte("""
  SELECT run_id, seed, node AS step, min(depth) AS depth,
    NOT EXISTS (SELECT 1 FROM ed WHERE ed.run_id = impact.run_id AND ed.src = impact.node AND ed.kind IN ('data', 'control', 'call')) AS is_leaf
  FROM impact GROUP BY run_id, seed, node""", recursive=True, seed0=SEED0, impact=IMPACT))
def f3(spark, sf):
    return T.forward_impact(X.edges(spark, sf), first_views(spark, sf))


@query("f3_forward_impact_variable")
def f3b(spark, sf):
    return T.forward_impact(X.edges(spark, sf), first_views(spark, sf).withColumn("var", F.lit("view")), carry_var=True)


TS = """
  SELECT run_id, step AS seed, step AS node, 0 AS depth FROM seed
  UNION SELECT s.run_id, s.seed, e.src, s.depth + 1 FROM tslice s JOIN te e ON e.run_id = s.run_id AND e.dst = s.node"""
TE = """
  SELECT run_id, src, dst FROM de UNION ALL SELECT run_id, src, dst FROM ce
  UNION ALL SELECT r.run_id, b.caller_step, r.step FROM rd r JOIN st s USING (run_id, step)
    JOIN pb b ON b.run_id = r.run_id AND b.call_id = s.call_id WHERE r.var = 'view'"""


@query("f4_timeline_slice", cte("""
  SELECT run_id, seed, node AS step, min(depth) AS depth,
    NOT EXISTS (SELECT 1 FROM ed WHERE ed.run_id = tslice.run_id AND ed.dst = tslice.node AND ed.kind IN ('data', 'control')) AS is_root
  FROM tslice GROUP BY run_id, seed, node""", recursive=True, seed=SEED, te=TE, tslice=TS))
def f4(spark, sf):
    t = X.trace(spark, sf)
    # the argument of every call is known as `view` inside it
    bindings = G.parameter_bindings(t.calls, t.snapshots).withColumn("param", F.lit("view"))
    return T.timeline_slice(t.steps, X.edges(spark, sf).filter("kind = 'data'"), t.blocks, bindings, purchases(spark, sf))


VS = """
  SELECT run_id, 'purchase@' || asked AS seed, v AS node, 0 AS depth FROM vstart
  UNION SELECT s.run_id, s.seed, e.src, s.depth + 1 FROM vslice s JOIN ve e ON e.run_id = s.run_id AND e.dst = s.node
  WHERE s.depth < 20"""
VSTART = """
  SELECT s.run_id, s.step AS asked, 'purchase#' || coalesce(max(CASE WHEN w.step <= s.step THEN w.n END), max(w.n)) AS v
  FROM seed s JOIN vw w ON w.run_id = s.run_id AND w.var = 'purchase' GROUP BY s.run_id, s.step"""


@query("f5_version_slice", cte("""
  SELECT run_id, seed, version, step, depth,
    CASE WHEN row_number() OVER (PARTITION BY run_id, seed ORDER BY step, version) = 1 THEN 'root_cause'
         WHEN row_number() OVER (PARTITION BY run_id, seed ORDER BY step DESC, version DESC) = 1 THEN 'failure_point'
         ELSE 'contributor' END AS role
  FROM (SELECT s.run_id, s.seed, s.node AS version, w.step, min(s.depth) AS depth FROM vslice s
        JOIN vw w ON w.run_id = s.run_id AND w.var || '#' || w.n = s.node GROUP BY ALL)""",
    recursive=True, seed=SEED, vstart=VSTART, vslice=VS, **VG))
def f5(spark, sf):
    nodes, edges = version_graph(spark, sf)
    return T.version_slice(nodes, edges, purchases(spark, sf).withColumn("var", F.lit("purchase"))).select(
        "run_id", "seed", "version", "step", "depth", "role")


UP = """
  SELECT node_id AS seed, node_id AS node, 0 AS layer FROM kn WHERE file_path = 'order'
  UNION SELECT u.seed, e.src, u.layer + 1 FROM up u JOIN ke e ON e.dst = u.node WHERE u.layer < 50"""


def all_orders(spark, sf):
    return X.key_graph(spark, sf)[0].filter("file_path = 'order'").select("graph_id", "node_id")


@query("f6_ancestor_layers", cte("SELECT seed, node, min(layer) AS layer FROM up GROUP BY seed, node", recursive=True, up=UP))
def f6(spark, sf):
    _, e = X.key_graph(spark, sf)
    return T.ancestors(e, all_orders(spark, sf)).select("seed", "node", "layer")


@query("f7_causal_chains", cte("""
  SELECT 'order:' || o_orderkey AS start, 'order:' || o_orderkey || '<customer:' || c_custkey || '<nation:' || n_nationkey
    || '<region:' || n_regionkey AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""))
def f7(spark, sf):
    _, e = X.key_graph(spark, sf)
    return T.causal_chains(e, all_orders(spark, sf)).select("start", F.concat_ws("<", "nodes").alias("path"))


#: Items have two causes: their order and their supplier.
KE2 = """SELECT src, dst, edge_type FROM ke UNION ALL
  SELECT DISTINCT 'supplier:' || l_suppkey, 'item:' || l_orderkey || ':' || l_linenumber, 'DATA_DEPENDENCY' FROM lineitem"""
WALKS = """SELECT dst AS start, src AS top, [dst, src] AS nodes, [edge_type] AS types FROM ke2 WHERE starts_with(dst, 'item:')
  UNION ALL SELECT w.start, e.src, list_append(w.nodes, e.src), list_append(w.types, e.edge_type) FROM walks w JOIN ke2 e ON e.dst = w.top"""
ENDED = """SELECT *, row_number() OVER (PARTITION BY start ORDER BY list_transform(list_zip(types, nodes[2:]), lambda z: {
    'p': list_position(['THROWS', 'CONFIG_INFLUENCE', 'DATA_DEPENDENCY', 'CALL_RELATION', 'RUNTIME_TRACE', 'CONTROL_FLOW'], z[1]), 'n': z[2]})) AS rank
  FROM walks WHERE starts_with(top, 'region:')"""


def item_graph(spark, sf):
    n, e = X.key_graph(spark, sf)
    item = F.concat_ws(":", F.lit("item"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    more = X.table(spark, sf, "lineitem").select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("src"), item.alias("dst")).distinct()
    # written once: the starts are read from it as well
    edges = checkpointed(e.select("graph_id", "src", "dst", "edge_type").unionByName(more.select(F.lit(n.first()["graph_id"]).alias("graph_id"), "src", "dst", F.lit("DATA_DEPENDENCY").alias("edge_type"))))
    return edges, edges.filter("dst LIKE 'item:%'").select("graph_id", F.col("dst").alias("node_id")).distinct()


@query("f7_chain_counts", cte("SELECT start, count(*) AS chains FROM walks WHERE starts_with(top, 'region:') GROUP BY start", recursive=True, ke2=KE2, walks=WALKS))
def f7_counts(spark, sf):
    return CH.count_chains(*item_graph(spark, sf)).select("start", "chains")


@query("f7_best_chains", cte("""
  SELECT start, rank, array_to_string(nodes, '<') AS path, array_to_string(types, '<') AS kinds FROM ended WHERE rank <= 2""", recursive=True, ke2=KE2, walks=WALKS, ended=ENDED))
def f7_best(spark, sf):
    return CH.best_chains(*item_graph(spark, sf), k=2).select("start", "rank", F.concat_ws("<", "nodes").alias("path"), F.concat_ws("<", "types").alias("kinds"))


@query("f8_root_cause_chain", cte("""
  SELECT seed, node, min(layer) AS depth, bool_and(on_chain) AS on_chain FROM (
    SELECT u.*, true AS on_chain FROM up u JOIN orders ON u.seed = 'order:' || o_orderkey WHERE o_orderstatus = 'F')
  GROUP BY seed, node""", recursive=True, up=UP))
def f8(spark, sf):
    n, e = X.key_graph(spark, sf)
    failed = n.filter("file_path = 'order' AND code_content = 'F'").select("graph_id", "node_id")
    return T.root_cause_chain(e, failed).select("seed", "node", "depth", "on_chain")


@query("f9_neighbours", cte("""
  SELECT node_id, other, edge_type, direction, code_content FROM (
    SELECT dst AS node_id, src AS other, edge_type, 'depends_on' AS direction FROM ke
    UNION ALL SELECT src, dst, edge_type, 'depended_by' FROM ke)
  JOIN (SELECT node_id AS other, code_content FROM kn) USING (other)"""))
def f9(spark, sf):
    return T.neighbours(*X.key_graph(spark, sf)).select("node_id", "other", "edge_type", "direction", "code_content")


PATH = """
  SELECT run_id, pair, node, depth AS position, tgt FROM pd WHERE node = tgt
  UNION SELECT p.run_id, p.pair, min(d.node) OVER (PARTITION BY p.run_id, p.pair), d.depth, p.tgt FROM path p
  JOIN pd d ON d.run_id = p.run_id AND d.depth = p.position - 1
  JOIN ed e ON e.run_id = p.run_id AND e.src = d.node AND e.dst = p.node"""
PD = """
  SELECT i.run_id, i.seed || '>' || x.tgt AS pair, i.node, min(i.depth) AS depth, x.tgt
  FROM reachall i JOIN (SELECT run_id, max(step) AS tgt FROM st GROUP BY run_id) x USING (run_id) GROUP BY ALL"""
RA = """
  SELECT run_id, step AS seed, step AS node, 0 AS depth FROM seed0
  UNION SELECT s.run_id, s.seed, e.dst, s.depth + 1 FROM reachall s
  JOIN ed e ON e.run_id = s.run_id AND e.src = s.node AND e.src <> e.dst WHERE s.depth < 50"""


@query("f10_shortest_path", cte("SELECT run_id, pair, node AS step, position FROM path", recursive=True,
                                seed0=SEED0, reachall=RA, pd=PD, path=PATH))
def f10(spark, sf):
    last = X.steps(spark, sf).groupBy("run_id").agg(F.max("step").alias("target"))
    pairs = first_views(spark, sf).withColumnRenamed("step", "source").join(last, "run_id")
    return T.shortest_paths(X.edges(spark, sf), pairs)


@query("f11_graph_stats", cte("""
  SELECT run_id, nodes, max_depth, functions, edges, data_edges, control_edges, call_edges, parameter_edges, variables
  FROM (SELECT run_id, count(*) AS nodes, max(depth) AS max_depth, count(DISTINCT func) AS functions FROM st GROUP BY run_id)
  JOIN (SELECT run_id, count(*) AS edges, count(*) FILTER (kind = 'data') AS data_edges,
          count(*) FILTER (kind = 'control') AS control_edges, count(*) FILTER (kind = 'call') AS call_edges,
          count(*) FILTER (kind = 'parameter') AS parameter_edges FROM ed GROUP BY run_id) USING (run_id)
  JOIN (SELECT run_id, count(DISTINCT var) AS variables FROM sn GROUP BY run_id) USING (run_id)"""))
def f11(spark, sf):
    t = X.trace(spark, sf)
    return T.graph_stats(t.steps, t.snapshots, X.edges(spark, sf))


@query("f12_roots_leaves", cte("""
  SELECT run_id, step, 'root' AS role FROM st WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.run_id = st.run_id
    AND ed.dst = st.step AND kind IN ('data', 'control'))
  UNION ALL SELECT run_id, step, 'leaf' FROM st WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.run_id = st.run_id
    AND ed.src = st.step AND kind IN ('data', 'control', 'call'))
  UNION ALL SELECT DISTINCT run_id, step, 'cause' FROM st JOIN wr USING (run_id, step) WHERE NOT EXISTS
    (SELECT 1 FROM de WHERE de.run_id = st.run_id AND de.dst = st.step)"""))
def f12(spark, sf):
    s, e = X.steps(spark, sf), X.edges(spark, sf)
    out = None
    for role, rows in (("root", T.roots(s, e)), ("leaf", T.leaves(s, e)), ("cause", T.root_cause_steps(s, e))):
        part = rows.select("run_id", "step", F.lit(role).alias("role"))
        out = part if out is None else out.unionByName(part)
    return out


@query("f12_fan_in_out", cte("""
  SELECT run_id, dst AS step, count(*) AS edges, 'in' AS direction FROM ed GROUP BY ALL HAVING count(*) >= 3
  UNION ALL SELECT run_id, src, count(*), 'out' FROM ed GROUP BY run_id, src HAVING count(*) >= 3"""))
def f12b(spark, sf):
    e = X.edges(spark, sf)
    return T.fan(e, "dst").withColumn("direction", F.lit("in")).unionByName(
        T.fan(e, "src").withColumn("direction", F.lit("out")))


@query("f13_edge_counts", cte("""
  SELECT run_id, src AS step, 'out' AS direction, kind, count(*) AS edges FROM ed GROUP BY ALL
  UNION ALL SELECT run_id, dst, 'in', kind, count(*) FROM ed GROUP BY run_id, dst, kind"""))
def f13(spark, sf):
    return T.edge_counts(X.edges(spark, sf))


@query("f13_incoming_variables", cte("SELECT DISTINCT run_id, dst AS step, var FROM de"))
def f13b(spark, sf):
    return T.incoming_variables(X.edges(spark, sf))


@query("f13_edges_of_variable", cte("SELECT run_id, src, dst FROM ed WHERE var = 'purchase' AND kind = 'data'"))
def f13c(spark, sf):
    return T.edges_of(X.edges(spark, sf), "purchase", "data").select("run_id", "src", "dst")


S5 = "SELECT run_id, step FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY md5(run_id || ':' || step)) AS p FROM st) WHERE p <= 5"
B5 = """SELECT run_id, step AS seed, step AS node FROM s5
  UNION SELECT s.run_id, s.seed, e.src FROM b5 s JOIN ed e ON e.run_id = s.run_id AND e.dst = s.node AND e.kind IN ('data', 'control')"""
I5 = """SELECT run_id, step AS seed, step AS node FROM s5
  UNION SELECT s.run_id, s.seed, e.dst FROM i5 s JOIN ed e ON e.run_id = s.run_id AND e.src = s.node AND e.kind IN ('data', 'control', 'call')"""


@query("f14_graph_profile", cte("""
  SELECT run_id, nodes, round(avg_degree, 3) AS avg_degree, max_degree, round(avg_slice, 3) AS avg_slice, round(avg_impact, 3) AS avg_impact
  FROM (SELECT run_id, count(*) AS nodes FROM st GROUP BY run_id)
  JOIN (SELECT run_id, avg(n) AS avg_degree, max(n) AS max_degree FROM (SELECT run_id, step, count(*) AS n
        FROM (SELECT run_id, src AS step FROM ed UNION ALL SELECT run_id, dst FROM ed) GROUP BY ALL) GROUP BY run_id) USING (run_id)
  JOIN (SELECT run_id, avg(n) AS avg_slice FROM (SELECT run_id, seed, count(*) AS n FROM b5 GROUP BY ALL) GROUP BY run_id) USING (run_id)
  JOIN (SELECT run_id, avg(n) AS avg_impact FROM (SELECT run_id, seed, count(*) AS n FROM i5 GROUP BY ALL) GROUP BY run_id) USING (run_id)""",
    recursive=True, s5=S5, b5=B5, i5=I5))
def f14(spark, sf):
    p = T.graph_profile(X.steps(spark, sf), X.edges(spark, sf))
    return p.select("run_id", "nodes", "max_degree", *[F.round(c, 3).alias(c) for c in ("avg_degree", "avg_slice", "avg_impact")])


ANC = """SELECT dst AS node_id, src AS ancestor, 1 AS depth FROM ke
  UNION ALL SELECT a.node_id, e.src, a.depth + 1 FROM anc a JOIN ke e ON e.dst = a.ancestor"""


@query("f15_hierarchy_ancestors", cte("SELECT DISTINCT node_id, ancestor, depth FROM anc", recursive=True, anc=ANC))
def f15(spark, sf):
    return H.ancestors_of(X.key_graph(spark, sf)[1]).select("node_id", "ancestor", "depth")


@query("f15_hierarchy_descendants", cte("""
  SELECT ancestor AS node_id, depth, count(*) AS descendants FROM (SELECT DISTINCT node_id, ancestor, depth FROM anc)
  WHERE starts_with(ancestor, 'nation:') OR starts_with(ancestor, 'region:') GROUP BY ALL""", recursive=True, anc=ANC))
def f15b(spark, sf):
    n, e = X.key_graph(spark, sf)
    tops = n.filter("file_path IN ('nation', 'region')").select("graph_id", F.col("node_id").alias("node"))
    return H.descendants_of(e, tops).groupBy("node_id", "depth").agg(F.count("*").alias("descendants"))


@query("f15_sibling_counts", cte("""
  SELECT e.dst AS node_id, sum(f.n - 1) AS siblings FROM ke e JOIN (SELECT src, count(*) AS n FROM ke GROUP BY src) f USING (src)
  GROUP BY e.dst"""))
def f15c(spark, sf):
    return H.sibling_counts(X.key_graph(spark, sf)[1]).select(F.col("dst").alias("node_id"), "siblings")


@query("f15_siblings", cte("""
  SELECT a.dst AS node_id, b.dst AS sibling FROM ke a JOIN ke b ON a.src = b.src AND a.dst <> b.dst WHERE starts_with(a.dst, 'nation:') OR starts_with(a.dst, 'supplier:')"""))
def f15_siblings(spark, sf):
    """Nations of a region; suppliers of a nation, with its customers."""
    n, e = X.key_graph(spark, sf)
    return H.siblings_of(e, n.filter("file_path IN ('nation', 'supplier')")).select("node_id", "sibling")


def customer_taxonomy(spark, sf):
    """Nations and customers as concepts: a customer's family is its segment, its behaviours are the priorities of its orders, its invariants their states."""
    c, o = X.table(spark, sf, "customer"), X.table(spark, sf, "orders")
    done = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("b"), F.collect_set("o_orderstatus").alias("i"))
    none = F.array().cast("array<string>")
    return c.join(done, "c_custkey", "left").select(
        F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("concept_id"), F.lit("customer").alias("category"), F.col("c_mktsegment").alias("family"),
        F.array(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string"))).alias("parents"),
        F.transform(F.coalesce("b", none), lambda p: F.struct(F.lit("orders").alias("relation"), p.alias("target"))).alias("related"),
        F.coalesce("b", none).alias("behaviors"), F.coalesce("i", none).alias("invariants"))


@query("f15_concepts_asked", """
  SELECT 'customer:' || c_custkey AS concept_id, 'member' AS asked FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'behaviour' FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'invariant' FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'
  UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'orders ' || o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey""")
def f15_concepts(spark, sf):
    t = customer_taxonomy(spark, sf)
    asked = lambda df, what: df.select("concept_id", what.alias("asked"))
    return (asked(H.members(t, "customer", "BUILDING"), F.lit("member")).unionByName(asked(H.with_behavior(t, "1-URGENT"), F.lit("behaviour")))
            .unionByName(asked(H.with_invariant(t, "F"), F.lit("invariant"))).unionByName(asked(H.related_by(t, "orders"), F.concat_ws(" ", "relation", "target"))))
