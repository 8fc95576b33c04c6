"""Reading, writing and static graphs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.values import joined
from causeway.operators import static as G
from causeway.session import ensure_checkpoint_dir
from causeway.sources import corpus as R
from causeway.sources import fixtures as X
from causeway.sources.fixtures import _var, indexed_events
from causeway.sources import trace as S
from causeway.suite import query
from causeway.suite.duck import cte


def _folder(spark, sf, name):
    ensure_checkpoint_dir(spark)
    return "/".join([spark.sparkContext.getCheckpointDir(), "files", sf.strip("/").replace("/", "-") + "-" + name])


def recorded(spark, sf):
    """The event trace written the way a recorder dumps it, as JSON lines."""
    path = _folder(spark, sf, "steps-json")
    held = X.snapshots(spark, sf).groupBy("run_id", "step").agg(F.map_from_entries(F.collect_list(
        F.struct("var", F.struct("value", "type", "memory_id")))).alias("vars"))
    X.steps(spark, sf).join(held, ["run_id", "step"], "left").select(
        "run_id", F.col("step").alias("index"), "file", "line", "code", "func", "vars", "depth", "indent", "block_id", "call_id",
        F.col("reads").alias("ast_reads"), F.col("writes").alias("ast_writes")).write.mode("overwrite").json(path)
    return path


@query("a1_read_steps", cte("""
  SELECT st.run_id, st.step, st.code, st.depth, coalesce(rs, '') AS reads FROM st
  LEFT JOIN (SELECT run_id, step, string_agg(var, ',' ORDER BY var) AS rs FROM rd GROUP BY run_id, step) USING (run_id, step)"""))
def a1(spark, sf):
    steps, _ = S.read_trace(spark, recorded(spark, sf))
    return steps.select("run_id", "step", "code", "depth", joined("reads").alias("reads"))


@query("a1_read_snapshots", cte("SELECT run_id, step, var, value, type, memory_id FROM sn"))
def a1b(spark, sf):
    return S.read_trace(spark, recorded(spark, sf))[1].select("run_id", "step", "var", "value", "type", "memory_id")


@query("a2_write_results", cte("SELECT run_id, src, dst, kind, var FROM ed"))
def a2(spark, sf):
    path = _folder(spark, sf, "edges")
    S.write_result(X.edges(spark, sf).select("run_id", "src", "dst", "kind", "var"), path)
    return S.read_result(spark, path, "run_id string, src long, dst long, kind string, var string").drop("bucket")


@query("a3_document_lines", """
  SELECT doc_id, line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)""")
def a3(spark, sf):
    return R.to_lines(X.table(spark, sf, "documents"), ("doc_id",))


@query("a4_config_leaves", "SELECT event_id, 'k' AS path, regexp_extract(props, '([0-9]+)', 1) AS value, CAST(NULL AS VARCHAR) AS error FROM events")
def a4(spark, sf):
    return R.flatten_config(X.table(spark, sf, "events"), "event_id", "props")


@query("a4_nested_and_unreadable", """
  SELECT event_id, 'event.kind' AS path, event_type AS value, false AS failed FROM events WHERE event_id % 3 <> 0
  UNION ALL SELECT event_id, 'event.at.user', user_id::VARCHAR, false FROM events WHERE event_id % 3 <> 0
  UNION ALL SELECT event_id, 'event.at.props.k', regexp_extract(props, '([0-9]+)', 1), false FROM events WHERE event_id % 3 <> 0
  UNION ALL SELECT event_id, NULL, NULL, true FROM events WHERE event_id % 3 = 0""")
def a4_nested(spark, sf):
    """Every event as a nested document; a third of them cut off in the middle."""
    text = F.format_string('{"event": {"kind": "%s", "at": {"user": %d, "props": %s}}}', "event_type", "user_id", "props")
    docs = X.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.substring(text, 1, 20)).otherwise(text).alias("text"))
    return R.flatten_config(docs, "event_id").select("event_id", "path", "value", F.col("error").isNotNull().alias("failed"))


def python_files(spark, sf):
    """Assignments of the event trace as source files of at most 1000 steps."""
    s = X.steps(spark, sf).filter(~F.col("code").rlike("^(for|if|while|return|[a-z]+.append)"))
    part = F.concat_ws("-", "run_id", F.floor(F.col("step") / 1000).cast("string"))
    rows = s.groupBy(part.alias("file")).agg(F.array_sort(F.collect_list(F.struct("step", "code"))).alias("l"))
    return rows.select("file", F.array_join(F.transform("l", lambda x: x["code"]), "\n").alias("text"))


PL = """SELECT run_id || '-0' AS file, row_number() OVER (PARTITION BY run_id ORDER BY step) AS line, t, w, r, r2, r3
  FROM (SELECT * FROM ev WHERE t IN (3, 4, 6, 8, 9))"""
PD = "SELECT file, line, w AS name FROM pl WHERE t IN (6, 8, 9) UNION SELECT file, line, r FROM pl WHERE t = 9"
PU = """SELECT file, line, r2 AS name FROM pl WHERE t = 4 UNION SELECT file, line, r FROM pl WHERE t IN (6, 8, 9)
  UNION SELECT file, line, r2 FROM pl WHERE t = 8 UNION SELECT file, line, r3 FROM pl WHERE t = 8 UNION SELECT file, line, w FROM pl WHERE t = 9"""


@query("d10_python_edges", cte("""
  SELECT DISTINCT u.file, u.file || ':' || d.line AS src, u.file || ':' || u.line AS dst, 'DATA_DEPENDENCY' AS edge_type FROM pu u ASOF JOIN pd d
  ON u.file = d.file AND u.name = d.name AND u.line >= d.line""", pl=PL, pd=PD, pu=PU))
def d10(spark, sf):
    return G.python_edges(G.scan_python(python_files(spark, sf)), chunk=None)


@query("d10_python_nodes", cte("SELECT file, line, 'assignment' AS semantic_label FROM pl WHERE t <> 3", pl=PL))
def d10b(spark, sf):
    files = python_files(spark, sf)
    return G.python_nodes(G.scan_python(files), R.to_lines(files)).select("file", "line", "semantic_label")


def calling_files(spark, sf):
    """The event trace as source files with functions, calls to them and assignments; every seventh file can't be parsed."""
    s = X.stored(spark, sf, "events", lambda: indexed_events(spark, sf))
    k, w = F.col("k"), F.col("w")
    t, r = F.floor(k / 10), _var(k % 5)
    line = F.when(t == 0, F.format_string("def %s(): pass", w)).when(t.isin(3, 5), F.format_string("%s()", r)).otherwise(F.format_string("%s = %s", w, r))
    rows = s.groupBy(F.col("run_id").alias("file")).agg(F.array_sort(F.collect_list(F.struct("step", line.alias("code")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["code"]), "\n")
    return rows.select("file", F.when(F.col("file").cast("int") % 7 == 0, F.concat(text, F.lit("\nreturn ("))).otherwise(text).alias("text"))


CW = "SELECT run_id AS file, step + 1 AS line, t, w, r FROM ev WHERE user_id % 7 <> 0"
CD = """SELECT c.file, c.line, c.r AS name, d.line AS def FROM (SELECT * FROM cw WHERE t IN (3, 5)) c
  ASOF JOIN (SELECT file, line, w FROM cw WHERE t = 0) d ON d.file = c.file AND d.w = c.r AND c.line >= d.line"""


@query("d10_call_graph", cte("""
  SELECT file, line, CASE WHEN t = 0 THEN 'function ' || w ELSE 'assignment' END AS label, NULL AS callee FROM cw WHERE t NOT IN (3, 5)
  UNION ALL SELECT file, line, 'calls ' || name, NULL FROM cd UNION ALL SELECT file, line, 'edge', def FROM cd
  UNION ALL SELECT DISTINCT run_id, NULL, 'error', NULL FROM ev WHERE user_id % 7 = 0""", cw=CW, cd=CD))
def d10c(spark, sf):
    files = calling_files(spark, sf)
    names = G.scan_python(files)
    nodes = G.python_nodes(names, R.to_lines(files)).select("file", F.col("line").cast("long").alias("line"), F.col("semantic_label").alias("label"), F.lit(None).cast("long").alias("callee"))
    edges = G.python_edges(names).filter("edge_type = 'CALL_RELATION'")
    at = lambda c: F.substring_index(c, ":", -1).cast("long")
    calls = edges.select("file", at("src").alias("line"), F.lit("edge").alias("label"), at("dst").alias("callee"))
    errors = names.filter("kind = 'error'").select("file", F.lit(None).cast("long").alias("line"), F.lit("error").alias("label"), F.lit(None).cast("long").alias("callee"))
    return nodes.unionByName(calls).unionByName(errors)


def script_lines(spark, sf):
    """The event trace as lines of a script, a file per run."""
    ev = X.stored(spark, sf, "events", lambda: indexed_events(spark, sf))
    k, w = F.col("k"), F.col("w")
    t, r, r2 = F.floor(k / 10), _var(k % 5), _var((k % 7) % 5)
    text = (
        F.when(t == 0, F.format_string("function %s(a) {", w)).when(t == 1, F.format_string("if (%s) {", r))
        .when(t == 2, F.format_string("return %s", r)).when(t == 4, F.format_string("import %s from 'm'", w))
        .when(t == 5, F.format_string("%s(%s);", r, w)).when(t == 7, F.format_string("while (%s) {", r)).when(t == 9, F.lit("// note"))
        .otherwise(F.format_string("let %s = %s + %s;", w, r, r2))
    )
    return ev.select(F.col("run_id").alias("file"), (F.col("step") + 1).alias("line"), text.alias("text"))


JF = "SELECT run_id AS file, w AS name, max(step) + 1 AS line FROM ev WHERE t = 0 GROUP BY run_id, w"
JU = "SELECT run_id AS file, step + 1 AS line, r AS name FROM ev WHERE t IN (3, 6, 8) AND r <> w UNION SELECT run_id, step + 1, r2 FROM ev WHERE t IN (3, 6, 8) AND r2 <> w"
JD = "SELECT run_id AS file, step + 1 AS line, w AS name FROM ev WHERE t IN (3, 6, 8)"


@query("d11_script_edges", cte("""
  SELECT DISTINCT u.file, u.file || ':' || d.line AS src, u.file || ':' || u.line AS dst, 'DATA_DEPENDENCY' AS edge_type FROM ju u ASOF JOIN jd d
  ON u.file = d.file AND u.name = d.name AND u.line > d.line
  UNION ALL SELECT DISTINCT run_id, run_id || ':' || (step + 1), run_id || ':' || jf.line, 'CALL_RELATION' FROM ev JOIN jf ON jf.file = run_id AND jf.name = r WHERE t = 5""",
    jf=JF, ju=JU, jd=JD))
def d11(spark, sf):
    return G.script_graph(script_lines(spark, sf), **X.fit(spark, sf))[1]


@query("d11_script_nodes", cte("""
  SELECT run_id AS file, step + 1 AS line, CASE t WHEN 0 THEN 'function ' || w WHEN 1 THEN 'if-branch' WHEN 2 THEN 'return' WHEN 4 THEN 'import'
    WHEN 5 THEN CASE WHEN jf.name IS NOT NULL THEN 'calls ' || r ELSE '' END WHEN 7 THEN 'loop' ELSE 'assignment' END AS semantic_label
  FROM ev LEFT JOIN jf ON jf.file = run_id AND jf.name = r WHERE t <> 9""", jf=JF))
def d11b(spark, sf):
    return G.script_graph(script_lines(spark, sf), **X.fit(spark, sf))[0].select("file", "line", "semantic_label")


@query("d11_page_links", """SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst FROM pages""")
def d11c(spark, sf):
    return G.page_links(X.table(spark, sf, "pages"))


@query("d12_config_influence", """
  WITH c AS (SELECT event_id, event_type AS w, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
  SELECT 'config:' || CASE k % 4 WHEN 0 THEN 'app.' || w WHEN 1 THEN w || '.ttl' ELSE upper(w) END AS src, event_id || ':1' AS dst, 'CONFIG_INFLUENCE' AS edge_type
  FROM c WHERE k % 4 < 3
  UNION ALL SELECT 'config:' || upper(w), event_id || ':1', 'CONFIG_INFLUENCE' FROM c WHERE k % 4 = 1""")
def d12(spark, sf):
    e = X.table(spark, sf, "events")
    k, w = F.regexp_extract("props", "([0-9]+)", 1).cast("int"), F.col("event_type")
    text = (
        F.when(k % 4 == 0, F.format_string('x = os.getenv("APP_%s")', F.upper(w))).when(k % 4 == 1, F.format_string('x = config["%s"]["ttl"]', w))
        .when(k % 4 == 2, F.format_string("x = cfg.%s", w)).otherwise(F.format_string("x = %s", w))
    )
    lines = e.select(F.col("event_id").cast("string").alias("file"), F.lit(1).alias("line"), text.alias("text"))
    keys = e.select("event_type").distinct().select(F.explode(F.array(
        F.concat(F.lit("app."), "event_type"), F.concat("event_type", F.lit(".ttl")), F.upper("event_type"))).alias("path"))
    return G.config_influence(lines, keys)


def traceback_texts(spark, sf):
    e = X.table(spark, sf, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1)
    text = F.format_string(
        'Traceback (most recent call last):\n  File "/app/%s.py", line %s, in main\n    run(%s)\n  File "/lib/core.py", line %s, in run\n    raise ValueError\nValueError: bad %s',
        "event_type", k, k, k, "event_type")
    return e.select(F.col("event_id").alias("trace_id"), text.alias("text"))


@query("d14_exception_nodes", """
  WITH c AS (SELECT event_id, event_type AS w, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)
  SELECT event_id AS trace_id, '/app/' || w || '.py:' || k AS node_id, 'CODE' AS node_type, 'in main' AS semantic_label FROM c
  UNION ALL SELECT event_id, '/lib/core.py:' || k, 'ERROR', 'ValueError: bad ' || w FROM c""")
def d14(spark, sf):
    return G.exception_graph(traceback_texts(spark, sf))[0]


@query("d14_throws_edges", """
  WITH c AS (SELECT event_id, event_type AS w, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)
  SELECT event_id AS trace_id, '/app/' || w || '.py:' || k AS src, '/lib/core.py:' || k AS dst, 'THROWS' AS edge_type FROM c""")
def d14b(spark, sf):
    return G.exception_graph(traceback_texts(spark, sf))[1]
