"""Dependence graphs from trace tables, and set operations on causal graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import code as C
from causeway.functions import ordered

def _no_meta() -> Column:
    return F.create_map().cast("map<string,string>")


def accesses(steps: DataFrame) -> DataFrame:
    """One row per variable a step reads or writes."""
    return steps.select(
        "run_id", "call_id", "step", "reads", "writes",
        F.explode(F.array_distinct(F.concat("reads", "writes"))).alias("var"),
    ).select(
        "run_id", "call_id", "var", "step",
        F.array_contains("reads", F.col("var")).alias("is_read"),
        F.array_contains("writes", F.col("var")).alias("is_write"),
    )


def versions(steps: DataFrame, **kw) -> DataFrame:
    """Accesses with the write before them and version numbers.

    A version counts the writes of a variable within a call. One window serves
    both the numbering and the as-of look-up of the last earlier write; a step
    that reads and writes a variable reads the previous version.
    """
    write = F.col("is_write")
    out = ordered.running(
        accesses(steps), ["run_id", "call_id", "var"], "step",
        {"write_before": ("last", F.when(write, F.col("step"))), "version_before": ("sum", write.cast("int"))}, **kw)
    return out.withColumn("version", F.col("version_before") + write.cast("int"))


def snapshot_versions(steps: DataFrame, snapshots: DataFrame, **kw) -> DataFrame:
    """The version every visible variable has after its step; 0 if the call never wrote it."""
    call = steps.select("run_id", "step", "call_id", "writes")
    rows = snapshots.join(call, ["run_id", "step"]).withColumn(
        "_w", F.array_contains("writes", F.col("var")).cast("int"))
    return ordered.running(
        rows.drop("writes"), ["run_id", "call_id", "var"], "step", {"version": ("sum", F.col("_w"), True)}, **kw
    ).drop("_w")


def data_edges(steps: DataFrame, snapshots: DataFrame | None = None, **kw) -> DataFrame:
    """Read-after-write edges: each read of a variable from its last earlier write in the call."""
    reads = versions(steps, **kw).filter("is_read AND write_before IS NOT NULL")
    if snapshots is not None:
        reads = reads.join(snapshots.select("run_id", "step", "var"), ["run_id", "step", "var"], "left_semi")
    return reads.select(
        "run_id", F.col("write_before").alias("src"), F.col("step").alias("dst"), F.lit("data").alias("kind"), "var",
        F.col("version_before").cast("int").alias("src_version"),
        F.col("version_before").cast("int").alias("dst_version"), _no_meta().alias("metadata"))


def _plain(df: DataFrame, src: Column, dst: Column, kind: str, var: Column | None = None,
           meta: Column | None = None) -> DataFrame:
    return df.select(
        "run_id", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"),
        (F.lit("") if var is None else var).alias("var"), F.lit(None).cast("int").alias("src_version"),
        F.lit(None).cast("int").alias("dst_version"), (_no_meta() if meta is None else meta).alias("metadata"))


def control_edges(steps: DataFrame, blocks: DataFrame) -> DataFrame:
    """Condition step to every step of the block it controls."""
    opened = blocks.filter("condition_step >= 0").select("run_id", "block_id", "condition_step")
    rows = steps.select("run_id", "step", "block_id").join(opened, ["run_id", "block_id"])
    return _plain(rows, F.col("condition_step"), F.col("step"), "control")


def call_edges(calls: DataFrame) -> DataFrame:
    rows = calls.filter("caller_step >= 0 AND callee_first_step IS NOT NULL")
    return _plain(rows, F.col("caller_step"), F.col("callee_first_step"), "call",
                  meta=F.create_map(F.lit("func"), F.col("func")))


def parameter_bindings(calls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Caller variable behind each argument: the first, by name, holding the same object at the call."""
    args = calls.select("run_id", "call_id", F.col("caller_step").alias("step"),
                        F.explode("args").alias("param", "arg")).withColumn("memory_id", F.col("arg.memory_id"))
    held = snapshots.select("run_id", "step", "memory_id", "var")
    return (
        args.join(held, ["run_id", "step", "memory_id"])
        .groupBy("run_id", "call_id", "step", "param").agg(F.min("var").alias("caller_var"))
        .withColumnRenamed("step", "caller_step")
    )


def parameter_edges(bindings: DataFrame) -> DataFrame:
    """A self-loop at the call site per bound argument, naming the callee's parameter."""
    return _plain(bindings, F.col("caller_step"), F.col("caller_step"), "parameter", F.col("caller_var"),
                  F.create_map(F.lit("param"), F.col("param")))


def return_bindings(calls: DataFrame, diff: DataFrame, **kw) -> DataFrame:
    """First later step at which a new or rebound variable holds the returned object.

    An as-of look-up ahead per ``(run, object)``: calls and assignments share
    one ordered pass, so no call is paired with more than one assignment.
    """
    key = ["run_id", "memory_id"]
    returned = calls.filter("return_value IS NOT NULL").select(
        "run_id", F.col("return_value.memory_id").alias("memory_id"), F.col("return_step").alias("step"), "call_id",
        F.lit(None).cast("string").alias("var"))
    given = diff.filter("change = 'new' OR how = 'rebound'").groupBy(
        "run_id", F.col("now.memory_id").alias("memory_id"), "step"
    ).agg(F.min("var").alias("var")).select(*key, "step", F.lit(None).cast("long").alias("call_id"), "var")
    # at one step the assignment comes first, so a call only sees later steps
    rows = returned.unionByName(given).withColumn("_is_call", F.col("call_id").isNotNull())
    ahead = ordered.running(
        rows, key, "step",
        {"_hit": ("last", F.when(~F.col("_is_call"), F.struct(F.col("step").alias("s"), F.col("var").alias("v"))))},
        order=["_is_call"], reverse=True, **kw)
    return ahead.filter("_is_call AND _hit IS NOT NULL").select(
        "run_id", "call_id", F.col("step").alias("return_step"), F.col("_hit.s").alias("caller_step"),
        F.col("_hit.v").alias("assigned_to"))


def dependence_parts(steps, snapshots, calls, blocks, **kw) -> list[DataFrame]:
    """All edges of the runs, a table each: data, control, call and parameter."""
    return [data_edges(steps, snapshots, **kw), control_edges(steps, blocks), call_edges(calls),
            parameter_edges(parameter_bindings(calls, snapshots))]


def dependence_graph(steps, snapshots, calls, blocks, **kw) -> DataFrame:
    """All edges of the runs: data, control, call and parameter."""
    return reduce(DataFrame.unionByName, dependence_parts(steps, snapshots, calls, blocks, **kw))


# Words of the language that never name a variable.
KEYWORDS = (
    "if else elif for while return def class import from as with try except finally and or not in is True False None "
    "range len int str float list dict set sorted sum min max abs append extend print type isinstance enumerate zip "
    "map filter"
).split()


def _version(count: Column | str, name: str = "version") -> Column:
    return F.concat_ws("#", "var", (F.col(count) if isinstance(count, str) else count).cast("string")).alias(name)


def version_graph(steps: DataFrame, snapshots: DataFrame, diff: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Versions ``var#n`` and the edges between them.

    A step writes the variables that are new or changed in its snapshot and
    reads the visible variables its right-hand side names. Versions follow
    from the writes alone.
    """
    changed = diff.filter("change IN ('new', 'changed')").select("run_id", "step", "var", F.col("now.value").alias("value"))
    numbered = ordered.running(changed, ["run_id", "var"], "step", {"n": ("sum", F.lit(1).cast("long"), True)}, **kw)
    nodes = numbered.select("run_id", _version("n"), "var", "n", "step", "value")
    wrote = changed.select("run_id", "step", "var", F.lit(True).alias("is_write"))
    named = F.array_except(C.words(C.right_hand_side(F.trim("code"))), F.array(*[F.lit(k) for k in KEYWORDS]))
    read = steps.select("run_id", "step", F.explode(named).alias("var")).join(
        snapshots.select("run_id", "step", "var"), ["run_id", "step", "var"], "left_semi"
    ).withColumn("is_read", F.lit(True))
    rows = wrote.join(read, ["run_id", "step", "var"], "full").select(
        "run_id", "step", "var", F.coalesce("is_read", F.lit(False)).alias("is_read"),
        F.coalesce("is_write", F.lit(False)).alias("is_write"))
    n = ordered.running(rows, ["run_id", "var"], "step", {
        "before": ("sum", F.col("is_write").cast("int")),
        "written": ("last", F.when(F.col("is_write"), F.col("step")))}, **kw)

    reads = n.filter("is_read AND before > 0").select(
        "run_id", "step", _version("before", "src"), F.col("written").alias("src_step"))
    targets = n.filter("is_write").select("run_id", "step", _version(F.col("before") + 1, "dst"))
    edges = reads.join(targets, ["run_id", "step"]).select(
        "run_id", "src", "dst", "src_step", F.col("step").alias("dst_step"))
    return nodes, edges


def subproblems(steps: DataFrame, edges: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions and loops as nodes, with the calls between different functions."""
    functions = steps.filter("func <> ''").select(
        "run_id", F.concat(F.lit("func_"), "func").alias("id"), F.col("func").alias("name"),
        F.lit("function").alias("type"), F.lit(None).cast("long").alias("iterations")).distinct()
    loops = facts.filter(F.lower("kind").contains("loop")).select(
        "run_id", F.concat_ws(":", F.lit("loop"), "kind", F.element_at("evidence", 1).cast("string"), "subject").alias("id"),
        F.col("subject").alias("name"), F.lit("loop").alias("type"),
        F.coalesce(F.col("metadata")["iterations"].cast("long"), F.lit(0)).alias("iterations"))
    at = steps.select("run_id", "step", "func")
    calls = (
        edges.filter("kind = 'call'").select("run_id", "src", "dst")
        .join(at.select("run_id", F.col("step").alias("src"), F.col("func").alias("f")), ["run_id", "src"])
        .join(at.select("run_id", F.col("step").alias("dst"), F.col("func").alias("g")), ["run_id", "dst"])
        .filter("f <> '' AND g <> '' AND f <> g")
        .select("run_id", F.concat(F.lit("func_"), "f").alias("src"), F.concat(F.lit("func_"), "g").alias("dst"))
    )
    return functions.unionByName(loops), calls


def shared_variables(steps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Variables visible in more than one function."""
    return (
        snapshots.join(steps.select("run_id", "step", "func"), ["run_id", "step"])
        .groupBy("run_id", "var").agg(F.countDistinct("func").alias("access_count")).filter("access_count > 1")
    )


def path_edges(events: DataFrame, node: str = "node_id", seq: str = "seq", **kw) -> DataFrame:
    """Edges between consecutive trace events on different nodes."""
    prev = ordered.previous_row(events, ["run_id"], seq, {"_src": F.col(node)}, **kw)
    return prev.filter(F.col("_src") != F.col(node)).select("run_id", F.col("_src").alias("src"), F.col(node).alias("dst"))


# ---- set operations on causal graphs


def _ranked(graphs: list[DataFrame]) -> DataFrame:
    out = None
    for rank, g in enumerate(graphs):
        g = g.withColumn("_rank", F.lit(rank))
        out = g if out is None else out.unionByName(g)
    return out


def _filled(name: str) -> Column:
    """The first non-empty value by rank, else empty."""
    value = F.when(F.col(name) != "", F.col(name))
    return F.coalesce(F.min_by(value, F.when(value.isNotNull(), F.col("_rank"))), F.lit(""))


def merge_nodes(graphs: list[DataFrame]) -> DataFrame:
    """Node union by id: the first graph wins, empty text is filled from later ones."""
    keep = ["file_path", "line_number", "node_type"]
    return _ranked(graphs).groupBy("graph_id", "node_id").agg(
        *[F.min_by(c, "_rank").alias(c) for c in keep],
        *[_filled(c).alias(c) for c in ("code_content", "semantic_label")])


def merge_edges(graphs: list[DataFrame]) -> DataFrame:
    """Edge union, distinct on ends and type."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.dropDuplicates(["graph_id", "src", "dst", "edge_type"])


def fuse_nodes(static: DataFrame, config: DataFrame, dynamic: list[DataFrame], exception: DataFrame) -> DataFrame:
    """Merge the four sources in order, by one aggregation per node.

    A runtime graph confirms a known node as ``CODE`` and fills an empty label;
    an exception graph turns a known node into ``ERROR`` and sets its label.
    """
    runtime = range(2, 2 + len(dynamic))
    failed = 2 + len(dynamic)
    rows = _ranked([static, config, *dynamic, exception])
    rank = F.col("_rank")
    early = rank < failed
    code = F.when(F.col("code_content") != "", F.col("code_content"))
    label = F.when(F.col("semantic_label") != "", F.col("semantic_label"))
    is_error = (rank == failed) & (F.col("node_type") == "ERROR")
    g = rows.groupBy("graph_id", "node_id").agg(
        F.min_by("file_path", "_rank").alias("file_path"), F.min_by("line_number", "_rank").alias("line_number"),
        F.min("_rank").alias("first"),
        F.min_by("node_type", "_rank").alias("own_type"),
        F.min_by("code_content", "_rank").alias("own_code"),
        F.min_by(code, F.when(code.isNotNull() & (rank < 2), rank)).alias("code"),
        F.min_by(label, F.when(label.isNotNull() & early, rank)).alias("label"),
        F.max(F.when(rank.isin(*runtime), rank)).alias("last_run"),
        F.max(is_error).alias("errs"),
        F.max_by("semantic_label", F.when(is_error, rank)).alias("err_label"),
        F.min_by("semantic_label", "_rank").alias("own_label"),
    )
    known_error = F.col("errs") & (F.col("first") < failed)
    confirmed = F.col("last_run").isNotNull() & (F.col("first") < F.col("last_run"))
    return g.select(
        "graph_id", "node_id", "file_path", "line_number",
        F.when(F.col("first") < 2, F.coalesce("code", F.lit(""))).otherwise(F.col("own_code")).alias("code_content"),
        F.when(known_error, "ERROR").when(confirmed, "CODE").otherwise(F.col("own_type")).alias("node_type"),
        F.when(known_error, F.col("err_label")).when(F.col("first") == failed, F.col("own_label"))
        .otherwise(F.coalesce("label", F.lit(""))).alias("semantic_label"),
    )


def incremental_update(nodes, edges, changed_files: DataFrame, sub_nodes, sub_edges) -> tuple[DataFrame, DataFrame]:
    """Replace the part of a graph that belongs to changed files."""
    changed = changed_files.select("file_path").distinct()
    kept = nodes.join(changed, "file_path", "left_anti")
    gone = nodes.join(changed, "file_path", "left_semi").select("graph_id", "node_id")
    left = edges
    for end in ("src", "dst"):
        left = left.join(gone.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
    return merge_nodes([kept, sub_nodes]), merge_edges([left.select(*edges.columns), sub_edges])


def causal_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node count, edge count and one row per edge type."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"))
    per_type = edges.groupBy("graph_id", "edge_type").agg(F.count("*").alias("type_edges"))
    total = per_type.groupBy("graph_id").agg(F.sum("type_edges").alias("edges"))
    return per_type.join(total, "graph_id").join(n, "graph_id")
