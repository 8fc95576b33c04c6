"""Facts about runs, extracted from the dependence graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions import ordered
from causeway.functions.ordered import CHUNK, chunk_of
from causeway.functions.values import number
from causeway.schemas import FACTS

# Description of each kind of fact.
TEXT = {
    "increases": "`%s` increases monotonically: %s → ... → %s (%d versions)",
    "decreases": "`%s` decreases monotonically: %s → ... → %s (%d versions)",
    "grows": "`%s` grows: %s → ... → %s (%d versions)",
    "accumulates": "`%s` accumulates over %d iterations",
    "evolves": "`%s` evolves through %d versions: %s → ... → %s",
    "mutation": "`%s` mutated in place at step #%d",
    "rebind": "`%s` rebound to new object at step #%d",
    "fan_in": "Step #%d converges %d data flows from %d variables",
    "fan_out": "Step #%d fans out to %d downstream steps",
    "iteration": "Loop executes %d iterations",
    "accumulation": "`%s` is written %d times across loop iterations",
    "filter": "Loop filters items via `%s`",
    "branch": "Branch `%s` controls %d steps",
    "early_return": "Early return at step #%d: `%s`",
    "root_cause": "Root cause: `%s` — source of data flow",
    "convergence": "Convergence point: `%s` receives %d data flows",
}

# Texts skipped when values are read as numbers.
NOT_NUMBERS = ["None", "True", "False", "{}", "[]", "set()"]


def no_facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FACTS)


def _say(key: str, *cols) -> Column:
    return F.format_string(TEXT[key], *[F.col(c) if isinstance(c, str) else c for c in cols])


def _facts(df: DataFrame, kind: str | Column, anchor: Column, subject: Column, text: Column, evidence: Column,
           meta: dict[str, Column], part: Column | None = None) -> DataFrame:
    entries = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    kind = F.lit(kind)
    return df.select(
        "run_id", F.concat_ws("#", kind, anchor.cast("string")).alias("fact_id"), kind.alias("kind"),
        subject.alias("subject"), text.alias("description"), evidence.cast("array<bigint>").alias("evidence"),
        (F.lit(0) if part is None else part).cast("long").alias("part"), F.lit(1.0).alias("confidence"),
        F.create_map(*entries).cast("map<string,string>").alias("metadata"))


def _evidence(rows: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Sorted steps per key, one array per chunk of steps; ``part`` 0 comes first."""
    parts = rows.groupBy(*keys, chunk_of(step, CHUNK).alias("_p")).agg(F.array_sort(F.collect_set(step)).alias("evidence"))
    first = parts.groupBy(*keys).agg(F.min("_p").alias("_p0"))
    return parts.join(first, keys).withColumn("part", F.col("_p") - F.col("_p0")).drop("_p", "_p0")


def evolution(edges: DataFrame, snapshots: DataFrame, **kw) -> DataFrame:
    """How the values of each variable with at least two data edges evolve."""
    data = edges.filter("kind = 'data' AND var <> ''").select("run_id", "var", F.col("dst").alias("step"))
    rows = data.join(snapshots.select("run_id", "step", "var", "value"), ["run_id", "step", "var"], "left").withColumn(
        "value", F.coalesce("value", F.lit("?")))
    plain = F.col("value").isin(NOT_NUMBERS)
    held = rows.withColumn("_n", F.when(~plain, number(F.col("value"))))
    seen = ordered.running(held, ["run_id", "var"], "step", {"_before": ("last", F.col("_n"))}, **kw)
    pair = F.col("_n").isNotNull() & F.col("_before").isNotNull()
    g = seen.groupBy("run_id", "var").agg(
        F.count("*").alias("total"),
        F.min_by("value", "step").alias("first_value"), F.max_by("value", "step").alias("last_value"),
        F.count("_n").alias("numbers"), F.count_if(~plain & F.col("_n").isNull()).alias("others"),
        F.bool_and(F.when(pair, F.col("_n") > F.col("_before"))).alias("strict"),
        F.bool_and(F.when(pair, F.col("_n") >= F.col("_before"))).alias("up"),
        F.bool_and(F.when(pair, F.col("_n") <= F.col("_before"))).alias("down"),
        F.bool_or(F.col("value").contains("append") | F.col("value").contains("update")).alias("grown"),
    ).filter("total >= 2")
    numeric = (F.col("others") == 0) & (F.col("numbers") >= 2)
    pattern = (
        F.when(numeric & F.col("strict"), "strictly_increasing").when(numeric & F.col("up"), "monotonic_increasing")
        .when(numeric & F.col("down"), "monotonic_decreasing").when(F.col("grown"), "accumulation").otherwise("changing")
    )
    args = ("var", "first_value", "last_value", "total")
    text = (
        F.when(F.col("pattern") == "monotonic_increasing", _say("increases", *args))
        .when(F.col("pattern") == "monotonic_decreasing", _say("decreases", *args))
        .when(F.col("pattern") == "strictly_increasing", _say("grows", *args))
        .when(F.col("pattern") == "accumulation", _say("accumulates", "var", "total"))
        .otherwise(_say("evolves", "var", "total", "first_value", "last_value"))
    )
    g = g.withColumn("pattern", pattern).join(_evidence(rows, ["run_id", "var"], "step"), ["run_id", "var"])
    return _facts(g, "variable.evolution", F.col("var"), F.col("var"), text, F.col("evidence"),
                  {"pattern": F.col("pattern"), "total_versions": F.col("total")}, F.col("part"))


def mutations(edges: DataFrame, diff: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changes seen at the end of a data edge: in place or to a new object."""
    data = edges.filter("kind = 'data' AND var <> ''").select("run_id", "src", F.col("dst").alias("step"), "var")
    often = data.groupBy("run_id", "var").count().filter("count >= 2").select("run_id", "var")
    now = diff.filter("change = 'changed'").select("run_id", "step", "var", F.col("now.memory_id").alias("memory_id"))
    then = snapshots.select("run_id", F.col("step").alias("src"), "var", F.col("memory_id").alias("source_memory"))
    rows = data.join(often, ["run_id", "var"], "left_semi").join(now, ["run_id", "step", "var"]).join(
        then, ["run_id", "src", "var"])
    same = F.col("memory_id").eqNullSafe(F.col("source_memory"))
    kind = F.when(same, "variable.mutation").otherwise("variable.rebind")
    text = F.when(same, _say("mutation", "var", "step")).otherwise(_say("rebind", "var", "step"))
    return _facts(rows, kind, F.concat_ws(":", "var", "step"), F.col("var"), text, F.array("step"), {"step": F.col("step")})


def fans(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps with at least three data edges of at least two variables on one side."""
    at = steps.select("run_id", "step", "code")
    out = None
    for name, end in (("fan_in", "dst"), ("fan_out", "src")):
        g = edges.filter("kind = 'data'").groupBy("run_id", F.col(end).alias("step")).agg(
            F.count("*").alias("n"), F.array_sort(F.collect_set("var")).alias("vars")
        ).filter("n >= 3 AND size(vars) >= 2").join(at, ["run_id", "step"])
        text = _say("fan_in", "step", "n", F.size("vars")) if end == "dst" else _say("fan_out", "step", "n")
        part = _facts(g, f"data_flow.{name}", F.col("step"), F.col("code"), text, F.array("step"),
                      {"count": F.col("n"), "variables": F.concat_ws(",", "vars")})
        out = part if out is None else out.unionByName(part)
    return out


def _controlled(steps: DataFrame, edges: DataFrame, heads: Column) -> DataFrame:
    head = steps.filter(heads).select("run_id", F.col("step").alias("src"), F.col("code").alias("head_code"))
    return edges.filter("kind = 'control'").select("run_id", "src", "dst").join(head, ["run_id", "src"])


def _members(body: DataFrame) -> DataFrame:
    """All steps of each head, itself included, as evidence in parts."""
    rows = body.select("run_id", "src", F.explode(F.array("src", "dst")).alias("step"))
    return _evidence(rows, ["run_id", "src"], "step")


def loops(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Loop headers with their iterations, accumulated variables and filters."""
    return reduce(DataFrame.unionByName, loop_parts(steps, edges))


def loop_parts(steps: DataFrame, edges: DataFrame) -> list[DataFrame]:
    code = F.col("code")
    body = _controlled(steps, edges, code.contains("for ") | code.contains("while "))
    at = steps.select("run_id", F.col("step").alias("dst"), "line", "code", "writes")
    inside = body.join(at, ["run_id", "dst"])
    n = inside.groupBy("run_id", "src").agg(
        F.count("*").alias("n"), F.countDistinct("line").alias("lines"), F.first("head_code").alias("head_code"),
        F.countDistinct("dst").alias("body_steps"))
    n = n.join(_members(body), ["run_id", "src"]).withColumn(
        "iterations", F.floor(F.col("n") / F.greatest(F.lit(1), F.col("lines"))))
    iteration = _facts(n, "loop.iteration", F.col("src"), F.col("head_code"), _say("iteration", "iterations"),
                       F.col("evidence"),
                       {"header_step": F.col("src"), "iterations": F.col("iterations"), "body_steps": F.col("body_steps")}, F.col("part"))

    wrote = inside.select("run_id", "src", "dst", F.explode("writes").alias("var")).distinct()
    times = wrote.groupBy("run_id", "src", "var").agg(F.count("*").alias("n")).filter("n >= 2").join(
        _evidence(wrote, ["run_id", "src", "var"], "dst"), ["run_id", "src", "var"])
    accumulation = _facts(times, "loop.accumulation", F.concat_ws(":", "src", "var"), F.col("var"),
                          _say("accumulation", "var", "n"), F.col("evidence"),
                          {"variable": F.col("var"), "write_count": F.col("n"), "header_step": F.col("src")}, F.col("part"))

    tests = inside.filter(code.contains("if ")).select("run_id", "src", "dst", "code").distinct()
    filters = _facts(tests, "loop.filter", F.concat_ws(":", "src", "dst"), code, _say("filter", F.trim("code")),
                     F.array("dst", "src"), {"condition_step": F.col("dst"), "loop_header": F.col("src")})
    return [iteration, accumulation, filters]


def controls(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Branches that control steps, and returns inside an indented block."""
    return reduce(DataFrame.unionByName, control_parts(steps, edges))


def control_parts(steps: DataFrame, edges: DataFrame) -> list[DataFrame]:
    code = F.col("code")
    body = _controlled(steps, edges, code.startswith("if ") | code.startswith("elif "))
    n = body.groupBy("run_id", "src").agg(F.count("*").alias("n"), F.first("head_code").alias("head_code")).join(
        _members(body), ["run_id", "src"])
    branch = _facts(n, "control.branch", F.col("src"), F.col("head_code"), _say("branch", F.trim("head_code"), "n"),
                    F.col("evidence"), {"condition_step": F.col("src"), "controlled": F.col("n")}, F.col("part"))
    early = steps.filter(code.startswith("return ") & (F.col("indent") > 0))
    return [branch, _facts(
        early, "control.early_return", F.col("step"), code, _say("early_return", "step", F.trim("code")),
        F.array("step"), {"step": F.col("step"), "indent": F.col("indent")})]


def causes(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Sources of data flow, and steps where at least three flows meet."""
    into = edges.filter("kind = 'data'").groupBy("run_id", F.col("dst").alias("step")).agg(F.count("*").alias("n"))
    at = steps.select("run_id", "step", "code", "writes")
    sources = at.filter(F.size("writes") > 0).join(into, ["run_id", "step"], "left_anti")
    root = _facts(sources, "causal.root_cause", F.col("step"), F.col("code"), _say("root_cause", F.trim("code")),
                  F.array("step"), {"step": F.col("step"), "writes": F.concat_ws(",", "writes")})
    meets = into.filter("n >= 3").join(at, ["run_id", "step"])
    return root.unionByName(_facts(
        meets, "causal.convergence", F.col("step"), F.col("code"), _say("convergence", F.trim("code"), "n"),
        F.array("step"), {"step": F.col("step"), "incoming_count": F.col("n")}))


def fact_parts(steps, snapshots, edges, diff, **kw) -> list[DataFrame]:
    """All facts of all runs, one table per family.

    A writer takes them one after the other: planned as one union, the joins of
    all families would be built, and broadcast by the driver, at the same time.
    """
    return [evolution(edges, snapshots, **kw), mutations(edges, diff, snapshots), fans(steps, edges),
            *loop_parts(steps, edges), *control_parts(steps, edges), causes(steps, edges)]


def extract_facts(steps, snapshots, edges, diff, **kw) -> DataFrame:
    """All facts of all runs."""
    return reduce(DataFrame.unionByName, fact_parts(steps, snapshots, edges, diff, **kw))
