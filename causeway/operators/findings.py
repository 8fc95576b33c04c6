"""Signs of failure in a run, and where it failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import code as C
from causeway.functions import ordered
from causeway.operators.traverse import version_slice

# Severities from mild to severe; type changes that are accepted.
SEVERITY = ["healthy", "warning", "error", "critical"]
ACCEPTED = ["float,int", "NoneType,int", "NoneType,str"]


def _finding(df: DataFrame, kind: str, severity: Column | str, subject: Column, count: Column, first: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    kind = F.lit(kind).alias("type") if isinstance(kind, str) else kind
    return df.select("run_id", kind, sev.alias("severity"),
                     subject.cast("string").alias("subject"), count.cast("long").alias("count"), first.cast("long").alias("first_step"))


def repeated_states(steps: DataFrame, snapshots: DataFrame, at_least: int = 3) -> DataFrame:
    """The same values of all variables at several steps."""
    state = snapshots.groupBy("run_id", "step").agg(
        F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("var", "value")))), 256).alias("state"))
    every = steps.select("run_id", "step").join(state, ["run_id", "step"], "left").na.fill("", ["state"])
    g = every.groupBy("run_id", "state").agg(F.count("*").alias("n"), F.min("step").alias("s")).filter(F.col("n") >= at_least)
    return _finding(g, "infinite_loop", "error", F.substring("state", 1, 8), F.col("n"), F.col("s"))


def recursion(steps: DataFrame, **kw) -> DataFrame:
    """Depth that grows without, or almost without, coming back."""
    prev = ordered.previous_row(steps.select("run_id", "step", "depth"), ["run_id"], "step", {"_before": F.col("depth")}, **kw)
    g = prev.groupBy("run_id").agg(
        F.max("depth").alias("top"), F.count_if(F.col("depth") > F.col("_before")).alias("up"),
        F.count_if(F.col("depth") < F.col("_before")).alias("down"), F.min(F.when(F.col("depth") > 3, F.col("step"))).alias("s"))
    endless = (F.col("top") > 5) & (F.col("down") == 0)
    deep = (F.col("top") > 3) & (F.col("down") < F.col("up") * 0.3)
    kind = F.when(endless, "recursion_no_base").otherwise("deep_recursion").alias("type")
    return _finding(g.filter(endless | deep), kind, F.when(endless, "critical").otherwise("warning"),
                    F.lit("depth"), F.col("top"), F.col("s"))


def stale_mutations(steps: DataFrame, snapshots: DataFrame, diff: DataFrame) -> DataFrame:
    """Variables written at least twice that no right-hand side names while they are visible."""
    writes = diff.filter("change IN ('new', 'changed')").groupBy("run_id", "var").agg(
        F.count("*").alias("n"), F.min("step").alias("s")).filter("n >= 2")
    named = steps.select("run_id", "step", F.explode(C.words(C.right_hand_side(F.col("code")))).alias("var"))
    reads = named.join(snapshots.select("run_id", "step", "var"), ["run_id", "step", "var"], "left_semi")
    return _finding(writes.join(reads, ["run_id", "var"], "left_anti"), "stale_mutation", "warning", F.col("var"), F.col("n"), F.col("s"))


def type_instability(snapshots: DataFrame) -> DataFrame:
    """Variables of exactly two types that do not go together."""
    g = snapshots.groupBy("run_id", "var").agg(F.array_sort(F.collect_set("type")).alias("types"), F.min("step").alias("s"))
    return _finding(
        g.filter((F.size("types") == 2) & ~F.array_join("types", ",").isin(ACCEPTED)), "type_instability", "warning",
        F.concat_ws(":", "var", F.array_join("types", ",")), F.size("types"), F.col("s"))


def long_runs(steps: DataFrame, limit: int = 100) -> DataFrame:
    g = steps.groupBy("run_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    return _finding(g, "performance", "warning", F.lit("steps"), F.col("n"), F.lit(None))


def all_findings(steps, snapshots, diff, limit: int = 100, **kw) -> DataFrame:
    return (
        repeated_states(steps, snapshots).unionByName(recursion(steps, **kw)).unionByName(stale_mutations(steps, snapshots, diff))
        .unionByName(type_instability(snapshots)).unionByName(long_runs(steps, limit))
    )


def health(steps: DataFrame, findings: DataFrame) -> DataFrame:
    """Worst severity of each run and the number of findings by severity."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    g = findings.groupBy("run_id").agg(F.max(rank).alias("_r"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY[1:]])
    runs = steps.groupBy("run_id").agg(F.count("*").alias("total_steps"), F.max("depth").alias("max_depth"))
    out = runs.join(g, "run_id", "left").na.fill(0, SEVERITY[1:]).na.fill(1, ["_r"])
    return out.withColumn("severity", F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("_r").cast("int"))).drop("_r")


# ---- where a run failed


def failure_points(steps: DataFrame, tail: int = 5) -> DataFrame:
    """The last step when it returns, else the last mention of an exception near the end, else the end."""
    last = steps.groupBy("run_id").agg(F.max("step").alias("_last"))
    near = steps.join(last, "run_id").filter(F.col("step") > F.col("_last") - tail)
    code = F.col("code")
    failed = code.contains("Error") | code.contains("raise") | code.contains("except")
    at_end = F.col("step") == F.col("_last")
    rank = F.when(at_end & code.contains("return"), F.struct(F.lit(2).alias("r"), "step")).when(
        failed, F.struct(F.lit(1).alias("r"), "step")).when(at_end, F.struct(F.lit(0).alias("r"), "step"))
    g = near.groupBy("run_id").agg(F.max(rank).alias("k"), F.max_by(F.struct("line", "code"), rank).alias("at"))
    kind = F.when(F.col("k.r") == 2, "return").when(F.col("k.r") == 1, "exception").otherwise("end")
    return g.select("run_id", F.col("k.step").alias("step"), kind.alias("type"), "at.line", "at.code")


def failure_targets(points: DataFrame, snapshots: DataFrame, diff: DataFrame, tail: int = 5) -> DataFrame:
    """The variable to explain: the last visible one at a return, else the one touched most near the end."""
    shown = points.filter("type = 'return'").join(snapshots.select("run_id", "step", "var"), ["run_id", "step"]).groupBy(
        "run_id").agg(F.max("var").alias("seen"))
    last = snapshots.groupBy("run_id").agg(F.max("step").alias("_last"))
    touched = diff.filter("change IN ('new', 'changed')").join(last, "run_id").filter(F.col("step") > F.col("_last") - tail)
    often = touched.groupBy("run_id", "var").agg(F.count("*").alias("n"))
    w = Window.partitionBy("run_id").orderBy(F.col("n").desc(), "var")
    most = often.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("run_id", F.col("var").alias("busy"))
    return points.join(shown, "run_id", "left").join(most, "run_id", "left").withColumn(
        "var", F.coalesce("seen", "busy")).drop("seen", "busy").filter("var IS NOT NULL")


# Values that count as empty.
EMPTY = ["None", "", "[]", "{}", "0", "False"]


def causal_analysis(nodes: DataFrame, edges: DataFrame, targets: DataFrame, **kw) -> DataFrame:
    """The chain of versions behind each failure, its length and the first empty value on it."""
    chain = version_slice(nodes, edges, targets, **kw)
    w = F.struct("step", "version")
    first = chain.groupBy("run_id", "seed").agg(F.min(w).alias("lo"))
    later = chain.join(first, ["run_id", "seed"])
    empty = F.col("value").isin(EMPTY) & (w != F.col("lo"))
    return later.groupBy("run_id", "seed").agg(
        F.count("*").alias("causal_distance"),
        F.min_by("version", F.when(empty, w)).alias("divergence"), F.min(F.when(empty, F.col("step"))).alias("divergence_step"))
