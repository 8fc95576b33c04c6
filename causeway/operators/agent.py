"""Observations of a run, the state they add up to, and hypotheses about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import ordered
from causeway.functions.values import number


def branch_taken(code: Column) -> Column:
    c = F.trim(code)
    return (
        F.when(c.rlike(r"^if[ (]"), "if_true").when(c.rlike(r"^elif[ (]"), "elif").when(c.startswith("else"), "else")
        .when(c.rlike(r"^(for |while )"), "loop_enter")
    )


def observations(steps: DataFrame, diff: DataFrame) -> DataFrame:
    """One or two rows per step: a change, a branch, or else a plain one."""
    key = ["run_id", "step"]
    c = F.col("change")

    def named(cond):
        return F.array_sort(F.collect_list(F.when(cond, F.col("var"))))

    g = diff.filter("change <> 'same'").groupBy(*key).agg(
        named(c == "changed").alias("changed"), named(c == "new").alias("new_vars"), named(c == "removed").alias("removed"),
        F.min(F.when(F.col("how") == "mutated", F.col("var"))).alias("mutation"))
    rows = steps.select(*key, "line", "code", "func", "depth", "block_id").join(g, key, "left")
    branch = branch_taken(F.col("code"))
    has_change = F.col("changed").isNotNull()

    def kind(name: str, cond: Column, taken: Column) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("kind"), taken.alias("branch_taken")))

    none = F.lit(None).cast("string")
    kinds = F.array_compact(F.array(
        kind("change", has_change, none), kind("branch", branch.isNotNull(), branch),
        kind("step", ~has_change & branch.isNull(), none)))
    out = rows.withColumn("_k", F.explode(kinds)).select(
        *rows.columns, F.col("_k.kind").alias("kind"), F.col("_k.branch_taken").alias("branch_taken"))
    only = F.col("kind") == "change"
    for name in ("changed", "new_vars", "removed", "mutation"):
        out = out.withColumn(name, F.when(only, F.col(name)))
    return out


def between(obs: DataFrame, start: int, end: int) -> DataFrame:
    return obs.filter(F.col("step").between(start, end))


def touching(obs: DataFrame, var: str) -> DataFrame:
    return obs.filter(F.array_contains("changed", var) | F.array_contains("new_vars", var))


def touched_variables(obs: DataFrame) -> DataFrame:
    return obs.filter("kind = 'change'").select("run_id", F.explode(F.concat("changed", "new_vars")).alias("var")).distinct()


def variable_state(diff: DataFrame) -> DataFrame:
    """What is known of each variable: values seen, first and last step, last value, mutations.

    A new variable counts with an unknown value; of several variables mutated
    in one step the first by name is counted.
    """
    first = diff.filter("how = 'mutated'").groupBy("run_id", "step").agg(F.min("var").alias("var"), F.lit(1).alias("m"))
    seen = diff.filter("change IN ('new', 'changed')").join(first, ["run_id", "step", "var"], "left")
    value = F.when(F.col("change") == "changed", F.col("now.value")).otherwise("?")
    return seen.groupBy("run_id", "var").agg(
        F.count("*").alias("values"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.max_by(value, "step").alias("last_value"), F.count("m").alias("mutations"))


def merge_states(states: DataFrame) -> DataFrame:
    """Partial states of the same runs as one."""
    return states.groupBy("run_id", "var").agg(
        F.sum("values").alias("values"), F.min("first_step").alias("first_step"), F.max("last_step").alias("last_step"),
        F.max_by("last_value", "last_step").alias("last_value"), F.sum("mutations").alias("mutations"))


def confidence(support: Column, contradict: Column, prior: Column | float = 0.5) -> Column:
    """Balance of evidence, never above 0.95; the prior without evidence."""
    total = support + contradict
    prior = F.lit(prior) if not isinstance(prior, Column) else prior
    return F.least(F.when(total > 0, support / total).otherwise(prior), F.lit(0.95))


def hypotheses(diff: DataFrame, steps: DataFrame, **kw) -> DataFrame:
    """Variables that only grow or are mutated often, and control flow with many branches."""
    changed = diff.filter("change = 'changed'").select("run_id", "var", "step", number(F.col("now.value")).alias("n"))
    seen = ordered.running(changed.filter("n IS NOT NULL"), ["run_id", "var"], "step", {"_b": ("last", F.col("n"))}, **kw)
    growing = seen.groupBy("run_id", "var").agg(
        F.count("*").alias("support"), F.bool_and(F.col("n") >= F.col("_b")).alias("up")).filter("support >= 3 AND up")
    heavy = variable_state(diff).filter("mutations > 2")
    b = steps.withColumn("b", branch_taken(F.col("code"))).filter("b IS NOT NULL").groupBy("run_id").agg(
        F.count("*").alias("support"), F.count_if(F.col("b") == "loop_enter").alias("loops")).filter("support > 3 AND loops > 0")

    def rows(df, pattern, subject, support, score):
        return df.select("run_id", F.lit(pattern).alias("pattern"), subject.alias("subject"), support.alias("support"), F.lit(score).alias("confidence"))

    return (
        rows(growing, "monotonic_increase", F.col("var"), F.col("support"), 0.7)
        .unionByName(rows(heavy, "heavy_mutation", F.col("var"), F.col("mutations"), 0.6))
        .unionByName(rows(b, "complex_control_flow", F.lit(""), F.col("support"), 0.8))
    )


def cross_run_knowledge(states: DataFrame, more_than: int = 3) -> DataFrame:
    """Variables mutated heavily, over all runs."""
    return states.filter(F.col("mutations") > more_than).groupBy("var").agg(
        F.count("*").alias("runs"), F.sum("mutations").alias("mutations"), F.max("mutations").alias("most"))


def agent_quality(hypotheses_: DataFrame, actions: DataFrame) -> DataFrame:
    """Hypotheses and evidence density, and successes and failures of actions, per run."""
    h = hypotheses_.groupBy("run_id").agg(F.count("*").alias("hypotheses"), F.avg("support").alias("evidence_density"))
    a = actions.groupBy("run_id").agg(
        F.count("*").alias("actions"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))
    return h.join(a, "run_id", "full").na.fill(0, ["hypotheses", "actions", "succeeded", "failed"])
