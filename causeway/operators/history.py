"""Variable history, comparison of steps, and questions about points in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import code as C
from causeway.functions import ordered
from causeway.operators.traverse import reach
from causeway.session import checkpointed


def variable_history(snapshots: DataFrame, var: str) -> DataFrame:
    return snapshots.filter(F.col("var") == var)


def version_chain(edges: DataFrame, var: str) -> DataFrame:
    return edges.filter((F.col("kind") == "data") & (F.col("var") == var))


def last_step_with(snapshots: DataFrame) -> DataFrame:
    """Last step of each run that holds each variable, with the value there."""
    return snapshots.groupBy("run_id", "var").agg(
        F.max("step").alias("step"), F.max_by("value", "step").alias("value"))


def mutated_variables(diff: DataFrame) -> DataFrame:
    """Variables seen at least twice that changed at least once."""
    return diff.filter("now IS NOT NULL").groupBy("run_id", "var").agg(
        F.count("*").alias("seen"), F.count_if(F.col("change") == "changed").alias("changes")
    ).filter("seen >= 2 AND changes > 0")


def variables_in(snapshots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Snapshots of the variables visible in a set of steps, one row per step."""
    return snapshots.join(nodes.select("run_id", "step"), ["run_id", "step"], "left_semi")


def compare_steps(versions: DataFrame, pairs: DataFrame, var: str | None = None) -> DataFrame:
    """Variables that differ between two steps of a run.

    ``versions`` are snapshots with version numbers; ``pairs`` has ``run_id,
    step_a, step_b``. A variable is changed, removed or added.
    """
    if var:
        versions = versions.filter(F.col("var") == var)
    side = versions.select("run_id", "step", "var", F.struct("value", "version").alias("s"))
    key = ["run_id", "step_a", "step_b", "var"]
    pairs = pairs.select("run_id", "step_a", "step_b").distinct()
    a = pairs.withColumn("step", F.col("step_a")).join(side, ["run_id", "step"]).select(*key, F.col("s").alias("a"))
    b = pairs.withColumn("step", F.col("step_b")).join(side, ["run_id", "step"]).select(*key, F.col("s").alias("b"))
    return a.join(b, key, "full").withColumn(
        "type", F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("changed")
    ).filter("type <> 'changed' OR NOT (a.value <=> b.value AND a.version <=> b.version)").select(
        *key, "type", F.col("a.value").alias("a_value"), F.col("b.value").alias("b_value"),
        F.col("a.version").alias("a_version"), F.col("b.version").alias("b_version"))


def _bound(when: str, step: Column, lo: Column, hi: Column | None) -> Column:
    return {"at": step == lo, "before": step < lo, "after": step > lo,
            "between": (step >= lo) & (step <= hi) if hi is not None else F.lit(False)}[when]


def temporal_steps(rows: DataFrame, when: str, moments: DataFrame, unknown: bool = True) -> DataFrame:
    """Steps or history rows ``at``, ``before``, ``after`` or ``between`` moments.

    ``moments`` has ``run_id, lo[, hi]``; a run whose moment is unknown keeps
    all of its rows, but for runs that ``moments`` does not name where
    ``unknown`` is false: these have none.
    """
    hi = F.col("hi") if "hi" in moments.columns else None
    joined = rows.join(moments, "run_id", "left" if unknown else "inner")
    return joined.filter(F.col("lo").isNull() | _bound(when, F.col("step"), F.col("lo"), hi)).select(*rows.columns)


def temporal_facts(facts: DataFrame, when: str, moments: DataFrame) -> DataFrame:
    """Facts by their evidence: all of it before, or any of it at, after or between."""
    hi = F.col("hi") if "hi" in moments.columns else None
    lo = F.col("lo")
    joined = facts.join(moments, "run_id", "left")
    holds = (F.forall if when == "before" else F.exists)("evidence", lambda e: _bound(when, e, lo, hi))
    verdict = joined.withColumn("_ok", F.col("lo").isNull() | holds)
    # a fact spread over several rows is judged as a whole
    per_fact = verdict.groupBy("run_id", "fact_id").agg((F.bool_and if when == "before" else F.bool_or)("_ok").alias("_ok"))
    return facts.join(per_fact.filter("_ok").select("run_id", "fact_id"), ["run_id", "fact_id"], "left_semi")


def resolve_marker(steps: DataFrame, marker: str) -> DataFrame:
    """The step a text marker points at in each run, as moments ``(run_id, lo)``.

    The first step whose code contains it; otherwise ``return``/``end`` means
    the last return and ``exception``/``error`` the first of either.
    """
    m, code = marker.lower(), F.lower("code")
    found = F.min(F.when(code.contains(m), F.col("step")))
    if m in ("return", "end"):
        found = F.coalesce(found, F.max(F.when(code.contains("return"), F.col("step"))))
    if m in ("exception", "error"):
        found = F.coalesce(found, F.min(F.when(code.contains("exception") | code.contains("error"), F.col("step"))))
    return steps.groupBy("run_id").agg(found.alias("lo"))


def snapshot_at(versions: DataFrame, steps: DataFrame, moments: DataFrame) -> DataFrame:
    """All variables of the run at its moment, with value, type, version and the code there."""
    at = moments.select("run_id", F.col("lo").alias("step"))
    return versions.join(at, ["run_id", "step"], "left_semi").join(
        steps.select("run_id", "step", "code"), ["run_id", "step"])


def state_as_of(snapshots: DataFrame, moments: DataFrame) -> DataFrame:
    """Latest known value of every variable at or before a moment (sparse snapshots)."""
    held = snapshots.join(moments, "run_id").filter("step <= lo")
    return held.groupBy("run_id", "var").agg(F.max("step").alias("step"), F.max_by("value", "step").alias("value"))


def window(rows: DataFrame, start: int = 0, end: int = -1) -> DataFrame:
    """Rows of a range of steps; edges need both ends inside, facts any evidence."""
    def inside(c: Column) -> Column:
        return (c >= start) if end < 0 else (c >= start) & (c <= end)

    if "src" in rows.columns:
        return rows.filter(inside(F.col("src")) & inside(F.col("dst")))
    if "evidence" in rows.columns:
        hit = rows.filter(F.exists("evidence", inside)).select("run_id", "fact_id").distinct()
        return rows.join(hit, ["run_id", "fact_id"], "left_semi")
    return rows.filter(inside(F.col("step")))


def context_window(steps: DataFrame, centers: DataFrame, before: int, after: int) -> DataFrame:
    """Rows around each center step.

    Every center asks for its neighbours by number, so the range becomes an
    equi-join on ``(run, step)``.
    """
    offsets = F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")
    asked = centers.select("run_id", F.col("step").alias("center"), offsets).withColumn(
        "step", F.col("center") + F.col("offset"))
    return asked.join(steps, ["run_id", "step"])


# ---- lineage of a result


def return_variables(steps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Variables named by the last return of each run."""
    code = F.trim("code")
    last = steps.filter(code.startswith("return")).groupBy("run_id").agg(
        F.max("step").alias("step"), F.max_by(code, "step").alias("code"))
    expr = F.regexp_extract("code", r"^return\s+(\S+)", 1)
    named = last.select("run_id", "step", F.explode(C.words(expr)).alias("var"))
    return named.join(snapshots.select("run_id", "step", "var"), ["run_id", "step", "var"], "left_semi").select("run_id", "var")


def value_events(snapshots: DataFrame, steps: DataFrame, **kw) -> DataFrame:
    """Steps at which a variable appears or takes another value."""
    prev = ordered.previous_row(
        snapshots.select("run_id", "step", "var", "value", "type"), ["run_id", "var"], "step",
        {"prev_value": F.col("value")}, **kw)
    event = F.when(F.col("prev_value").isNull(), "created").when(F.col("value") != F.col("prev_value"), "changed")
    return prev.withColumn("event", event).filter("event IS NOT NULL").join(
        steps.select("run_id", "step", "line", "code"), ["run_id", "step"])


def lineage(steps: DataFrame, snapshots: DataFrame, **kw) -> DataFrame:
    """Events of every variable the result depends on.

    Starts at the variables of the last return and follows the variables named
    (as whole words) in the lines that create or change them.
    """
    events = ordered.read_twice(value_events(snapshots, steps, **kw))
    links = events.select("run_id", "var", F.explode(C.words(F.col("code"))).alias("other")).filter("var <> other").distinct()
    known = snapshots.select("run_id", F.col("var").alias("other")).distinct()
    links = links.join(known, ["run_id", "other"], "left_semi")
    start = return_variables(steps, snapshots)
    found = reach(
        links.select("run_id", F.col("var").alias("from_node"), F.col("other").alias("to_node")),
        start.select("run_id", F.lit("result").alias("seed"), F.col("var").alias("node")))
    return events.join(checkpointed(found.select("run_id", F.col("node").alias("var"))), ["run_id", "var"], "left_semi")


def critical_steps(steps: DataFrame, diff: DataFrame, lineage_: DataFrame) -> DataFrame:
    """Steps where a variable of the lineage changed, or that are part of it."""
    vars_ = lineage_.select("run_id", "var").distinct()
    changed = diff.filter("change = 'changed'").join(vars_, ["run_id", "var"], "left_semi").select("run_id", "step")
    hit = changed.unionByName(lineage_.select("run_id", "step")).distinct()
    return steps.join(hit, ["run_id", "step"], "left_semi")
