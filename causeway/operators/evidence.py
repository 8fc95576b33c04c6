"""Evidence behind a slice, an impact or a history, and its explanation.

Evidence is kept as rows, one per step it names, so that no slice has to be
gathered into one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import ordered

_KEY = ["run_id", "seed"]


def _rows(df: DataFrame, unit: str, subject: Column | None = None, detail: Column | None = None) -> DataFrame:
    return df.select(
        *_KEY, F.lit(unit).alias("unit"), (F.lit("") if subject is None else subject).alias("subject"), "step",
        (F.lit("") if detail is None else detail).alias("detail"))


def _touching(facts: DataFrame, slice_: DataFrame, kind: str) -> DataFrame:
    """Facts of a kind with evidence inside the slice."""
    at = facts.filter((F.col("kind") == kind)).select(
        "run_id", "fact_id", "subject", "description", F.explode("evidence").alias("step"))
    return at.join(slice_.select(*_KEY, "step"), ["run_id", "step"]).groupBy(*_KEY, "fact_id").agg(
        F.min("step").alias("step"), F.first("subject").alias("subject"), F.first("description").alias("description"))


def slice_evidence(slice_: DataFrame, followed: DataFrame, steps: DataFrame, facts: DataFrame) -> DataFrame:
    """Target, roots, flows of at least two edges per variable, conditions and loop facts."""
    target = slice_.filter("depth = 0")
    data = followed.filter("kind = 'data'")
    often = data.groupBy(*_KEY, "var").count().filter("count >= 2").select(*_KEY, "var")
    chain = data.join(often, [*_KEY, "var"], "left_semi").select(
        *_KEY, "var", F.explode(F.array("src", "dst")).alias("step")).distinct()
    versions = data.filter("var <> ''").select(*_KEY, "var", F.inline(F.array(
        F.struct(F.col("src").alias("step"), F.col("src_version").alias("version")),
        F.struct(F.col("dst").alias("step"), F.col("dst_version").alias("version"))))).distinct()
    conditions = followed.filter("kind = 'control'").select(*_KEY, F.col("src").alias("step")).distinct()
    out = (
        _rows(target, "target")
        .unionByName(_rows(slice_.filter("is_root"), "root_cause"))
        .unionByName(_rows(chain, "flow", F.col("var")))
        .unionByName(_rows(versions, "version", F.col("var"), F.col("version").cast("string")))
        .unionByName(_rows(conditions, "control"))
    )
    return _resolved(_with_loops(out, facts, slice_), steps)


def impact_evidence(impact: DataFrame, edges: DataFrame, steps: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Source, data edges and affected outputs of an impact, with the loop facts it touches where facts are given."""
    ends = impact.select(*_KEY, F.col("step").alias("dst"), "depth")
    inside = impact.select(*_KEY, F.col("step").alias("src"))
    data = edges.filter("kind = 'data'").join(ends, ["run_id", "dst"]).join(inside, [*_KEY, "src"], "left_semi")
    flow = data.select(*_KEY, F.explode(F.array("src", "dst")).alias("step")).distinct()
    out = (
        _rows(impact.filter("depth = 0"), "source").unionByName(_rows(flow, "flow"))
        .unionByName(_rows(impact.filter("is_leaf"), "output"))
    )
    return _resolved(out if facts is None else _with_loops(out, facts, impact), steps)


def _with_loops(out: DataFrame, facts: DataFrame, found: DataFrame) -> DataFrame:
    for kind, unit in (("loop.iteration", "loop"), ("loop.accumulation", "accumulation")):
        out = out.unionByName(_rows(_touching(facts, found, kind), unit, F.col("subject"), F.col("description")))
    return out


# ---- variables

BEHAVIORS = ["retyped", "steady", "rises", "falls", "changes"]


def _behavior() -> Column:
    """What a value does against the one before it; numbers are compared as numbers."""
    a, b = F.col("prev_value").try_cast("double"), F.col("value").try_cast("double")
    return (
        F.when(~F.col("prev_type").eqNullSafe(F.col("type")), "retyped").when(F.col("prev_value").eqNullSafe(F.col("value")), "steady")
        .when(a < b, "rises").when(a > b, "falls").when(a == b, "steady").otherwise("changes")
    )


def variable_spans(history: DataFrame, **kw) -> DataFrame:
    """Islands of equal behaviour in the history of each variable.

    ``history`` holds ``run_id, var, step, value, type``. A span begins at the
    step the behaviour turned (or at the first one) and ends at the next turn,
    which it shares with the span after it. Spans are numbered from 1 per run
    and variable; a variable seen once has none. Long runs are cut into chunks.
    """
    keys = ["run_id", "var"]
    rows = ordered.previous_row(
        history.select(*keys, "step", "value", "type"), keys, "step",
        {"prev_step": F.col("step"), "prev_value": F.col("value"), "prev_type": F.col("type")}, **kw)
    moves = rows.filter("prev_step IS NOT NULL").withColumn("behavior", _behavior())
    turned = ordered.previous_row(moves, keys, "step", {"before": F.col("behavior")}, **kw)
    turned = turned.withColumn("turn", (~F.col("before").eqNullSafe(F.col("behavior"))).cast("long"))
    counted = ordered.running(turned, keys, "step", {"span": ("sum", F.col("turn"), True)}, **kw)
    return counted.groupBy(*keys, "span", "behavior").agg(
        F.min("prev_step").alias("first_step"), F.max("step").alias("last_step"), F.count("*").alias("steps"),
        F.min_by("prev_value", "step").alias("first_value"), F.max_by("value", "step").alias("last_value"))


def variable_evidence(history: DataFrame, **kw) -> DataFrame:
    """Where each variable begins, its spans of equal behaviour, and where it ends, as rows in ``position`` order."""
    keys = ["run_id", "var"]
    spans = ordered.read_twice(variable_spans(history, **kw))
    ends = history.groupBy(*keys).agg(
        F.min("step").alias("lo"), F.max("step").alias("hi"), F.count("*").alias("seen"),
        F.min_by("value", "step").alias("first"), F.max_by("value", "step").alias("last"))
    n = spans.groupBy(*keys).agg(F.max("span").alias("n"))
    def end(unit, position, at, steps, value):
        return F.struct(F.lit(unit).alias("unit"), position.cast("long").alias("position"), at.alias("first_step"), at.alias("last_step"),
                        steps.cast("long").alias("steps"), value.alias("first_value"), value.alias("last_value"))

    ends = ends.join(n, keys, "left").select(*keys, F.inline(F.array(
        end("origin", F.lit(0), F.col("lo"), F.lit(1), F.col("first")),
        end("final", F.coalesce("n", F.lit(0)) + 1, F.col("hi"), F.col("seen"), F.col("last")))))
    return ends.withColumn("behavior", F.lit("")).unionByName(
        spans.withColumnRenamed("span", "position").withColumn("unit", F.lit("span")))


def explain_variable(evidence: DataFrame, examples: int = 5) -> DataFrame:
    """Origin, evolution and final value of each variable in words; only the spans named in the text are limited."""
    keys = ["run_id", "var"]
    spans = evidence.filter("unit = 'span'")
    told = F.format_string("%s from `%s` to `%s` over %d steps", "behavior", F.coalesce("first_value", F.lit("")), F.coalesce("last_value", F.lit("")), "steps")
    first = spans.filter(F.col("position") <= examples).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", told.alias("t")))).alias("_t"))
    evolution = spans.groupBy(*keys).agg(F.count("*").alias("items")).join(first, keys).select(
        *keys, F.lit(2).cast("long").alias("position"), F.lit("evolution").alias("role"), "items", F.array_join(F.transform("_t", lambda x: x["t"]), "; ").alias("text"))
    value = F.coalesce("last_value", F.lit(""))
    origin = evidence.filter("unit = 'origin'").select(
        *keys, F.lit(1).cast("long").alias("position"), F.lit("origin").alias("role"), F.lit(1).cast("long").alias("items"),
        F.format_string("`%s` is first seen at step #%d with value `%s`", "var", "first_step", value).alias("text"))
    final = evidence.filter("unit = 'final'").select(
        *keys, F.lit(3).cast("long").alias("position"), F.lit("final").alias("role"), F.col("steps").alias("items"),
        F.format_string("`%s` ends at step #%d with value `%s`, seen %d times", "var", "last_step", value, "steps").alias("text"))
    return origin.unionByName(evolution).unionByName(final)


def _resolved(rows: DataFrame, steps: DataFrame) -> DataFrame:
    return rows.join(steps.select("run_id", "step", "line", "code"), ["run_id", "step"], "left")


# Order of the units of an explanation.
ORDER = ["target", "source", "root_cause", "flow", "loop", "accumulation", "control", "output", "result"]


def explain(evidence: DataFrame, examples: int = 5) -> DataFrame:
    """One row per run and unit: what it says, with up to ``examples`` steps named.

    Counts cover all evidence; only the examples in the text are limited.
    """
    units = evidence.filter("unit <> 'version'")
    w = Window.partitionBy(*_KEY, "unit").orderBy("step", "subject", "detail")
    named = units.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= examples)
    say = F.when(F.col("detail") != "", F.col("detail")).when(
        F.col("subject") != "", F.format_string("`%s` at step #%d", "subject", "step")).otherwise(
        F.format_string("step #%d `%s`", "step", F.trim("code")))
    texts = named.groupBy(*_KEY, "unit").agg(
        F.array_sort(F.collect_list(F.struct("_r", say.alias("t")))).alias("_t"))
    totals = units.groupBy(*_KEY, "unit").agg(F.count("*").alias("items"), F.countDistinct("subject").alias("subjects"))
    intro = (
        F.when(F.col("unit") == "target", "Explaining ").when(F.col("unit") == "source", "Starting from ")
        .when(F.col("unit") == "root_cause", "Originates at ").when(F.col("unit") == "flow", "Data flows through ")
        .when(F.col("unit") == "control", "Depends on ").when(F.col("unit") == "output", "Ends in ").otherwise("")
    )
    position = F.array_position(F.array(*[F.lit(o) for o in ORDER]), F.col("unit"))
    return totals.join(texts, [*_KEY, "unit"]).select(
        *_KEY, position.alias("position"), F.col("unit").alias("role"), "items",
        F.concat(intro, F.array_join(F.transform("_t", lambda x: x["t"]), "; ")).alias("text"))
