"""Selecting, filtering, sorting and limiting steps and facts, per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions import code as C


def select_nodes(steps: DataFrame, step: int | None = None, var: str | None = None,
                 pattern: str | None = None) -> DataFrame:
    """Steps asked for by number, by variable or by code pattern.

    A variable no step of the run reads or writes is looked for in the code,
    without case. A run where nothing matches answers with its last step.
    """
    code = F.col("code")
    no = F.lit(False)
    first, second = no, no
    if step is not None and step >= 0:
        first = F.col("step") == step
    elif var:
        first = F.array_contains("reads", var) | F.array_contains("writes", var)
        second = F.lower(code).contains(var.lower())
    elif pattern:
        first = code.contains(pattern)
    tier = F.when(first, 0).when(second, 1)
    best = steps.groupBy("run_id").agg(F.min(tier).alias("_best"), F.max("step").alias("_last"))
    kept = F.when(F.col("_best").isNull(), F.col("step") == F.col("_last")).when(
        F.col("_best") == 0, first).otherwise(second)
    return steps.join(best, "run_id").filter(kept).drop("_best", "_last")


def compare(value: Column, op: str, target) -> Column:
    """``value op target``; numbers compare as numbers, ``contains`` ignores case."""
    if op == "contains":
        return F.lower(value.cast("string")).contains(str(target).lower())
    if isinstance(target, (int, float)) and not isinstance(target, bool):
        value, right = value.try_cast("double"), F.lit(float(target))
    else:
        value, right = value.cast("string"), F.lit(str(target))
    return {
        ">": value > right, "<": value < right, ">=": value >= right, "<=": value <= right,
        "==": value == right, "!=": value != right,
    }[op]


def fact_field(field: str) -> Column:
    """A field of a fact, or an entry of its metadata; ``evidence`` is the length of all its parts together."""
    if field == "evidence":
        return F.sum(F.size("evidence")).over(Window.partitionBy("run_id", "fact_id")).cast("string")
    if field in ("kind", "subject", "description", "confidence", "fact_id"):
        return F.col(field).cast("string")
    return F.col("metadata")[field]


def filter_facts(facts: DataFrame, field: str, op: str, value) -> DataFrame:
    return facts.withColumn("_field", fact_field(field)).filter(compare(F.col("_field"), op, value)).drop("_field")


def select_facts(facts: DataFrame, pattern: str = "all", limit: int = 20, where: tuple | None = None) -> DataFrame:
    """Facts whose kind, description or subject contains the pattern, the first ``limit`` of each run.

    Facts come in order of kind and anchor; the row number is limited before
    the shuffle.
    """
    p = pattern.lower()
    rows = facts
    if p != "all":
        rows = rows.filter(F.col("kind").contains(p) | F.lower("description").contains(p) | F.lower("subject").contains(p))
    if where:
        rows = filter_facts(rows, *where)
    return limit_per_run(rows.filter("part = 0"), limit, ["kind", "fact_id"])


def filter_slice(slice_: DataFrame, predicate: str, value: int | None = None) -> DataFrame:
    """Slice steps by ``is_root``, ``depth_gt`` or ``depth_lt``."""
    bound = value or 0
    return slice_.filter({
        "is_root": F.col("is_root"), "depth_gt": F.col("depth") > bound, "depth_lt": F.col("depth") < bound,
    }[predicate])


def sort_keys(df: DataFrame, field: str, desc: bool = False) -> tuple[Column, list[Column]]:
    """The value to order by, and the order over it (as ``_field``): numbers as numbers, ahead of other texts; missing counts as 0."""
    if field in df.columns and not (field == "evidence" and "fact_id" in df.columns):
        value = F.col(field)
    else:
        value = fact_field(field)
    text = isinstance(df.select(value.alias("v")).schema["v"].dataType, T.StringType)
    value = F.coalesce(value, F.lit("0") if text else F.lit(0).cast(df.select(value.alias("v")).schema["v"].dataType))
    keys = [F.col("_field").try_cast("double"), F.col("_field")] if text else [F.col("_field")]
    return value, [k.desc_nulls_last() if desc else k.asc_nulls_last() for k in keys]


def sort_rows(df: DataFrame, field: str, desc: bool = False) -> DataFrame:
    """Order by a column or fact field."""
    value, keys = sort_keys(df, field, desc)
    return df.withColumn("_field", value).orderBy(*keys).drop("_field")


def ranked_per_run(df: DataFrame, field: str, desc: bool = False, ties: str = "fact_id") -> DataFrame:
    """Place of each row of a run in the order of ``sort_rows``; ties by ``ties``."""
    value, keys = sort_keys(df, field, desc)
    return df.withColumn("_field", value).withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(*keys, ties))).drop("_field")


def limit_per_run(df: DataFrame, n: int, order: list, keys=("run_id",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """Only the asked columns that exist."""
    return df.select(*[f for f in fields if f in df.columns])


def reading(steps: DataFrame, var: str) -> DataFrame:
    return steps.filter(F.array_contains("reads", var))


def writing(steps: DataFrame, var: str) -> DataFrame:
    return steps.filter(F.array_contains("writes", var))


def code_contains(steps: DataFrame, text: str) -> DataFrame:
    return steps.filter(F.col("code").contains(text))


def code_matches(steps: DataFrame, regex: str) -> DataFrame:
    return steps.filter(F.col("code").rlike(regex))


def classify(steps: DataFrame) -> DataFrame:
    """Steps that branch, return before the end of the run, or head a loop."""
    last = steps.groupBy("run_id").agg(F.max("step").alias("_last"))
    code = F.col("code")
    role = (
        F.when(C.is_branch(code), "branch").when(C.is_loop_header(code), "loop_header")
        .when(C.is_return(code) & (F.col("step") < F.col("_last")), "early_return")
    )
    return steps.join(last, "run_id").withColumn("role", role).filter("role IS NOT NULL").drop("_last")


def config_influenced(cnodes: DataFrame, cedges: DataFrame, keys: DataFrame) -> DataFrame:
    """Nodes a configuration key (``key``) reaches by a direct influence edge."""
    ids = keys.select("graph_id", F.concat(F.lit("config:"), "key").alias("src"), "key")
    return influenced_by(cnodes, cedges, ids)


def influenced_by(cnodes: DataFrame, cedges: DataFrame, sources: DataFrame) -> DataFrame:
    hit = cedges.filter("edge_type = 'CONFIG_INFLUENCE'").join(sources, ["graph_id", "src"])
    return hit.select("graph_id", "src", F.col("dst").alias("node_id")).join(cnodes, ["graph_id", "node_id"])


def error_nodes(cnodes: DataFrame) -> DataFrame:
    return cnodes.filter("node_type = 'ERROR'")
