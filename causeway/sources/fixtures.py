"""The given business tables read as trace tables.

``events`` of one user are one run; an event is one executed step whose code
line, accesses and values follow from ``event_type``, ``value`` and the number
in ``props``. Orders of a customer give a second trace with dense snapshots.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import ordered
from causeway.operators import graph
from causeway.operators.facts import fact_parts
from causeway.operators.identity import identity_parts
from causeway.operators.prepare import step_diff
from causeway.session import ensure_checkpoint_dir

VARS = ["view", "click", "signup", "error", "purchase"]


_STORED: set[str] = set()
_FIT: dict[tuple, int | None] = {}


@dataclass(frozen=True)
class Trace:
    steps: DataFrame
    snapshots: DataFrame
    calls: DataFrame
    blocks: DataFrame


def stored_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return "/".join([spark.sparkContext.getCheckpointDir(), "tables", f"{sf_dir.strip('/').replace('/', '-')}-{name}"])


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame | list[DataFrame]]) -> DataFrame:
    """A derived table, written once per application to the shared checkpoint folder.

    Trace tables are inputs to every operator, so they are kept as Parquet with
    its pruning and pushdown, not derived again inside each query. A table built
    in parts is written part by part, so that the driver plans one at a time.
    """
    path = stored_path(spark, sf_dir, name)
    if path not in _STORED:
        built = build()
        for n, part in enumerate(built if isinstance(built, list) else [built]):
            part.write.mode("append" if n else "overwrite").parquet(path)
        _STORED.add(path)
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _var(position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in VARS]), position.cast("int") + 1)


def _accesses(t: Column, w: Column, r: Column, r2: Column, r3: Column) -> tuple[Column, Column]:
    none = F.array().cast("array<string>")
    reads = (
        F.when(t.isin(3, 5, 9), F.array(w, r))
        .when(t == 4, F.array(w, r, r2))
        .when(t == 7, F.array(r, r2))
        .when(t == 8, F.array(r, r2, r3))
        .otherwise(F.array(r))
    )
    writes = F.when(t.isin(1, 2, 7), none).when(t == 9, F.array(w, r)).otherwise(F.array(w))
    return F.array_distinct(reads), F.array_distinct(writes)


def _code(t: Column, w: Column, r: Column, r2: Column, r3: Column) -> Column:
    forms = {
        0: F.format_string("for %s in range(%s):", w, r),
        1: F.format_string("if %s > 3:", r),
        2: F.format_string("return %s", r),
        3: F.format_string("%s += %s", w, r),
        4: F.format_string("%s[%s] = %s", w, r, r2),
        5: F.format_string("%s.append(%s)", w, r),
        6: F.format_string("%s = %s.pop()", w, r),
        7: F.format_string("while %s < %s:", r, r2),
        8: F.format_string("%s = max(%s, %s, %s)", w, r, r2, r3),
    }
    out = None
    for n, text in forms.items():
        out = F.when(t == n, text) if out is None else out.when(t == n, text)
    return out.otherwise(F.format_string("%s, %s = %s, %s", w, r, r, w))


def indexed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered per user in time order."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        "ts", "event_id",
        F.col("event_type").alias("w"),
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )
    return ordered.dense_index(
        events, ["run_id"], "ts", "step", order=["event_id"],
        bucket=F.unix_date(F.to_date("ts")).cast("long"),
    )


def trace_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "steps", lambda: derive_steps(spark, sf_dir))


def derive_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, step, w = F.col("k"), F.col("step"), F.col("w")
    t = F.floor(k / 10).cast("int")
    r, r2, r3 = _var(k % 5), _var((k % 7) % 5), _var(k % 3)
    reads, writes = _accesses(t, w, r, r2, r3)
    decade = F.floor(step / 10).cast("long")
    user = F.col("run_id").cast("long")
    base = indexed_events(spark, sf_dir).select(
        "run_id", "step", "ts",
        F.lit("trace.py").alias("file"),
        k.alias("line"),
        _code(t, w, r, r2, r3).alias("code"),
        F.concat(F.lit("fn"), (k % 4).cast("string")).alias("func"),
        F.when(user % 10 == 0, step).when(user % 10 == 1, step % 10).otherwise(k % 7).cast("int").alias("depth"),
        F.when(decade % 2 == 0, F.lit(0).cast("long")).otherwise(decade).alias("call_id"),
        ((k % 3) * 4).alias("indent"),
        reads.alias("reads"),
        writes.alias("writes"),
        "k", "value",
        t.isin(0, 1, 7).alias("_ctl"),
    )
    return ordered.running(
        base, ["run_id"], "step", {"block_id": ("sum", F.col("_ctl").cast("long"))}
    )


def _steps_view(full: DataFrame) -> DataFrame:
    return full.drop("k", "value", "_ctl")


def _value(k: Column, value: Column) -> Column:
    return (
        F.when(k % 11 == 0, F.lit("None"))
        .when(k % 13 == 0, F.format_string("[%d, 1]", k))
        .when(F.floor(k / 10) == 4, F.format_string("{1: %d}", k))
        .when(k % 5 == 2, k.cast("string"))
        .otherwise(value.cast("string"))
    )


def _type(k: Column) -> Column:
    return (
        F.when(k % 11 == 0, F.lit("NoneType"))
        .when(k % 13 == 0, F.lit("list"))
        .when(F.floor(k / 10) == 4, F.lit("dict"))
        .when(k % 5 == 2, F.lit("int"))
        .otherwise(F.lit("float"))
    )


def _keys(k: Column) -> Column:
    names = F.array_distinct(F.array(*[(k % m).cast("string") for m in (3, 5, 4)]))
    return F.when((k % 11 != 0) & ((k % 13 == 0) | (F.floor(k / 10) == 4)), names)


def fit(spark: SparkSession, sf_dir: str) -> dict:
    """Keyword for ordered operators over the event trace: the checked chunk."""
    if (sf_dir, "fit") not in _FIT:
        _FIT[sf_dir, "fit"] = ordered.fitting_chunk(trace_steps(spark, sf_dir))
    return {"chunk": _FIT[sf_dir, "fit"]}


#: Steps of the trace for each part that ``parts`` counts.
PART = 1 << 17


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts of the event trace that each hold about ``PART`` steps."""
    if (sf_dir, "parts") not in _FIT:
        _FIT[sf_dir, "parts"] = trace_steps(spark, sf_dir).count() // PART + 1
    return _FIT[sf_dir, "parts"]


def derive_snapshots(full: DataFrame, **kw) -> DataFrame:
    """Every variable visible at a step with the value it was last given."""
    k = F.col("k")
    written = F.struct(
        _value(k, F.col("value")).alias("value"),
        _type(k).alias("type"),
        (k % 8).cast("long").alias("memory_id"),
        _keys(k).alias("container_keys"),
    )
    # one pass over the steps holds all variables; they become rows behind it
    last = {f"_s{i}": ("last", F.when(F.array_contains("writes", v), written), True) for i, v in enumerate(VARS)}
    held = ordered.running(full.select("run_id", "step", "writes", "k", "value"), ["run_id"], "step", last, **kw)
    seen = [F.when(F.col(n).isNotNull(), F.struct(F.lit(v).alias("var"), f"{n}.*")) for n, v in zip(last, VARS)]
    return held.select("run_id", "step", F.inline(F.array_compact(F.array(*seen))))


def trace_calls(full: DataFrame) -> DataFrame:
    """One row per call: the odd decades of a run, called from the step before."""
    k = F.col("k")
    first = F.min_by(F.struct("line", (k % 8).cast("long").alias("m")), F.col("step"))
    last = F.max_by(F.struct("line", (k % 8).cast("long").alias("m")), F.col("step"))
    calls = full.filter("call_id > 0").groupBy("run_id", "call_id").agg(
        F.min_by("func", "step").alias("func"),
        F.min("step").alias("callee_first_step"),
        F.max("step").alias("return_step"),
        F.min_by("depth", "step").alias("depth"),
        first.alias("_f"), last.alias("_l"),
    )

    def obj(memory: str) -> Column:
        return F.struct(F.lit("?").alias("value"), F.lit("object").alias("type"), F.col(memory).alias("memory_id"))

    return calls.select(
        "run_id", "call_id", F.lit(0).cast("long").alias("parent_call_id"), "func",
        (F.col("callee_first_step") - 1).alias("caller_step"),
        "callee_first_step", "return_step", "depth",
        F.col("_f.line").alias("start_line"), F.col("_l.line").alias("end_line"),
        F.create_map(F.lit("arg"), obj("_f.m")).alias("args"),
        obj("_l.m").alias("return_value"),
    )


def trace_blocks(full: DataFrame) -> DataFrame:
    return full.filter("_ctl").select(
        "run_id", (F.col("block_id") + 1).alias("block_id"), F.col("block_id").alias("parent_block_id"),
        "indent", F.col("step").alias("condition_step"),
    )


def trace(spark: SparkSession, sf_dir: str) -> Trace:
    full = trace_steps(spark, sf_dir)
    return Trace(_steps_view(full), snapshots(spark, sf_dir), trace_calls(full), trace_blocks(full))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps_view(trace_steps(spark, sf_dir))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    kw = fit(spark, sf_dir)
    return stored(spark, sf_dir, "snapshots", lambda: derive_snapshots(trace_steps(spark, sf_dir), **kw))


def orders_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a run with three variables at every step."""
    return stored(spark, sf_dir, "orders", lambda: derive_orders(spark, sf_dir))


def derive_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("run_id"), "o_orderkey", "o_orderdate",
        "o_totalprice", "o_orderstatus", "o_orderpriority",
    )
    indexed = ordered.dense_index(
        orders, ["run_id"], "o_orderdate", "step", order=["o_orderkey"],
        bucket=F.year("o_orderdate").cast("long"),
    )
    held = F.array(
        F.struct(F.lit("o_totalprice").alias("var"), F.col("o_totalprice").cast("string").alias("value"),
                 F.lit("float").alias("type")),
        F.struct(F.lit("o_orderstatus").alias("var"), F.col("o_orderstatus").alias("value"),
                 F.lit("str").alias("type")),
        F.struct(F.lit("o_orderpriority").alias("var"), F.col("o_orderpriority").alias("value"),
                 F.lit("str").alias("type")),
    )
    return indexed.select("run_id", "step", F.inline(held))


def key_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The key hierarchy as a causal graph: nodes ``table:key``, parent to child."""

    def t(name):
        return table(spark, sf_dir, name)

    def node(kind: str, key: str) -> Column:
        return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))

    def nodes(df, kind, key, label, node_type):
        return df.select(
            node(kind, key).alias("node_id"), F.lit(kind).alias("file_path"),
            F.col(key).cast("int").alias("line_number"), F.col(label).cast("string").alias("code_content"),
            F.lit(node_type).alias("node_type"), F.lit("").alias("semantic_label"),
        )

    orders, lineitem = t("orders"), t("lineitem")
    cnodes = (
        nodes(t("region"), "region", "r_regionkey", "r_name", "CONFIG")
        .unionByName(nodes(t("nation"), "nation", "n_nationkey", "n_name", "CONFIG"))
        .unionByName(nodes(t("customer"), "customer", "c_custkey", "c_name", "CODE"))
        .unionByName(nodes(t("supplier"), "supplier", "s_suppkey", "s_name", "CODE"))
        .unionByName(nodes(orders, "order", "o_orderkey", "o_orderstatus", "RUNTIME"))
    )

    def edges(df, kind, key, child, child_key, edge_type):
        return df.select(node(kind, key).alias("src"), node(child, child_key).alias("dst"),
                         F.lit(edge_type).alias("edge_type"))

    item = lineitem.select(
        node("order", "l_orderkey").alias("src"),
        F.concat_ws(":", F.lit("item"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("dst"),
        F.lit("RUNTIME_TRACE").alias("edge_type"),
    ).distinct()
    cedges = (
        edges(t("nation"), "region", "n_regionkey", "nation", "n_nationkey", "CONFIG_INFLUENCE")
        .unionByName(edges(t("customer"), "nation", "c_nationkey", "customer", "c_custkey", "DATA_DEPENDENCY"))
        .unionByName(edges(t("supplier"), "nation", "s_nationkey", "supplier", "s_suppkey", "DATA_DEPENDENCY"))
        .unionByName(orders.select(
            node("customer", "o_custkey").alias("src"), node("order", "o_orderkey").alias("dst"),
            F.when(F.col("o_orderstatus") == "F", "THROWS").otherwise("CALL_RELATION").alias("edge_type")))
        .unionByName(item)
    )
    return (cnodes.withColumn("graph_id", F.lit("keys")), cedges.withColumn("graph_id", F.lit("keys")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependence graph of the event trace, as a stored table."""
    t, kw = trace(spark, sf_dir), fit(spark, sf_dir)
    return stored(spark, sf_dir, "edges", lambda: graph.dependence_parts(t.steps, t.snapshots, t.calls, t.blocks, **kw))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the event trace, as a stored table."""
    t, kw = trace(spark, sf_dir), fit(spark, sf_dir)
    return stored(spark, sf_dir, "facts", lambda: fact_parts(
        t.steps, t.snapshots, edges(spark, sf_dir), diff(spark, sf_dir), **kw))


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-to-step changes of the event trace, as a stored table."""
    t = trace(spark, sf_dir)
    return stored(spark, sf_dir, "diff", lambda: step_diff(t.snapshots, t.steps))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archetypes of the event trace, as a stored table."""
    t, kw = trace(spark, sf_dir), fit(spark, sf_dir)
    return stored(spark, sf_dir, "identities", lambda: identity_parts(t.steps, t.snapshots, facts(spark, sf_dir), **kw))
