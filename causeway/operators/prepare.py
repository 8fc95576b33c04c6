"""Columns and tables derived per step from a recorded trace."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import code as C
from causeway.functions import ordered
from causeway.functions.ordered import read_twice

_SNAP = ["value", "type", "memory_id", "container_keys"]


def step_diff(snapshots: DataFrame, steps: DataFrame) -> DataFrame:
    """Each variable's change against the previous step of the run.

    ``change`` is ``new``, ``changed`` (value or object differs), ``same`` or
    ``removed``; ``how`` splits changes into ``mutated`` (same object) and
    ``rebound``. Rows are shuffled once, with those next to a chunk's edge in
    both chunks, and each is compared with the row before it.
    """
    have = [c for c in _SNAP if c in snapshots.columns]
    if "memory_id" not in have:
        snapshots = snapshots.withColumn("memory_id", F.lit(None).cast("long"))
        have.append("memory_id")
    rows = ordered.with_halo(snapshots.select("run_id", "step", "var", F.struct(*have).alias("now")), "step", before=1, after=1)
    w = Window.partitionBy("run_id", "var", "_chunk").orderBy("step")
    seen = rows.select("*", F.lag(F.struct("step", "now")).over(w).alias("_before"), F.lead("step").over(w).alias("_next")).filter("NOT _halo")
    held = seen.select("run_id", "step", "var", "now", F.when(F.col("_before.step") == F.col("step") - 1, F.col("_before.now")).alias("old"))
    # a variable is removed only where the run has a next step
    ends = seen.filter("_next IS NULL OR _next > step + 1").select(
        "run_id", (F.col("step") + 1).alias("step"), "var", F.when(F.lit(False), F.col("now")).alias("now"), F.col("now").alias("old"))
    gone = ends.join(steps.select("run_id", "step"), ["run_id", "step"], "left_semi")
    rows = held.unionByName(gone)
    differs = ~F.col("now.value").eqNullSafe(F.col("old.value")) | ~F.col("now.memory_id").eqNullSafe(
        F.col("old.memory_id"))
    same_object = F.col("now.memory_id").eqNullSafe(F.col("old.memory_id"))
    change = (
        F.when(F.col("now").isNull(), "removed").when(F.col("old").isNull(), "new")
        .when(differs, "changed").otherwise("same")
    )
    return rows.withColumn("change", change).withColumn(
        "how", F.when(F.col("change") == "changed", F.when(same_object, "mutated").otherwise("rebound"))
    )


def alias_groups(snapshots: DataFrame) -> DataFrame:
    """Variables of a step that hold the same object."""
    return (
        snapshots.groupBy("run_id", "step", "memory_id")
        .agg(F.array_sort(F.collect_list("var")).alias("vars"))
        .filter(F.size("vars") > 1)
    )


def alias_references(snapshots: DataFrame) -> DataFrame:
    """The first other name of each variable that shares its object."""
    return alias_groups(snapshots).select(
        "run_id", "step", F.explode("vars").alias("var"), "vars"
    ).select(
        "run_id", "step", "var",
        F.when(F.element_at("vars", 1) == F.col("var"), F.element_at("vars", 2))
        .otherwise(F.element_at("vars", 1)).alias("is_reference_to"),
    )


def container_deltas(diff: DataFrame) -> DataFrame:
    """Keys that appeared in or left a container changed in place."""
    new, old = F.col("now.container_keys"), F.col("old.container_keys")
    return (
        diff.filter("how = 'mutated'")
        .filter((F.size(new) > 0) & (F.size(old) > 0) & F.col("now.type").isin("list", "dict", "set"))
        .select("run_id", "step", "var", F.col("now.type").alias("type"),
                F.array_except(new, old).alias("added"), F.array_except(old, new).alias("removed"))
        .filter((F.size("added") > 0) | (F.size("removed") > 0))
    )


def drop_repeats(steps: DataFrame, **kw) -> DataFrame:
    """Without definition lines and immediate repeats of a step; re-indexed."""
    kept = steps.filter(~F.col("code").rlike(r"^(async )?def "))
    seen = ordered.previous_row(
        kept, ["run_id"], "step",
        {"_line": F.col("line"), "_depth": F.col("depth"), "_func": F.col("func")}, **kw)
    repeat = F.col("_line").eqNullSafe(F.col("line")) & F.col("_depth").eqNullSafe(F.col("depth")) & F.col(
        "_func").eqNullSafe(F.col("func"))
    return ordered.dense_index(
        seen.filter(~repeat).drop("_line", "_depth", "_func"), ["run_id"], "step", "index", **kw)


# Names that are never counted as variables.
BUILTINS = {
    "range", "len", "int", "str", "float", "list", "dict", "set", "tuple", "bool", "type", "isinstance", "enumerate", "zip", "map", "filter",
    "sorted", "sum", "min", "max", "abs", "print", "repr", "round", "any", "all", "next", "iter", "open", "input", "super", "True", "False",
    "None", "self", "cls",
}


def _names(nodes: list[ast.AST], kind: type[ast.expr_context]) -> list[str]:
    """Variables below the nodes that are read (or written), in the order of the text."""
    found = [n for top in nodes for n in ast.walk(top) if isinstance(n, ast.Name) and isinstance(n.ctx, kind) and n.id not in BUILTINS]
    return list(dict.fromkeys(n.id for n in sorted(found, key=lambda n: (n.lineno, n.col_offset))))


def line_accesses(line: str) -> tuple[list[str], list[str]]:
    """Names read and written by one line of Python.

    A header is parsed with an empty body. Loops and ``with`` headers bind
    their targets, and loops read what they run over; other headers have no
    accesses of their own.
    """
    text = line.strip()
    try:
        body = ast.parse(f"{text} pass" if text.endswith(":") else text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], []
    match body:
        case [ast.For(target=target, iter=over)]:
            bound = _names([target], ast.Store)
            return [n for n in _names([over], ast.Load) if n not in bound], bound
        case [ast.With(items=items)]:
            return [], _names([i.optional_vars for i in items if i.optional_vars], ast.Store)
        case [ast.If() | ast.While() | ast.FunctionDef() | ast.ClassDef()] if text.endswith(":"):
            return [], []
    changed = [n.target for top in body for n in ast.walk(top) if isinstance(n, ast.AugAssign) and isinstance(n.target, ast.Name)]
    first = _names(changed, ast.Store)  # read before they are written
    return first + [n for n in _names(body, ast.Load) if n not in first], _names(body, ast.Store)


def reads_writes(lines: DataFrame, text: str = "code") -> DataFrame:
    """Accesses of every distinct line: parsed once, joined back by the caller."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [line_accesses(t) for t in pdf[text]]
            yield pd.DataFrame({text: pdf[text], "reads": [r for r, _ in found], "writes": [w for _, w in found]})

    return lines.select(text).distinct().mapInPandas(parse, f"{text} string, reads array<string>, writes array<string>")


def with_accesses(steps: DataFrame) -> DataFrame:
    return steps.drop("reads", "writes").join(reads_writes(steps), "code")


def _open_levels(steps: DataFrame, **kw) -> DataFrame:
    """For each step the last step on every lower indent level that no step at or below that level has closed since.

    ``steps`` needs ``run_id, step, indent`` and the struct ``_row`` to carry.
    """
    levels = steps.groupBy("run_id").agg(F.collect_set("indent").alias("levels"))
    spread = steps.join(levels, "run_id").withColumn("level", F.explode("levels")).drop("levels")
    at_or_below = F.when(F.col("indent") <= F.col("level"), F.struct("_row", (F.col("indent") == F.col("level")).alias("opens")))
    held = ordered.running(spread, ["run_id", "level"], "step", {"_open": ("last", at_or_below)}, **kw)
    return held.filter((F.col("level") < F.col("indent")) & F.col("_open.opens")).select("run_id", "step", "level", "_open._row.*")


def block_structure(steps: DataFrame, **kw) -> DataFrame:
    """Block of every step; rows that open a block also carry its parent, indent and condition step.

    A block is known by its headers, the last open step on every lower indent
    level: a loop header by its line, so that later rounds of the loop stay
    in one block, any other header by its step. Blocks count from 1 in the
    order of their first step; 0 is the block without headers.
    """
    code = F.trim("code")
    loop, test = code.rlike("^(for|while) "), code.rlike("^(for|while|if|elif) ")
    name = F.when(loop, F.concat(F.lit("line "), F.col("line").cast("string"))).otherwise(F.concat(F.lit("step "), F.col("step").cast("string")))
    rows = steps.select("run_id", "step", "indent", F.struct(name.alias("name"), F.when(test, F.col("step")).alias("test")).alias("_row"))
    headers = _open_levels(rows, **kw).groupBy("run_id", "step").agg(
        F.array_sort(F.collect_list(F.struct("level", "name"))).alias("h"), F.max_by("test", "level").alias("test"))
    path = F.coalesce(F.transform("h", lambda x: x["name"]), F.array().cast("array<string>"))
    placed = read_twice(rows.select("run_id", "step", "indent").join(headers, ["run_id", "step"], "left").withColumn("path", path))
    firsts = placed.filter(F.size("path") > 0).groupBy("run_id", "path").agg(
        F.min_by(F.struct("step", "indent", "test"), "step").alias("f")).select("run_id", "path", "f.*")
    blocks = read_twice(ordered.dense_index(firsts, ["run_id"], "step", "block_id", **kw).withColumn("block_id", F.col("block_id") + 1))
    ids = blocks.select("run_id", "path", "block_id")
    parent = blocks.withColumn("up", F.slice("path", 1, F.size("path") - 1)).join(
        ids.select("run_id", F.col("path").alias("up"), F.col("block_id").alias("parent")), ["run_id", "up"], "left")
    opened = parent.select("run_id", "step", F.coalesce("parent", F.lit(0)).cast("long").alias("parent_block_id"), F.col("indent").alias("block_indent"),
                           F.coalesce("test", F.lit(-1)).cast("long").alias("condition_step"))
    return placed.join(ids, ["run_id", "path"], "left").join(opened, ["run_id", "step"], "left").select(
        "run_id", "step", F.coalesce("block_id", F.lit(0)).cast("long").alias("block_id"), "parent_block_id", F.col("block_indent").cast("int"), "condition_step")


_CONTROL = r"^(if |elif |for |while |try:|except |else:)"


def enclosing_control(steps: DataFrame, **kw) -> DataFrame:
    """The nearest control line a step is nested in, by indent.

    For every indent level of the run the last step at or below that level is
    carried; it encloses the current step when it is a control line of exactly
    that level. The innermost such level wins.
    """
    rows = steps.filter(F.length(F.rtrim("code")) > 0).select(
        "run_id", "step", "indent", F.struct(F.col("step").alias("s"), F.ltrim("code").rlike(_CONTROL).alias("control")).alias("_row"))
    return _open_levels(rows, **kw).filter("control").groupBy("run_id", "step").agg(F.max("s").alias("control_step"))


def loop_groups(steps: DataFrame, min_steps: int = 3, **kw) -> DataFrame:
    """Stretches of at least ``min_steps`` steps on one line; ``iteration`` counts
    stretches since the last shorter one."""
    seen = ordered.previous_row(steps.select("run_id", "step", "line", "code"), ["run_id"], "step",
                                {"_line": F.col("line")}, **kw)
    starts = ~F.col("_line").eqNullSafe(F.col("line")) | C.is_loop_header(F.col("code"))
    marked = ordered.running(seen, ["run_id"], "step", {"island": ("sum", starts.cast("long"), True)}, **kw)
    islands = marked.groupBy("run_id", "island").agg(
        F.first("line").alias("line"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.count("*").alias("steps"))
    long_enough = F.col("steps") >= min_steps
    counted = ordered.running(islands, ["run_id"], "island", {"_n": ("sum", long_enough.cast("long"))}, **kw)
    reset = ordered.running(counted, ["run_id"], "island", {"_base": ("last", F.when(~long_enough, F.col("_n")))}, **kw)
    return reset.filter(long_enough).select(
        "run_id", "line", "first_step", "last_step", "steps",
        (F.col("_n") - F.coalesce("_base", F.lit(0))).alias("iteration"))


def timeline_summary(steps: DataFrame, snapshots: DataFrame) -> DataFrame:
    a = steps.groupBy("run_id").agg(F.count("*").alias("total_steps"), F.countDistinct("file").alias("files"))
    b = snapshots.groupBy("run_id").agg(F.countDistinct("var").alias("variables"))
    return a.join(b, "run_id", "left").withColumn("variables", F.coalesce("variables", F.lit(0)))


def block_summary(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id", "block_id").agg(
        F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("steps"))


def variable_rollup(diff: DataFrame) -> DataFrame:
    """First and last value, first and last step, and number of changes per variable."""
    held = diff.filter("now IS NOT NULL")
    return held.groupBy("run_id", "var").agg(
        F.min_by("now.value", "step").alias("first_value"), F.max_by("now.value", "step").alias("last_value"),
        F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.count_if(F.col("change") == "changed").alias("changes"))


def step_changes(diff: DataFrame) -> DataFrame:
    """Changed and new variables of each step, as sorted arrays."""
    return diff.filter("change IN ('changed', 'new')").groupBy("run_id", "step").agg(
        F.array_sort(F.collect_list(F.when(F.col("change") == "changed", F.col("var")))).alias("changed"),
        F.array_sort(F.collect_list(F.when(F.col("change") == "new", F.col("var")))).alias("new_vars"))


def key_timeline(steps: DataFrame, changes: DataFrame) -> DataFrame:
    """Steps that change something, return or head a loop."""
    code = F.col("code")
    event = (
        F.when(code.contains("for ") | code.contains("while "), "loop")
        .when(F.lower(code).contains("return"), "return")
        .when(F.size("changed") > 0, "changed")
        .when(F.size("new_vars") > 0, "new_vars").otherwise("")
    )
    rows = steps.select("run_id", "step", "line", "code").join(changes, ["run_id", "step"], "left")
    return rows.withColumn("event", event).filter((F.size("changed") > 0) | F.col("event").isin("loop", "return")).select(
        "run_id", "step", "line", F.trim(code).alias("code"),
        F.coalesce("changed", F.array().cast("array<string>")).alias("changed_vars"), "event")


def heap_changes(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """Objects that are new or whose references changed since the previous step.

    ``attr`` is null for a new object; otherwise one row per reference that is
    new or points elsewhere, and ``attr`` ``''`` marks a dropped reference.
    """
    key = ["run_id", "step", "obj_id"]
    now = objects.select(*key)
    before = objects.select("run_id", (F.col("step") + 1).alias("step"), "obj_id")
    has_before = before.select("run_id", "step").distinct()
    fresh = now.join(before, key, "left_anti").join(has_before, ["run_id", "step"], "left_semi").select(
        *key, F.lit("new").alias("change"), F.lit(None).cast("string").alias("attr"),
        F.lit(None).cast("long").alias("target_id"))
    old = refs.select("run_id", (F.col("step") + 1).alias("step"), "obj_id", "attr", F.col("target_id").alias("_old"))
    moved = (
        refs.join(old, [*key, "attr"], "full")
        .filter(~F.col("target_id").eqNullSafe(F.col("_old")))
        .join(now, key, "left_semi").join(before, key, "left_semi")
        .select(*key, F.lit("refs").alias("change"),
                F.when(F.col("target_id").isNull(), "").otherwise(F.col("attr")).alias("attr"), "target_id")
    )
    return fresh.unionByName(moved)


def heap_graph(objects: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of the heap at each step, with change flags."""
    changes = heap_changes(objects, refs)
    key = ["run_id", "step", "obj_id"]
    touched = changes.select(*key).distinct().withColumn("changed", F.lit(True))
    nodes = objects.join(touched, key, "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    ends = objects.select("run_id", "step", F.col("obj_id").alias("target_id"))
    moved = changes.filter("change = 'refs' AND attr <> ''").select(*key, "attr").withColumn("changed", F.lit(True))
    edges = (
        refs.join(objects.select(*key), key, "left_semi").join(ends, ["run_id", "step", "target_id"], "left_semi")
        .join(moved, [*key, "attr"], "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
    )
    return nodes, edges


def heap_bindings(snapshots: DataFrame, objects: DataFrame) -> DataFrame:
    """Variables bound to an object that is on the heap at the step."""
    held = objects.select("run_id", "step", F.col("obj_id").alias("memory_id")).distinct()
    return snapshots.join(held, ["run_id", "step", "memory_id"], "left_semi").select(
        "run_id", "step", "var", F.col("memory_id").alias("obj_id"))
