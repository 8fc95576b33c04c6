"""Archetypes of variables, control, structure and algorithm; normal form and fingerprint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions import ordered
from causeway.functions.values import number, repr_size, round3
from causeway.operators.facts import _evidence
from causeway.session import checkpointed

# Archetype | category | canonical id | invariants | behaviours
ARCHETYPES = """
loop_counter|variable|bounded_iterator|monotonic,bounded_range,integer|iterates,indexes
accumulator|variable|monotonic_accumulator|monotonic_growth,numeric|aggregates,sums
memo_table|variable|dict_state_write|key_value_mapping,monotonic_growth|caches,lookups,stores
state_transition|variable|parallel_state_transition|previous_value_used,atomic_swap|transitions,shifts_state
boundary_condition|variable|boolean_guard|boolean_guard|guards,controls_flow
visited_set|variable|membership_guard|no_duplicates,monotonic_growth|tracks_visited,prevents_cycles
dedup_guard|control|deduplication_filter|prevents_duplicate_processing|filters_duplicates
early_termination|control|short_circuit|terminates_before_normal_flow|short_circuits
convergence_check|control|fixed_point_detection|reaches_fixed_point|converges
stack_dfs|structure|lifo_traversal|lifo_order|depth_first_traversal
queue_bfs|structure|fifo_traversal|fifo_order|breadth_first_traversal
heap_priority|structure|priority_selection|min_heap_order|priority_selection
hash_lookup|structure|constant_time_lookup|o1_access|constant_time_lookup
dynamic_programming|algorithm|dp_optimization|optimal_substructure,overlapping_subproblems|memoizes,builds_solution_bottom_up
greedy_selection|algorithm|greedy_optimization|locally_optimal_choice|selects_locally_optimal,sorts_then_processes
sliding_window|algorithm|window_optimization|window_invariant|slides_window,maintains_subarray
"""

# From | to | relationship
RELATIONS = """
memo_table|dynamic_programming|enables
loop_counter|accumulator|drives
state_transition|dynamic_programming|implements
visited_set|stack_dfs|guards
visited_set|queue_bfs|guards
"""


def archetype_table(spark: SparkSession) -> DataFrame:
    """Sixteen fixed rows, safe to broadcast."""
    rows = []
    for line in ARCHETYPES.strip().splitlines():
        a, category, canonical, invariants, behaviors = line.split("|")
        rows.append((a, category, canonical, invariants.split(","), behaviors.split(",")))
    return spark.createDataFrame(
        rows, "archetype string, category string, canonical_id string, invariants array<string>, behaviors array<string>")


def _points(cond: Column, worth: float) -> Column:
    return F.when(cond, F.lit(worth)).otherwise(F.lit(0.0))


def _code_signals(steps: DataFrame) -> DataFrame:
    """What the code lines that touch a variable say about it."""
    acc = steps.select(
        "run_id", "code", "reads", "writes", F.explode(F.array_distinct(F.concat("reads", "writes"))).alias("var"))
    code, var = F.col("code"), F.col("var")
    r, w = F.array_contains("reads", var), F.array_contains("writes", var)
    has = code.contains
    lhs, rhs = F.substring_index(code, "=", 1), F.expr("substring(code, locate('=', code) + 1)")
    indexed = F.expr(r"code rlike concat('\\Q', var, '\\E\\[.+\\]')")
    index_written = F.expr(r"code rlike concat('\\Q', var, '\\E\\[.+\\]\\s*=')")
    return acc.groupBy("run_id", "var").agg(
        F.bool_or(r & has("for") & has("range")).alias("loop_header"),
        F.bool_or(r & has("[") & has("]")).alias("as_index"),
        F.bool_or(r & w & (code.contains(F.concat(var, F.lit(" +="))) | code.contains(F.concat(var, F.lit(" ="))))).alias("self_update"),
        F.bool_or(r & index_written).alias("index_write"),
        F.bool_or(r & indexed & ~F.expr("contains(substring_index(code, var, 1), '=')")).alias("index_read"),
        F.count_if(r & w & has(",") & has("=") & lhs.contains(var) & rhs.contains(var)).alias("self_unpacks"),
        F.count_if(w & (F.size("writes") > 1)).alias("paired"),
        F.bool_or(r & (has("if") | has("while"))).alias("in_condition"),
        F.bool_or(r & (code.contains(F.concat(F.lit("in "), var)) | has("not in"))).alias("membership"),
        F.bool_or(r & has(".add(")).alias("adds"),
    )


def _value_signals(snapshots: DataFrame, **kw) -> DataFrame:
    """What the history of a variable's values says about it; at least two rows."""
    value = F.col("value")
    rows = snapshots.select(
        "run_id", "var", "step", "type",
        F.when(value.rlike(r"^-?[0-9]+$"), value.try_cast("bigint")).alias("whole"),
        number(value).alias("num"),
        F.when(value.startswith("{"), repr_size(value)).otherwise(0).alias("entries"))
    seen = ordered.running(rows, ["run_id", "var"], "step", {
        "whole_before": ("last", F.col("whole")), "num_before": ("last", F.col("num")),
        "entries_before": ("last", F.col("entries"))}, **kw)
    d = F.col("whole") - F.col("whole_before")
    return seen.groupBy("run_id", "var").agg(
        F.count("*").alias("rows"), F.min_by("type", "step").alias("first_type"),
        F.count("whole").alias("wholes"), F.bool_and(d == 1).alias("by_one"), F.bool_and(d >= 0).alias("rising"),
        F.count("num").alias("nums"), F.bool_and(F.col("num") >= F.col("num_before")).alias("num_rising"),
        F.bool_and(F.col("entries") >= F.col("entries_before")).alias("growing"),
    ).filter("rows >= 2")


def variable_archetypes(steps: DataFrame, snapshots: DataFrame, **kw) -> DataFrame:
    """Roles of variables with a summed confidence of at least 0.4; evidence in parts, as that of facts."""
    s = _value_signals(snapshots, **kw).join(_code_signals(steps), ["run_id", "var"], "left")
    flags = ["loop_header", "as_index", "self_update", "index_write", "index_read", "in_condition", "membership", "adds"]
    s = s.na.fill(False, flags).na.fill(0, ["self_unpacks", "paired"])
    c = F.col
    counter = F.when((c("wholes") >= 3) & c("by_one"), 0.4).when((c("wholes") >= 3) & c("rising"), 0.2).otherwise(0.0)
    scores = {
        "loop_counter": counter + _points(c("loop_header"), 0.4) + _points(c("as_index"), 0.1),
        "accumulator": _points(c("self_update"), 0.5) + _points((c("nums") >= 3) & c("num_rising"), 0.3)
        + _points(c("first_type").isin("int", "float"), 0.1),
        "memo_table": _points(c("first_type") == "dict", 0.3) + _points(c("index_write"), 0.4)
        + _points(c("index_read"), 0.2) + _points(c("growing"), 0.2),
        "state_transition": c("self_unpacks") * 0.5 + c("paired") * 0.3,
        "boundary_condition": _points(c("in_condition"), 0.4) + _points(c("first_type") == "bool", 0.3),
        "visited_set": _points(c("first_type") == "set", 0.3) + _points(c("membership"), 0.4) + _points(c("adds"), 0.2),
    }
    rated = F.array(*[F.struct(F.lit(k).alias("archetype"), F.least(v, F.lit(1.0)).alias("confidence")) for k, v in scores.items()])
    out = s.select("run_id", "var", F.inline(rated)).filter("confidence >= 0.3999999")
    return out.join(_evidence(snapshots, ["run_id", "var"], "step"), ["run_id", "var"]).select(
        "run_id", "archetype", F.lit("variable").alias("category"), F.col("var").alias("subject"),
        round3(F.col("confidence")).alias("confidence"), "evidence", F.col("part").cast("long").alias("part"))


def control_archetypes(steps: DataFrame, facts: DataFrame) -> DataFrame:
    """Duplicate guards, returns before the end inside a condition, convergence checks."""
    code = F.col("code")
    subject = F.concat(F.lit("step#"), F.col("step").cast("string"))

    def rows(df, name, confidence):
        return df.select("run_id", F.lit(name).alias("archetype"), F.lit("control").alias("category"),
                         subject.alias("subject"), F.lit(confidence).alias("confidence"), F.array("step").alias("evidence"),
                         F.lit(0).cast("long").alias("part"))

    guard = steps.filter(code.contains("not in") & (code.contains("seen") | code.contains("visited") | code.contains("memo")))
    per_run = steps.groupBy("run_id").agg(
        F.max("step").alias("_last"), F.min(F.when(code.contains("if"), F.col("indent"))).alias("_if_indent"))
    early = steps.filter(F.trim(code).startswith("return")).join(per_run, "run_id").filter(
        "step < _last AND _if_indent < indent")
    said = F.lower("description")
    stable = facts.filter((F.col("kind") == "loop.accumulation") & (said.contains("converge") | said.contains("stable"))).select(
        "run_id", F.explode("evidence").alias("step")).distinct()
    return (
        rows(guard, "dedup_guard", 0.8).unionByName(rows(early, "early_termination", 0.6))
        .unionByName(rows(stable, "convergence_check", 0.7))
    )


def structure_archetypes(steps: DataFrame) -> DataFrame:
    """Stack, queue, heap and hash use, over all code lines of a run; evidence in parts."""
    code = F.col("code")
    look = code.rlike(r"\w+\[.+\]")
    marks = {
        "append": code.contains(".append("), "pop": code.contains(".pop()"), "pop0": code.contains(".pop(0)"),
        "heapq": code.contains("heapq") | code.contains("heappush") | code.contains("heappop"), "heap": code.contains("heap"),
        "look": look, "read": look & ~F.substring_index(code, "[", 1).contains("="),
    }
    rows = steps.select("run_id", "step", *[v.alias(k) for k, v in marks.items()])
    per_run = rows.groupBy("run_id").agg(*[F.count_if(k).alias(k) for k in marks])
    rules = {
        "stack_dfs": ((F.col("append") > 0) & (F.col("pop") > 0), 0.8), "queue_bfs": ((F.col("append") > 0) & (F.col("pop0") > 0), 0.8),
        "heap_priority": (F.col("heapq") > 0, 0.9), "hash_lookup": (F.col("read") >= 3, 0.6),
    }
    found = F.array_compact(F.array(*[
        F.when(ok, F.struct(F.lit(name).alias("archetype"), F.lit(score).alias("confidence"))) for name, (ok, score) in rules.items()]))
    shows = {"stack_dfs": "append OR pop", "queue_bfs": "append OR pop0", "heap_priority": "heap", "hash_lookup": "look"}
    shown = None
    for name, cond in shows.items():
        part = _evidence(rows.filter(cond), ["run_id"], "step").withColumn("archetype", F.lit(name))
        shown = part if shown is None else shown.unionByName(part)
    return per_run.select("run_id", F.inline(found)).join(shown, ["run_id", "archetype"], "left").select(
        "run_id", "archetype", F.lit("structure").alias("category"), F.lit("execution").alias("subject"), "confidence", "evidence",
        F.coalesce("part", F.lit(0)).cast("long").alias("part"))


def algorithm_archetypes(steps: DataFrame, facts: DataFrame, variables: DataFrame) -> DataFrame:
    """Dynamic programming, greedy choice and sliding window, by counted signals."""
    code, lower = F.col("code"), F.lower("code")
    runs = steps.groupBy("run_id").agg(
        F.max((code.contains("sorted") | code.contains(".sort")).cast("int")).alias("sorts"),
        F.max((code.contains("min(") | code.contains("max(")).cast("int")).alias("minmax"),
        F.sum((code.rlike(r"while.*<.*len\(") | code.rlike(r"for.*range.*len\(")).cast("int")
              + (lower.contains("window") | (lower.contains("left") & lower.contains("right"))).cast("int")).alias("windows"))
    names = ["left", "right", "start", "end", "i", "j"]
    named = code.contains(names[0])
    for n in names[1:]:
        named = named | code.contains(n)
    pointers = steps.filter(code.contains("+=") & named).select("run_id", F.explode("writes").alias("v")).groupBy(
        "run_id").agg(F.countDistinct("v").alias("pointers"))
    hit = r"(\w+)\[(.+?)\]\s*="
    written = steps.select("run_id", F.regexp_extract(code, hit, 1).alias("v"), F.regexp_extract(code, hit, 2).alias("i")).filter(
        "v <> ''").groupBy("run_id", "v").agg(F.countDistinct("i").alias("n")).groupBy("run_id").agg(
        F.max((F.col("n") > 2).cast("int")).alias("index_writes"))
    fact = facts.groupBy("run_id").agg(
        F.max((F.col("kind") == "loop.accumulation").cast("int")).alias("accumulates"),
        F.max((F.col("kind") == "control.branch").cast("int")).alias("branches"))
    var = variables.groupBy("run_id").agg(
        F.max((F.col("archetype") == "memo_table").cast("int")).alias("memo"),
        F.max((F.col("archetype") == "state_transition").cast("int")).alias("transition"))
    s = runs
    for extra in (pointers, written, fact, var):
        s = s.join(extra, "run_id", "left")
    s = s.na.fill(0)
    dp = F.col("memo") + F.col("accumulates") + F.col("transition") + F.col("index_writes")
    greedy = F.col("branches") + F.col("sorts") + F.col("minmax")
    window = F.col("windows") + F.when((F.col("windows") >= 1) & (F.col("pointers") >= 2), 1).otherwise(0)

    def rated(name, n, base, cap):
        return F.when(n >= 2, F.struct(F.lit(name).alias("archetype"), F.least(F.lit(base) + n * 0.15, F.lit(cap)).alias("confidence"),
                                       n.cast("long").alias("signals")))

    found = F.array_compact(F.array(
        rated("dynamic_programming", dp, 0.5, 0.95), rated("greedy_selection", greedy, 0.4, 0.85),
        rated("sliding_window", window, 0.4, 0.85)))
    return s.select("run_id", F.inline(found)).select(
        "run_id", "archetype", F.lit("algorithm").alias("category"), F.lit("execution").alias("subject"),
        round3(F.col("confidence")).alias("confidence"), F.array().cast("array<bigint>").alias("evidence"), F.lit(0).cast("long").alias("part"))


def identity_parts(steps, snapshots, facts, **kw) -> list[DataFrame]:
    """All archetypes of all runs, best per archetype and subject, a table per category.

    Categories share no archetype, so each is reduced to its best rows alone.
    """
    variables = checkpointed(variable_archetypes(steps, snapshots, **kw))
    parts = [variables, control_archetypes(steps, facts), structure_archetypes(steps),
             algorithm_archetypes(steps, facts, variables)]
    return [deduplicate(p) for p in parts]


def identify(steps, snapshots, facts, **kw) -> DataFrame:
    """All archetypes of all runs, best per archetype and subject, ranked by confidence."""
    return reduce(DataFrame.unionByName, identity_parts(steps, snapshots, facts, **kw))


def deduplicate(identities: DataFrame) -> DataFrame:
    """The best rows per archetype and subject, with all parts of their evidence."""
    key = ["run_id", "archetype", "subject"]
    best = F.max("confidence").over(Window.partitionBy(*key))
    return identities.withColumn("_best", best).filter("confidence = _best").groupBy(*key, "part").agg(
        F.first(F.struct("category", "confidence", "evidence")).alias("b")).select(*key, "b.*", "part")


def relationships(identities: DataFrame) -> DataFrame:
    """Related archetypes of a run; ``pairs`` counts how many subjects relate."""
    spark = identities.sparkSession
    table = F.broadcast(spark.createDataFrame(
        [tuple(r.split("|")) for r in RELATIONS.strip().splitlines()], "src string, dst string, relation string"))
    n = identities.filter("part = 0").groupBy("run_id", "archetype").agg(F.count("*").alias("n"))
    a = n.select("run_id", F.col("archetype").alias("src"), F.col("n").alias("na"))
    b = n.select("run_id", F.col("archetype").alias("dst"), F.col("n").alias("nb"))
    return a.join(table, "src").join(b, ["run_id", "dst"]).select(
        "run_id", "src", "dst", "relation", (F.col("na") * F.col("nb")).alias("pairs"))


def normalize(identities: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """One canonical identity per kind and run, in parts of its evidence: the first by confidence, archetype, subject."""
    w = Window.partitionBy("run_id", "archetype").orderBy(F.col("confidence").desc(), "subject")
    first = identities.withColumn("_r", F.dense_rank().over(w)).filter("_r = 1").drop("_r", "category")
    out = first.join(F.broadcast(archetype_table(identities.sparkSession)), "archetype")
    return out if steps is None else _refined(out, steps)


def _refined(canonical: DataFrame, steps: DataFrame) -> DataFrame:
    """Parameters read off the evidence lines; a later line overrides an earlier one."""
    lines = canonical.filter(F.col("archetype").isin("memo_table", "accumulator", "state_transition")).select(
        "run_id", "archetype", F.explode("evidence").alias("step")).join(steps.select("run_id", "step", "code"), ["run_id", "step"])
    code, lower, kind = F.col("code"), F.lower("code"), F.col("archetype")
    memo = (
        F.when(code.contains("memo"), "memoization").when(code.contains("cache"), "caching").when(lower.contains("dp"), "dp_table")
        .when(lower.contains("lookup") | lower.contains("index"), "index").otherwise("state_store")
    )
    sign = F.when(code.contains("+="), "+").when(code.contains("-="), "-").when(code.contains("*="), "*")
    total = F.when(sign.isNull(), F.when(lower.contains("sum"), "sum").when(lower.contains("count"), "count").when(lower.contains("total"), "total"))
    role = F.when(kind == "memo_table", memo).when(kind == "accumulator", total)
    operator = F.when(kind == "accumulator", sign)
    lhs = F.when((kind == "state_transition") & code.contains(",") & code.contains("="), F.trim(F.substring_index(code, "=", 1)))

    def last(c: Column) -> Column:
        return F.max_by(c, F.when(c.isNotNull(), F.col("step")))

    g = lines.groupBy("run_id", "archetype").agg(
        last(role).alias("semantic_role"), last(operator).alias("operator"),
        F.when(F.bool_or(operator == "-"), "decreasing").alias("direction"), last(lhs).alias("transition_vars"))
    return canonical.join(g, ["run_id", "archetype"], "left").withColumn(
        "arity", F.size(F.split("transition_vars", ",")))


def complexity_shape(canonical: DataFrame, steps: DataFrame, **kw) -> DataFrame:
    """Shape of a run from its canonical identities and nesting of loop headers."""
    code = F.col("code")
    heads = steps.filter(code.contains("for") | code.contains("while")).select("run_id", "step", "indent")
    inner = ordered.running(heads, ["run_id"], "step", {"_outer": ("min", F.col("indent"))}, **kw).groupBy("run_id").agg(
        F.bool_or(F.col("indent") > F.col("_outer")).alias("nested"))
    has = canonical.groupBy("run_id").agg(F.collect_set("canonical_id").alias("ids"))
    every = steps.select("run_id").distinct().join(has, "run_id", "left").join(inner, "run_id", "left")

    def h(name):
        return F.coalesce(F.array_contains("ids", name), F.lit(False))

    shape = (
        F.when(h("dp_optimization") & h("bounded_iterator"), "linear_iterative_dp")
        .when(F.coalesce("nested", F.lit(False)), "nested_iterative").when(h("bounded_iterator"), "linear_iterative")
        .when(h("lifo_traversal"), "recursive_dfs").when(h("fifo_traversal"), "iterative_bfs").otherwise("sequential")
    )
    return every.select("run_id", shape.alias("complexity"))


def _ids(category: str) -> Column:
    return F.array_sort(F.collect_set(F.when(F.col("category") == category, F.col("canonical_id"))))


def _json(name: str) -> Column:
    items = F.array_join(F.transform(name, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    return F.concat(F.lit(f'"{name}": ['), items, F.lit("]"))


def fingerprints(canonical: DataFrame, shapes: DataFrame) -> DataFrame:
    """One comparable row per run; the hash covers the sorted canonical ids and the shape."""
    algo = F.min_by(F.struct("canonical_id", "confidence"),
                    F.when(F.col("category") == "algorithm", F.struct(-F.col("confidence"), F.col("archetype"))))
    g = canonical.groupBy("run_id").agg(
        algo.alias("_a"), _ids("algorithm").alias("algorithms"), _ids("structure").alias("structures"),
        _ids("control").alias("control"), _ids("variable").alias("variables"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("invariants")))).alias("invariant_set"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("behaviors")))).alias("behaviors"),
        F.count_if(F.col("part") == 0).alias("identity_count"))
    empty = F.array().cast("array<string>")
    # a subject keeps the last of its canonical identities in rank order
    roles = canonical.filter("category = 'variable'").groupBy("run_id", "subject").agg(
        F.max_by("canonical_id", F.struct(-F.col("confidence"), F.col("archetype"))).alias("role")
    ).groupBy("run_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "subject", "role"))).alias("variable_roles"))
    g = shapes.join(g, "run_id", "left").join(roles, "run_id", "left")
    for c in ("algorithms", "structures", "control", "variables", "variable_roles", "invariant_set", "behaviors"):
        g = g.withColumn(c, F.coalesce(c, empty))
    text = F.concat(F.lit("{"), F.concat_ws(", ", _json("algorithms"), F.concat(F.lit('"complexity": "'), "complexity", F.lit('"')),
                                            _json("control"), _json("structures"), _json("variables")), F.lit("}"))
    return g.select(
        "run_id", F.substring(F.sha2(text, 256), 1, 16).alias("hash"),
        F.coalesce("_a.canonical_id", F.lit("unknown")).alias("algorithm"),
        F.coalesce("_a.confidence", F.lit(0.0)).alias("algorithm_confidence"),
        "algorithms", "structures", "control", "complexity", "variables",
        "variable_roles", "invariant_set", "behaviors", F.coalesce("identity_count", F.lit(0)).alias("identity_count"),
        F.least(F.size(F.array_union(F.array_union("algorithms", "structures"), F.array_union("control", "variables"))) / 10.0,
                F.lit(1.0)).alias("structural_complexity"))


def signatures(canonical: DataFrame) -> DataFrame:
    """Sorted canonical ids per category joined by ``+``; ``none`` when empty."""
    def sig(c):
        return F.when(F.size(_ids(c)) > 0, F.concat_ws("+", _ids(c))).otherwise("none").alias(f"{c}_signature")

    return canonical.groupBy("run_id").agg(sig("algorithm"), sig("structure"), sig("control"))


# ---- behaviour patterns


def behavior_patterns(facts: DataFrame) -> DataFrame:
    """Algorithmic behaviours seen in the facts of a run; ``sequential`` when there are none."""
    kind, subject, said = F.lower("kind"), F.lower("subject"), F.lower("description")
    tests = {
        "loop.accumulation": (kind.contains("loop"), 0.85),
        "memoization": (subject.contains("memo") | subject.contains("cache") | said.contains("memo"), 0.9),
        "recursion": (kind.contains("call") | said.contains("recursive"), 0.8),
        "in_place_mutation": (kind.contains("mutation") | said.contains("mutate"), 0.75),
    }
    flags = facts.groupBy("run_id").agg(*[F.bool_or(c).alias(n) for n, (c, _) in tests.items()])
    found = F.array_compact(F.array(*[
        F.when(F.col(f"`{n}`"), F.struct(F.lit(n).alias("name"), F.lit(s).alias("confidence"))) for n, (_, s) in tests.items()]))
    fallback = F.array(F.struct(F.lit("sequential").alias("name"), F.lit(0.5).alias("confidence")))
    return flags.select("run_id", F.inline(F.when(F.size(found) > 0, found).otherwise(fallback)))


def timeline_patterns(steps: DataFrame, snapshots: DataFrame, diff: DataFrame) -> DataFrame:
    """Patterns of code and values over a run; the best confidence per name."""
    code = F.trim("code")
    changed = diff.filter("change = 'changed'").select("run_id", "step", "var", "now")
    value = F.col("now.value")
    lead = number(F.trim(F.substring_index(F.regexp_replace(value, r"^[\[\](){}]+|[\[\](){}]+$", ""), ",", 1)))
    g = changed.groupBy("run_id", "var").agg(
        F.count("*").alias("n"), F.count(lead).alias("nums"), F.min_by(lead, "step").alias("lo"), F.max_by(lead, "step").alias("hi"),
        F.bool_and(value.startswith("{") ).alias("dicts"), F.bool_and(value.startswith("[")).alias("lists"),
        F.min_by(F.length(value), "step").alias("len0"), F.max_by(F.length(value), "step").alias("len1")).filter("n >= 3")
    grows = F.when(F.col("nums") == F.col("n"), F.col("hi") > F.col("lo")).otherwise(
        (F.col("dicts") | F.col("lists")) & (F.col("len1") > F.col("len0")))

    def named(df, name, confidence):
        return df.select("run_id").distinct().select("run_id", F.lit(name).alias("name"), F.lit(confidence).alias("confidence"))

    at = changed.filter(F.col("now.type").isin("dict", "list")).join(steps.select("run_id", "step", "code"), ["run_id", "step"])
    builds = at.filter(F.col("code").contains(".append(") | (F.col("code").contains("[") & F.col("code").contains("] =")))
    seen = snapshots.select("run_id", "step").distinct()
    first_loop = steps.filter(code.rlike("^(for |while )")).join(seen, ["run_id", "step"], "left_semi").groupBy("run_id").agg(
        F.min("step").alias("_loop"))
    tests = steps.filter(code.startswith("if ")).join(first_loop, "run_id").filter("step > _loop").groupBy("run_id").count().filter("count >= 2")
    searches = steps.filter(F.col("code").contains("break")).join(changed.select("run_id", "step"), ["run_id", "step"], "left_semi")
    memo = snapshots.filter((F.col("type") == "dict") & (F.lower("var").contains("memo") | F.lower("var").contains("cache")))
    return (
        named(g.filter(grows), "accumulation", 0.9).unionByName(named(builds, "building", 0.85))
        .unionByName(named(tests, "selection", 0.8))
        .unionByName(named(steps.filter(code.contains("sorted(") | code.contains(".sort(")), "ordering", 0.95))
        .unionByName(named(memo, "memoization", 0.9)).unionByName(named(searches, "search", 0.7))
        .unionByName(named(steps.filter(code.rlike(r"^\w+,\s*\w+\s*=\s*\w+,\s*\w+")), "swap", 0.85))
        .unionByName(named(steps.filter(code.contains("map(") | code.contains("lambda") | code.contains("comprehension")), "transformation", 0.75))
    )


def phases(steps: DataFrame) -> DataFrame:
    """Phases of a run: initialization, iteration and return, or computation without a loop."""
    code = F.trim("code")
    loop, ret = code.rlike("^(for |while )"), code.startswith("return ")
    marks = steps.groupBy("run_id").agg(
        F.min(F.when(loop, F.col("step"))).alias("loop"), F.min(F.when(ret, F.col("step"))).alias("ret"),
        F.min("step").alias("first"), F.max("step").alias("last"))
    after = steps.filter(ret).join(marks.select("run_id", "loop"), "run_id").filter("step > loop").groupBy("run_id").agg(
        F.min("step").alias("done"))
    m = marks.join(after, "run_id", "left")
    looped = F.col("loop").isNotNull() & (F.col("ret").isNull() | (F.col("loop") < F.col("ret")))
    c = F.col

    def phase(name, start, end):
        return F.struct(F.lit(name).alias("phase"), start.alias("start_step"), end.alias("end_step"))

    with_loop = F.when(c("done").isNotNull(), F.array(
        phase("Initialization", c("first"), c("loop") - 1), phase("Iteration", c("loop"), c("done") - 1),
        phase("Return", c("done"), c("last")))).otherwise(F.array(
            phase("Initialization", c("first"), c("loop") - 1), phase("Iteration (continued)", c("loop"), c("last"))))
    without = F.when(c("ret").isNotNull(), F.array(
        phase("Computation", c("first"), c("ret") - 1), phase("Return", c("ret"), c("last")))).otherwise(
            F.array(phase("Computation", c("first"), c("last"))))
    return m.select("run_id", F.inline(F.when(looped, with_loop).otherwise(without))).withColumn(
        "steps", F.col("end_step") - F.col("start_step") + 1)


def phase_variables(phases_: DataFrame, diff: DataFrame, top: int = 5) -> DataFrame:
    """The most important variables of each phase: three points when new, two per change."""
    worth = diff.filter("change IN ('new', 'changed')").select(
        "run_id", "step", "var", F.when(F.col("change") == "new", 3).otherwise(2).alias("points"))
    at = worth.join(phases_, "run_id").filter("step BETWEEN start_step AND end_step")
    g = at.groupBy("run_id", "phase", "var").agg(F.sum("points").alias("points"))
    w = Window.partitionBy("run_id", "phase").orderBy(F.col("points").desc(), "var")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def step_types(steps: DataFrame, changes: DataFrame) -> DataFrame:
    """Each step's kind by its code, else by what it changed."""
    code = F.trim("code")
    kind = (
        F.when((code == "") | code.startswith("#"), "empty").when(code.rlike("^(def |class |import |from )"), "definition")
        .when(code.rlike("^(for |while )"), "loop_header").when(code.rlike("^(if |elif )"), "condition")
        .when(code.startswith("return "), "return")
        .when((F.size("new_vars") > 0) & ~(F.size("changed") > 0), "init").when(F.size("changed") > 0, "mutation").otherwise("other")
    )
    return steps.select("run_id", "step", "code").join(changes, ["run_id", "step"], "left").select("run_id", "step", kind.alias("step_type"))


def run_insight(runs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Algorithm type of each run by precedence of its patterns, and the best confidence."""
    g = patterns.groupBy("run_id").agg(F.collect_set("name").alias("n"), F.max("confidence").alias("c"))

    def h(name):
        return F.array_contains("n", name)

    kind = (
        F.when(h("memoization"), "dynamic_programming").when(h("accumulation") & h("selection"), "filter_accumulate")
        .when(h("accumulation"), "accumulate").when(h("building"), "construction").when(h("search"), "search")
        .when(h("ordering"), "sort_transform").otherwise("general")
    )
    return runs.select("run_id").distinct().join(g, "run_id", "left").select(
        "run_id", kind.alias("algorithm_type"), F.coalesce("c", F.lit(0.5)).alias("confidence"))
