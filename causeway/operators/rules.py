"""Predicates, invariants, goals and derived facts over stretches of a run.

``spans`` has ``run_id, span_id, start_step, end_step`` and what is known of
each stretch: ``op``, ``terminates`` and ``pattern``. Matches of patterns are
one source of spans. Evidence is kept as counts with first and last step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import ordered
from causeway.functions.values import number
from causeway.operators.traverse import reach
from causeway.session import checkpointed

_SPAN = ["run_id", "span_id"]
_CELL = 64


def inside(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with a ``step`` joined to the spans they fall in.

    Both sides meet on cells of 64 steps of a run, so a long span or a long
    run is spread over many tasks.
    """
    cells = spans.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col("start_step") / _CELL).cast("long"), F.floor(F.col("end_step") / _CELL).cast("long"))))
    at = rows.withColumn("_cell", F.floor(F.col("step") / _CELL).cast("long"))
    return at.join(cells, ["run_id", "_cell"]).filter("step BETWEEN start_step AND end_step").drop("_cell")


def _rows(df: DataFrame, name: str, subject: Column, confidence: Column | float, count: Column, first: Column, last: Column) -> DataFrame:
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return df.select(*_SPAN, F.lit(name).alias("predicate"), subject.cast("string").alias("subject"), conf.cast("double").alias("confidence"),
                     count.cast("long").alias("count"), first.cast("long").alias("first_step"), last.cast("long").alias("last_step"))


def _tag(name: str) -> Column:
    return F.array_contains("tags", name)


def _summary(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Everything the rules ask of the events of a span, in one aggregation."""
    e = inside(events, spans)
    kind, step = F.col("event_type"), F.col("step")
    asked = {
        "returns": kind == "return", "bases": _tag("base_case"), "ends": _tag("base_case") | _tag("null_check"), "nulls": _tag("null_check"),
        "moves": kind == "pointer_move", "sets": kind == "assignment", "tests": kind == "condition", "grows": _tag("accumulation"),
    }
    aggs = []
    for name, cond in asked.items():
        aggs += [F.count_if(cond).alias(name), F.min(F.when(cond, step)).alias(f"{name}_lo"), F.max(F.when(cond, step)).alias(f"{name}_hi")]
    return e.groupBy(*_SPAN, "op", "terminates").agg(
        F.count("*").alias("events"), F.min(step).alias("lo"), F.max(step).alias("hi"), F.min("depth").alias("d0"), F.max("depth").alias("d1"), *aggs)


def _of(s: DataFrame, cond: str, name: str, subject: str, confidence, which: str) -> DataFrame:
    return _rows(s.filter(cond), name, F.lit(subject), confidence, F.col(which), F.col(f"{which}_lo"), F.col(f"{which}_hi"))


def temporal_predicates(events: DataFrame, spans: DataFrame) -> DataFrame:
    """What always, eventually or repeatedly holds in each span, and until when."""
    s = _summary(events, spans)
    bounded = _rows(s.filter("events >= 3 AND d1 - d0 <= 3"), "always", F.lit("bounded_depth"), 0.8, F.col("events"), F.col("lo"), F.col("hi"))
    e = inside(events, spans)
    named = e.filter("target_var IS NOT NULL").groupBy(*_SPAN, "target_var").agg(F.count("*").alias("n"), F.min("step").alias("a"), F.max("step").alias("b"))
    total = named.groupBy(*_SPAN).agg(F.sum("n").alias("t"), F.max(F.struct("n", F.col("target_var"))).alias("top"))
    focus = named.join(total, _SPAN).filter("target_var = top.target_var AND n / t >= 0.5")
    focused = _rows(focus, "always", F.concat(F.lit("focuses_"), "target_var"), F.col("n") / F.col("t"), F.col("n"), F.col("a"), F.col("b"))
    repeated = e.filter(F.col("event_type").isin("pointer_move", "assignment", "recursive_call")).groupBy(*_SPAN, "event_type").agg(
        F.count("*").alias("n"), F.min("step").alias("a"), F.max("step").alias("b")).filter("n >= 3")
    repeats = _rows(repeated, "repeats", F.col("event_type"), F.least(0.5 + F.col("n") * 0.1, F.lit(0.9)), F.col("n"), F.col("a"), F.col("b"))
    two = F.lit(2)
    return (
        bounded.unionByName(focused).unionByName(_of(s, "returns > 0", "eventually", "returns", 0.9, "returns"))
        .unionByName(_of(s, "ends > 0", "eventually", "base_case", 0.85, "ends"))
        .unionByName(_rows(s.filter("op = 'traverse' AND moves > 0 AND nulls > 0"), "until", F.lit("traversal_termination"), 0.85, two, F.col("moves_lo"), F.col("nulls_hi")))
        .unionByName(_rows(s.filter("op = 'search' AND sets > 0 AND returns > 0"), "until", F.lit("search_convergence"), 0.8, two, F.col("sets_lo"), F.col("returns_hi")))
        .unionByName(_of(s, "terminates IN ('null_check', 'convergence') AND moves >= 2", "converges", "pointer_position", 0.75, "moves"))
        .unionByName(_of(s, "op = 'search' AND sets >= 2", "converges", "search_bounds", 0.7, "sets")).unionByName(repeats)
    )


def invariants(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Invariants of each span: ``predicate`` is the category, ``count`` where they hold, ``violated`` where not."""
    s = checkpointed(_summary(events, spans))
    deep = inside(events, spans).join(s.filter("d1 - d0 > 5").select(*_SPAN, "d0"), _SPAN).filter("depth > d0 + 3")
    s = s.join(deep.groupBy(*_SPAN).agg(F.count("*").alias("bad")), _SPAN, "left").na.fill(0, ["bad"])
    c, none = F.col, F.array().cast("array<string>")

    def holds(cond, name, subject, confidence, count, first, last, violated=F.lit(0), depends=none):
        conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.when(F.expr(cond), F.struct(
            F.lit(subject).alias("subject"), F.lit(name).alias("predicate"), conf.cast("double").alias("confidence"),
            count.cast("long").alias("count"), first.cast("long").alias("first_step"), last.cast("long").alias("last_step"),
            violated.cast("long").alias("violated"), depends.alias("depends_on")))

    def of(cond, name, subject, confidence, which, **kw):
        return holds(cond, name, subject, confidence, c(which), c(f"{which}_lo"), c(f"{which}_hi"), **kw)

    found = [
        of("op IN ('search', 'traverse') AND tests > 0", "loop_invariant", "loop_guard", 0.85, "tests"),
        of("op = 'search' AND sets >= 2", "progress", "monotonic_progress", 0.75, "sets", depends=F.array(F.lit("loop_guard"))),
        of("op = 'traverse' AND moves >= 2", "progress", "pointer_advance", 0.8, "moves"),
        of("op = 'accumulate' AND grows > 0", "progress", "accumulator_growth", 0.7, "grows"),
        of("op = 'traverse' AND moves > 0", "loop_invariant", "pointer_validity", 0.7, "moves"),
        of("op = 'search'", "loop_invariant", "bounds_ordering", 0.8, "tests"),
        holds("true", "termination", "bounded_depth", F.when(F.expr("d1 - d0 > 5"), 0.6).otherwise(0.9), c("events") - c("bad"),
              c("lo"), c("hi"), violated=c("bad")),
        holds("returns > 0", "postcondition", "result_reachability", 0.95, F.lit(1), c("returns_hi"), c("returns_hi")),
        of("bases > 0", "termination", "base_case_reachability", 0.85, "bases"),
    ]
    return s.select(*_SPAN, F.inline(F.array_compact(F.array(*found))))


# Ends of intervals, pairs that meet, counters left out, names of accumulators, tags that speak for a goal.
INTERVALS = [("lo", "hi"), ("left", "right"), ("start", "end"), ("low", "high"), ("begin", "end"), ("min_idx", "max_idx")]
MEETING = [("slow", "fast"), ("lo", "hi"), ("left", "right"), ("tortoise", "hare"), ("i", "j")]
COUNTERS = ["i", "j", "k", "n"]
ACCUMULATORS = ["sum", "total", "count", "result", "acc", "score", "max_val", "profit"]
SORT_TAGS = ["sort", "merge", "heap", "partition", "ordered", "sorted"]
STRUCTURE_TAGS = ["balanced", "bst", "heap_property", "invariant"]
MEMO_TAGS = ["memo", "cache", "dp", "memoize", "lookup", "table"]
MEMO_NAMES = ["dynamic", "memo", "dp", "cache"]


def trajectories(snapshots: DataFrame, spans: DataFrame, **kw) -> DataFrame:
    """Course of every numeric variable over each span."""
    v = inside(snapshots.select("run_id", "step", "var", number(F.col("value")).alias("n")).filter("n IS NOT NULL"), spans.select(*_SPAN, "start_step", "end_step"))
    seen = ordered.running(v, [*_SPAN, "var"], "step", {"_b": ("last", F.col("n")), "_i": ("sum", F.lit(1).cast("long"))}, **kw)
    return seen.groupBy(*_SPAN, "var").agg(
        F.count("*").alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.min_by("n", "step").alias("first"), F.max_by("n", "step").alias("last"),
        F.coalesce(F.bool_and(F.col("n") >= F.col("_b")), F.lit(True)).alias("up"), F.coalesce(F.bool_and(F.col("n") <= F.col("_b")), F.lit(True)).alias("down"),
        # rows from the last at which the value moved: nothing after it differs
        (F.count("*") - F.coalesce(F.max(F.when(F.col("n") != F.col("_b"), F.col("_i"))), F.lit(0))).alias("still"))


def _paired(t: DataFrame, pairs) -> DataFrame:
    table = F.broadcast(t.sparkSession.createDataFrame(pairs, "a string, b string"))
    cols = [c for c in t.columns if c not in _SPAN]
    side = F.struct(*cols)
    x = t.select(*_SPAN, F.col("var").alias("a"), side.alias("x")).join(table, "a")
    return x.join(t.select(*_SPAN, F.col("var").alias("b"), side.alias("y")), [*_SPAN, "b"])


def _goal(cond: Column, kind: str, target: Column, confidence: Column | float) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.when(cond, F.struct(F.lit(kind).alias("goal"), target.alias("target"), conf.alias("confidence")))


def _said(df: DataFrame, *goals_: Column) -> DataFrame:
    return df.select(*_SPAN, F.inline(F.array_compact(F.array(*goals_))))


def goals(events: DataFrame, courses: DataFrame, spans: DataFrame, intervals=INTERVALS, meeting=MEETING) -> DataFrame:
    """What each span seems to aim at, from the courses of its variables and its tags."""
    return reduce(DataFrame.unionByName, goal_parts(events, courses, spans, intervals, meeting))


def goal_parts(events: DataFrame, courses: DataFrame, spans: DataFrame, intervals=INTERVALS, meeting=MEETING) -> list[DataFrame]:
    """The goals of all spans by what speaks for them: intervals, single variables, meetings, tags."""
    c, var = F.col, F.col("var")
    both = (c("x.n") >= 2) & c("x.up") & (c("y.n") >= 2) & c("y.down")
    narrow = _said(_paired(courses, intervals), _goal(
        F.expr("(x.n >= 2 AND x.up) OR (y.n >= 2 AND y.down)"), "minimize", F.concat(F.lit("["), "a", F.lit(", "), "b", F.lit("]")),
        F.when(both, 0.85).otherwise(0.65)))
    alone = _said(
        courses, _goal(F.expr("n >= 3 AND down") & ~var.isin(COUNTERS), "minimize", var, 0.6),
        _goal(F.expr("n >= 3 AND up"), "maximize", var, F.when(F.lower("var").isin(ACCUMULATORS), 0.8).otherwise(0.55)),
        _goal(F.expr("n >= 4 AND still >= 3 AND first <> last"), "converge", F.concat("var", F.lit("_fixed_point")), 0.7))
    d0, d1 = F.abs(c("x.first") - c("y.first")), F.abs(c("x.last") - c("y.last"))
    meets = _said(_paired(courses, meeting), _goal(
        F.expr("x.n >= 2 AND y.n >= 2") & (d0 > 0) & (d1 < d0 * 0.3), "converge", F.concat_ws("=", "a", "b"), 0.85))

    def some(names):
        return F.bool_or(F.arrays_overlap("tags", F.array(*[F.lit(n) for n in names])))

    t = inside(events, spans).groupBy(*_SPAN, "pattern").agg(
        some(SORT_TAGS).alias("sorts"), some(STRUCTURE_TAGS).alias("shapes"), some(MEMO_TAGS).alias("memo"))
    named = F.lit(False)
    for n in MEMO_NAMES:
        named = named | F.lower(F.coalesce("pattern", F.lit(""))).contains(n)
    tagged = _said(
        t, _goal(c("sorts"), "preserve", F.lit("ordering"), 0.75), _goal(c("shapes"), "preserve", F.lit("structural_invariant"), 0.7),
        _goal(c("memo") | named, "compress", F.lit("state_space"), F.when(c("memo") & named, 0.8).otherwise(0.6)))
    return [narrow, alone, meets, tagged]


# What is lost without an invariant of each category; without a goal: severity, factor and loss.
LOSS = {"precondition": "correctness_loss", "loop_invariant": "correctness_loss", "progress": "progress_loss", "termination": "termination_loss",
        "postcondition": "correctness_loss"}
GOAL_LOSS = {"minimize": ("major", 0.7, "efficiency_loss"), "converge": ("critical", 0.8, "termination_loss"),
             "compress": ("major", 0.85, "efficiency_loss"), "preserve": ("critical", 0.75, "correctness_loss")}


def counterfactuals(invariants_: DataFrame, goals_: DataFrame) -> DataFrame:
    """What would break without the supports of invariants, without progress, and without goals."""
    loss = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LOSS.items() for x in kv]), F.col("predicate")), F.lit("correctness_loss"))

    def rows(df, condition, affected, severity, confidence, category):
        return df.select(*_SPAN, condition.alias("condition"), affected.alias("affected"), severity.alias("severity"),
                         confidence.alias("confidence"), category.alias("category"))

    name = F.col("subject")
    deps = rows(invariants_.select("*", F.explode("depends_on").alias("dep")), F.concat(F.lit("without "), "dep"), name,
                F.when(F.col("predicate").isin("termination", "loop_invariant"), "critical").otherwise("major"), F.col("confidence") * 0.8, loss)
    stuck = rows(invariants_.filter("predicate = 'progress'"), F.concat(F.lit("no progress: "), name), name, F.lit("critical"), F.col("confidence") * 0.9, F.lit("termination_loss"))
    out = deps.unionByName(stuck)
    for kind, (severity, factor, category) in GOAL_LOSS.items():
        out = out.unionByName(rows(goals_.filter(F.col("goal") == kind), F.concat(F.lit(f"not {kind}: "), "target"), F.col("target"), F.lit(severity),
                                   F.col("confidence") * factor, F.lit(category)))
    best = F.max(F.struct("confidence", "severity", "category"))
    return out.groupBy(*_SPAN, "condition", "affected").agg(best.alias("b")).select(*_SPAN, "condition", "affected", "b.severity", "b.confidence", "b.category")


# Operations and pattern names of each motif, and the goal that supports it.
MOTIFS = {
    "uncertainty_reduction": (["search", "binary_search", "narrow", "partition"], ["binary_search", "ternary_search", "bisect"], "minimize", 0.15),
    "state_compression": (["memo", "cache", "dp", "lookup", "store"], ["dynamic_programming", "memoization", "dp"], "compress", 0.2),
    "frontier_expansion": (["enqueue", "dequeue", "expand", "visit", "bfs", "dfs"], ["bfs", "dfs", "dijkstra", "graph_traversal"], "maximize", 0.1),
    "constraint_propagation": (["backtrack", "prune", "try", "undo", "constraint"], ["backtracking", "n_queens", "sudoku", "permutation"], "", 0.0),
    "fixed_point_convergence": (["iterate", "relax", "update", "converge", "stable"], ["bellman_ford", "floyd_warshall", "page_rank", "iterative"], "converge", 0.15),
}


def motifs(events: DataFrame, goals_: DataFrame, spans: DataFrame) -> DataFrame:
    """Deep patterns of each span by its tags, its pattern's name and its goals."""
    words = sorted({w for ops, *_ in MOTIFS.values() for w in ops})
    tags = inside(events, spans).select(*_SPAN, F.explode("tags").alias("t")).filter(F.col("t").isin(words)).groupBy(*_SPAN).agg(F.collect_set("t").alias("t"))
    aims = goals_.groupBy(*_SPAN).pivot("goal", ["minimize", "maximize", "converge", "compress"]).count()
    s = spans.select(*_SPAN, F.lower(F.coalesce("pattern", F.lit(""))).alias("p")).join(tags, _SPAN, "left").join(aims, _SPAN, "left")
    s = s.na.fill(0, ["minimize", "maximize", "converge", "compress"]).withColumn("t", F.coalesce("t", F.array().cast("array<string>")))
    rated = []
    for name, (ops, patterns, goal, worth) in MOTIFS.items():
        score = F.least(F.size(F.array_intersect("t", F.array(*[F.lit(o) for o in ops]))) * 0.2, F.lit(0.5))
        for p in patterns:
            score = score + F.when(F.col("p").contains(p), 0.3).otherwise(0.0)
        if goal:
            score = score + F.col(goal) * worth
        rated.append(F.struct(F.lit(name).alias("motif"), F.round(score, 6).alias("score")))
    out = s.select(*_SPAN, F.inline(F.array(*rated))).filter("score >= 0.25")
    return out.select(*_SPAN, "motif", F.least("score", F.lit(1.0)).alias("confidence"),
                      F.when(F.col("score") < 0.4, 0).when(F.col("score") < 0.6, 1).otherwise(2).alias("depth"))


# ---- constraint facts

# Other words for kinds and relations of facts.
ALIASES = [
    ("monotonic", "positive", "monotonic", "increasing"), ("monotonic", "up", "monotonic", "increasing"), ("monotonic", "growing", "monotonic", "increasing"),
    ("monotonic", "negative", "monotonic", "decreasing"), ("monotonic", "down", "monotonic", "decreasing"), ("monotonic", "shrinking", "monotonic", "decreasing"),
    ("paired", "range", "paired", "interval"), ("paired", "bounds", "paired", "interval"), ("paired", "ordered", "paired", "sorted"),
    ("converges", "meets", "converges", "converges_with"), ("converges", "approaches", "converges", "converges_with"),
    ("objective", "reduce", "objective", "minimize"), ("objective", "shrink", "objective", "minimize"),
    ("objective", "grow", "objective", "maximize"), ("objective", "expand", "objective", "maximize"),
    ("objective", "reach", "objective", "converge"), ("objective", "stabilize", "objective", "converge"),
    ("objective", "maintain", "objective", "preserve"), ("objective", "keep", "objective", "preserve"),
]


def fact_id() -> Column:
    return F.concat_ws(":", "kind", "subject", F.coalesce("relation", F.lit("")), F.coalesce("value", F.lit("None")))


def dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    """Rows with whole spans in as many parts as asked, before they are aggregated.

    Most facts stand for one step, so that merging them ahead of the shuffle
    would only hold them all; a number of parts that grows with the trace
    bounds what one task holds.
    """
    return rows if parts is None else rows.repartition(parts, *_SPAN)


def canonical(facts: DataFrame, parts: int | None = None) -> DataFrame:
    """Facts under their usual names, equal ones merged: highest confidence, widest steps."""
    table = F.broadcast(facts.sparkSession.createDataFrame(ALIASES, "kind string, relation string, _k string, _r string"))
    named = facts.join(table, ["kind", "relation"], "left").withColumn("kind", F.coalesce("_k", "kind")).withColumn("relation", F.coalesce("_r", "relation"))
    return dealt(named.withColumn("id", fact_id()), parts).groupBy(*_SPAN, "id", "kind", "subject", "relation", "value").agg(
        F.min("first_step").alias("first_step"), F.max("last_step").alias("last_step"), F.max("confidence").alias("confidence"))


def observed_facts(events: DataFrame, courses: DataFrame, spans: DataFrame, intervals=INTERVALS, meeting=MEETING, parts: int | None = None) -> DataFrame:
    """Facts that follow directly from events and courses of variables; ``parts`` as in ``dealt``."""
    none = F.lit(None).cast("string")

    def rows(df, kind, subject, relation, a, b, value=none):
        return df.select(*_SPAN, F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), relation.alias("relation"), value.alias("value"),
                         a.cast("long").alias("first_step"), b.cast("long").alias("last_step"), F.lit(1.0).alias("confidence"))

    a, b, var, empty = F.col("first_step"), F.col("last_step"), F.col("var"), F.lit("")
    t = courses.filter("n >= 2")
    mono = rows(t.filter("up OR down"), "monotonic", var, F.when(F.col("up"), "increasing").otherwise("decreasing"), a, b)
    changes = rows(t, "changes", var, empty, a, b)
    grown = rows(courses.filter(F.lower("var").isin(ACCUMULATORS[:6])), "accumulates", var, empty, a, b)
    pair = _paired(courses, intervals)
    paired = rows(pair, "paired", F.concat_ws(",", "a", "b"), F.lit("interval"), F.least("x.first_step", "y.first_step"), F.greatest("x.last_step", "y.last_step"))
    d0, d1 = F.abs(F.col("x.first") - F.col("y.first")), F.abs(F.col("x.last") - F.col("y.last"))
    met = _paired(courses, meeting).filter("x.n >= 2 AND y.n >= 2").filter((d0 > 0) & (d1 < d0 * 0.3))
    converges = rows(met, "converges", F.concat_ws(",", "a", "b"), F.lit("converges_with"), F.col("x.first_step"), F.col("x.last_step"))
    e, step = inside(events, spans), F.col("step")
    kind = F.col("event_type")
    looping = rows(e.filter(kind.isin("loop", "condition", "loop_guard")), "looping", step, empty, step, step)
    recursive = rows(e.filter((kind == "recursive_call") | _tag("recursive")), "recursive", F.coalesce("target_var", F.lit("?")), empty, step, step)
    base = rows(e.filter((kind == "base_case") | _tag("base_case")), "base_case", step, empty, step, step)
    memo = rows(e.filter(F.arrays_overlap("tags", F.array(*[F.lit(m) for m in MEMO_TAGS]))), "memoized", F.coalesce("target_var", F.lit("memo")), empty, step, step)
    out = mono
    for part in (changes, grown, paired, converges, looping, recursive, base, memo):
        out = out.unionByName(part)
    return canonical(out, parts)


# Rules as name, needed (kind, relation, bind) and produced (kind, subject, relation, confidence factor).
# ``bind`` "same" asks for one subject throughout; a produced subject "*" is that of the first need.
RULES = [
    [("interval_shrinks", [("paired", "interval", ""), ("monotonic", "increasing", ""), ("monotonic", "decreasing", "")], [("shrinks", "*", "")]),
     ("accumulation_maximization", [("accumulates", None, "same"), ("monotonic", "increasing", "same")], [("objective", "maximize", "*")]),
     ("memoization_compression", [("memoized", None, "")], [("objective", "compress", "state_space"), ("invariant", "progress", "subproblems_cached")]),
     ("recursion_base_case_termination", [("recursive", None, ""), ("base_case", None, "")], [("invariant", "termination", "base_case_reached")]),
     ("loop_guard_invariant", [("looping", None, "")], [("invariant", "loop_invariant", "guard_holds")]),
     ("ordering_preservation", [("paired", "sorted", "")], [("objective", "preserve", "ordering"), ("invariant", "postcondition", "sorted_output")]),
     ("no_memo_counterfactual", [("memoized", None, ""), ("recursive", None, "")], [("counterfactual", "memo_removed", "exponential_blowup")])],
    [("shrinking_interval_progress", [("shrinks", None, ""), ("looping", None, "")], [("invariant", "progress", "interval_shrinks"), ("objective", "minimize", "search_space")]),
     ("convergence_termination", [("converges", None, ""), ("shrinks", None, "")], [("invariant", "termination", "convergence"), ("objective", "converge", "*")])],
    [("no_progress_counterfactual", [("invariant", "@progress", ""), ("looping", None, "")], [("counterfactual", "progress_violated", "infinite_loop")])],
]


def _flat(rules) -> list[tuple]:
    return [r for part in rules for r in (part if isinstance(part, list) else [part])]


def strata(rules) -> list[tuple[list[tuple], bool]]:
    """Rules in groups, each after the groups whose conclusions it needs; with each, whether it feeds itself.

    One rule depends on another that concludes a kind it needs; rules that
    depend on each other in a circle form one group.
    """
    rules = _flat(rules)
    n = len(rules)
    made = [{kind for kind, _, _ in produces} for _, _, produces in rules]
    needed = [{kind for kind, _, _ in needs} for _, needs, _ in rules]
    after = [[bool(made[j] & needed[i]) for j in range(n)] for i in range(n)]
    for k in range(n):
        for i in range(n):
            if after[i][k]:
                after[i] = [x or y for x, y in zip(after[i], after[k])]
    groups, left = [], set(range(n))
    while left:
        free = [i for i in left if all(j not in left or after[j][i] for j in range(n) if after[i][j])]
        now = {i for i in free if not after[i][i]} or {i for i in free if i == min(free) or (after[i][min(free)] and after[min(free)][i])}
        groups.append(([rules[i] for i in sorted(now)], any(after[i][i] for i in now)))
        left -= now
    return groups


def _fits(facts: DataFrame, kind: str, relation: str | None) -> DataFrame:
    fit = facts.filter(F.col("kind") == kind)
    if relation and relation.startswith("@"):
        return fit.filter(F.col("subject") == relation[1:])
    return fit.filter(F.col("relation") == relation) if relation else fit


def _conclusions(rules: list[tuple], known: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What a group of rules concludes from ``known`` in one pass, and the facts behind it.

    Facts are first reduced per kind, relation and subject; every need of
    every rule reads that table.
    """
    kinds = sorted({kind for _, needs, _ in rules for kind, _, _ in needs})
    reduced = checkpointed(dealt(known.filter(F.col("kind").isin(*kinds)), parts).groupBy(*_SPAN, "kind", "relation", "subject").agg(
        F.max("confidence").alias("c"), F.min("first_step").alias("a"), F.max("last_step").alias("b")))
    rows, links = None, None
    for name, needs, produces in rules:
        bound = any(bind == "same" for _, _, bind in needs) or any("*" in p for p in produces)
        met, by_need = None, []
        for i, (kind, relation, bind) in enumerate(needs):
            by = [*_SPAN, "_s"] if bound and (i == 0 or bind == "same") else _SPAN
            by_need.append(by)
            g = _fits(reduced, kind, relation).withColumn("_s", F.col("subject")).groupBy(*by).agg(
                F.max("c").alias(f"_c{i}"), F.min("a").alias(f"_a{i}"), F.max("b").alias(f"_b{i}"))
            met = g if met is None else met.join(g, by)
        n = range(len(needs))

        def many(fn, p):
            return fn(*[F.col(f"{p}{i}") for i in n]) if len(needs) > 1 else F.col(f"{p}0")

        for kind, subject, relation in produces:
            sub = F.col("_s") if subject == "*" else F.lit(subject)
            rel = F.col("_s") if relation == "*" else F.lit(relation)
            row = met.select(
                *_SPAN, *(["_s"] if bound else []), F.lit(kind).alias("kind"), sub.alias("subject"), rel.alias("relation"), F.lit(None).cast("string").alias("value"),
                many(F.least, "_a").alias("first_step"), many(F.greatest, "_b").alias("last_step"), many(F.least, "_c").alias("confidence")).withColumn("id", fact_id())
            rows = row.drop("_s") if rows is None else rows.unionByName(row.drop("_s"))
            for (need, asked, _), by in zip(needs, by_need):
                fit = _fits(known, need, asked).select(*_SPAN, F.col("subject").alias("_s"), F.col("id").alias("source_id"))
                link = row.select(*by, "id").distinct().join(fit, by).select(*_SPAN, "id", F.lit(name).alias("rule"), "source_id")
                links = link if links is None else links.unionByName(link)
    merged = rows.groupBy(*_SPAN, "id", "kind", "subject", "relation", "value").agg(
        F.min("first_step").alias("first_step"), F.max("last_step").alias("last_step"), F.max("confidence").alias("confidence"))
    return merged, links


def derive(facts: DataFrame, rules=RULES, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts that follow by a table of rules, and everything each rests on.

    ``rules`` holds ``(name, needs, produces)`` as in ``RULES``; the order in
    which they apply follows from what they need and conclude, so a user's
    rules may be added in any order. Rules that feed themselves are applied
    until nothing new follows: conclusions name only subjects that are there
    or that a rule states, so this ends. A conclusion keeps all facts that
    meet its needs as sources; its confidence is the least of the surest fact
    of each need. ``facts`` are kept as they are; only conclusions are written.
    """
    known, derived, sources = ordered.read_twice(facts), None, None
    for group, circular in strata(rules):
        seen = None
        while True:
            merged, links = _conclusions(group, known, parts)
            if circular:
                merged = checkpointed(merged if seen is None else merged.join(seen.select(*_SPAN, "id"), [*_SPAN, "id"], "left_anti"))
                if seen is not None and merged.isEmpty():
                    break
                seen = merged if seen is None else seen.unionByName(merged)
            else:
                merged = checkpointed(merged)
            derived = merged if derived is None else derived.unionByName(merged)
            known = known.unionByName(merged)
            if not circular:
                break
        sources = links if sources is None else sources.unionByName(links)
    return derived, sources.distinct()


def contradictions(facts: DataFrame) -> DataFrame:
    """Subjects said to rise and fall, or to stay and to move."""
    says = facts.filter("kind IN ('monotonic', 'constant')").groupBy(*_SPAN, "subject").agg(
        F.bool_or((F.col("kind") == "monotonic") & (F.col("relation") == "increasing")).alias("up"),
        F.bool_or((F.col("kind") == "monotonic") & (F.col("relation") == "decreasing")).alias("down"), F.bool_or(F.col("kind") == "constant").alias("still"))
    found = F.array_compact(F.array(
        F.when(F.col("up") & F.col("down"), F.struct(F.lit("contradictory_monotonicity").alias("type"), F.lit("critical").alias("severity"))),
        F.when(F.col("still") & (F.col("up") | F.col("down")), F.struct(F.lit("constant_vs_monotonic").alias("type"), F.lit("warning").alias("severity")))))
    return says.select(*_SPAN, "subject", F.inline(found))


def proofs(sources: DataFrame, max_depth: int | None = None, **kw) -> DataFrame:
    """Everything each derived fact rests on, with the least depth."""
    key = F.concat_ws("|", "run_id", F.col("span_id").cast("string"))
    links = sources.select("run_id", "span_id", key.alias("graph"), F.col("id").alias("from_node"), F.col("source_id").alias("to_node")).distinct()
    seeds = links.select("graph", F.col("from_node").alias("seed"), F.col("from_node").alias("node")).distinct()
    found = reach(links.select("graph", "from_node", "to_node"), seeds, "graph", max_depth=max_depth, **kw).filter("depth > 0")
    return found.select(F.substring_index("graph", "|", 1).alias("run_id"), F.substring_index("graph", "|", -1).alias("span_id"),
                        F.col("seed").alias("id"), F.col("node").alias("source_id"), "depth")


def merge_conclusions(derived: DataFrame, heuristic: DataFrame, keys: list[str]) -> DataFrame:
    """Derived rows, then heuristic ones whose key was not derived."""
    return derived.unionByName(heuristic.join(derived.select(*_SPAN, *keys).distinct(), [*_SPAN, *keys], "left_anti"))


def derived_goals(derived: DataFrame) -> DataFrame:
    return derived.filter("kind = 'objective'").select(*_SPAN, F.col("subject").alias("goal"), F.col("relation").alias("target"), "confidence")


# Suggested actions as source, what it says, type, title and factor of confidence.
ACTIONS = [
    ("goal", "minimize", "optimize", "optimize the computation of %s", 0.8), ("goal", "maximize", "optimize", "optimize the accumulation of %s", 0.7),
    ("goal", "converge", "verify", "verify that %s converges", 0.6), ("goal", "preserve", "verify", "verify that %s is kept", 0.7),
    ("violation", "*", "debug", "repair the violated invariant %s", 0.9), ("guard", "loop", "add_guard", "assert %s", 0.4), ("guard", "bound", "add_guard", "assert %s", 0.4),
    ("counterfactual", "high", "add_guard", "guard against: %s", 0.8), ("counterfactual", "medium", "verify", "verify: %s", 0.5),
    ("motif", "divide_and_conquer", "add_memo", "add memoization", 0.8), ("motif", "greedy_choice", "verify", "verify the greedy choice", 0.6),
    ("motif", "dynamic_programming", "optimize", "reduce the space of the table", 0.5), ("motif", "backtracking", "optimize", "prune the search", 0.7),
    ("conflict", "*", "debug", "resolve the conflict about %s", 0.9),
    ("pattern", "recursive_fibonacci", "optimize", "use matrix powers", 0.7), ("pattern", "bubble_sort", "refactor", "use a faster sort", 0.8),
    ("pattern", "linear_search", "optimize", "use a hash table", 0.6),
]


def suggest_actions(goals_=None, invariants_=None, counterfactuals_=None, motifs_=None, conflicts=None, matches=None) -> DataFrame:
    """Actions that conclusions speak for; one per span, type and title, the most urgent."""
    one = F.lit(1.0)

    def said(df, source, what, subject, confidence):
        return df.select(*_SPAN, F.lit(source).alias("source"), what.alias("what"), subject.cast("string").alias("subject"), confidence.alias("confidence"))

    parts = []
    if goals_ is not None:
        parts.append(said(goals_, "goal", F.col("goal"), F.col("target"), F.col("confidence")))
    if invariants_ is not None:
        parts += [said(invariants_.filter("violated > 0"), "violation", F.lit("*"), F.col("subject"), F.col("confidence")),
                  said(invariants_, "guard", F.col("predicate"), F.col("subject"), F.col("confidence"))]
    if counterfactuals_ is not None:
        parts.append(said(counterfactuals_, "counterfactual", F.col("severity"), F.col("condition"), F.col("confidence")))
    if motifs_ is not None:
        parts.append(said(motifs_, "motif", F.col("motif"), F.lit(""), F.col("confidence")))
    if conflicts is not None:
        parts.append(said(conflicts, "conflict", F.lit("*"), F.col("subject"), one))
    if matches is not None:
        parts.append(said(matches, "pattern", F.col("pattern"), F.lit(""), one))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    table = F.broadcast(every.sparkSession.createDataFrame(ACTIONS, "source string, what string, action_type string, form string, factor double"))
    named = every.join(table, ["source", "what"]).withColumn("title", F.replace("form", F.lit("%s"), F.col("subject")))
    return named.groupBy(*_SPAN, "action_type", "title").agg(F.max(F.col("confidence") * F.col("factor")).alias("priority"))
