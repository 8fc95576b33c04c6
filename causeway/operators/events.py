"""Typed events of a run, and patterns in their order."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import ordered
from causeway.functions.folding import fold_runs, settle_keys
from causeway.functions.values import round3

# Attributes that lead along a structure, methods of lists, names of node classes, first values.
POINTERS = "next|prev|left|right|children|child|parent"
LIST_METHODS = "append|extend|insert|remove|pop|sort|reverse"
NODE_CLASSES = ["Node", "TreeNode", "ListNode"]
INITIAL = ["0", "1", "None", "True", "False", "{}", "[]"]

_CALL = r"^([\w.]+)\([^()]*(?:\([^()]*\)[^()]*)*\)$"
_POINTER = rf"^(\w+)\s*=\s*(\w+)\.({POINTERS})$"
_LIST = rf"^(\w+)\.({LIST_METHODS})\((.*)\)$"
_AUG = r"^([\w.]+)[^=<>!]*?\s*(?:\+|-|\*\*?|//?|%|&|\||\^|>>|<<)=(?!=)"
_TUPLE = r"^\(?(\w+)\s*,[^=(]*=(?!=)"
_ASSIGN = r"^([A-Za-z_]\w*)[\w.\[\]'\", ]*?\s*=(?!=)\s*(.*)$"
_TEST = r"^(?:if|elif|while)\s+(.*?):?$"


def line_events(lines: DataFrame) -> DataFrame:
    """Event of every distinct line, by the first form that fits.

    ``callee`` is the function an assignment or a statement calls; whether that
    is a recursive call depends on the run and is settled in ``typed_events``.
    """
    c = F.trim("code")

    def g(pattern, n=1):
        return F.regexp_extract(c, pattern, n)

    rhs = g(_ASSIGN, 2)
    test = g(_TEST)
    name = F.regexp_extract(test, r"([A-Za-z_]\w*)", 1)
    bare_not = test.rlike(r"^not\s+\w+$")
    is_none = test.rlike(r"\bis\s+None\b")
    not_none = test.rlike(r"\bis\s+not\s+None\b")
    called = F.substring_index(F.regexp_extract(c, _CALL, 1), ".", -1)

    def ev(kind, tags, target=None, callee=None, via=None):
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("event_type"),
            (F.array(*[F.lit(t) for t in tags]) if isinstance(tags, list) else tags).cast("array<string>").alias("tags"),
            (none if target is None else target).alias("target_var"), (none if callee is None else callee).alias("callee"),
            (none if via is None else via).alias("via"))

    def tags(*names):
        return F.array(*[F.lit(n) for n in names])

    event = (
        F.when(c.rlike(_POINTER), ev("pointer_move", ["pointer", "traversal"], g(_POINTER), None, g(_POINTER, 3)))
        .when(c.rlike(_LIST), ev("list_op", F.when((g(_LIST, 2) == "append") & (g(_LIST, 3) != ""), tags("list_mutation", "append"))
                                 .otherwise(tags("list_mutation")), g(_LIST)))
        .when(c.rlike(r"^\w+\(.*\)$") & c.rlike(_CALL), ev("function_call", ["function_call"], None, called))
        .when(c.rlike(_AUG) & g(_AUG).contains("."), ev("pointer_update", ["pointer", "mutation"], g(_AUG)))
        .when(c.rlike(_AUG), ev("assignment", ["accumulation"], g(_AUG)))
        .when(c.rlike(r"^(if|elif|while)\b"), ev(
            "condition", F.when(bare_not | is_none, tags("null_check", "base_case")).when(not_none, tags("null_check")).otherwise(tags("branch")),
            F.when(bare_not, F.regexp_extract(test, r"(\w+)$", 1)).otherwise(name)))
        .when(c.rlike(r"^return\b"), ev("return", ["return"], None, F.substring_index(F.regexp_extract(c, r"^return\s+([\w.]+)\(.*\)$", 1), ".", -1)))
        .when(c.rlike(r"^for\b"), ev("loop", ["loop", "iteration"], F.regexp_extract(c, r"^for\s+\(?(\w+)", 1)))
        .when(c.rlike(r"^class\b"), ev("class_def", ["class_definition"])).when(c.rlike(r"^(async )?def\b"), ev("function_def", ["function_definition"]))
        .when(c.rlike(_TUPLE), ev("assignment", ["tuple_unpack"], g(_TUPLE)))
        .when(c == "pass", ev("pass", [])).when(c == "break", ev("break", ["loop_control"])).when(c == "continue", ev("continue", ["loop_control"]))
        .when(c.startswith("#"), ev("comment", [])).when(c.rlike("^(import|from) "), ev("import", []))
        .when(c.rlike(_ASSIGN) & rhs.rlike(_CALL), ev("assignment", ["function_call"], g(_ASSIGN), F.substring_index(F.regexp_extract(rhs, _CALL, 1), ".", -1)))
        .when(c.rlike(_ASSIGN), ev("assignment", [], g(_ASSIGN))).otherwise(ev("unknown", []))
    )
    return lines.select("code").distinct().withColumn("_e", event).select("code", "_e.*")


def typed_events(steps: DataFrame, snapshots: DataFrame, functions: DataFrame | None = None, **kw) -> DataFrame:
    """The event of every step.

    ``functions`` (``run_id, callee``) names the functions of each run; calls to
    them are recursive. A plain assignment is an initialization when the
    variable then holds a first value.
    """
    rows = steps.select("run_id", "step", "code", "depth", "call_id").join(line_events(steps), "code")
    held = snapshots.filter(F.col("value").isin(INITIAL)).select("run_id", "step", F.col("var").alias("target_var"), F.lit(True).alias("_first"))
    rows = rows.join(held, ["run_id", "step", "target_var"], "left")
    if functions is not None:
        own = functions.select("run_id", "callee").distinct().withColumn("_own", F.lit(True))
        rows = rows.join(own, ["run_id", "callee"], "left")
        recursive = F.coalesce("_own", F.lit(False))
    else:
        recursive = F.lit(False)
    kind = F.col("event_type")
    plain = (kind == "assignment") & (F.size("tags") == 0)
    created = (kind == "assignment") & F.col("callee").isin(NODE_CLASSES)

    def tags(*names):
        return F.array(*[F.lit(n) for n in names])

    t = (
        F.when(created, tags("node_creation", "heap_alloc")).when(recursive & (kind == "assignment"), tags("recursion", "function_call"))
        .when(recursive & (kind == "function_call"), tags("recursion")).when(recursive & (kind == "return"), tags("return", "recursion"))
        .when(plain & F.col("_first"), tags("initialization")).otherwise(F.col("tags"))
    )
    k = F.when(recursive & kind.isin("assignment", "function_call") & ~created, "recursive_call").otherwise(kind)
    out = rows.select("run_id", "step", k.alias("event_type"), t.alias("tags"), "depth", "call_id", "target_var", "via")
    prev = ordered.previous_row(out, ["run_id"], "step", {"_depth": F.col("depth")}, **kw)
    return prev.withColumn("depth_delta", F.coalesce(F.col("depth") - F.col("_depth"), F.lit(0))).drop("_depth")


# ---- causal edges between events


def event_edges(events: DataFrame, **kw) -> DataFrame:
    """Data, control, state and recursion edges between the events of a run."""
    e = events.select("run_id", "step", "event_type", "target_var")
    named = e.filter("target_var IS NOT NULL")
    kind = F.col("event_type")
    writes = kind.isin("assignment", "pointer_move")
    seen = ordered.running(named, ["run_id", "target_var"], "step", {
        "_last": ("last", F.col("step")), "_set": ("last", F.when(writes, F.col("step")))}, **kw)

    def edges(df, cause, effect, name, var, confidence):
        return df.select("run_id", cause.alias("src"), effect.alias("dst"), F.lit(name).alias("kind"), var.alias("var"),
                         F.lit(confidence).alias("confidence"))

    var, step = F.col("target_var"), F.col("step")
    data = edges(seen.filter("_last IS NOT NULL"), F.col("_last"), step, "data_dependency", var, 0.9)
    state = edges(seen.filter(writes & F.col("_set").isNotNull()), F.col("_set"), step, "state_change", var, 0.75)
    ahead = ordered.running(e, ["run_id"], "step", {
        "_next": ("last", step), "_return": ("last", F.when(kind == "return", step))}, reverse=True, **kw)
    control = edges(ahead.filter((kind == "condition") & F.col("_next").isNotNull()), step, F.col("_next"), "control_dependency", var, 0.8)
    calls = edges(ahead.filter((kind == "recursive_call") & F.col("_return").isNotNull()), step, F.col("_return"),
                  "recursive_invocation", F.lit(None).cast("string"), 0.85)
    return data.unionByName(control).unionByName(state).unionByName(calls)


def event_roles(events: DataFrame, edges: DataFrame) -> DataFrame:
    """What part each event plays: result, trigger, propagation, convergence or isolated."""
    ends = edges.select("run_id", F.explode(F.array(
        F.struct(F.col("src").alias("step"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("step"), F.lit(False).alias("out")))).alias("e"))
    g = ends.groupBy("run_id", "e.step").agg(F.bool_or("e.out").alias("causes"), F.bool_or(~F.col("e.out")).alias("caused"))
    role = (
        F.when(F.col("event_type") == "return", "result").when(F.col("causes") & ~F.col("caused"), "trigger")
        .when(F.col("causes") & F.col("caused"), "propagation").when(F.col("caused"), "convergence").otherwise("isolated")
    )
    return events.select("run_id", "step", "event_type").join(g, ["run_id", "step"], "left").select("run_id", "step", role.alias("role"))


# ---- patterns


@dataclass(frozen=True)
class Node:
    """One step of a pattern: any of the ``(event_type, tags, target)`` specs fits."""

    name: str
    specs: tuple
    role: str
    weight: float


@dataclass(frozen=True)
class Pattern:
    """Nodes, the root-to-leaf paths through them, and whether two of them may run side by side."""

    name: str
    nodes: tuple[Node, ...]
    paths: tuple[tuple[str, ...], ...]
    min_confidence: float
    op: str
    terminates: str
    parallel: tuple[tuple[str, str], ...] = ()


def _n(name, role, weight, *specs):
    return Node(name, tuple((s if isinstance(s, tuple) else (s, ())) for s in specs), role, weight)


# The built-in patterns.
BUILTIN = (
    Pattern("linked_list_traversal", (
        _n("entry", "start_traversal", 1.0, "pointer_move"), _n("guard", "guard", 0.8, "condition"),
        _n("advance", "advance_pointer", 1.0, "pointer_move")), (("entry", "guard", "advance"),), 0.55, "traverse", "null_check"),
    Pattern("tree_dfs", (
        _n("base", "base_case", 1.0, ("condition", ("null_check",))), _n("left", "recurse_left", 0.9, "recursive_call"),
        _n("right", "recurse_right", 0.9, "recursive_call"), _n("ret", "combine", 0.7, "return")),
        (("base", "left", "right", "ret"),), 0.5, "divide", "null_check"),
    Pattern("accumulator", (
        _n("init", "init", 1.0, ("assignment", ("initialization",))), _n("loop", "iterate", 0.8, "loop"),
        _n("acc", "accumulate", 1.0, ("assignment", ("accumulation",))), _n("ret", "result", 0.6, "return")),
        (("init", "loop", "acc", "ret"),), 0.4, "accumulate", "exhaustion"),
    Pattern("memoization", (
        _n("check", "cache_lookup", 1.0, "condition"), _n("compute", "compute", 0.9, "assignment"),
        _n("store", "cache_store", 0.8, ("assignment", ("accumulation",)), "list_op"), _n("ret", "return_cached", 0.7, "return")),
        (("check", "compute", "store"), ("check", "ret")), 0.35, "transform", "convergence"),
    Pattern("fast_slow_pointer", (
        _n("slow", "slow_pointer", 1.0, "pointer_move"), _n("fast", "fast_pointer", 1.0, "pointer_move")),
        (("slow", "fast"),), 0.45, "traverse", "convergence", (("slow", "fast"),)),
    Pattern("binary_search", (
        _n("bounds", "init_bounds", 0.7, "assignment"), _n("compare", "compare", 1.0, "condition"),
        _n("narrow", "narrow_bounds", 1.0, "assignment"), _n("ret", "found", 0.6, "return")),
        (("bounds", "compare", "narrow"), ("ret",)), 0.4, "search", "bounds_check"),
    Pattern("sliding_window", (
        _n("expand", "expand_right", 1.0, "loop"), _n("update", "update_window", 0.9, "assignment"),
        _n("shrink", "shrink_left", 0.8, "assignment"), _n("ret", "result", 0.6, "return")),
        (("ret",),), 0.35, "traverse", "exhaustion"),
    Pattern("state_transition", (
        _n("init", "init_state", 0.8, ("assignment", ("initialization",))), _n("transition", "transition", 1.0, "assignment"),
        _n("transition2", "transition", 0.8, "assignment"), _n("ret", "final_state", 0.7, "return")),
        (("init", "transition", "transition2", "ret"),), 0.4, "transform", "convergence"),
)


def fits(node: Node) -> Column:
    """Whether an event fits a node; a target may end in ``*`` for a prefix."""
    out = F.lit(False)
    for spec in node.specs:
        kind, tags, target = (*spec, None)[:3] if len(spec) < 3 else spec
        ok = F.col("event_type") == kind if kind else F.lit(True)
        for t in tags:
            ok = ok & F.array_contains("tags", t)
        if target:
            held = F.coalesce("target_var", F.lit(""))
            ok = ok & (held.startswith(target[:-1]) if target.endswith("*") else held == target)
        out = out | ok
    return F.coalesce(out, F.lit(False))


def candidates(events: DataFrame, patterns=BUILTIN, window: int = 30, chunk: int | None = ordered.CHUNK) -> DataFrame:
    """Partial and whole matches of every pattern from every event.

    Each event has a text of bits per kind of node, one bit for each of the next
    ``window - 1`` events. The next event that fits a node is the next ``1`` of
    its text, so a path is a chain of look-ups, made once for paths that begin
    alike. A missing node uses up the window, so matches are prefixes of a path.
    """
    kinds = list(dict.fromkeys(n.specs for p in patterns for n in p.nodes))
    bits = {s: f"_b{i}" for i, s in enumerate(kinds)}
    probe = {s: next(n for p in patterns for n in p.nodes if n.specs == s) for s in kinds}
    fit = [F.when(fits(probe[s]), "1").otherwise("0").alias(bits[s]) for s in kinds]
    rows = ordered.with_halo(events.select("run_id", "step", *fit), "step", after=window - 2, chunk=chunk)
    w = Window.partitionBy("run_id", "_chunk").orderBy("step").rowsBetween(0, window - 2)
    text = rows.select("run_id", "step", "_halo", *[F.array_join(F.collect_list(b).over(w), "").alias(b) for b in bits.values()])
    text = text.filter("NOT _halo").drop("_halo")

    # the place where each distinct beginning of a path ends, one more node per round
    paths = [tuple(next(n for n in p.nodes if n.name == name).specs for name in path) for p in patterns for path in p.paths]
    places: dict[tuple, str] = {}
    for n in range(1, max(map(len, paths), default=0) + 1):
        fresh = [b for b in dict.fromkeys(path[:n] for path in paths if len(path) >= n)]
        added = []
        for begun in fresh:
            places[begun] = f"_p{len(places)}"
            look = f"locate('1', {bits[begun[-1]]}, {places[begun[:-1]]} + 1)" if n > 1 else f"locate('1', {bits[begun[-1]]})"
            added.append(F.expr(f"CASE WHEN {places[begun[:-1]]} > 0 THEN {look} ELSE 0 END" if n > 1 else look).alias(places[begun]))
        text = text.select("*", *added)

    found = []
    for p in patterns:
        nodes = {n.name: n for n in p.nodes}
        for path in p.paths:
            total, got, begun, ends, roles = sum(nodes[n].weight for n in path), 0.0, (), [], set()
            for name in path:
                node = nodes[name]
                begun += (node.specs,)
                got += node.weight
                roles = roles | {node.role}
                end = F.col(places[begun])
                ends = [*ends, end]
                score = F.lit(got / total)
                for a, b in p.parallel:
                    # both ends of the edge must occur inside the text matched so far
                    first = [F.expr(f"locate('1', {bits[nodes[x].specs]})") for x in (a, b)]
                    both = (first[0] > 0) & (first[0] <= end) & (first[1] > 0) & (first[1] <= end)
                    score = F.when(both, F.least(score + 0.1, F.lit(1.0))).otherwise(score)
                conf = F.least(score + len(roles) / len(p.nodes) * 0.15, F.lit(1.0))
                found.append(F.when((end > 0) & (score >= p.min_confidence), F.struct(
                    F.lit(p.name).alias("pattern"), F.col("step").alias("start_step"), (F.col("step") + end - 1).alias("end_step"),
                    F.round(score, 6).alias("raw"), F.round(conf, 6).alias("confidence"),
                    F.array(*[F.col("step") + e - 1 for e in ends]).alias("key_steps"))))
    return text.select("run_id", F.inline(F.array_compact(F.array(*found))))


def _settled(starts: list, ends: list, confidences: list, raws: list) -> list[tuple[int, float]]:
    """Matches of one run and pattern that overlap nothing surer or earlier, with their confidence.

    Of the ways to reach one end from one start the best by score stands for
    all, with the highest confidence of any.
    """
    best: dict[tuple, tuple] = {}
    for i, (a, b, c, r) in enumerate(zip(starts, ends, confidences, raws)):
        if (a, b) in best:
            top, kept, j = best[a, b]
            best[a, b] = (max(top, c), *max((kept, j), ((r, c), i), key=lambda x: x[0]))
        else:
            best[a, b] = (c, (r, c), i)
    busy, taken = 0, []
    for (a, b), (c, _, i) in sorted(best.items(), key=lambda m: (-m[1][0], m[0])):
        # the steps taken are the bits of a number
        span = ((1 << (b - a + 1)) - 1) << a
        if not busy & span:
            busy |= span
            taken.append((i, c))
    return taken


_MATCH = "run_id string, pattern string, start_step bigint, end_step bigint, confidence double, key_steps array<bigint>"
_COLS = [c.split()[0] for c in _MATCH.split(", ")]


def best_matches(found: DataFrame, chunk: int | None = ordered.CHUNK) -> DataFrame:
    """Non-overlapping matches of each pattern: most confident first, then earliest.

    Runs of one chunk are settled whole, many in one task. In longer runs each level of
    confidence is settled in turn, left to right, against the levels above it,
    chunk by chunk, so no task holds a whole run.
    """
    if chunk is None:
        return settle_keys(found.select(*_COLS, "raw"), ["run_id", "pattern"], ["start_step", "end_step", "confidence", "raw"],
                           _settled, "confidence").select(*_COLS)

    # of the ways to reach one end from one start only the best counts
    best = found.groupBy("run_id", "pattern", "start_step", "end_step").agg(
        F.max("confidence").alias("confidence"), F.max_by("key_steps", F.struct("raw", "confidence")).alias("key_steps"))
    best = best.select(*_COLS)

    # the few scores a pattern can have, ranked per pattern: as many rounds as the richest has
    scores = best.select("pattern", "confidence").distinct()
    ranked = scores.withColumn("_level", F.dense_rank().over(Window.partitionBy("pattern").orderBy(F.col("confidence").desc())))
    best = ordered.read_twice(best.join(ranked, ["pattern", "confidence"]))
    rounds = best.agg(F.max("_level")).first()[0] or 0
    kept = best.select(*_COLS).limit(0)

    def along(pdf: pd.DataFrame, state: str):
        last = json.loads(state) if state else -1
        pdf = pdf.sort_values(["start_step", "end_step"], ignore_index=True)
        rows = []
        for i, (a, b) in enumerate(zip(pdf["start_step"], pdf["end_step"])):
            if a > last:
                rows.append(i)
                last = int(b)
        return pdf.iloc[rows][_COLS], json.dumps(last)

    for level in range(1, rounds + 1):
        part = best.filter(F.col("_level") == level).select(*_COLS)
        if level > 1:
            part = part.join(_overlapping(part, kept), ["run_id", "pattern", "start_step", "end_step"], "left_anti")
        kept = kept.unionByName(fold_runs(part.select(*_COLS), ["run_id", "pattern"], "start_step", along, _MATCH, chunk, keep_state=True))
    return kept


def _overlapping(part: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``part`` that overlap a kept match; both sides are spread over the steps they cover."""
    def cover(df):
        return df.select("run_id", "pattern", "start_step", "end_step", F.explode(F.sequence("start_step", "end_step")).alias("at"))

    busy = cover(kept).select("run_id", "pattern", "at")
    return cover(part).join(busy, ["run_id", "pattern", "at"], "left_semi").select("run_id", "pattern", "start_step", "end_step").distinct()


# Composed patterns and their parts.
COMPOSED = [
    ("floyd_cycle_finder", ("fast_slow_pointer", "linked_list_traversal")),
    ("recursive_divide_and_conquer", ("tree_dfs", "accumulator")),
    ("memoized_recursion", ("tree_dfs", "memoization")),
    ("iterative_state_evolution", ("accumulator", "state_transition")),
]


def compose(matches: DataFrame, rules=COMPOSED) -> DataFrame:
    """Composed patterns of runs in which all parts occur, spanning all of them."""
    table = F.broadcast(matches.sparkSession.createDataFrame(
        [(name, part, len(parts)) for name, parts in rules for part in parts], "composite string, pattern string, parts int"))
    g = matches.join(table, "pattern").groupBy("run_id", "composite", "parts").agg(
        F.countDistinct("pattern").alias("met"), F.min("start_step").alias("start_step"), F.max("end_step").alias("end_step"),
        F.avg("confidence").alias("confidence"))
    return g.filter("met = parts").select("run_id", F.col("composite").alias("pattern"), "start_step", "end_step", "confidence")


def key_events(matches: DataFrame, composites: DataFrame, rules=COMPOSED) -> DataFrame:
    """Key steps of every match as rows; a composite has those of its parts."""
    own = matches.select("run_id", "pattern", "start_step", "end_step", F.explode("key_steps").alias("step"))
    table = F.broadcast(matches.sparkSession.createDataFrame(
        [(name, part) for name, parts in rules for part in parts], "composite string, pattern string"))
    parts = own.select("run_id", "pattern", "step").join(table, "pattern").select("run_id", F.col("composite").alias("pattern"), "step")
    of_composite = composites.select("run_id", "pattern", "start_step", "end_step").join(parts, ["run_id", "pattern"])
    return own.unionByName(of_composite.select(*own.columns)).distinct()


def rescore(matches: DataFrame, keys: DataFrame, events: DataFrame) -> DataFrame:
    """Confidence blended with structure, closeness, data flow and topology of the key events."""
    m = ["run_id", "pattern", "start_step", "end_step"]
    g = keys.join(events, ["run_id", "step"]).groupBy(*m).agg(
        F.count("*").alias("n"), F.countDistinct("event_type").alias("types"), F.min("step").alias("lo"), F.max("step").alias("hi"),
        F.count("target_var").alias("named"), F.countDistinct("target_var").alias("names"),
        F.bool_or(F.col("event_type") == "pointer_move").alias("moves"), F.countDistinct("depth").alias("depths"))
    n = F.col("n")
    structural = F.least(F.col("types") / n + 0.3, F.lit(1.0))
    temporal = F.when(n < 2, 0.5).otherwise(0.5 + 0.5 * F.least(n / (F.col("hi") - F.col("lo") + 1), F.lit(1.0)))
    flow = F.least((F.col("named") - F.col("names")) / F.greatest(n - 1, F.lit(1)) + 0.2, F.lit(1.0))
    dataflow = F.when(n < 2, 0.5).otherwise(F.least(flow + F.when(F.col("moves"), 0.2).otherwise(0.0), F.lit(1.0)))
    topology = F.least(F.lit(0.5) + F.when(F.col("depths") > 1, 0.3).otherwise(0.0) + F.when(F.col("types") < n, 0.2).otherwise(0.0), F.lit(1.0))
    total = 0.35 * structural + 0.2 * temporal + 0.25 * dataflow + 0.2 * topology
    s = g.select(*m, total.alias("_s"))
    return matches.join(s, m, "left").withColumn("confidence", F.round(F.coalesce(
        0.6 * F.col("confidence") + 0.4 * F.col("_s"), F.col("confidence")), 6)).drop("_s")


def _undominated(active: list, rows: list[tuple]) -> list[int]:
    """Places of rows, by start and confidence, that overlap no earlier kept one of at least their confidence."""
    kept = []
    for i, (a, b, c) in enumerate(rows):
        active[:] = [(e, k) for e, k in active if e >= a]
        if not any(k >= c for _, k in active):
            kept.append(i)
            # what ends no later and is no surer cannot matter any more
            active[:] = [(e, k) for e, k in active if e > b or k > c] + [(b, c)]
    return kept


def _undominated_run(starts: list, ends: list, confidences: list, patterns: list) -> list[tuple[int, float]]:
    order = sorted(range(len(starts)), key=lambda i: (starts[i], -confidences[i], patterns[i], ends[i]))
    kept = _undominated([], [(starts[i], ends[i], confidences[i]) for i in order])
    return [(order[i], confidences[order[i]]) for i in kept]


def drop_dominated(matches: DataFrame, chunk: int | None = ordered.CHUNK) -> DataFrame:
    """Without matches that overlap an earlier kept one of at least their confidence."""
    schema = "run_id string, pattern string, start_step bigint, end_step bigint, confidence double"
    cols = [c.split()[0] for c in schema.split(", ")]

    if chunk is None:
        return settle_keys(matches.select(*cols), ["run_id"], ["start_step", "end_step", "confidence", "pattern"], _undominated_run, "confidence")

    def along(pdf: pd.DataFrame, state: str):
        active = [tuple(x) for x in json.loads(state)] if state else []
        pdf = pdf.assign(_c=-pdf["confidence"]).sort_values(["start_step", "_c", "pattern", "end_step"], ignore_index=True)
        rows = _undominated(active, [(int(a), int(b), float(c)) for a, b, c in zip(pdf["start_step"], pdf["end_step"], pdf["confidence"])])
        return pdf.iloc[rows][cols], json.dumps(active)

    return fold_runs(matches.select(*cols), ["run_id"], "start_step", along, schema, chunk, keep_state=True)


def detect(events: DataFrame, patterns=BUILTIN, rules=COMPOSED, chunk: int | None = ordered.CHUNK) -> DataFrame:
    """All patterns of all runs: matched, composed, scored and freed of dominated ones."""
    atomic = ordered.read_twice(best_matches(candidates(events, patterns, chunk=chunk), chunk))
    composed = compose(atomic, rules)
    every = atomic.drop("key_steps").unionByName(composed)
    return drop_dominated(rescore(every, key_events(atomic, composed, rules), events), chunk).withColumn(
        "confidence", round3(F.col("confidence")))


# ---- cost of a run


def run_metrics(events: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """Steps, depth and calls of each run, and violated invariants when given."""
    g = events.groupBy("run_id").agg(
        F.count("*").alias("steps"), F.max("depth").alias("depth"),
        F.count_if(F.col("event_type").isin("call", "recursive_call", "function_call")).alias("calls"))
    if violations is None:
        return g.withColumn("violations", F.lit(0).cast("long"))
    v = violations.groupBy("run_id").agg(F.sum("violated").alias("violations"))
    return g.join(v, "run_id", "left").na.fill(0, ["violations"])
