"""Reachability, slices, chains and paths over edge tables.

One contract, several physical forms, chosen per key by counted properties:

* keys whose edges times seeds stay under ``LOCAL_WORK`` are searched one by
  one inside tasks that read many of them, after a single shuffle (many small runs);
* larger keys whose nodes have one way on, or whose edges all lead to earlier
  (or all to later) steps, are searched in logarithmically many rounds (``deep``);
* what is left is searched by a distributed frontier loop, one join per layer,
  with every layer written to the checkpoint folder.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.ordered import read_twice
from causeway.operators import deep
from causeway.session import checkpointed

LOCAL_WORK = 2_000_000
_COMPACT_EVERY = 12
#: Rows found after which a task gives them out, between two keys.
_GIVEN = 20_000


def _search(key, seeds: dict, adjacency, max_depth, carry):
    """Layered search from every seed of one key, given with its first ``(node, var)`` pairs.

    With ``carry`` a node is reached together with a variable, and only edges
    of that variable (or any, when it is empty) are followed on data edges. Of
    the arrivals in one layer the one from the smallest node counts, data edges
    before others.
    """
    rows = []
    for seed, first in seeds.items():
        layer = {}
        for node, var in first:
            layer[node] = (None, min(layer[node][1], var) if node in layer else var)
        seen, depth = set(layer), 0
        while layer:
            rows.extend((key, seed, node, depth, parent, var) for node, (parent, var) in layer.items())
            if max_depth is not None and depth >= max_depth:
                break
            depth += 1
            coming: dict = {}
            for node, (_, var) in layer.items():
                for to, edge_var, is_data in adjacency.get(node, ()):
                    if to in seen or (carry and is_data and var and edge_var != var):
                        continue
                    via = edge_var if carry and is_data else ""
                    arrival = (node, not is_data, via)
                    coming[to] = min(coming.get(to, arrival), arrival)
            seen.update(coming)
            layer = {to: (parent, via) for to, (parent, _, via) in coming.items()}
    return rows


def reach(
    edges: DataFrame,
    seeds: DataFrame,
    key: str = "run_id",
    *,
    max_depth: int | None = None,
    carry: bool = False,
    parents: bool = True,
    local_work: int = LOCAL_WORK,
) -> DataFrame:
    """Nodes reachable from each seed along ``from_node -> to_node``.

    ``edges`` has ``key, from_node, to_node`` (with ``carry`` also ``var,
    is_data``); ``seeds`` has ``key, seed, node`` (``carry``: ``var``). Gives
    ``key, seed, node, depth, parent`` where depth is the least number of edges
    and parent the smallest node of the layer before (null at the start; it may
    be null throughout where ``parents`` says that nobody reads it).
    """
    if not carry:
        edges = edges.select(key, "from_node", "to_node").distinct().withColumn("var", F.lit("")).withColumn(
            "is_data", F.lit(False))
        seeds = seeds.select(key, "seed", "node").distinct().withColumn("var", F.lit(""))
    else:
        edges = edges.select(key, "from_node", "to_node", "var", "is_data")
        seeds = seeds.select(key, "seed", "node", "var")
    # fresh names, so that tables of one origin can be joined and co-grouped
    edges = read_twice(edges)
    seeds = read_twice(seeds).select(*[F.col(c).alias(c) for c in (key, "seed", "node", "var")])
    edges = edges.join(seeds.select(key).distinct(), key, "left_semi")

    # the key of every seed counts, also where it has no edges
    sizes = (
        seeds.groupBy(key).agg(F.count("*").alias("_s"))
        .join(edges.groupBy(key).agg(F.count("*").alias("_e")), key, "left").na.fill(0, ["_e"])
    )
    large = sizes.filter(F.col("_e") * F.col("_s") > local_work).select(key)
    counts = sizes.agg(
        F.count_if(F.col("_e") * F.col("_s") > local_work).alias("large"),
        F.count_if(F.col("_e") * F.col("_s") <= local_work).alias("small")).first()
    if not counts["large"]:
        return _local(edges, seeds, key, max_depth, carry)
    if not counts["small"]:
        return _large(edges, seeds, key, max_depth, carry, parents)
    small_part = _local(edges.join(large, key, "left_anti"), seeds.join(large, key, "left_anti"), key, max_depth, carry)
    return small_part.unionByName(
        _large(edges.join(large, key, "left_semi"), seeds.join(large, key, "left_semi"), key, max_depth, carry, parents))


def _large(edges, seeds, key, max_depth, carry, parents) -> DataFrame:
    """Keys too large for one task, by the form their edges allow."""
    if carry:
        return _frontier(edges, seeds, key, max_depth, carry)
    numbered = _node_type(edges, "from_node") in ("bigint", "int")
    links = edges.filter("from_node <> to_node").select(key, "from_node", "to_node")
    per_node = links.groupBy(key, "from_node").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("to_node") > F.col("from_node")).alias("up"), F.count_if(F.col("to_node") < F.col("from_node")).alias("down"))
    form = F.when(F.max("n") <= 1, "lifted")
    if numbered:
        form = form.when(F.sum("up") == 0, "falling").when(F.sum("down") == 0, "rising")
    forms = checkpointed(per_node.groupBy(key).agg(form.otherwise("frontier").alias("form")))
    kinds = [r[0] for r in forms.select("form").distinct().collect()]
    kinds = kinds or ["lifted"]
    # a key that has no edges but loops goes with any of the others
    held, out = seeds.join(forms, key, "left").na.fill(kinds[0], ["form"]), None
    for kind in kinds:
        some = links if len(kinds) <= 1 else links.join(forms.filter(F.col("form") == kind), key, "left_semi")
        start = held.filter(F.col("form") == kind).drop("form")
        found = None
        if kind == "lifted":
            found = deep.climbed(some, start, key, max_depth)
        elif kind != "frontier":
            found = deep.swept(some, start, key, kind == "falling", max_depth=max_depth)
            if found is not None:
                found = _with_parents(found, some, key) if parents else found.withColumn("parent", F.lit(None).cast(_node_type(some, "from_node")))
        if found is None:
            found = _frontier(some.withColumn("var", F.lit("")).withColumn("is_data", F.lit(False)), start, key, max_depth, carry)
        out = found if out is None else out.unionByName(found)
    return out


def _with_parents(found: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """The smallest node of the layer before that leads to each node."""
    from_here = found.select(key, "seed", F.col("node").alias("from_node"), (F.col("depth") + 1).alias("depth")).join(links, [key, "from_node"])
    least = from_here.groupBy(key, "seed", F.col("to_node").alias("node"), "depth").agg(F.min("from_node").alias("parent"))
    return found.join(least, [key, "seed", "node", "depth"], "left")


def _node_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def _local(edges, seeds, key, max_depth, carry) -> DataFrame:
    """Keys that fit in a task one by one.

    Edges and seeds are shuffled and sorted by key and read in batches that
    hold many keys, so that small keys cost no table of their own.
    """
    node, seed = _node_type(edges, "from_node"), _node_type(seeds, "seed")
    kt = _node_type(edges, key)
    schema = f"{key} {kt}, seed {seed}, node {node}, depth int, parent {node}, var string"
    rows = edges.select(
        key, F.lit(None).cast(seed).alias("seed"), F.col("from_node").alias("at"), F.col("to_node").alias("to"), "var", "is_data", F.lit(False).alias("start")
    ).unionByName(seeds.select(
        key, "seed", F.col("node").cast(node).alias("at"), F.lit(None).cast(node).alias("to"), "var", F.lit(False).alias("is_data"), F.lit(True).alias("start")))

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, starts, adjacency, types = [], None, defaultdict(list), defaultdict(list), None

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), types)], [key, "seed", "node", "depth", "parent", "var"])

        for batch in batches:
            at = batch.schema.field("at").type
            types = [batch.schema.field(key).type, batch.schema.field("seed").type, at, pa.int32(), at, pa.string()]
            for k, s, a, b, var, is_data, start in zip(*[c.to_pylist() for c in batch.columns]):
                if k != now:
                    out.extend(_search(now, starts, adjacency, max_depth, carry))
                    now, starts, adjacency = k, defaultdict(list), defaultdict(list)
                    if len(out) >= _GIVEN:
                        yield given()
                        out = []
                if start:
                    starts[s].append((a, var))
                else:
                    adjacency[a].append((b, var, is_data))
        out.extend(_search(now, starts, adjacency, max_depth, carry))
        if out:
            yield given()

    out = rows.repartition(key).sortWithinPartitions(key).mapInArrow(along, schema)
    return out if carry else out.drop("var")


def _frontier(edges, seeds, key, max_depth, carry) -> DataFrame:
    edges = checkpointed(edges.repartition(key, "from_node"))
    node = _node_type(edges, "from_node")
    first = seeds.groupBy(key, "seed", "node").agg(F.min("var").alias("var")).select(
        key, "seed", "node", F.lit(0).alias("depth"), F.lit(None).cast(node).alias("parent"), "var")
    layer = checkpointed(first)
    pieces, depth = [layer], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = layer.select(key, "seed", F.col("node").alias("from_node"), F.col("var").alias("held")).join(
            edges, [key, "from_node"])
        if carry:
            step = step.filter("NOT is_data OR held = '' OR held = var").withColumn(
                "var", F.when(F.col("is_data"), F.col("var")).otherwise(""))
        arrival = F.min(F.struct(F.col("from_node").alias("parent"), ~F.col("is_data"), "var"))
        coming = step.groupBy(key, "seed", F.col("to_node").alias("node")).agg(arrival.alias("a")).select(
            key, "seed", "node", "a.parent", "a.var")
        seen = pieces[0]
        for p in pieces[1:]:
            seen = seen.unionByName(p)
        layer = checkpointed(
            coming.join(seen.select(key, "seed", "node"), [key, "seed", "node"], "left_anti")
            .select(key, "seed", "node", F.lit(depth).alias("depth"), "parent", "var"))
        if layer.isEmpty():
            break
        pieces.append(layer)
        if len(pieces) > _COMPACT_EVERY:
            merged = pieces[0]
            for p in pieces[1:]:
                merged = merged.unionByName(p)
            pieces = [checkpointed(merged)]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out if carry else out.drop("var")


def _directed(edges: DataFrame, kinds: list[str], backward: bool) -> DataFrame:
    f, t = ("dst", "src") if backward else ("src", "dst")
    return edges.filter(F.col("kind").isin(*kinds)).select(
        "run_id", F.col(f).alias("from_node"), F.col(t).alias("to_node"), "var", (F.col("kind") == "data").alias("is_data"))


def _as_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds ``(run_id, step[, var])`` as search starts, one search per step."""
    var = F.coalesce(F.col("var"), F.lit("")) if "var" in seeds.columns else F.lit("")
    return seeds.select("run_id", F.col("step").alias("seed"), F.col("step").alias("node"), var.alias("var"))


# ---- slices of a run


def backward_slice(edges: DataFrame, seeds: DataFrame, **kw) -> DataFrame:
    """Steps that the seed steps depend on, with least depth and root flag.

    A root has no incoming data or control edge. All sources of a slice step's
    edges are in the slice as well, so "from inside" needs no second look-up.
    """
    found = reach(_directed(edges, ["data", "control", "parameter"], True), _as_seeds(seeds), parents=False, **kw)
    return _flag(found, edges.filter("kind IN ('data', 'control')").select("run_id", F.col("dst").alias("node")), "is_root")


def _flag(found: DataFrame, linked: DataFrame, name: str) -> DataFrame:
    linked = linked.distinct().withColumn("_linked", F.lit(True))
    return found.join(linked, ["run_id", "node"], "left").select(
        "run_id", "seed", F.col("node").alias("step"), "depth", F.col("_linked").isNull().alias(name))


def slice_edges(edges: DataFrame, slice_: DataFrame) -> DataFrame:
    """Edges a backward slice followed: all that end in it."""
    followed = edges.filter("kind IN ('data', 'control', 'parameter')")
    ends = slice_.select("run_id", "seed", F.col("step").alias("dst"))
    return followed.join(ends, ["run_id", "dst"])


def forward_impact(edges: DataFrame, seeds: DataFrame, carry_var: bool = False, **kw) -> DataFrame:
    """Steps the seed steps influence, with least depth and leaf flag.

    ``carry_var`` follows a data edge only while it is about the variable the
    step was reached by; otherwise the whole closure is taken.
    """
    found = reach(_directed(edges, ["data", "control", "call"], False), _as_seeds(seeds), carry=carry_var, parents=False, **kw)
    links = edges.filter("kind IN ('data', 'control', 'call')").select("run_id", "src", "dst")
    if not carry_var:
        return _flag(found, links.select("run_id", F.col("src").alias("node")), "is_leaf")
    found = read_twice(found)
    inside = found.select("run_id", "seed", F.col("node").alias("src")).join(links, ["run_id", "src"]).join(
        found.select("run_id", "seed", F.col("node").alias("dst")), ["run_id", "seed", "dst"], "left_semi"
    ).select("run_id", "seed", F.col("src").alias("node")).distinct().withColumn("_linked", F.lit(True))
    return found.join(inside, ["run_id", "seed", "node"], "left").select(
        "run_id", "seed", F.col("node").alias("step"), "depth", F.col("_linked").isNull().alias("is_leaf"))


def timeline_slice(steps, data, blocks, bindings, seeds, **kw) -> DataFrame:
    """Backward slice over data edges, block conditions and argument bindings.

    A step that reads a parameter of its own call continues at the call site.
    A root has no incoming data edge and sits in no controlled block.
    """
    at = steps.select("run_id", "step", "block_id", "call_id", "reads")
    conditions = at.join(
        blocks.filter("condition_step >= 0").select("run_id", "block_id", "condition_step"), ["run_id", "block_id"])
    crossing = at.select("run_id", "call_id", "step", F.explode("reads").alias("param")).join(
        bindings, ["run_id", "call_id", "param"])
    followed = (
        data.select("run_id", F.col("dst").alias("from_node"), F.col("src").alias("to_node"))
        .unionByName(conditions.select("run_id", F.col("step").alias("from_node"), F.col("condition_step").alias("to_node")))
        .unionByName(crossing.select("run_id", F.col("step").alias("from_node"), F.col("caller_step").alias("to_node")))
    )
    found = reach(followed, _as_seeds(seeds), parents=False, **kw)
    held = data.select("run_id", F.col("dst").alias("node")).unionByName(
        conditions.select("run_id", F.col("step").alias("node")))
    return _flag(found, held, "is_root")


def version_slice(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, **kw) -> DataFrame:
    """Chain of variable versions behind ``(run_id, step, var)``.

    The start is the latest version of the variable at or before the step, or
    its last version when there is none. The first link by step is the root
    cause, the last the failure point.
    """
    n = F.struct("n", "version")
    asked = seeds.select("run_id", F.col("step").alias("asked"), "var")
    start = nodes.join(asked, ["run_id", "var"]).groupBy("run_id", "var", "asked").agg(
        F.coalesce(F.max(F.when(F.col("step") <= F.col("asked"), n)), F.max(n)).alias("v")
    ).select("run_id", F.concat_ws("@", "var", F.col("asked").cast("string")).alias("seed"), F.col("v.version").alias("node"))
    back = edges.select("run_id", F.col("dst").alias("from_node"), F.col("src").alias("to_node"))
    found = reach(back, start, max_depth=max_depth, parents=False, **kw).drop("parent").withColumnRenamed("node", "version")
    chain = found.join(nodes, ["run_id", "version"])
    ends = chain.groupBy("run_id", "seed").agg(
        F.min(F.struct("step", "version")).alias("lo"), F.max(F.struct("step", "version")).alias("hi"))
    role = (
        F.when(F.col("version") == F.col("lo.version"), "root_cause")
        .when(F.col("version") == F.col("hi.version"), "failure_point").otherwise("contributor")
    )
    return chain.join(ends, ["run_id", "seed"]).withColumn("role", role).drop("lo", "hi")


# ---- causal graphs

# Parents are followed in this order of edge types.
PRIORITY = ["THROWS", "CONFIG_INFLUENCE", "DATA_DEPENDENCY", "CALL_RELATION", "RUNTIME_TRACE", "CONTROL_FLOW"]


def _reversed(cedges: DataFrame) -> DataFrame:
    return cedges.select("graph_id", F.col("dst").alias("from_node"), F.col("src").alias("to_node"))


def _starts(starts: DataFrame) -> DataFrame:
    return starts.select("graph_id", F.col("node_id").alias("seed"), F.col("node_id").alias("node"))


def _behind(cedges: DataFrame, starts: DataFrame) -> DataFrame:
    """Edges that a search back from the starts may follow: those into a start, or into a node that leads to another."""
    may = starts.select("graph_id", F.col("node_id").alias("dst")).unionByName(cedges.select("graph_id", F.col("src").alias("dst"))).distinct()
    return cedges.join(may, ["graph_id", "dst"], "left_semi")


def ancestors(cedges: DataFrame, starts: DataFrame, max_depth: int | None = None, **kw) -> DataFrame:
    """Layers of ancestors of every start node."""
    return reach(_reversed(_behind(cedges, starts)), _starts(starts), "graph_id", max_depth=max_depth, **kw).withColumnRenamed("depth", "layer")


def priority(edge_type: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), edge_type)
    return F.when(rank > 0, rank - 1).otherwise(F.lit(99))


def primary_parents(cedges: DataFrame) -> DataFrame:
    """The incoming edge of each node that comes first by type, then by source."""
    best = F.min(F.struct(priority(F.col("edge_type")).alias("p"), "src", "edge_type"))
    return cedges.groupBy("graph_id", "dst").agg(best.alias("b")).select("graph_id", "dst", "b.src", "b.edge_type")


def root_cause_chain(cedges: DataFrame, errors: DataFrame, max_depth: int | None = None, **kw) -> DataFrame:
    """Everything behind each error node, and the primary chain through it.

    ``on_chain`` marks the nodes met by always taking the primary parent.
    """
    cedges = read_twice(_behind(cedges.select("graph_id", "src", "dst", "edge_type"), errors))
    everything = reach(_reversed(cedges), _starts(errors), "graph_id", max_depth=max_depth, parents=False, **kw)
    several = cedges.select("graph_id", "dst", "src").distinct().groupBy("graph_id", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if several.isEmpty():  # the only parent is the primary one
        return everything.drop("parent").withColumn("on_chain", F.lit(True))
    chain = reach(_reversed(primary_parents(cedges)), _starts(errors), "graph_id", max_depth=max_depth, parents=False, **kw)
    marked = chain.select("graph_id", "seed", "node", F.lit(True).alias("on_chain"))
    return everything.drop("parent").join(marked, ["graph_id", "seed", "node"], "left").withColumn(
        "on_chain", F.coalesce("on_chain", F.lit(False)))


def causal_chains(cedges: DataFrame, starts: DataFrame, edge_types: list[str] | None = None,
                  max_depth: int | None = None) -> DataFrame:
    """Every path from a start back to a node without incoming edges.

    No node repeats on a path. The number of paths can grow exponentially with
    depth, so the caller may bound the depth; nothing is dropped otherwise.
    """
    followed = cedges if edge_types is None else cedges.filter(F.col("edge_type").isin(*edge_types))
    followed = checkpointed(followed.select("graph_id", F.col("dst").alias("at"), "src", "edge_type").repartition("graph_id", "at"))
    inner = read_twice(cedges.select("graph_id", F.col("dst").alias("at")).distinct())
    paths = starts.select(
        "graph_id", F.col("node_id").alias("start"), F.col("node_id").alias("at"), F.array("node_id").alias("nodes"),
        F.array().cast("array<string>").alias("types"))
    done, depth = None, 0
    while True:
        if depth:
            ended = paths.join(inner, ["graph_id", "at"], "left_anti")
            done = ended if done is None else done.unionByName(ended)
        if max_depth is not None and depth >= max_depth:
            break
        grown = paths.join(followed, ["graph_id", "at"]).filter(~F.array_contains("nodes", F.col("src")))
        paths = checkpointed(grown.select(
            "graph_id", "start", F.col("src").alias("at"), F.concat("nodes", F.array("src")).alias("nodes"),
            F.concat("types", F.array("edge_type")).alias("types")))
        depth += 1
        if paths.isEmpty():
            break
    if done is None:
        done = paths.limit(0)
    return done.select("graph_id", "start", F.col("at").alias("source"), "nodes", "types")


def neighbours(cnodes: DataFrame, cedges: DataFrame) -> DataFrame:
    """Direct dependencies and dependents of every node, with edge types."""
    name = cnodes.select("graph_id", F.col("node_id").alias("other"), "code_content", "semantic_label")
    on = cedges.select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("other"), "edge_type",
                       F.lit("depends_on").alias("direction"))
    by = cedges.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("other"), "edge_type",
                       F.lit("depended_by").alias("direction"))
    return on.unionByName(by).join(name, ["graph_id", "other"])


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None, **kw) -> DataFrame:
    """A shortest path per ``(run_id, source, target)`` pair, one row per node.

    The search tree keeps the smallest parent of each node; the path is the way
    up that tree. Pairs of one run may share sources.
    """
    starts = pairs.select("run_id", F.col("source").alias("seed"), F.col("source").alias("node"))
    links = edges.select("run_id", F.col("src").alias("from_node"), F.col("dst").alias("to_node"))
    tree = checkpointed(reach(links, starts, max_depth=max_depth, **kw))
    tag = F.concat_ws(">", F.col("source").cast("string"), F.col("target").cast("string"))
    hit = pairs.join(tree.select("run_id", F.col("seed").alias("source"), F.col("node").alias("target"),
                                 F.col("depth").alias("length")), ["run_id", "source", "target"])
    # one tree per source: its edges are told apart by the source inside the key
    key = F.concat_ws("|", "run_id", F.col("seed").cast("string"))
    up = tree.filter("parent IS NOT NULL").select(
        key.alias("tree"), F.col("node").alias("from_node"), F.col("parent").alias("to_node"))
    ends = hit.select(
        F.concat_ws("|", "run_id", F.col("source").cast("string")).alias("tree"), tag.alias("seed"),
        F.col("target").alias("node"), "run_id", "length")
    walked = reach(up, ends.select("tree", "seed", "node"), "tree", **kw)
    return walked.join(ends.select("tree", "seed", "run_id", "length"), ["tree", "seed"]).select(
        "run_id", F.col("seed").alias("pair"), (F.col("length") - F.col("depth")).alias("position"),
        F.col("node").alias("step"))


# ---- statistics and look-ups


def graph_stats(steps, snapshots, edges) -> DataFrame:
    a = steps.groupBy("run_id").agg(
        F.count("*").alias("nodes"), F.max("depth").alias("max_depth"), F.countDistinct("func").alias("functions"))
    kinds = ["data", "control", "call", "parameter"]
    e = edges.groupBy("run_id").agg(
        F.count("*").alias("edges"), *[F.count_if(F.col("kind") == k).alias(f"{k}_edges") for k in kinds])
    v = snapshots.groupBy("run_id").agg(F.countDistinct("var").alias("variables"))
    return a.join(e, "run_id", "left").join(v, "run_id", "left").na.fill(0)


def roots(steps, edges, kinds=("data", "control")) -> DataFrame:
    """Steps without incoming edges of the given kinds."""
    into = edges.filter(F.col("kind").isin(*kinds)).select("run_id", F.col("dst").alias("step"))
    return steps.join(into, ["run_id", "step"], "left_anti")


def leaves(steps, edges, kinds=("data", "control", "call")) -> DataFrame:
    out = edges.filter(F.col("kind").isin(*kinds)).select("run_id", F.col("src").alias("step"))
    return steps.join(out, ["run_id", "step"], "left_anti")


def root_cause_steps(steps, edges) -> DataFrame:
    """Steps that write something no earlier data flows into."""
    return roots(steps, edges, ("data",)).filter(F.size("writes") > 0)


def fan(edges: DataFrame, end: str, at_least: int = 3) -> DataFrame:
    """Steps with many incoming (``dst``) or outgoing (``src``) edges."""
    return edges.groupBy("run_id", F.col(end).alias("step")).agg(F.count("*").alias("edges")).filter(
        F.col("edges") >= at_least)


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges of each step by direction and kind."""
    ends = edges.select("run_id", "kind", F.explode(F.array(
        F.struct(F.col("src").alias("step"), F.lit("out").alias("direction")),
        F.struct(F.col("dst").alias("step"), F.lit("in").alias("direction")))).alias("e"))
    return ends.groupBy("run_id", "e.step", "e.direction", "kind").agg(F.count("*").alias("edges"))


def incoming_variables(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'data'").select("run_id", F.col("dst").alias("step"), "var").distinct()


def edges_of(edges: DataFrame, var: str | None = None, kind: str | None = None) -> DataFrame:
    if var is not None:
        edges = edges.filter(F.col("var") == var)
    return edges if kind is None else edges.filter(F.col("kind") == kind)


def graph_profile(steps, edges, samples: int = 5, **kw) -> DataFrame:
    """Degrees, and mean slice and impact sizes of ``samples`` steps of each run, chosen by a hash."""
    degree = edges.select("run_id", F.explode(F.array("src", "dst")).alias("step")).groupBy("run_id", "step").count()
    d = degree.groupBy("run_id").agg(F.avg("count").alias("avg_degree"), F.max("count").alias("max_degree"))
    mark = F.md5(F.concat_ws(":", "run_id", F.col("step").cast("string")))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(mark))
    seeds = steps.select("run_id", "step").withColumn("_p", place).filter(F.col("_p") <= samples).drop("_p")

    def mean_size(found, name):
        per_seed = found.groupBy("run_id", "seed").count()
        return per_seed.groupBy("run_id").agg(F.avg("count").alias(name))

    back = mean_size(backward_slice(edges, seeds, **kw), "avg_slice")
    ahead = mean_size(forward_impact(edges, seeds, **kw), "avg_impact")
    n = steps.groupBy("run_id").agg(F.count("*").alias("nodes"))
    return n.join(d, "run_id", "left").join(back, "run_id", "left").join(ahead, "run_id", "left")


def fact_profile(facts: DataFrame) -> DataFrame:
    """Facts per kind, mean evidence, and distinct subjects per fact."""
    whole = F.col("part") == 0
    return facts.groupBy("kind").agg(
        F.count_if(whole).alias("facts"), (F.sum(F.size("evidence")) / F.count_if(whole)).alias("avg_evidence"),
        (F.approx_count_distinct("subject") / F.count_if(whole)).alias("subject_selectivity"))
