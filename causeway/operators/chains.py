"""Causal chains as a path graph: counted without being listed, and the best of them taken in order.

The number of chains behind a node can double with every layer, so chains are
not built to be counted. Counts go from the sources up the graph, each edge
once; the chain of any rank is then found by walking from its start and, at
each node, choosing the edge whose share of the counts holds the rank.
``traverse.causal_chains`` lists all chains where that is asked for.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.ordered import read_twice
from causeway.operators.deep import PEELED, met
from causeway.operators.traverse import LOCAL_WORK, priority
from causeway.session import checkpointed

#: Counts beyond this stay at it; ranks below it are exact.
MOST = 10**18
#: Settled nodes sent to the edges; more of them meet the edges in a shuffle.
FEW = 10_000
_COUNT = "decimal(38,0)"


def _followed(cedges: DataFrame, edge_types: list[str] | None) -> DataFrame:
    """Edges from a node to what is behind it, with their place among the node's edges and whether they end at a source."""
    kept = cedges if edge_types is None else cedges.filter(F.col("edge_type").isin(*edge_types))
    inner = cedges.select("graph_id", F.col("dst").alias("src")).distinct().withColumn("_inner", F.lit(True))
    return kept.select("graph_id", F.col("dst").alias("node"), "src", "edge_type", priority(F.col("edge_type")).alias("rank")).join(
        inner, ["graph_id", "src"], "left").withColumn("ends", F.col("_inner").isNull()).drop("_inner")


def _settled(edges: DataFrame) -> DataFrame:
    """``(graph_id, node, chains)`` from the sources up; a node is settled once all nodes behind it are."""
    edges = checkpointed(edges)
    led = edges.select("graph_id", F.col("src").alias("node")).distinct().withColumn("leads", F.lit(True))
    need = edges.groupBy("graph_id", "node").agg(F.count("*").alias("need"))
    asked = checkpointed(need.join(led, ["graph_id", "node"], "left"))
    one = F.lit(1).cast(_COUNT)
    # a source counts one chain for each edge that leads to it; any other node without followed edges counts none
    dead = edges.filter("NOT ends").select("graph_id", F.col("src").alias("node")).distinct().join(need, ["graph_id", "node"], "left_anti")
    fresh = checkpointed(edges.filter("ends").select("graph_id", F.col("src").alias("node"), one.alias("chains")).distinct()
                         .unionByName(dead.withColumn("chains", F.lit(0).cast(_COUNT))))
    waiting, done = None, [fresh]
    while (n := fresh.count()) > 0:
        settled = fresh.withColumnRenamed("node", "src")
        came = (F.broadcast(settled) if n <= FEW else settled).join(edges, ["graph_id", "src"]).groupBy("graph_id", "node").agg(
            F.sum("chains").cast(_COUNT).alias("chains"), F.count("*").alias("met"))
        if waiting is not None:
            came = came.unionByName(waiting).groupBy("graph_id", "node").agg(F.sum("chains").cast(_COUNT).alias("chains"), F.sum("met").alias("met"))
        came = came.withColumn("chains", F.least("chains", F.lit(MOST).cast(_COUNT)))
        step = checkpointed(came.join(asked, ["graph_id", "node"]))
        done.append(step.filter("met = need").select("graph_id", "node", "chains"))
        # a node that no edge leads to another from settles nothing further
        fresh = step.filter("met = need AND leads").select("graph_id", "node", "chains")
        waiting = step.filter("met < need").select("graph_id", "node", "chains", "met")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _ways(cedges: DataFrame, edge_types: list[str] | None) -> tuple[DataFrame, DataFrame | None]:
    """Followed edges as in ``_followed``, not told whether they end, and the nodes that are no sources; None where these are those with followed edges."""
    kept = cedges if edge_types is None else cedges.filter(F.col("edge_type").isin(*edge_types))
    ways = kept.select("graph_id", F.col("dst").alias("node"), "src", "edge_type", priority(F.col("edge_type")).alias("rank"))
    return ways, None if edge_types is None else checkpointed(cedges.select("graph_id", F.col("dst").alias("node")).distinct())


def _nodes(ways: DataFrame) -> DataFrame:
    return ways.select("graph_id", "node").distinct()


def _ending(ways: DataFrame, inner: DataFrame | None) -> DataFrame:
    inner = (_nodes(ways) if inner is None else inner).select("graph_id", F.col("node").alias("src"), F.lit(True).alias("_inner"))
    return checkpointed(ways.join(inner, ["graph_id", "src"], "left").withColumn("ends", F.col("_inner").isNull()).drop("_inner"))


def _parted(ways: DataFrame, asked: DataFrame, least: int) -> tuple[DataFrame, DataFrame] | None:
    """Edges of nodes that others lead to, and of leaves, with ``asked``; None where the former are more than half, or all are few."""
    total = ways.count()
    if total <= least:
        return None
    at = ["graph_id", "node"]
    led = ways.select("graph_id", F.col("src").alias("node"), F.lit(True).alias("led")).distinct()
    marked = checkpointed(ways.join(led, at, "left").join(asked.withColumn("asked", F.lit(True)), at, "left"))
    upper = marked.filter("led").drop("led", "asked")
    return (upper, marked.filter("led IS NULL").drop("led")) if 2 * upper.count() <= total else None


def _behind(leaves: DataFrame, upper: DataFrame, inner: DataFrame | None, settled: DataFrame) -> DataFrame:
    """Edges of leaves with ``n``, the chains that go on behind each: null on or above a circle."""
    known = _nodes(upper).withColumn("_has", F.lit(True)).join(settled, ["graph_id", "node"], "full").select("graph_id", F.col("node").alias("src"), "_has", "chains")
    on = leaves.join(known, ["graph_id", "src"], "left")
    if inner is None:
        ends = F.col("_has").isNull()
    else:
        on = on.join(inner.select("graph_id", F.col("node").alias("src"), F.lit(True).alias("_inner")), ["graph_id", "src"], "left")
        ends = F.col("_inner").isNull()
    n = F.when(ends, F.lit(1)).when(F.col("chains").isNotNull(), F.col("chains")).when(F.col("_has").isNull(), F.lit(0)).cast(_COUNT)
    return on.select("graph_id", "node", "src", "edge_type", "rank", "asked", ends.alias("ends"), n.alias("n"))


def _totals(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("graph_id", "node").agg(F.sum("n").alias("chains"), F.count_if(F.col("n").isNull()).alias("_open")).filter("_open = 0").select(
        "graph_id", "node", F.least("chains", F.lit(MOST).cast(_COUNT)).cast(_COUNT).alias("chains"))


def _counted(ways: DataFrame, inner: DataFrame | None, least: int) -> DataFrame:
    """``_settled`` where most nodes may be leaves that nothing leads to: these only add up what is behind their edges."""
    parts = _parted(ways, _nodes(ways).limit(0), least)
    if parts is None:
        return _settled(_ending(ways, inner))
    upper, leaves = parts
    settled = checkpointed(_counted(upper, inner, least))
    return settled.unionByName(_totals(_behind(leaves, upper, inner, settled)))


def _best(ways: DataFrame, inner: DataFrame | None, asked: DataFrame, k: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The first ``k`` chains of the asked nodes, and the counts of all nodes that have any.

    A leaf's chains are those of the nodes behind it, one edge longer: which of
    them come first follows from the counts alone.
    """
    parts = _parted(ways, asked, least)
    if parts is None:
        edges = _ending(ways, inner)
        settled = checkpointed(_settled(edges))
        return _walked(edges, settled, asked, k), settled
    upper, leaves = parts
    at = ["graph_id", "node"]
    wanted = leaves.filter("asked").select("graph_id", F.col("src").alias("node")).unionByName(asked).distinct()
    above, settled = _best(upper, inner, checkpointed(wanted.join(_nodes(upper), at, "left_semi")), k, least)
    above, settled = checkpointed(above), checkpointed(settled)
    of = Window.partitionBy(*at)
    order = of.orderBy("rank", "src", "edge_type").rowsBetween(Window.unboundedPreceding, -1)
    first = _behind(leaves.filter("asked"), upper, inner, settled).withColumn("ahead", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn(
        "_open", F.max(F.col("n").isNull()).over(of)).filter(~F.col("_open") & (F.col("n") > 0) & (F.col("ahead") < k))
    first = checkpointed(first.select("graph_id", "node", "src", "edge_type", "ends", F.col("ahead").cast("long").alias("ahead")))
    one = first.filter("ends").select("graph_id", F.col("node").alias("start"), (F.col("ahead") + 1).alias("rank"), F.array("node", "src").alias("nodes"), F.array("edge_type").alias("types"))
    more = met(first.filter("NOT ends"), above.withColumnRenamed("start", "src"), "graph_id", "src").filter(F.col("rank") <= k - F.col("ahead")).select(
        "graph_id", F.col("node").alias("start"), (F.col("ahead") + F.col("rank")).alias("rank"),
        F.concat(F.array("node"), "nodes").alias("nodes"), F.concat(F.array("edge_type"), "types").alias("types"))
    own = above.join(asked.select("graph_id", F.col("node").alias("start")), ["graph_id", "start"], "left_semi")
    return own.unionByName(one).unionByName(more), settled.unionByName(_totals(_behind(leaves, upper, inner, settled)))


def _small(cedges: DataFrame, local_work: int) -> bool:
    most = cedges.groupBy("graph_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) ** 2 <= local_work


def _counts(links: pd.DataFrame) -> tuple[dict, dict]:
    """Edges by node in rank order, and chains behind each node; nodes on or above a circle have none of their own."""
    ways = defaultdict(list)
    for node, src, kind, rank, ends in zip(links["node"], links["src"], links["edge_type"], links["rank"], links["ends"]):
        ways[node].append((rank, src, kind, ends))
    back, left, chains, ready = defaultdict(list), {}, {}, []
    for node, of in ways.items():
        of.sort()
        open_ways = [src for _, src, _, ends in of if not ends and src in ways]
        left[node] = len(open_ways)
        for src in open_ways:
            back[src].append(node)
        if not open_ways:
            ready.append(node)
    while ready:
        node = ready.pop()
        chains[node] = min(MOST, sum(1 if ends else chains.get(src, 0) for _, src, _, ends in ways[node]))
        for other in back[node]:
            left[other] -= 1
            if not left[other]:
                ready.append(other)
    return ways, chains


def count_chains(cedges: DataFrame, starts: DataFrame, edge_types: list[str] | None = None, local_work: int = LOCAL_WORK, least: int = PEELED) -> DataFrame:
    """``(graph_id, start, chains)``: how many chains lead from each start back to a node without incoming edges.

    A start without chains has 0. Edges that differ in type count apart.
    Starts on or above a circle, where chains may be entered without end, get
    null: ``causal_chains`` lists theirs, without repeated nodes. Counts stop
    at ``MOST``.
    """
    cedges = read_twice(cedges.select("graph_id", "src", "dst", "edge_type"))
    edges, asked = _followed(cedges, edge_types), starts.select("graph_id", F.col("node_id").alias("node")).distinct()
    if _small(cedges, local_work):
        def run(k, seeds: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
            ways, chains = _counts(links)
            got = [chains.get(n) if n in ways else 0 for n in seeds["node"]]
            return pd.DataFrame({"graph_id": k[0], "start": seeds["node"], "chains": pd.array(got, "Int64")})

        return asked.groupBy("graph_id").cogroup(edges.groupBy("graph_id")).applyInPandas(run, "graph_id string, start string, chains long")
    ways, inner = _ways(cedges, edge_types)
    above = ways.select("graph_id", "node").distinct().withColumn("_above", F.lit(True))
    return asked.join(_counted(ways, inner, least).filter("chains IS NOT NULL"), ["graph_id", "node"], "left").join(above, ["graph_id", "node"], "left").select(
        "graph_id", F.col("node").alias("start"), F.when(F.col("_above").isNull(), 0).otherwise(F.col("chains")).cast("long").alias("chains"))


def best_chains(cedges: DataFrame, starts: DataFrame, k: int = 1, edge_types: list[str] | None = None, local_work: int = LOCAL_WORK, least: int = PEELED) -> DataFrame:
    """``(graph_id, start, rank, nodes, types)``: the first ``k`` chains of each start, ranks from 1.

    Chains are ordered by their edges from the start on: by type in the order
    of ``traverse.PRIORITY``, then by source. So the first is the one that
    always takes the primary parent. Starts on or above a circle have none.
    """
    cedges = read_twice(cedges.select("graph_id", "src", "dst", "edge_type"))
    edges, asked = _followed(cedges, edge_types), starts.select("graph_id", F.col("node_id").alias("node")).distinct()
    schema = "graph_id string, start string, rank long, nodes array<string>, types array<string>"
    if _small(cedges, local_work):
        def run(key, seeds: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
            ways, chains = _counts(links)
            rows = []
            for start in seeds["node"]:
                todo, rank = [([start], [])] if chains.get(start) else [], 0
                while todo and rank < k:
                    nodes, types = todo.pop()
                    if len(types) and types[-1][1]:
                        rank += 1
                        rows.append((key[0], start, rank, nodes, [t for t, _ in types]))
                        continue
                    todo += [([*nodes, src], [*types, (kind, ends)]) for _, src, kind, ends in reversed(ways[nodes[-1]]) if ends or chains.get(src)]
            return pd.DataFrame(rows, columns=["graph_id", "start", "rank", "nodes", "types"])

        return asked.groupBy("graph_id").cogroup(edges.groupBy("graph_id")).applyInPandas(run, schema)
    return _best(*_ways(cedges, edge_types), checkpointed(asked), k, least)[0]


def _walked(edges: DataFrame, settled: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The first ``k`` chains of the asked nodes, an edge of all of them after the other."""
    behind = F.when(F.col("ends"), 1).otherwise(F.coalesce("chains", F.lit(0))).cast(_COUNT)
    order = Window.partitionBy("graph_id", "node").orderBy("rank", "src", "edge_type").rowsBetween(Window.unboundedPreceding, -1)
    ways = edges.join(settled.withColumnRenamed("node", "src"), ["graph_id", "src"], "left").withColumn("n", behind).filter("n > 0")
    ways = ways.withColumn("ahead", F.coalesce(F.sum("n").over(order), F.lit(0)))
    ways = checkpointed(ways.filter(F.col("ahead") < k).select("graph_id", F.col("node").alias("at"), "src", "edge_type", "ends", "ahead", "n"))
    first = asked.join(settled, ["graph_id", "node"]).filter("chains > 0")
    walk = first.select("graph_id", F.col("node").alias("start"), F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("chains"), F.lit(k)).cast("long"))).alias("rank"))
    walk = walk.select("*", F.col("start").alias("at"), (F.col("rank") - 1).cast(_COUNT).alias("left"), F.array("start").alias("nodes"), F.array().cast("array<string>").alias("types"))
    done = None
    while True:
        on = met(walk, ways, "graph_id", "at").filter("left >= ahead AND left < ahead + n")
        step = checkpointed(on.select("graph_id", "start", "rank", F.col("src").alias("at"), (F.col("left") - F.col("ahead")).cast(_COUNT).alias("left"),
                                      F.concat("nodes", F.array("src")).alias("nodes"), F.concat("types", F.array("edge_type")).alias("types"), "ends"))
        ended = step.filter("ends").select("graph_id", "start", "rank", "nodes", "types")
        done = ended if done is None else done.unionByName(ended)
        walk = step.filter("NOT ends").drop("ends")
        if walk.isEmpty():
            return done
