"""Reachability of deep keys in logarithmically many rounds.

Two forms for keys that are too large for one task (``traverse.reach`` picks
them by counted properties of the edges):

* ``lifted``: every node has at most one way on. Tables of the 1st, 2nd, 4th,
  8th, ... next node are made by joining the last table with itself; a seed's
  chain is then put together from jumps of falling length, so each of its
  nodes comes up exactly once and nothing needs to be checked as seen.
* ``swept``: nodes are numbers and all edges go up, or all go down. The axis
  is cut into chunks. One task finds the distances inside a chunk from its
  *gates*, the few nodes by which paths enter it (or leave the chunk before);
  the gates then form a much smaller weighted graph, which is cut into longer
  chunks in turn, until one chunk holds all. Distances come back down the same
  levels. The rounds grow with the logarithm of the number of chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.session import checkpointed

#: Steps of a chunk at the lowest level, and chunks merged on the way to the next level.
CHUNK, MERGED = 1 << 14, 32
#: Gate-to-gate distances allowed for each edge below: beyond it the gates are too many to pay.
SPREAD = 16
#: Share of all rows from which those at one node are joined where they lie.
OFTEN = 0.001
#: Nodes that the sketch of a pass over the rows tracks.
TRACKED = 16_384
#: Gates whose distances advance together.
LANES = 64
#: Edges of a hierarchy from which its lowest nodes are joined to what lies above instead of climbing.
PEELED = 1 << 19


def met(rows: DataFrame, table: DataFrame, *on: str) -> DataFrame:
    """``rows`` joined on the named columns with a table of few rows per node, however many rows stand on one node.

    Both are read twice. Nodes that hold more than ``OFTEN`` of all rows, at most
    ``1 / OFTEN`` of them, are found in one pass without a shuffle, by a sketch
    of hashed nodes; their part of the table is sent to the rows, and only the
    other rows are shuffled. Nodes that share a hash only go the same way.
    """
    on = list(on)
    at = F.xxhash64(*on)
    top = rows.agg(F.count(F.lit(1)).alias("n"), F.call_function("approx_top_k", at, F.lit(round(1 / OFTEN)), F.lit(TRACKED)).alias("top")).first()
    often = [(t["item"],) for t in top["top"] or [] if t["count"] >= OFTEN * top["n"]]
    if not often:
        return rows.join(table, on)
    hot = F.broadcast(rows.sparkSession.createDataFrame(often, "_at long"))
    table = table.withColumn("_at", F.xxhash64(*[F.col(c).cast(rows.schema[c].dataType) for c in on]))
    rows = rows.withColumn("_at", at)
    near = F.broadcast(table.join(hot, "_at", "left_semi").drop("_at"))
    return rows.join(hot, "_at", "left_semi").drop("_at").join(near, on).unionByName(rows.join(hot, "_at", "left_anti").drop("_at").join(table.drop("_at"), on))


def lifted(edges: DataFrame, seeds: DataFrame, key: str, max_depth: int | None = None) -> DataFrame | None:
    """``reach`` where each ``from_node`` has one ``to_node``; None where the edges turn out to hold a cycle.

    ``edges`` is ``(key, from_node, to_node)`` without loops, cheap to read
    again, ``seeds`` ``(key, seed, node)``. Gives ``(key, seed, node, depth, parent)``.
    """
    node = edges.schema["from_node"].dataType.simpleString()
    ups = [edges.select(key, F.col("from_node").alias("at"), F.col("to_node").alias("to"), F.col("from_node").alias("last"))]
    total = ups[0].count()
    if total == 0:
        ups = []
    while ups and (max_depth is None or 2 ** len(ups) <= max_depth):
        if 2 ** len(ups) > 2 * total:
            return None  # chains of distinct nodes have ended by now
        on = ups[-1].select(key, F.col("at").alias("to"), F.col("to").alias("then"), F.col("last").alias("then_last"))
        twice = checkpointed(met(ups[-1], on, key, "to").select(key, "at", F.col("then").alias("to"), F.col("then_last").alias("last")))
        if twice.isEmpty():
            break
        ups.append(twice)
    found = seeds.select(key, "seed", "node", F.lit(0).alias("depth"), F.lit(None).cast(node).alias("parent"))
    for k in range(len(ups) - 1, -1, -1):
        jumped = met(found, ups[k].select(key, F.col("at").alias("node"), "to", "last"), key, "node").select(
            key, "seed", F.col("to").alias("node"), (F.col("depth") + 2**k).alias("depth"), F.col("last").alias("parent"))
        if max_depth is not None:
            jumped = jumped.filter(F.col("depth") <= max_depth)
        found = found.unionByName(checkpointed(jumped) if k else jumped)
    return found


def climbed(edges: DataFrame, seeds: DataFrame, key: str, max_depth: int | None = None, least: int = PEELED) -> DataFrame | None:
    """``lifted`` where most nodes may be leaves that nothing leads to.

    Jumps are made for the other nodes only; a seed takes its one way on and
    then takes over what is known of the node there.
    """
    total = edges.count()
    upper = _upper(edges, key, total) if total > least else None
    if upper is None:
        return lifted(edges, seeds, key, max_depth)
    above = peeled(upper, key, max_depth, least)
    if above is None:
        return None
    start = seeds.select(key, "seed", "node", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["from_node"].dataType).alias("parent"))
    first = checkpointed(met(seeds.select(key, "seed", F.col("node").alias("from_node")), edges.select(key, "from_node", "to_node"), key, "from_node").select(
        key, "seed", F.col("to_node").alias("node"), F.lit(1).alias("depth"), F.col("from_node").alias("parent")))
    found = start.unionByName(first).unionByName(_taken_over(first, checkpointed(above), key))
    return found if max_depth is None else found.filter(F.col("depth") <= max_depth)


def _upper(edges: DataFrame, key: str, total: int) -> DataFrame | None:
    """Edges from nodes that an edge leads to; None where these are more than half."""
    inner = edges.select(key, F.col("to_node").alias("from_node")).distinct()
    upper = checkpointed(edges.select(key, "from_node", "to_node").join(inner, [key, "from_node"], "left_semi"))
    return upper if 2 * upper.count() <= total else None


def _taken_over(first: DataFrame, above: DataFrame, key: str) -> DataFrame:
    """What is reached from the nodes of ``first``, one edge from their seeds."""
    on = above.select(key, F.col("seed").alias("node"), F.col("node").alias("to"), F.col("depth").alias("more"), F.col("parent").alias("last"))
    return met(first.select(key, "seed", "node"), on, key, "node").select(key, "seed", F.col("to").alias("node"), (F.col("more") + 1).alias("depth"), F.col("last").alias("parent"))


def peeled(edges: DataFrame, key: str, max_depth: int | None = None, least: int = PEELED) -> DataFrame | None:
    """``lifted`` from every node that has a way on, without the start itself: ``(key, seed, node, depth, parent)``.

    Where most nodes are leaves that nothing leads to, only the others climb; a
    leaf then takes over what is known of the node above it, in one join. This
    is done again for the nodes above while it at least halves the edges.
    """
    total = edges.count()
    above = None
    if total > least:
        upper = _upper(edges, key, total)
        if upper is not None:
            above = peeled(upper, key, max_depth, least)
            if above is None:
                return None
    if above is None:
        found = lifted(edges, edges.select(key, F.col("from_node").alias("seed"), F.col("from_node").alias("node")), key, max_depth)
        return found if found is None else found.filter("depth > 0")
    above = checkpointed(above)
    leaves = edges.select(key, "from_node", "to_node").join(upper.select(key, "from_node"), [key, "from_node"], "left_anti").select(
        key, F.col("from_node").alias("seed"), F.col("to_node").alias("node"), F.lit(1).alias("depth"), F.col("from_node").alias("parent"))
    leaves = checkpointed(leaves)
    found = above.unionByName(leaves).unionByName(_taken_over(leaves, above, key))
    return found if max_depth is None else found.filter(F.col("depth") <= max_depth)


def _chunk(column: str, size: int):
    return F.floor(F.col(column) / size)


def _distances(key: str, falling: bool, wanted_only: bool):
    """Least distances inside one chunk: from each gate to the wanted nodes, or to all nodes."""
    columns = [key, "gate", "node", "dist"]

    def run(k, starts: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        begin = starts[starts["dist"] >= 0]
        wanted = starts.loc[starts["dist"] < 0, "node"].unique()
        if not len(begin) or (wanted_only and not len(wanted)):
            return pd.DataFrame(columns=columns)
        nodes = np.unique(np.concatenate([begin["node"], links["from_node"], links["to_node"], wanted]))
        place = np.searchsorted(nodes, links["from_node"].to_numpy())
        order = np.argsort(-place if falling else place, kind="stable")
        tails = place[order].tolist()
        heads = np.searchsorted(nodes, links["to_node"].to_numpy())[order].tolist()
        weights = links["w"].to_numpy()[order].tolist()
        gates, lane = np.unique(begin["gate"].to_numpy(), return_inverse=True)
        at = np.searchsorted(nodes, begin["node"].to_numpy())
        shown = np.searchsorted(nodes, np.sort(wanted)) if wanted_only else np.arange(len(nodes))
        far, out = np.iinfo(np.int64).max // 4, []
        for first in range(0, len(gates), LANES):
            dist = np.full((len(nodes), min(LANES, len(gates) - first)), far, np.int64)
            mine = (lane >= first) & (lane < first + LANES)
            np.minimum.at(dist, (at[mine], lane[mine] - first), begin["dist"].to_numpy()[mine])
            for u, v, w in zip(tails, heads, weights):
                np.minimum(dist[v], dist[u] + w, out=dist[v])
            i, j = np.nonzero(dist[shown] < far)
            out.append(pd.DataFrame({"gate": gates[first + j], "node": nodes[shown[i]], "dist": dist[shown[i], j]}))
        got = pd.concat(out)
        got.insert(0, key, k[0])
        return got[columns]

    return run


def _inside(starts: DataFrame, inner: DataFrame, key: str, size: int, falling: bool, wanted: DataFrame | None = None) -> DataFrame:
    """Distances ``(key, gate, node, dist)`` inside chunks of ``size``; a wanted node is a row with a distance below 0."""
    gate = starts.schema["gate"].dataType.simpleString()
    rows = starts.select(key, _chunk("node", size).alias("part"), "gate", "node", "dist")
    if wanted is not None:
        rows = rows.unionByName(wanted.select(key, _chunk("node", size).alias("part"), F.col("node").alias("gate"), "node", F.lit(-1).cast("long").alias("dist")))
    links = inner.select(key, _chunk("from_node", size).alias("part"), "from_node", "to_node", "w")
    kt = starts.schema[key].dataType.simpleString()
    run = _distances(key, falling, wanted is not None)
    return rows.groupBy(key, "part").cogroup(links.groupBy(key, "part")).applyInPandas(run, f"{key} {kt}, gate {gate}, node bigint, dist bigint")


def swept(edges: DataFrame, seeds: DataFrame, key: str, falling: bool, *, max_depth: int | None = None,
          chunk: int = CHUNK, merged: int = MERGED, spread: int = SPREAD) -> DataFrame | None:
    """``reach`` over numbered nodes whose edges all fall (or all rise); None where too many gates make it dear.

    ``edges`` is ``(key, from_node, to_node)``, distinct and without loops,
    ``seeds`` ``(key, seed, node)``. Gives ``(key, seed, node, depth)``.
    Gates are the nodes that edges from other chunks lead to, or those they
    come from, whichever are fewer: few values are alive at any step of a
    run, though one may be read very often.
    """
    links = edges.select(key, F.col("from_node").cast("long").alias("from_node"), F.col("to_node").cast("long").alias("to_node"), F.lit(1).cast("long").alias("w"))
    starts = checkpointed(seeds.select(key, F.col("seed").alias("gate"), F.col("node").cast("long").alias("node"), F.lit(0).cast("long").alias("dist")))
    own = starts.select(key, F.col("node").alias("gate"), "node", "dist")
    levels, size, heads = [], chunk, None
    while True:
        links = checkpointed(links)
        crossing = _chunk("from_node", size) != _chunk("to_node", size)
        inner, outer = links.filter(~crossing), links.filter(crossing)
        levels.append((inner, outer, size))
        n = outer.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key, "to_node").alias("heads"), F.count_distinct(key, "from_node").alias("tails")).first()
        if n["n"] == 0:
            break
        if heads is None:
            heads = n["heads"] <= n["tails"]
        begin = (outer.select(key, F.col("to_node").alias("gate"), F.col("to_node").alias("node"), F.lit(0).cast("long").alias("dist")).distinct() if heads
                 else outer.select(key, F.col("from_node").alias("gate"), F.col("to_node").alias("node"), F.col("w").alias("dist")))
        begin = checkpointed(begin.unionByName(own).distinct())
        wanted = checkpointed(outer.select(key, F.col("from_node").alias("node")).distinct())
        per_chunk = begin.groupBy(key, _chunk("node", size).alias("part")).agg(F.count_distinct("gate").alias("g")).join(
            wanted.groupBy(key, _chunk("node", size).alias("part")).agg(F.count(F.lit(1)).alias("x")), [key, "part"])
        work = per_chunk.agg(F.sum(F.col("g") * F.col("x"))).first()[0] or 0
        if work > spread * max(links.count(), 1 << 16):
            return None
        found = _inside(begin, inner, key, size, falling, wanted)
        if heads:
            found = found.join(outer.select(key, F.col("from_node").alias("node"), F.col("to_node").alias("next"), "w"), [key, "node"]).select(
                key, "gate", F.col("next").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        links = found.filter("gate <> node").groupBy(key, F.col("gate").alias("from_node"), F.col("node").alias("to_node")).agg(F.min("dist").alias("w"))
        size *= merged
    known = starts
    for inner, outer, size in reversed(levels):
        if not heads and heads is not None:
            entered = known.join(outer.select(key, F.col("from_node").alias("node"), F.col("to_node").alias("next"), "w"), [key, "node"]).select(
                key, "gate", F.col("next").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
        else:
            entered = known
        begin = entered.unionByName(starts).groupBy(key, "gate", "node").agg(F.min("dist").alias("dist"))
        known = checkpointed(_inside(begin, inner, key, size, falling))
    out = known.select(key, F.col("gate").alias("seed"), F.col("node").cast(edges.schema["from_node"].dataType).alias("node"), F.col("dist").cast("int").alias("depth"))
    return out if max_depth is None else out.filter(F.col("depth") <= max_depth)


def squared(edges: DataFrame, key: str) -> DataFrame:
    """All pairs ``(key, from_node, to_node, depth)`` joined by a path, in as many rounds as the depth has binary digits.

    A pair ``d`` edges apart, ``h < d <= 2h``, is a pair exactly ``h`` apart
    followed by a pair at most ``h`` apart: only those are joined, and only
    pairs found in the round are compared with those known.
    """
    known = checkpointed(edges.filter("from_node <> to_node").select(key, "from_node", "to_node").distinct().withColumn("depth", F.lit(1)))
    exact, h = known, 1
    while True:
        on = known.select(key, F.col("from_node").alias("to_node"), F.col("to_node").alias("then"), F.col("depth").alias("more"))
        met = exact.select(key, "from_node", "to_node").join(on, [key, "to_node"]).filter("from_node <> then").groupBy(
            key, "from_node", F.col("then").alias("to_node")).agg((F.min("more") + h).alias("depth"))
        new = checkpointed(met.join(known.select(key, "from_node", "to_node"), [key, "from_node", "to_node"], "left_anti"))
        known, exact, h = known.unionByName(new), new.filter(F.col("depth") == 2 * h), 2 * h
        if exact.isEmpty():
            return known
