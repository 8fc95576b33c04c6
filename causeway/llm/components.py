"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import cut, release


def _chosen(edges: DataFrame, turn: int) -> DataFrame:
    """``(node, label)``: the best of each node and its neighbours, by id on even turns, by a fresh hash on odd ones.

    Choosing by id settles stars around their least node at once; choosing by
    a hash shrinks chains by a constant share whatever their ids.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")),
                                          F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("e")).select("e.*")
    if turn % 2 == 0:
        return ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("label"))
    rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c).alias("id"))
    best = ends.groupBy("node").agg(F.min(rank("near")).alias("near"))
    return best.select("node", F.least(rank("node"), F.col("near"))["id"].alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: component is the least node reachable.

    Self-loops and null ends are ignored; an empty table gives no rows. Every
    turn maps each node to a label near it and keeps the edges between
    labels, as written tables, until none is left; no list of neighbours is
    gathered and the number of turns grows with the logarithm of the input.
    """
    now, labels, turn, old = cut(edges.select("a", "b").filter("a <> b")), None, 0, []
    while not now.isEmpty():
        step = cut(_chosen(now, turn))
        new = (now.join(step.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
               .join(step.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
               .filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        new = cut(new)
        old.append(now)
        if labels is None:
            labels = step
        else:
            old += [labels, step]
            labels = cut(labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
                         .select("node", F.coalesce("next", "label").alias("label")))
        now, turn = new, turn + 1
    if labels is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = labels.withColumnRenamed("label", "component")
    if turn > 1:
        least = labels.groupBy("label").agg(F.min("node").alias("component"))
        out = cut(labels.join(least, "label").select("node", "component"))
        old.append(labels)
    release(now, *old)
    return out
