"""Mixing sources to target weights by fitting subset sums of document lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from causeway.llm.common import cut, numbered

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Largest remaining budget, in words, that the knapsack table covers.
TABLE = 1 << 16
#: Parts of one length group that are counted apart, so that ranking never gathers a whole group.
PARTS = 1024
_WORD = r"[^\x20\x09-\x0D]+"


def fit_counts(lengths: list[int], counts: list[int], budget: int, table: int = TABLE) -> list[int]:
    """How many documents of each length to take so that their lengths sum close below ``budget``.

    Every length first gives its share rounded down, then the longest fill
    up and then give back until about ``table`` words are missing; a bounded
    knapsack over the documents left picks the rest, with each count split
    into powers of two and the reachable sums held as the bits of one number.
    """
    total = sum(n * m for n, m in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    taken = [m * budget // total for m in counts]
    rest = budget - sum(n * m for n, m in zip(lengths, taken, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        more = min(counts[i] - taken[i], max(0, rest - table // 2) // lengths[i])
        taken[i] += more
        rest -= more * lengths[i]
    for i in order:  # documents given back leave the table more sums to choose from
        back = min(taken[i], max(0, table - rest) // lengths[i])
        taken[i] -= back
        rest += back * lengths[i]
    reach, steps, mask = 1, [], (1 << (rest + 1)) - 1
    for i in order:
        left, size = min(counts[i] - taken[i], rest // lengths[i]), 1
        while left > 0 and not reach >> rest & 1:
            size = min(size, left)
            steps.append((i, size, reach))
            reach |= reach << size * lengths[i] & mask
            left -= size
            size *= 2
    at = reach.bit_length() - 1
    for i, size, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += size
            at -= size * lengths[i]
    return taken


def _targets(sources: DataFrame) -> DataFrame:
    """Share the total by weight; what exceeds a source's limit goes to the others until none exceeds it."""
    limit = F.col("source_size") * MAX_REPEATS
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = limit < F.lit(level) * F.col("weight")
        used, weight = sources.agg(F.sum(F.when(full, limit).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        new = (total - (used or 0)) / weight if weight else level
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20) -> DataFrame:
    """``doc_id, source, size, source_size, target, repeats, taken`` for every row of ``docs``.

    A document's size is its number of words; null and blank texts have size
    0 and are never taken. Sources are ranked by code point, null is a source
    of its own, last; they weigh 1, 2, 3, repeating. A source whose target
    holds all its words is taken whole that many times, at most three; the
    words still missing come from documents chosen per length, as many as
    ``fit_counts`` says, in the order of a seeded hash of the id. Equal rows
    without id are interchangeable. Reruns give the same rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("long")
    key = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    mark = F.xxhash64("doc_id", "source", "size", F.lit(seed))
    sized = cut(key.withColumn("mark", mark).withColumn("part", F.shiftrightunsigned("mark", 54).cast("int")))
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = numbered(sources, F.col("source").asc_nulls_last(), name="rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEATS))).otherwise(0).cast("long")
    plan = cut(_targets(ranked.withColumn("weight", weight)).withColumn("full", full)
               .withColumn("budget", F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long")))

    parts = cut(sized.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("m")))
    lengths = parts.filter("size > 0").groupBy("source", "size").agg(F.sum("m").alias("m"))
    budgets = plan.select(F.col("source").alias("s"), "budget")
    asked = lengths.join(budgets, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        x = fit_counts([int(v) for v in group["size"]], [int(v) for v in group["m"]], int(group["budget"].iloc[0]))
        return pd.DataFrame({"source": group["source"], "size": group["size"], "extra": np.array(x, np.int64)})

    # one row per length and source: bounded by the longest text
    chosen = asked.groupBy("source").applyInPandas(fitted, T.StructType([sized.schema["source"], T.StructField("size", T.LongType()), T.StructField("extra", T.LongType())]))
    chosen = chosen.select(F.col("source").alias("s"), F.col("size").alias("z"), "extra")
    ahead = F.coalesce(F.sum("m").over(W.Window.partitionBy("source", "size").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    shares = (parts.withColumn("ahead", ahead).join(chosen, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").drop("s", "z")
              .join(plan.select(F.col("source").alias("s"), "source_size", "target", "full"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    shares = shares.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "source_size", "target", "full",
                           (F.coalesce("extra", F.lit(0)) - F.col("ahead")).alias("open"))
    rank = F.row_number().over(W.Window.partitionBy("source", "size", "part").orderBy("mark", "doc_id"))
    taken = (sized.withColumn("rank", rank)
             .join(shares, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p"))))
    repeats = F.when(F.col("size") > 0, F.col("full") + F.when(F.col("rank") <= F.col("open"), 1).otherwise(0)).otherwise(0).cast("long")
    return taken.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))
