"""Exact top-k search by inner product over a pivot-distance index.

Vectors are keyed by their nearest pivot and the distance to it and stored in
that order in blocks, each an annulus around a pivot. The triangle inequality
bounds how near a query a block can lie, and with it the inner product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from causeway.llm.common import cut, release, shuffle_width

#: Pivots are the vectors with the least hashes of their ids: a quarter of the root of the number of rows, within these bounds.
PIVOTS = (32, 1024)
BLOCK = 2048
QUERY_BLOCK = 256
#: Query blocks that meet one block of vectors in one task.
MEET = 64
#: Blocks around a query's own place that give the first bound.
FIRST = 2
SCALE = 256


def _ints(column: str):
    ends = lambda x: F.greatest(F.least(F.floor(x), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(F.col(column).cast("array<double>"), lambda x: ends(x * SCALE))


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    """Integer rows, filled up with zeros to ``dims``."""
    flat = column.flatten().to_numpy()
    ends = np.cumsum(np.diff(column.offsets.to_numpy()))
    sizes = np.diff(ends, prepend=0)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    for i, (e, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
        out[i, :n] = flat[e - n:e]
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    d2 = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * x @ p.T
    return np.sqrt(np.maximum(d2, 0.0))


#: Scores beyond the range of a long count as its ends.
LARGEST = (1 << 63) - 1


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held to the range of a long.

    Doubles hold them where the sums stay below 2**53. Integers of 64 bits may
    wrap on the way, but end right wherever the product itself fits, which the
    norms tell; what is left is multiplied in integers of any length.
    """
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]
    if most < 2.0 ** 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    out = q @ x.T
    for i, j in zip(*np.nonzero(_norms(q)[:, None] * _norms(x)[None] >= 2.0 ** 62), strict=True):
        exact = sum(a * b for a, b in zip(q[i].tolist(), x[j].tolist(), strict=True))
        out[i, j] = max(-LARGEST, min(LARGEST, exact))
    return out


def _keyed(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(1), pivots.shape[1])
            d = _distances(x, pivots)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], ["vec_id", "v", "pivot", "dist"])

    return run


def _blocked(size: int, dims: int):
    """Consecutive rows of one pivot as one row, with the range of distances and the largest norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> pa.RecordBatch:
            x, d = _rows(rows.column("v").combine_chunks(), dims), rows.column("dist").to_numpy()
            norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max())
            return pa.RecordBatch.from_pydict({"pivot": pa.array([rows.column("pivot")[0].as_py()], pa.int32()), "near": [float(d.min())], "far": [float(d.max())], "norm": [norm],
                                               "ids": pa.array([rows.column("vec_id").to_numpy().tobytes()], pa.binary()), "data": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())})

        def flush(rows: pa.Table):
            for at in range(0, rows.num_rows, size):
                yield out(rows.slice(at, size))

        for batch in batches:
            pivot = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(lo, hi - lo)
                if held and held[0].column(2)[0] != part.column(2)[0]:
                    yield from flush(pa.Table.from_batches(held))
                    held = []
                held.append(part)
            while sum(b.num_rows for b in held) >= size:
                rows = pa.Table.from_batches(held)
                yield out(rows.slice(0, size))
                rest = rows.slice(size).combine_chunks().to_batches()
                held = rest
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


_BLOCK = "pivot int, near double, far double, norm double, ids binary, data binary"


def _blocks(rows: DataFrame, size: int, dims: int, name: str) -> DataFrame:
    order = ["pivot", "dist", "vec_id"]
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    return cut(dealt.mapInArrow(_blocked(size, dims), _BLOCK).withColumn(name, F.monotonically_increasing_id()))


def _bounds(pivots: np.ndarray):
    """Per query block and pivot: range of distances, largest norm, least bound to beat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["data"], np.int64).reshape(-1, pivots.shape[1])
                d = _distances(q, pivots)
                n = len(pivots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["qb"])), pa.array(np.arange(n), pa.int32()), pa.array(d.min(axis=0)), pa.array(d.max(axis=0)), pa.array(np.full(n, row["norm"])),
                     pa.array(np.full(n, row["least"], np.float64))], ["qb", "pivot", "q_near", "q_far", "q_norm", "least"])

    return run


def _best(k: int, dims: int, pivots: np.ndarray):
    """The k best of one block of vectors for each query of the blocks it meets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for block in left.to_pylist():
            ids, x = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["data"], np.int64).reshape(-1, dims)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for row in right.to_pylist():
                qids, q = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.int64).reshape(-1, dims)
                least = np.frombuffer(row["bar"], np.float64) if row["bar"] is not None else np.full(len(q), -np.inf)
                d = _distances(q, pivots[block["pivot"]][None])[:, 0]
                gap = np.maximum(0.0, np.maximum(d - block["far"], block["near"] - d))
                norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
                use = np.flatnonzero(_upper(norm, block["norm"], gap) >= least)
                if not len(use):
                    continue
                s = _products(q[use], x)
                own = qids[use][:, None] == ids[None]
                room = (~own).sum(axis=1)
                s[own] = np.iinfo(np.int64).min
                at = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
                for i, (j, bar) in enumerate(zip(use.tolist(), at.tolist(), strict=True)):
                    hit = np.flatnonzero((s[i] >= bar) & ~own[i])
                    hit = hit[np.argsort(-s[i, hit], kind="stable")][:min(k, room[i])]
                    found.append((np.full(len(hit), qids[j]), ids[hit], s[i, hit]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def _upper(q_norm, norm, gap):
    """Largest inner product of a query with a vector of at most ``norm`` that lies ``gap`` away at least.

    With distance g and norms a and b, twice the product is a^2 + b^2 - g^2
    for the exact b, which isn't known, so the bound takes the largest over
    all norms up to ``norm``; rounding gets a margin.
    """
    top = (q_norm ** 2 + norm ** 2 - gap ** 2) / 2
    both = q_norm * norm
    return np.minimum(top, both) + 1e-9 * (q_norm ** 2 + norm ** 2) + 1e-6


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows for each row whose id is divisible by ``every``.

    Components count as ``floor(256 x)``; the score is the integer inner
    product, ties go to the smaller id. Components and scores beyond the range
    of a long count as its ends. Vectors that are null or hold null or
    non-finite components, and rows without id, take no part; shorter vectors
    count as filled up with zeros. Rows that share an id are one candidate,
    which counts with its best score, and are never candidates of their own
    queries. Other columns are ignored.

    Two blocks near a query's own place give a first bound. Then every block
    is compared whose annulus may hold a vector reaching that bound: blocks
    of queries meet blocks of vectors, and only the best rows come out.
    """
    spark = vectors.sparkSession
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias(vec_col)).filter(F.col("vec_id").isNotNull() & F.col(vec_col).isNotNull() & finite)
    base = cut(named.select("vec_id", _ints(vec_col).alias("v")).distinct())
    dims, rows = base.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    pivots = pivots or min(max(int(rows ** 0.5) // 4, PIVOTS[0]), PIVOTS[1])
    schema = "query_id long, rank int, vec_id long, score long"
    if not dims:
        dims = 1
    chosen = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()  # a fixed number of vectors
    if not chosen:
        return spark.createDataFrame([], schema)
    middle = np.zeros((len(chosen), dims), np.int64)
    for i, r in enumerate(chosen):
        middle[i, :len(r.v)] = r.v
    keyed = base.mapInArrow(_keyed(middle), "vec_id long, v array<long>, pivot int, dist double")
    blocks = _blocks(keyed, BLOCK, dims, "vb")
    queries = _blocks(keyed.filter(F.col("vec_id") % every == 0), QUERY_BLOCK, dims, "qb")
    salts = max(1, math.ceil(queries.count() / MEET))

    def meet(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        dealt = cut(pairs.withColumn("salt", F.pmod(F.xxhash64("qb"), F.lit(salts))))
        right = dealt.join(asked.select("qb", "ids", "data", "bar"), "qb")
        wanted = dealt.select(F.col("vb").alias("b"), F.col("salt").alias("s")).distinct()
        left = blocks.join(wanted, F.col("vb") == F.col("b")).select("b", "s", "pivot", "near", "far", "norm", "ids", "data")
        return left.groupBy("b", "s").cogroup(right.groupBy("vb", "salt")).applyInArrow(_best(k, dims, middle), "query_id long, vec_id long, score long")

    places = blocks.select("vb", "pivot", "near", "far")
    spread = queries.select("qb", "pivot", F.col("near").alias("q_near"), F.col("far").alias("q_far"))
    gap = F.greatest(F.col("q_near") - F.col("far"), F.col("near") - F.col("q_far"))
    rank = F.row_number().over(W.Window.partitionBy("qb").orderBy("gap", "vb"))
    first = cut(spread.join(places, "pivot").withColumn("gap", gap).withColumn("r", rank).filter(F.col("r") <= FIRST).select("qb", "vb"))
    near = cut(meet(first, queries.withColumn("bar", F.lit(None).cast("binary"))))
    place = W.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    one = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    kth = one.withColumn("r", F.row_number().over(place)).filter(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("bar"))

    def barred(left: pa.Table, right: pa.Table) -> pa.Table:
        bars = dict(zip(right.column("query_id").to_pylist(), right.column("bar").to_pylist(), strict=True))
        out = []
        for ids in left.column("ids").to_pylist():
            out.append(np.array([bars.get(i, -np.inf) for i in np.frombuffer(ids, np.int64).tolist()]))
        return left.append_column("bar", pa.array([b.tobytes() for b in out], pa.binary())).append_column("least", pa.array([float(b.min()) for b in out], pa.float64()))

    owner = queries.select("qb", "ids").mapInArrow(_owners, "qb long, query_id long")
    wanted = queries.select("qb", "norm", "ids", "data").groupBy("qb").cogroup(owner.join(kth, "query_id").groupBy("qb")).applyInArrow(
        barred, "qb long, norm double, ids binary, data binary, bar binary, least double")
    asked = cut(wanted)
    reach = asked.select("qb", "norm", "data", "least").mapInArrow(_bounds(middle), "qb long, pivot int, q_near double, q_far double, q_norm double, least double")
    gap = F.greatest(F.lit(0.0), F.col("q_near") - F.col("far"), F.col("near") - F.col("q_far"))
    size = F.col("q_norm") * F.col("q_norm") + F.col("norm") * F.col("norm")
    upper = F.least((size - gap * gap) / 2, F.col("q_norm") * F.col("norm")) + size * 1e-9 + 1e-6
    pairs = reach.join(blocks.select("vb", "pivot", "near", "far", "norm"), "pivot").filter(upper >= F.col("least")).select("qb", "vb").join(first, ["qb", "vb"], "left_anti")
    rest = meet(pairs, asked)
    best = near.union(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    release(base)
    return best.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for qb, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qb)), pa.array(ids)], ["qb", "query_id"])
