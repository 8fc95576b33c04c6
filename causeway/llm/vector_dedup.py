"""Near-duplicate vectors by sorted projection passes.

Each pass orders the vectors of a label by the concatenated signs of random
projections, so near vectors mostly become neighbours, and compares every
vector with a bounded window after it. The union of all passes gives the
first components. Then the vectors of each label are cut into blocks that lie
close along fixed axes, and all blocks of a label meet: rows that lie too far
from the other block's box can't be linked, all others are compared. That
counts every link and joins the components the passes left apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import cut, release, shuffle_width
from causeway.llm.components import components

PASSES = 10
WINDOW = 24
BITS = 63
BLOCK = 1024
#: Blocks of a label that one task holds on either side.
MEET = 16
AXES = 16
#: What single precision may be off by in a product of unit vectors, with room.
SLACK = 1e-4
SEED = 11


def _usable(column: str):
    """Vectors that are not null, hold finite numbers only and aren't zero."""
    return F.coalesce(F.size(column) > 0, F.lit(False)) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(column, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision; the vectors of a batch have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch, at: int):
    sizes = np.array([len(v) for v in batch.column(at)])
    for n in np.unique(sizes):
        yield batch if (sizes == n).all() else batch.filter(pa.array(sizes == n))


def _keys(passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_length(whole, 3):
                x = _matrix(batch.column(3))
                for p in range(passes):
                    planes = np.random.default_rng((SEED, p, x.shape[1])).standard_normal((x.shape[1], BITS))
                    key = ((x @ planes) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), p), pa.int32()), *batch.columns[:3], pa.array(key), batch.column(3)],
                                                     ["pass", "label", "dims", "rep", "key", "vec"])

    return run


def _windows(window: int, least: float):
    """Links between each row and the rows after it, as far as they join parts that earlier links haven't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_group, tail_ids, tail_x = None, np.empty(0, np.int64), None
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            edges = np.flatnonzero(np.append(True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)))
            found = []
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                ids, x = part.column(3).to_numpy(), _matrix(part.column(5))
                group = tuple(marks[:, lo])
                if group == tail_group:
                    ids, x = np.concatenate([tail_ids, ids]), np.concatenate([tail_x, x])
                parent = list(range(len(ids)))

                def top(i: int, parent=parent) -> int:
                    while parent[i] != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                for s in range(1, min(window, len(ids) - 1) + 1):
                    for i in np.flatnonzero(np.einsum("ij,ij->i", x[:-s], x[s:]) >= least).tolist():
                        a, b = top(i), top(i + s)
                        if a != b:
                            parent[a] = b
                            found.append((ids[i], ids[i + s]))
                tail_group, tail_ids, tail_x = group, ids[-window:], x[-window:]
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _axes(dims: int) -> np.ndarray:
    """Fixed orthonormal directions, as columns; no row passes through the driver."""
    return np.linalg.qr(np.random.default_rng((SEED, dims)).standard_normal((dims, min(dims, AXES))))[0]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest axis of each vector, by direction, and the cosine with it."""
    for whole in batches:
        for batch in _by_length(whole, 5):
            along = _matrix(batch.column(5)) @ _axes(len(batch.column(5)[0]))
            near = np.abs(along).argmax(axis=1)
            at = along[np.arange(len(along)), near]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.where(at < 0, ~near, near), pa.int32()), pa.array(at), *batch.columns[2:]],
                                             ["label", "dims", "axis", "at", "rep", "copies", "component", "vec"])


def _packed(size: int):
    """Consecutive rows of one label and length as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy() for i in range(2)])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                for at in range(lo, hi, size):
                    part = batch.slice(at, min(size, hi - at))
                    packed = [pa.array([part.column(i).to_numpy().astype(np.int64).tobytes()], pa.binary()) for i in (4, 5, 6)]
                    yield pa.RecordBatch.from_arrays([part.column(0)[:1], part.column(1)[:1], pa.array([part.num_rows], pa.int64()), *packed,
                                                      pa.array([_matrix(part.column(7)).tobytes()], pa.binary())], ["label", "dims", "n", "reps", "copies", "components", "data"])

    return run


def _hits(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs with a cosine of at least ``least``; single precision only rules out."""
    rough = x.astype(np.float32) @ y.astype(np.float32).T >= np.float32(least - SLACK)
    i, j = np.nonzero(rough)
    if len(i) * 50 > rough.size:
        return np.nonzero(x @ y.T >= least)
    sure = np.einsum("ij,ij->i", x[i], y[j]) >= least
    return i[sure], j[sure]


def _met(least: float):
    """All links between the blocks of two groups: copies linked to each row, and pairs that join components."""

    def run(table: pa.Table) -> pa.Table:
        dims = table.column("dims")[0].as_py()
        axes, reach = _axes(dims), 2 - 2 * least + SLACK
        blocks, counts, parent, links = [], {}, {}, []
        for r in table.select(["lo", "hi", "part", "block", "reps", "copies", "components", "data"]).to_pylist():
            x = np.frombuffer(r["data"]).reshape(-1, dims)
            blocks.append((r, *(np.frombuffer(r[c], np.int64) for c in ("reps", "copies", "components")), x, x @ axes))

        def top(i: int) -> int:
            while (up := parent.setdefault(i, i)) != i:
                parent[i] = up = parent[up]
                i = up
            return i

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Rows of ``a`` within reach of the box of ``b``; the axes only see a part of each distance."""
            gap = np.maximum(np.maximum(b.min(axis=0) - a, a - b.max(axis=0)), 0)
            return np.flatnonzero((gap * gap).sum(axis=1) <= reach)

        for k, (r, ra, na, ca, xa, ga) in enumerate(blocks):
            for s, rb, nb, cb, xb, gb in blocks[k:]:
                # groups that differ meet across, a group that meets itself does so in all pairs
                if r["lo"] != r["hi"] and r["part"] == s["part"]:
                    continue
                p = near(ga, gb)
                q = near(gb, ga[p]) if len(p) else p
                if not len(q):
                    continue
                i, j = _hits(xa[p], xb[q], least)
                i, j = p[i], q[j]
                if s is r:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                for ids, n in ((ra, np.bincount(i, nb[j], len(ra))), (rb, np.bincount(j, na[i], len(rb)))):
                    for at in np.flatnonzero(n).tolist():
                        counts[int(ids[at])] = counts.get(int(ids[at]), 0) + int(n[at])
                apart = np.flatnonzero(ca[i] != cb[j])
                for u, v in np.unique(np.stack([ca[i[apart]], cb[j[apart]]]), axis=1).T.tolist():
                    a, b = top(u), top(v)
                    if a != b:
                        parent[a] = b
                        links.append((u, v))
        return pa.Table.from_arrays([pa.array([*counts, *(u for u, _ in links)], pa.int64()), pa.array([*[None] * len(counts), *(v for _, v in links)], pa.int64()),
                                     pa.array([*counts.values(), *[None] * len(links)], pa.int64())], ["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, passes: int = PASSES, window: int = WINDOW, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors of one length and one label that isn't null are linked where
    their cosine, in double precision, is at least ``least``. Null, empty and
    zero vectors, vectors with null or non-finite components, and rows with a
    null label or id link with nothing: their component is their own id.
    Equal vectors of a label are one class and linked. ``n_links`` counts
    rows, repeated ones included. Rows that share an id are one node. Other
    columns are ignored.

    The windows bound what a pass may find, not what is reported: every link
    of a label is counted and joins its ends, whatever the passes found.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).cast("long").alias("label"))
    named = base.filter(_usable("vec") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = cut(named.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dims", F.size("vec").cast("long")))
    keyed = classes.select("label", "dims", "rep", "vec").mapInArrow(_keys(passes), "pass int, label long, dims long, rep long, key long, vec array<double>")
    order = ["pass", "label", "dims", "key", "rep"]
    sorted_rows = keyed.repartitionByRange(shuffle_width(vectors.sparkSession), *order).sortWithinPartitions(*order)
    links = cut(sorted_rows.select("pass", "label", "dims", "rep", "key", "vec").mapInArrow(_windows(window, least), "a long, b long"))
    # vectors that share an id are one node, whose classes lie under several representatives
    shared = named.groupBy("vec_id").agg(F.count_distinct("label", "vec").alias("m")).filter("m > 1").select("vec_id")
    several = named.join(shared, "vec_id").join(classes, ["label", "vec"]).select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    first = cut(components(links.union(several)))
    release(links)

    placed = (classes.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("label", "dims", "rep", "copies", F.coalesce("component", "rep").alias("component"), "vec")
              .mapInArrow(_placed, "label long, dims long, axis int, at double, rep long, copies long, component long, vec array<double>"))
    order = ["label", "dims", "axis", "at", "rep"]
    packed = placed.repartitionByRange(shuffle_width(vectors.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(
        _packed(BLOCK), "label long, dims long, n long, reps binary, copies binary, components binary, data binary")
    blocks = cut(packed.withColumn("block", F.monotonically_increasing_id()))
    sizes = blocks.groupBy("label", "dims").agg(F.sum("n").alias("rows"), F.ceil(F.sum("n") / (BLOCK * MEET)).cast("int").alias("parts")).filter("rows > 1").drop("rows")
    grouped = blocks.join(sizes, ["label", "dims"]).withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"))
    # each group of blocks meets every group of its label; only counts and joining pairs come out
    dealt = (grouped.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("label", "dims", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "block", "reps", "copies", "components", "data"))
    met = cut(dealt.groupBy("label", "dims", "lo", "hi").applyInArrow(_met(least), "a long, b long, n long"))
    counts = met.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = met.filter("b IS NOT NULL").select("a", "b")
    comp = cut(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(joined)))
    release(first, blocks)

    per = (classes.join(counts, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
           .select(F.col("label").alias("l"), F.col("vec").alias("v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = base.join(per, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("v")) & F.col("vec_id").isNotNull(), "left")
    top = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), top.alias("component_id"), F.coalesce(F.col("vec_id") == top, F.lit(True)).alias("kept"))
