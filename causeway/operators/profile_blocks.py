"""Scores of all pairs of profiles, block against block.

A block holds the numbers of up to ``BLOCK`` neighbouring profiles in one row:
hashes of their fields, of their sets and of the elements of these. All fields
but the last set together are a profile's head. Two blocks compare their
distinct heads and their distinct last sets only; the score of a pair is read
from both tables, added in the order of ``similarity.match_score``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.session import checkpointed

#: Profiles of a block, and blocks that one task packs.
BLOCK, PACKED = 1024, 16
#: Profiles of a block that are scored at once, and shared elements counted at once.
STRIPE, ELEMENTS = 128, 4096
HEAD_SETS, TAIL_SET = ("structures", "control", "roles"), "invariant_set"
_SETS = (*HEAD_SETS, TAIL_SET)
_PLAIN = ("profile", "head", "algorithm", "complexity", *[f"{c}_id" for c in _SETS], *[f"{c}_n" for c in _SETS])
_COLUMNS = (*_PLAIN, *[f"{c}_of" for c in _SETS])
_PACKED = pa.schema([("block", pa.int64()), *[(c, pa.list_(pa.int64())) for c in _COLUMNS]])


def packed(profiles: DataFrame) -> DataFrame:
    """Profiles as blocks, those with like heads next to each other; written once."""
    sets = {c: F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in _SETS}
    field = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.xxhash64(c)).cast("long")
    rows = profiles.select(
        "profile", field("algorithm").alias("algorithm"), field("complexity").alias("complexity"),
        *[F.xxhash64(F.array_sort(s)).alias(f"{c}_id") for c, s in sets.items()], *[F.size(s).cast("long").alias(f"{c}_n") for c, s in sets.items()],
        *[F.transform(s, lambda x: F.xxhash64(x)).alias(f"{c}_of") for c, s in sets.items()])
    head = ("algorithm", "complexity", *[f"{c}_id" for c in HEAD_SETS])
    rows = checkpointed(rows.withColumn("head", F.xxhash64(*head)).select(*_COLUMNS))
    near = [*head, "profile"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        for first in range(0, len(table), BLOCK):
            part = table.slice(first, BLOCK)
            key = part["profile"][0].as_py()  # no two blocks begin with the same profile
            lists = [pc.chunk(0) if c in _PLAIN else pc.chunk(0).flatten() for c, pc in ((c, part[c]) for c in _COLUMNS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), *[pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v.cast(pa.int64())) for v in lists]], schema=_PACKED)

    tasks = rows.count() // (PACKED * BLOCK) + 1
    return checkpointed(rows.repartitionByRange(tasks, *near).sortWithinPartitions(*near).mapInArrow(
        pack, "block long, " + ", ".join(f"{c} array<long>" for c in _COLUMNS)))


class Block:
    """One packed row, with one profile for each of its heads."""

    def __init__(self, batch: pa.RecordBatch, at: int, side: str):
        self.of = {c: batch.column(f"{side}_{c}")[at].values.to_numpy(zero_copy_only=False) for c in _COLUMNS}
        self.profile = self.of["profile"]
        self.heads, self.head = np.unique(self.of["head"], return_index=True, return_inverse=True)[1:]

    def sets(self, column: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold each distinct set of the given rows, and which of them each has."""
        first, place = np.unique(self.of[f"{column}_id"][rows], return_index=True, return_inverse=True)[1:]
        return rows[first], place

    def elements(self, column: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the row and element, for all elements of the rows' sets."""
        n = self.of[f"{column}_n"]
        ends, size = np.cumsum(n), n[rows]
        own = np.repeat(np.arange(len(rows)), size)
        inside = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        return own, self.of[f"{column}_of"][np.repeat(ends[rows] - size, size) + inside]


def _jaccard(a: Block, b: Block, column: str, rows_a: np.ndarray, rows_b: np.ndarray) -> np.ndarray:
    (sets_a, in_a), (sets_b, in_b) = a.sets(column, rows_a), b.sets(column, rows_b)
    (own_a, of_a), (own_b, of_b) = a.elements(column, sets_a), b.elements(column, sets_b)
    shared, common = np.zeros((len(sets_a), len(sets_b))), np.intersect1d(of_a, of_b)
    for first in range(0, len(common), ELEMENTS):
        some = common[first:first + ELEMENTS]
        held = []
        for own, of, n in ((own_a, of_a, len(sets_a)), (own_b, of_b, len(sets_b))):
            m, place = np.zeros((n, len(some)), np.float32), np.minimum(np.searchsorted(some, of), len(some) - 1)
            hit = some[place] == of
            m[own[hit], place[hit]] = 1
            held.append(m)
        shared += held[0] @ held[1].T
    union = a.of[f"{column}_n"][sets_a][:, None] + b.of[f"{column}_n"][sets_b][None] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)[in_a][:, in_b]


def _same(a: Block, b: Block, column: str) -> np.ndarray:
    x, y = a.of[column][a.heads], b.of[column][b.heads]
    return ((x[:, None] == y[None]) & (x != 0)[:, None]).astype(float)


class Scores:
    """Scores of the pairs of two blocks."""

    def __init__(self, a: Block, b: Block):
        j = {c: _jaccard(a, b, c, a.heads, b.heads) for c in HEAD_SETS}
        self.head = 4 * _same(a, b, "algorithm") + 2 * j["structures"] + 1.5 * j["control"] + _same(a, b, "complexity") + 1.5 * j["roles"]
        (tails_a, self.tail_a), (tails_b, self.tail_b) = a.sets(TAIL_SET, np.arange(len(a.profile))), b.sets(TAIL_SET, np.arange(len(b.profile)))
        self.tail = _jaccard(a, b, TAIL_SET, tails_a, tails_b)
        self.a, self.b = a, b

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Scores of some rows of the first block, not rounded."""
        return (np.take(self.head[self.a.head[rows]], self.b.head, axis=1) + np.take(self.tail[self.tail_a[rows]], self.tail_b, axis=1)) / 11

    def most(self) -> np.ndarray:
        """Thousandths that no score of a row of the first block exceeds."""
        return thousandths((self.head.max(axis=1) + self.tail.max()) / 11)[self.a.head]


def thousandths(x: np.ndarray) -> np.ndarray:
    """Values rounded to thousandths as Spark rounds doubles: half up, by their shortest decimal text."""
    y = x * 1000
    out = np.floor(y + 0.5)
    for i in zip(*np.nonzero(np.abs(y - out) > 0.5 - 1e-6)):
        out[i] = int(Decimal(repr(float(x[i]))).quantize(Decimal("0.001"), ROUND_HALF_UP).scaleb(3))
    return out.astype(np.int64)


def meet(a: DataFrame, b: DataFrame, each: Callable[[Iterator[Scores]], Iterator[pa.RecordBatch]], schema: str, upper: bool = False) -> DataFrame:
    """Every block of ``a`` with every block of ``b``, or with those not before it; ``each`` gets the pairs of a task, those of one block of ``a`` in a row."""
    left, right = (df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns]) for df, s in ((a, "a"), (b, "b")))
    pairs = left.repartition(max(1, a.count()), "a_block").crossJoin(right)
    if upper:
        pairs = pairs.filter("a_block <= b_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scores() -> Iterator[Scores]:
            now, held = None, None
            for batch in batches:
                for i, key in enumerate(batch.column("a_block").to_pylist()):
                    if key != now:
                        now, held = key, Block(batch, i, "a")
                    yield Scores(held, Block(batch, i, "b"))

        return each(scores())

    return pairs.mapInArrow(run, schema)


def stripes(block: Block) -> Iterator[np.ndarray]:
    for first in range(0, len(block.profile), STRIPE):
        yield np.arange(first, min(first + STRIPE, len(block.profile)))


def listed(scores: Iterator[Scores]) -> Iterator[pa.RecordBatch]:
    """Pairs that share anything: both profiles and thousandths."""
    for s in scores:
        for rows in stripes(s.a):
            raw = s.raw(rows)
            i, j = np.nonzero(raw > 0)
            yield pa.RecordBatch.from_arrays([pa.array(s.a.profile[rows[i]]), pa.array(s.b.profile[j]), pa.array(thousandths(raw[i, j]))], ["profile_a", "profile_b", "score"])


def counted(scores: Iterator[Scores]) -> Iterator[pa.RecordBatch]:
    """How many ordered pairs that share anything have each score, where blocks meet those not before them."""
    total = np.zeros(1001, np.int64)
    for s in scores:
        twice = 1 + (s.a.profile[0] != s.b.profile[0])
        for rows in stripes(s.a):
            raw = s.raw(rows)
            found = np.bincount(thousandths(raw).ravel(), minlength=1001)
            found[0] -= np.count_nonzero(raw <= 0)
            total += twice * found
    kept = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], ["score", "pairs"])


def best(k: int) -> Callable[[Iterator[Scores]], Iterator[pa.RecordBatch]]:
    """The ``k`` best partners of every profile among the blocks it meets in a task, ties to the smaller one."""

    def run(scores: Iterator[Scores]) -> Iterator[pa.RecordBatch]:
        own, top, whom = None, None, None

        def given() -> pa.RecordBatch:
            i, j = np.nonzero(top >= 0)
            return pa.RecordBatch.from_arrays([pa.array(own.profile[i]), pa.array(whom[i, j]), pa.array(top[i, j])], ["profile_a", "profile_b", "score"])

        for s in scores:
            if own is not s.a:
                if own is not None:
                    yield given()
                own, top, whom = s.a, np.full((len(s.a.profile), k), -1, np.int64), np.zeros((len(s.a.profile), k), np.int64)
            # an equal score may still win by the smaller profile
            open_rows = np.flatnonzero(s.most() >= top[:, -1])
            order = np.argsort(s.b.profile, kind="stable")
            for first in range(0, len(open_rows), STRIPE):
                rows = open_rows[first:first + STRIPE]
                raw = s.raw(rows)[:, order]
                score = np.where(raw > 0, thousandths(raw), -1)
                rank = score * len(order) + (len(order) - 1 - np.arange(len(order)))
                n = min(k, len(order))
                place = np.argpartition(-rank, n - 1, axis=1)[:, :n]
                new, who = np.take_along_axis(score, place, axis=1), s.b.profile[order][place]
                both, all_who = np.concatenate([top[rows], new], axis=1), np.concatenate([whom[rows], who], axis=1)
                keep = np.lexsort((all_who, -both), axis=1)[:, :k]
                top[rows], whom[rows] = np.take_along_axis(both, keep, axis=1), np.take_along_axis(all_who, keep, axis=1)
        if own is not None:
            yield given()

    return run
