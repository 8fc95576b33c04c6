"""Spelling variants: words one edit apart, found by k-d trees over counts of letters.

One edit moves a word's letter counts little. A replaced letter takes one
away and adds one, so each of the two words lies at most one above and at
most one below any box that holds the other; an inserted letter only adds
one. A search over a box is cut off where a word lies further outside.

Words of one length are dealt into cells by a tree fitted on a bounded
sample. A word is sent to the cells of its own length and of the next one
that can hold a partner; there the cell's words form a tree of their own, and
the order of letters decides. A cell that is too large, as when very many words
have equal counts, is searched in slabs, so nothing is lost by the sample.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import cut, release, shuffle_width

#: Words a cell is meant to hold, and words a task builds one tree of.
CELL, SLAB = 4096, 16384
#: Bytes of words a task builds one tree of; long words make smaller slabs.
SLAB_BYTES = 1 << 24
#: Words on which the cells of all lengths are fitted; a bound on what the driver sees.
SAMPLE = 200_000
#: Sampled words per cell at least.
SEEN = 24
#: Words in a leaf of the tree inside a cell.
LEAF = 64
#: Pairs whose halves are compared at once.
BLOCK = 1 << 20

#: Letters a to z count apart, all others by their code modulo 6: sums of counts keep every bound.
DIMS = 32
_FOLD = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)], np.int64)
_WEIGHTS = np.random.default_rng(12).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)

RUNS = "[A-Za-z\\u00C0-\\u00FF]"


def words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = 7, times: int = 2, every: int = 31) -> DataFrame:
    """``(word, n)``: words of at least ``least`` letters that occur ``times`` times.

    A word is a maximal run of letters with A-Z in lower case. Where ``every``
    divides ``crc32("<doc_id>:<run>")`` one letter, given by the same number,
    is left out: misprints made on purpose. A null text has no words, a null
    id counts as the empty text.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text_col, F.lit(f"{RUNS}{{{least},}}+"), F.lit(0))).alias("run"))
    runs = runs.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, lower)).otherwise(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % every == 0, short).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


def _matrix(found: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(found).encode("latin-1"), np.uint8).reshape(len(found), length)


def _counts(letters: np.ndarray) -> np.ndarray:
    n = len(letters)
    at = _FOLD[letters] + np.arange(n)[:, None] * DIMS
    return np.bincount(at.ravel(), minlength=n * DIMS).reshape(n, DIMS).astype(np.int32)


def _halving(counts: np.ndarray) -> tuple[int, int] | None:
    """The dimension and threshold that come closest to halving the rows; None where all are equal."""
    n, best = len(counts), None
    for d in np.argsort(-counts.var(axis=0))[:8]:
        values = np.sort(counts[:, d])
        if values[0] == values[-1]:
            continue
        for t in {int(values[n // 2]), int(values[n // 2]) - 1}:
            share = np.searchsorted(values, t, side="right")
            if 0 < share < n and (best is None or abs(2 * share - n) < best[0]):
                best = (abs(2 * share - n), int(d), t)
    return best and best[1:]


class Cells:
    """A k-d tree over all of letter-count space, whose leaves are cells numbered from 0."""

    def __init__(self, sample: np.ndarray | None = None, cells: float = 1.0):
        self.dim, self.cut, self.low, self.high, self.leaf, self.size = [], [], [], [], [], 0
        self._grow(sample, cells)

    def _grow(self, sample, cells) -> int:
        me, split = len(self.dim), None
        for of in (self.dim, self.cut, self.low, self.high, self.leaf):
            of.append(-1)
        if sample is not None and cells > 1 and len(sample) >= 2 * SEEN:
            split = _halving(sample)
        if split is None:
            self.leaf[me], self.size = self.size, self.size + 1
            return me
        d, t = self.dim[me], self.cut[me] = split
        left = sample[:, d] <= t
        share = left.mean()
        self.low[me], self.high[me] = self._grow(sample[left], cells * share), self._grow(sample[~left], cells * (1 - share))
        return me

    def home(self, counts: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out, todo = np.zeros(len(counts), np.int64), [(0, np.arange(len(counts)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                left = counts[rows, self.dim[node]] <= self.cut[node]
                todo += [(self.low[node], rows[left]), (self.high[node], rows[~left])]
        return out

    def near(self, counts: np.ndarray, above: int, below: int):
        """``(row, cell)`` of all cells whose box a row exceeds by at most ``above`` and falls short of by at most ``below``."""
        n, rows_out, cells_out = len(counts), [], []
        zero = np.zeros(n, np.int32)
        todo = [(0, np.arange(n), zero, zero, {})]
        while todo:
            node, rows, over, under, box = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                rows_out.append(rows)
                cells_out.append(np.full(len(rows), self.leaf[node]))
                continue
            d, t = self.dim[node], self.cut[node]
            x, (low, high) = counts[rows, d], box.get(d, (0, 1 << 30))
            more = over - np.maximum(x - high, 0) + np.maximum(x - t, 0)
            less = under - np.maximum(low - x, 0) + np.maximum(t + 1 - x, 0)
            a, b = more <= above, less <= below
            todo += [(self.low[node], rows[a], more[a], under[a], box | {d: (low, t)}), (self.high[node], rows[b], over[b], less[b], box | {d: (t + 1, high)})]
        return (np.concatenate(rows_out), np.concatenate(cells_out)) if rows_out else (np.zeros(0, int), np.zeros(0, int))


def _by_length(found: list[str]):
    """``(length, places)`` of the words of each length."""
    lengths = np.array([len(w) for w in found])
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


def fit_cells(counted: DataFrame) -> dict[int, Cells]:
    """Cells of every length that needs more than one, from at most about ``SAMPLE`` words picked by hash."""
    sizes = {r.length: r.n for r in counted.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL).collect()}
    if not sizes:
        return {}
    one_in = max(1, -(-sum(sizes.values()) // SAMPLE))
    picked = counted.filter(F.length("word").isin(*sizes) & (F.pmod(F.xxhash64("word"), F.lit(one_in)) == 0))
    found = [r.word for r in picked.select("word").collect()]
    return {length: Cells(_counts(_matrix([found[i] for i in at], length)), sizes[length] / CELL) for length, at in _by_length(found)}


def _slab_words(length: int) -> int:
    return max(1, min(SLAB, SLAB_BYTES // length))


_HOMES = "word string, n long, length int, cell long"
_SENT = "length int, cell long, slab int, asked int, word string, n long"
_PAIRS = "word string, near string, near_n long"
_ONE = Cells()


def _at_home(cells: dict[int, Cells]):
    def run(batches):
        for batch in batches:
            found = batch.column(0).to_pylist()
            length, cell = np.zeros(len(found), np.int32), np.zeros(len(found), np.int64)
            for size, at in _by_length(found):
                length[at] = size
                if size in cells:
                    cell[at] = cells[size].home(_counts(_matrix([found[i] for i in at], size)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(length), pa.array(cell)], ["word", "n", "length", "cell"])

    return run


def _sent(cells: dict[int, Cells], slabs: dict[tuple[int, int], int]):
    """Each word once as a member of its cell (``asked`` 0) and once for each cell to search: 1 same length, 2 next length, 3 its own cell."""
    def rows(length, cell, asked, found, n, at):
        many = np.array([slabs.get((length, int(c)), 1) for c in cell], np.int64)
        if asked == 0:
            slab = np.array([zlib.crc32(found[i].encode()) % m if m > 1 else 0 for i, m in zip(at, many)], np.int32)
        else:  # every slab of a cell is searched
            slab = np.concatenate([np.arange(m) for m in many]).astype(np.int32) if len(many) else np.zeros(0, np.int32)
            at, cell = np.repeat(at, many), np.repeat(cell, many)
        k = len(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, length, np.int32)), pa.array(cell.astype(np.int64)), pa.array(slab), pa.array(np.full(k, asked, np.int32)),
             pa.array([found[i] for i in at], pa.string()), n.take(pa.array(at))], ["length", "cell", "slab", "asked", "word", "n"])

    def run(batches):
        for batch in batches:
            found, n = batch.column(0).to_pylist(), batch.column(1)
            home = batch.column(3).to_numpy(zero_copy_only=False)
            for length, at in _by_length(found):
                yield rows(length, home[at], 0, found, n, at)
                counts = _counts(_matrix([found[i] for i in at], length))
                i, cell = cells.get(length, _ONE).near(counts, 1, 1)
                for asked, mine in ((1, cell < home[at][i]), (3, cell == home[at][i])):  # a pair of cells meets once
                    yield rows(length, cell[mine], asked, found, n, at[i[mine]])
                i, cell = cells.get(length + 1, _ONE).near(counts, 0, 1)
                yield rows(length + 1, cell, 2, found, n, at[i])

    return run


def _weighed(letters: np.ndarray) -> np.ndarray:
    """One number per row: equal rows have equal ones."""
    out = np.zeros(len(letters), np.uint64)
    for i in range(0, letters.shape[1], 64):
        part = letters[:, i:i + 64].astype(np.uint64)
        out = out * np.uint64(0x9E3779B97F4A7C15) + (part * _WEIGHTS[:part.shape[1]]).sum(axis=1, dtype=np.uint64)
    return out


class Tree:
    """The words of one cell (or slab) by their letter counts, to be searched by words of the same or the shorter length."""

    def __init__(self, found: list[str], n: np.ndarray, length: int):
        self.found, self.n, self.length = found, n, length
        self.letters = _matrix(found, length)
        self.counts = _counts(self.letters)
        self.nodes = []  # (lowest, highest, rows of a leaf or None, low child, high child)
        self._grow(np.arange(len(found)))
        half, short = length // 2, (length - 1) // 2
        self.halves = {1: (_weighed(self.letters[:, :half]), _weighed(self.letters[:, half:])),
                       2: (_weighed(self.letters[:, :short]), _weighed(self.letters[:, short + 1:]))}

    def _grow(self, rows) -> int:
        me, own = len(self.nodes), self.counts[rows]
        self.nodes.append(None)
        split = _halving(own) if len(rows) > LEAF else None
        if split is None:
            self.nodes[me] = (own.min(axis=0), own.max(axis=0), rows, -1, -1)
        else:
            left = own[:, split[0]] <= split[1]
            self.nodes[me] = (own.min(axis=0), own.max(axis=0), None, self._grow(rows[left]), self._grow(rows[~left]))
        return me

    def search(self, asked: list[str], kind: int):
        """``(place in asked, member)`` of all pairs one edit apart: same length where ``kind`` is 1, else one letter shorter."""
        size = self.length if kind == 1 else self.length - 1
        letters = _matrix(asked, size)
        counts, above = _counts(letters), 1 if kind == 1 else 0
        heads, tails = _weighed(letters[:, :size // 2]), _weighed(letters[:, size // 2:])
        own_heads, own_tails = self.halves[kind]
        todo = [(0, np.arange(len(asked)))]
        while todo:
            node, rows = todo.pop()
            lowest, highest, members, low, high = self.nodes[node]
            mine = counts[rows]
            rows = rows[(np.maximum(mine - highest, 0).sum(axis=1) <= above) & (np.maximum(lowest - mine, 0).sum(axis=1) <= 1)]
            if not len(rows):
                continue
            if members is None:
                todo += [(low, rows), (high, rows)]
                continue
            step = max(1, BLOCK // len(members))
            for i in range(0, len(rows), step):
                part = rows[i:i + step]
                # one edit leaves the half before it or the half after it as it was
                a, b = np.nonzero((heads[part][:, None] == own_heads[members]) | (tails[part][:, None] == own_tails[members]))
                yield from self._verified(letters, part[a], members[b], kind)

    def _verified(self, letters, a, b, kind):
        step = max(1, BLOCK // self.length)
        for i in range(0, len(a), step):
            x, y, q, m = letters[a[i:i + step]], self.letters[b[i:i + step]], a[i:i + step], b[i:i + step]
            if kind == 1:
                ok = (x != y).sum(axis=1) == 1
            else:
                same, shifted = x == y[:, :-1], (x == y[:, 1:])[:, ::-1]
                lead = np.where(same.all(axis=1), x.shape[1], same.argmin(axis=1))
                trail = np.where(shifted.all(axis=1), x.shape[1], shifted.argmin(axis=1))
                ok = lead + trail >= x.shape[1]
            yield q[ok], m[ok]


def _searched(batches):
    """Pairs one edit apart, both ways. Rows come sorted by cell, its members first; those that ask stream past."""
    key, members, tree = None, [], None
    for batch in batches:
        length, cell, slab, asked = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        found, n = batch.column(4).to_pylist(), batch.column(5).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in (length, cell, slab, asked)], axis=0)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(found)]):
            if start == end:
                continue
            here, kind = (length[start], cell[start], slab[start]), int(asked[start])
            if here != key:
                key, members, tree = here, [], None
            if kind == 0:
                members.append((found[start:end], n[start:end]))
                continue
            if not members:
                continue
            if tree is None:
                tree = Tree([w for part, _ in members for w in part], np.concatenate([c for _, c in members]), int(here[0]))
            for i in range(start, end, 4096):
                yield from _both_ways(tree, found[i:min(end, i + 4096)], n[i:min(end, i + 4096)], kind)


def _both_ways(tree: Tree, asked: list[str], n: np.ndarray, kind: int):
    left, right, near_n = [], [], []
    for q, m in tree.search(asked, 2 if kind == 2 else 1):
        for i, j in zip(q.tolist(), m.tolist()):
            a, b = asked[i], tree.found[j]
            if kind == 3 and a < b:
                continue  # words of one cell meet twice
            left += [a, b]
            right += [b, a]
            near_n += [int(tree.n[j]), int(n[i])]
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(near_n, pa.int64())], ["word", "near", "near_n"])


def near_words(counted: DataFrame) -> DataFrame:
    """``(word, near, near_n)`` for all ordered pairs of ``counted(word, n)`` that differ by one letter inserted, deleted or replaced.

    Words hold code points up to 255 and are distinct.
    """
    cells = fit_cells(counted)
    homes = cut(counted.select("word", "n").mapInArrow(_at_home(cells), _HOMES))
    most = F.lit(SLAB_BYTES) / F.col("length")
    large = homes.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > F.least(F.lit(SLAB), most))
    slabs = {(r.length, r.cell): -(-r.n // _slab_words(r.length)) for r in large.collect()}
    place = ["length", "cell", "slab"]
    sent = homes.mapInArrow(_sent(cells, slabs), _SENT).repartition(shuffle_width(counted.sparkSession), *place).sortWithinPartitions(*place, "asked")
    return sent.mapInArrow(_searched, _PAIRS)


def _roots(formed: DataFrame) -> DataFrame:
    """``(word, root)`` for the words of ``formed(word, form)``: forms followed to the last, two steps at a time."""
    links = cut(formed.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        more = cut(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        done = more.filter("moved").isEmpty()
        release(links)
        links = more.select("word", "root")
        links._cut_path = more._cut_path
        if done:
            return links


def variants(counted: DataFrame, factor: int = 10) -> DataFrame:
    """The most frequent near word of each word of ``counted(word, n)``, where it is ``factor`` times as frequent.

    Gives ``word, form, root, n, n_near, form_n``; ties go to the word that
    comes first by code points. ``root`` follows forms to the last one, which
    ends because every form is more frequent than its word; it is the word
    itself where it has no form. A word without near words keeps its row.
    """
    best = near_words(counted).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    formed = F.col("best.less") * -1 >= F.col("n") * factor
    rows = cut(counted.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")))
    roots = _roots(rows.filter("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of whole texts with their spelling variants; see ``words`` and ``variants``. Extra columns are ignored."""
    return variants(cut(words(docs)))
