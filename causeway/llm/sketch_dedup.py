"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders the shingles of a text; its sketch keeps the ``k``
least. Inverted lists of kept values give candidate pairs, an estimate over
the sketch of the union filters them, and the full sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from causeway.llm.common import as_bytes, cut, mix64, release
from causeway.llm.components import components

SHINGLE = 5
#: Kept values of a sketch. Two sets with similarity 0.85 share about 27 of 32.
K = 32
#: Longer lists are hot: their members are compared by their full sets.
HOT = 64
#: Candidate pairs of hot lists that one round may make; more pairs take more rounds.
PAIRS = 20_000_000
TURNS = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes, words: dict, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a text.

    A-Z count as lower case; words are separated by ASCII white space. A
    shorter text is one shingle; a text without words has none.
    """
    found = text.lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, count=n)
    width = min(n, size)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = out * _STEP + h[i:n - width + 1 + i]
    return np.unique(mix64(out + np.uint64(width)))


def _sketches(k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            ns, sigs, sketches = [], [], []
            for text in as_bytes(batch.column(1)):
                s = shingle_set(text, words, size)
                ns.append(len(s))
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketches.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n", "sig", "sketch"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            ids, texts = batch.column(0), as_bytes(batch.column(1))
            for at in range(0, len(texts), 256):
                sets = [shingle_set(t, words, size).tobytes() for t in texts[at:at + 256]]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(sets)), pa.array(sets, pa.binary())], ["doc_id", "set"])

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = np.frombuffer(data.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), doc)), pa.array(np.full(len(s), len(s)))], ["v", "rep", "n"])


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs whose estimate over the k least values of the union isn't far below the threshold.

    The margin is six standard deviations of the estimate at the threshold.
    """
    p = percent / 100
    one = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    hit = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))
    m = F.size("u")
    return (pairs.join(one, "a").join(two, "b").withColumn("u", union)
            .filter(hit >= m * p - 6 * F.sqrt(m * (p * (1 - p)))).select("a", "b"))


def _fetched(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``doc_id, set``, written, of the documents ``ids``; the join is the same at every size."""
    return cut(docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id long, set binary"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))


def _links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that the full sets confirm, as a written table."""
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("xa")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("xb"))
    full = near.join(one, "a").join(two, "b").select("a", "b", "xa", "xb")
    return cut(full.mapInArrow(_verified(percent), "a long, b long"))


def _star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Each member of a list with the least member of about its size.

    Sizes fall into bands no wider than the similarity allows; a member also
    meets the least member of the band below.
    """
    banded = lists.withColumn("band", F.floor(F.log(F.col("n")) / float(-np.log(percent / 100))).cast("int"))
    least = banded.groupBy("v", "band").agg(F.min("rep").alias("hub"))
    hubs = least.union(least.select("v", F.col("band") + 1, "hub"))
    return (banded.join(hubs, ["v", "band"]).filter("rep <> hub")
            .select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct())


def _need(n, p: float):
    """Least number of common values among ``n`` kept ones that the estimate lets pass."""
    return F.greatest(F.lit(1), F.ceil(n * p - 6 * F.sqrt(n * (p * (1 - p)))))


def _prefix_lists(sets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Inverted lists of the rarest elements of the full sets of ``reps``.

    Elements are ranked by the number of these sets that hold them; two sets
    of the asked similarity share one of their ``n - ceil(percent n) + 1``
    first elements.
    """
    full = cut(sets.join(reps, "doc_id", "left_semi").distinct().mapInArrow(_elements, "v long, rep long, n long"))
    ranked = full.join(full.groupBy("v").agg(F.count(F.lit(1)).alias("df")), "v")
    place = F.row_number().over(W.Window.partitionBy("rep", "n").orderBy("df", "v"))
    first = ranked.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    out = cut(first.filter("df > 1").select("v", "rep", "n", "df", "place"))
    release(full)
    return out


def _open_lists(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """Lists whose members still belong to several components, with each member's component.

    ``major`` marks members of the component that holds most of the list.
    """
    named = lists.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    per = named.groupBy("v", "c").agg(F.count(F.lit(1)).alias("m"))
    top = per.groupBy("v").agg(F.max(F.struct("m", "c"))["c"].alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
    return named.join(top, "v").withColumn("major", F.col("c") == F.col("top")).drop("top")


def _cross_pairs(hubs: DataFrame, members: DataFrame, percent: int, placed: bool = False) -> DataFrame:
    """Pairs of a list across components whose sizes allow the similarity.

    Where lists hold an element's place in the order of a full set, a pair
    must also be able to share enough from its first common element on.
    """
    places = [F.col("place").alias("rplace")] if placed else []
    h = hubs.select("v", F.col("rep").alias("r"), F.col("c").alias("rc"), F.col("n").alias("rn"), *places)
    pairs = members.join(h, "v").filter("c <> rc").filter("major or rep > r").filter(F.least("n", "rn") * 100 >= F.greatest("n", "rn") * percent)
    if placed:
        pairs = pairs.filter((F.least(F.col("n") - F.col("place"), F.col("rn") - F.col("rplace")) + 1) * (100 + percent) >= (F.col("n") + F.col("rn")) * percent)
    return pairs.select(F.greatest("rep", "r").alias("a"), F.least("rep", "r").alias("b")).distinct()


#: Rows without id are named by their texts, from here on: above all ids given.
UNNAMED = 1 << 62


def node_id(doc_id, text):
    """The id of a row as a node; a row without id is named by a hash of its text."""
    return F.coalesce(doc_id.cast("long"), F.lit(UNNAMED) + F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(UNNAMED >> 1)))


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = K, size: int = SHINGLE, hot: int = HOT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Components of documents linked by ``100 * common >= percent * union`` of their shingle sets.

    Returns ``doc_id, n_shingles, component_id, kept, node`` for every row of
    ``docs``, with the least id reachable as the component. Null and blank
    texts have no shingles and link with nothing. Rows that share an id are
    one node, as are rows without id that share a text. Those link like all
    others, after every id: such a row is kept where no row with an id and no
    other node before it is in its component, whose id is null if nobody in
    it has one. Ids from 2**62 on can't be told from such rows. Other columns
    are ignored.

    Texts with equal sets are one class, so copies never meet each other. A
    text is looked up by the rarest values of its sketch alone, so many that
    two texts which the estimate lets pass must share one of them. A list is
    first linked through its least member per size band; afterwards only
    pairs across components are compared, in short lists at once. Texts
    whose lookup values include hot ones also meet through the rarest
    elements of their full sets: there, the members outside a list's largest
    component are compared with the whole list, in as many rounds as keep
    each round's output bounded.
    """
    base = docs.select(node_id(F.col(id_col), F.col(text_col)).alias("doc_id"), F.col(text_col).alias("text"))
    seen = cut(base.mapInArrow(_sketches(k, size), "doc_id long, n long, sig binary, sketch array<long>"))
    named = seen.filter("sig is not null")
    classes = cut(named.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    # same id, several texts: the classes of an id are linked through it
    entries = classes.select(F.explode("sketch").alias("v"), "rep", "n", F.size("sketch").alias("kept"))
    shared = entries.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    met = cut(entries.join(shared, "v"))
    mine = W.Window.partitionBy("rep")
    place = F.col("kept") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("df", "v"))
    lists = cut(met.withColumn("place", place).filter(F.col("place") <= F.col("kept") - _need(F.col("kept"), percent / 100) + 1).select("v", "rep", "n", "df"))
    common = cut(lists.filter(F.col("df") > hot).select(F.col("rep").alias("doc_id")).distinct())
    release(met)

    near = cut(_estimated(_star_pairs(lists, percent), classes, percent, k))
    sets = _fetched(base, _ends(near).union(common), size)
    links = _links(near, sets, percent)
    release(near)
    comp = components(links)
    left = cut(_open_lists(lists.filter(F.col("df") <= hot), comp))
    near = cut(_estimated(_cross_pairs(left.filter("not major"), left, percent), classes, percent, k))
    release(left, lists)
    if not near.isEmpty():
        some = _fetched(base, _ends(near), size)
        links = links.union(_links(near, some, percent))
        release(some)
    release(near)
    if not common.isEmpty():
        lists = _prefix_lists(sets, common, percent)
        comp = components(links)
        # every pair across components has an end outside the list's largest one: those ends are the hubs, in rounds of bounded output
        many = cut(_open_lists(lists, comp).withColumn("turn", F.pmod(F.xxhash64("rep"), F.lit(TURNS))))
        sizes = many.groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.col("major")).alias("h"))
        total = sizes.agg(F.sum(F.col("m") * F.col("h"))).first()[0] or 0
        rounds = min(TURNS, -(-total // PAIRS))
        for r in range(rounds):
            comp = components(links) if r else comp
            now = many.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "c")).drop("component")
            turn = now.filter(~F.col("major") & (F.col("turn") % rounds == r))
            near = cut(_estimated(_cross_pairs(turn, now.withColumn("major", F.lit(True)), percent, True), classes, percent, k))
            if not near.isEmpty():
                links = links.union(_links(near, sets, percent))
            release(near)
        release(many, lists)
    release(sets, common)
    same_id = (named.groupBy("doc_id").agg(F.count_distinct("sig").alias("m")).filter("m > 1").select("doc_id")
               .join(named.select("doc_id", "sig"), "doc_id").join(classes.select("sig", "rep"), "sig").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    comp = components(links.union(same_id))
    out = (seen.join(classes.select("sig", "rep"), "sig", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
           .join(comp.withColumnRenamed("node", "rep"), "rep", "left"))
    top = F.coalesce("component", "rep")
    named_only = lambda c: F.when(c < UNNAMED, c)
    return out.select(named_only(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), named_only(top).alias("component_id"), (F.col("doc_id") == top).alias("kept"), F.col("doc_id").alias("node"))
