"""Conversations that share their first turns, as the nodes of a prefix trie.

A conversation is cut into blocks of ``WIDTH`` turns, whose ids lie in
positional columns. One ``ROLLUP`` over these columns per block makes all
prefixes of all blocks at once; ``grouping_id`` tells how deep each lies. A
block is keyed by the node that the block before it ends in, so a long
conversation goes on in further rows and never in wider ones. Names of these
nodes come from pointer doubling: in round ``r`` a block takes in the ``2^r``
blocks before it, so the rounds grow with the logarithm of the longest
conversation, and one that holds most of all turns is spread like any other.

Of the members of a node the least owns it. Whoever owns a node owns all
nodes below it on its own path, each node has one owner, and so what is to be
summed over a subtree lies on the rows of its owners: a second ``ROLLUP`` adds
it up.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import ordered
from causeway.llm.common import cut, release, shuffle_width

#: Turns in a block.
WIDTH = 8
#: Bytes of a turn's id taken from SHA-256; four more hold the length of its text.
DIGEST = 16
#: Conversations among which one that leaves a hot node looks up its owner together.
SALTS = 64
#: Identifiers of one node that are joined to a text in one row.
BUCKET = 1 << 14

_TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]


def _zero() -> Column:
    return F.lit(0).cast("long")


def _turn_id(role: Column, text: Column) -> Column:
    """Role and text as one binary value: a digest and the text's length in bytes."""
    head = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(head.cast("binary"), 256)), 1, DIGEST)
    return F.concat(digest, F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0")))


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _numbered(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn_id)`` as a written table: place of each turn in its conversation.

    Rows are put in order by range partitions, so a conversation of any
    length is spread; one row count per partition comes to the driver.
    """
    spark = turns.sparkSession
    clean = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = cut(clean.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
               .select("conv_id", _turn_id(F.col("role"), F.col("text")).alias("turn_id"), F.monotonically_increasing_id().alias("at")))
    part, low = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    ahead = F.broadcast(spark.createDataFrame(starts, "p long, ahead long"))  # one row per partition
    placed = rows.join(ahead, part == F.col("p")).select("conv_id", "turn_id", (F.col("ahead") + low).alias("at"))
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    out = cut(placed.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "turn_id"))
    release(rows)
    return out


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` as numbered rows, and ``(conv_id, n)`` of all conversations."""
    rows = _numbered(turns)
    return rows, cut(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """As ``as_they_are``, each conversation beginning with the first turns of its group's first one.

    Of conversation ``c - c % group`` the first ``h`` turns are taken,
    ``h = crc32(c as text) % most``, then the turns of ``c`` after its own
    first ``h``.
    """
    rows = _numbered(turns)
    own = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    convs = own.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    convs = cut(convs.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
                .select("conv_id", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("k")))
    borrowed = (convs.filter("k > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("pos"))
                .join(rows.filter(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "turn_id"), ["base", "pos"])
                .select("conv_id", "pos", "turn_id"))
    kept = (rows.join(convs.select("conv_id", "h", "k"), "conv_id").filter("pos >= h")
            .select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "turn_id"))
    out = cut(borrowed.unionByName(kept))
    sizes = cut(convs.select("conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    release(rows, convs)
    return out, sizes


def _blocks(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv_id, block, n, t1 ..)``: turns in columns; every conversation has block 0, if only an empty one."""
    at = F.col("pos") % WIDTH
    wide = rows.groupBy("conv_id", F.floor(F.col("pos") / WIDTH).cast("long").alias("block")).agg(
        *[F.max(F.when(at == i, F.col("turn_id"))).alias(t) for i, t in enumerate(_TURNS)])
    all_of = convs.select("conv_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("n") - 1) / WIDTH), F.lit(0)).cast("long"))).alias("block"))
    return all_of.join(wide, ["conv_id", "block"], "left")


def _keyed(blocks: DataFrame, longest: int) -> DataFrame:
    """``blocks`` with ``before`` and ``key``: names of the paths up to the block's start and, if it is full, to its end."""
    last, name = max(0, (longest - 1) // WIDTH), F.when(F.col("n") >= (F.col("block") + 1) * WIDTH, _digest(*[F.col(t) for t in _TURNS]))
    if last == 0:
        return blocks.select("*", F.lit(None).cast("binary").alias("before"), name.alias("key"))
    names = cut(blocks.select("conv_id", "block", name.alias("key")).filter("key IS NOT NULL"))
    step = 1
    while step <= last:
        ahead = names.select("conv_id", (F.col("block") + step).alias("block"), F.col("key").alias("ahead"))
        joined = F.when(F.col("ahead").isNull(), F.col("key")).otherwise(_digest(F.col("ahead"), F.col("key")))
        more = cut(names.join(ahead, ["conv_id", "block"], "left").select("conv_id", "block", joined.alias("key")))
        release(names)
        names, step = more, step * 2
    before = names.select("conv_id", (F.col("block") + 1).alias("block"), F.col("key").alias("before"))
    return blocks.join(before, ["conv_id", "block"], "left").join(names, ["conv_id", "block"], "left")


def _named(level: Column) -> Column:
    """Name of the node ``level`` turns deep in a block; the end of a full block is the start of the next."""
    full = level == WIDTH
    head = F.concat_ws(":", F.col("block") + F.when(full, 1).otherwise(0), F.when(full, 0).otherwise(level), F.lit("")).cast("binary")
    turns = [F.when(level > i, F.col(t)).otherwise(F.lit(b"")) for i, t in enumerate(_TURNS)]
    return F.when(full, _digest(head, F.col("key"))).otherwise(_digest(head, F.coalesce("before", F.lit(b"")), *turns))


def _rolled(blocks: DataFrame, sums: str) -> DataFrame:
    """One row per node: all prefixes of all blocks at once. The empty prefix counts in the first block only."""
    level = reduce(lambda rest, i: F.when(F.col("gid") == (1 << (WIDTH - i)) - 1, i).otherwise(rest), range(WIDTH + 1), F.lit(None).cast("int"))
    last = reduce(lambda rest, i: F.when(F.col("gid") == (1 << (WIDTH - i)) - 1, F.col(_TURNS[i - 1])).otherwise(rest), range(1, WIDTH + 1), F.lit(None).cast("binary"))
    turns = ", ".join(_TURNS)
    out = blocks.sparkSession.sql(
        f"SELECT block, before, {turns}, grouping_id() AS gid, min(conv_id) AS conv_id, {sums} FROM {{blocks}} GROUP BY block, before, ROLLUP({turns})", blocks=blocks)
    return (out.select("*", level.alias("level"), last.alias("last")).filter("last IS NOT NULL OR (level = 0 AND block = 0)")
            .withColumn("depth", F.col("block") * WIDTH + F.col("level")))


def _nodes(blocks: DataFrame) -> DataFrame:
    size = F.coalesce(F.conv(F.hex(F.substring("last", DIGEST + 1, 4)), 16, 10).cast("long"), _zero())
    level = F.col("level")
    rolled = _rolled(blocks, "count(1) AS n_convs, min(key) AS key")
    return cut(rolled.select("conv_id", "depth", "block", "level", "n_convs", _named(level).alias("name"), F.when(F.col("depth") > 0, _named(level - 1)).alias("parent"),
                             ((F.col("n_convs") - 1) * size).alias("saved")))


def _children(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(name, n_children)`` and ``(parent, salt, parent_conv_id)``.

    Children of one node look its owner up together, in ``SALTS`` parts: a
    node with very many children is joined once a part, not once a child.
    """
    parts = cut(nodes.filter("depth > 0").groupBy("parent", _salt().alias("salt")).agg(F.count(F.lit(1)).alias("n")))
    counts = parts.groupBy(F.col("parent").alias("name")).agg(F.sum("n").alias("n_children"))
    owners = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return counts, parts.select("parent", "salt").join(owners, "parent")


def _salt() -> Column:
    return F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")


def _ended(blocks: DataFrame) -> DataFrame:
    """``(name, ends_sha256)`` of nodes where a conversation ends: digest of their identifiers in order."""
    end = (F.col("n") - F.col("block") * WIDTH).cast("int")
    ends = blocks.filter((F.col("n") <= (F.col("block") + 1) * WIDTH)).select(_named(end).alias("name"), "conv_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy("name", F.floor(F.col("conv_id") / BUCKET).alias("bucket")).agg(joined.alias("ids"))
    ordered_parts = parts.repartition(shuffle_width(blocks.sparkSession), "name").sortWithinPartitions("name", "bucket").select("name", "ids")

    def hashed(batches):
        """Rows of a name follow each other; only its running digest is held."""
        name, digest, done = None, None, []
        for batch in batches:
            for here, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if here != name:
                    if name is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = here, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield _pairs(done)
                done = []
        if name is not None:
            yield _pairs([(name, digest.hexdigest())])

    return ordered_parts.mapInArrow(hashed, "name binary, ends_sha256 string")


def _pairs(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["name", "ends_sha256"])


def _subtree_sums(blocks: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """``(conv_id, depth, n_leaves, saved_tokens)``: what owners hold at and below each node, added up over its members."""
    held = nodes.groupBy("conv_id", "block").agg(
        F.count(F.lit(1)).alias("owned"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"),
        *[F.sum(F.when(F.col("level") >= i, F.col("saved")).otherwise(_zero())).alias(f"s{i}") for i in range(1, WIDTH + 1)])
    zero = {c: 0 for c in held.columns if c not in ("conv_id", "block")}
    rows = blocks.select("conv_id", "block", "before", *_TURNS).join(held, ["conv_id", "block"], "left").fillna(zero)
    later = {"later": "s1", "later_leaf": "leaf", "later_owned": "owned"}
    if longest > WIDTH:
        rows = cut(rows)
        chunk = ordered.fitting_chunk(rows, "block")
        rows = ordered.running(rows, ["conv_id"], "block", {k: ("sum", F.col(v)) for k, v in later.items()}, reverse=True, chunk=chunk)
    else:
        rows = rows.select("*", *[_zero().alias(k) for k in later])
    rows = rows.filter("owned + later_owned > 0")
    rolled = _rolled(rows, "sum(leaf + later_leaf) AS n_leaves, " + ", ".join(f"sum(s{i} + later) AS v{i}" for i in range(1, WIDTH + 1)))
    saved = reduce(lambda rest, i: F.when(F.col("level") == i, F.col(f"v{i}")).otherwise(rest), range(2, WIDTH + 1), F.col("v1"))
    return rolled.select("conv_id", "depth", "n_leaves", saved.alias("saved_tokens"))


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``rows(conv_id, pos, turn_id)`` and ``convs(conv_id, n)``.

    ``conv_id`` is the least member, ``depth`` the number of turns,
    ``parent_conv_id`` the parent's ``conv_id`` (null at the root), then
    ``n_convs`` members, ``n_children``, ``n_leaves`` in the subtree,
    ``saved_tokens`` (bytes of last texts that members beyond the first
    repeat, over the subtree) and ``ends_sha256`` (digest of the identifiers
    that end there). Without conversations there is no node.

    Turns without ``conv_id`` belong to no conversation; null roles and texts
    are empty ones; turns with equal ``turn`` are ordered by role, then text,
    and equal rows count as often as they are there. Other columns are
    ignored.
    """
    longest = convs.agg(F.max("n")).first()[0] or 0
    blocks = cut(_keyed(_blocks(rows, convs), longest))
    nodes = _nodes(blocks)
    counts, owners = _children(nodes)
    counted = cut(nodes.join(counts, "name", "left").join(_ended(blocks), "name", "left").select(
        "conv_id", "depth", "block", "level", "parent", _salt().alias("salt"), "n_convs", "saved", F.coalesce("n_children", _zero()).alias("n_children"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
    sums = _subtree_sums(blocks, counted, longest)
    return (counted.join(sums, ["conv_id", "depth"], "left").join(owners, ["parent", "salt"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
