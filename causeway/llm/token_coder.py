"""Token ids in a binary format, packed by an adaptive context-mixing range coder.

A block holds the ids of whole documents, about a million. It starts from
fresh models, carries a checksum and can be read without any other block.
Inside a block, lanes of consecutive ids have coder states of their own and
advance together, one numpy lane each, over models they share: the last id
seen after the same two ids and the last one after the same id predict the
next; the range is divided among these two predictions and the order-0 model
by how often each was right at the same confidence. All models learn from
what the block has held so far.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import as_bytes, cut, shuffle_width

#: Ids after which a block ends with the document; a longer document makes a longer block.
BLOCK = 1 << 20
LANES = 2048
#: Least ids of a lane, so that short blocks have few.
STEPS = 512
#: Steps between two updates of the order-0 model, and the weight of an id seen.
EVERY, WEIGHT = 16, 32
END = 1
MAGIC = b"TIDX\x02"
_HEAD = struct.Struct("<5sxHIIQII")
MEMORY = 500_000
#: White space that parts the runs of a text.
SPACES = "\t\n\x0b\x0c\r "
_U = np.uint64
_TOP, _BOT = _U(1 << 48), _U(1 << 32)
_W16, _W48, _LOW32 = _U(16), _U(48), _U((1 << 32) - 1)
_SLOTS1, _SLOTS2 = 17, 20
_FLAGS = 1 << 20


class _Coder:
    """Shared models of a block and the coder states of its lanes."""

    def __init__(self, lanes: int, steps: int, symbols: int, words: np.ndarray | None = None):
        self.lanes, self.symbols, self.at = lanes, symbols, np.arange(lanes)
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.flags = np.tile(np.array([1, 1, 4], np.int64), (32, 1))
        self.last1, self.sure1 = np.zeros(1 << _SLOTS1, np.uint32), np.zeros(1 << _SLOTS1, np.uint8)
        self.last2, self.sure2 = np.zeros(1 << _SLOTS2, np.uint32), np.zeros(1 << _SLOTS2, np.uint8)
        self.counts, self.seen = np.ones(symbols, np.int64), []
        self._cumulate()
        self.words, self.pos = words, np.full(lanes, 0 if words is None else 4, np.int64)
        if words is None:
            self.out = np.zeros((lanes, 3 * steps + 16), np.uint16)
        else:
            self.code = sum(words[:, i].astype(np.uint64) << _U(48 - 16 * i) for i in range(4))

    def _cumulate(self) -> None:
        self.ends = np.cumsum(self.counts)

    def _narrow(self, at: np.ndarray | slice, start: np.ndarray, count: np.ndarray, rng: np.ndarray) -> None:
        """Give the lanes ``at`` their part of the range and move settled 16-bit words out of (or into) their states."""
        low, rng = self.low[at] + start.astype(np.uint64) * rng, rng * count.astype(np.uint64)
        while True:
            same = (low ^ (low + rng)) < _TOP
            go = np.flatnonzero(same | (rng < _BOT))
            if not len(go):
                break
            lanes, l = self.at[at][go], low[go]
            r = np.where(same[go], rng[go], (~l + _U(1)) & _LOW32)
            if self.words is None:
                self.out[lanes, self.pos[lanes]] = (l >> _W48).astype(np.uint16)
            else:
                self.code[lanes] = (self.code[lanes] << _W16) | self.words[lanes, self.pos[lanes]].astype(np.uint64)
            self.pos[lanes] += 1
            low[go], rng[go] = l << _W16, r << _W16
        self.low[at], self.range[at] = low, rng

    def step(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Code the next id of every lane after the ids ``b, a`` (``a`` is the nearer one)."""
        one = (a * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS1)
        two = ((a * np.uint32(0x85EBCA6B)) ^ (b * np.uint32(0xC2B2AE35))) * np.uint32(0x9E3779B1) >> np.uint32(32 - _SLOTS2)
        p1, p2, s1, s2 = self.last1[one], self.last2[two], self.sure1[one], self.sure2[two]
        ctx = s2.astype(np.int64) * 8 + s1 * 2 + (p1 == p2)
        flags = self.flags
        ends = np.cumsum(flags, axis=1)
        rng = self.range // ends[ctx, 2].astype(np.uint64)
        if ids is None:
            value = ((self.code - self.low) // rng).astype(np.int64)
            kind = (value >= ends[ctx, 0]).astype(np.int64) + (value >= ends[ctx, 1])
            out = np.where(kind == 0, p2, p1) - np.uint32(1)
        else:
            out = ids
            new = ids + np.uint32(1)
            kind = np.where(p2 == new, 0, np.where(p1 == new, 1, 2))
        count = flags[ctx, kind]
        self._narrow(slice(None), ends[ctx, kind] - count, count, rng)
        flags += np.bincount(ctx * 3 + kind, minlength=96).reshape(32, 3)
        if ends[:, 2].max() > _FLAGS:
            flags[ends[:, 2] > _FLAGS] = (flags[ends[:, 2] > _FLAGS] + 1) >> 1
        rest = np.flatnonzero(kind == 2)
        if len(rest):
            total = int(self.ends[-1])
            rng = self.range[rest] // _U(total)
            if ids is None:
                value = np.minimum(((self.code[rest] - self.low[rest]) // rng).astype(np.int64), total - 1)
                symbol = np.searchsorted(self.ends, value, side="right")
                out[rest] = symbol
            else:
                symbol = ids[rest]
            count = self.counts[symbol]
            self._narrow(rest, self.ends[symbol] - count, count, rng)
        if ids is None and out.max() >= self.symbols:
            raise ValueError("an id beyond those of the block")
        new = out + np.uint32(1)
        self.last1[one], self.sure1[one] = new, np.where(p1 == new, np.minimum(s1 + 1, 3), 0)
        self.last2[two], self.sure2[two] = new, np.where(p2 == new, np.minimum(s2 + 1, 3), 0)
        self.seen.append(out)
        if len(self.seen) == EVERY:
            self.counts += WEIGHT * np.bincount(np.concatenate(self.seen), minlength=self.symbols)
            self._cumulate()
            self.seen = []
        return out

    def finish(self) -> list[bytes]:
        for _ in range(4):
            self.out[self.at, self.pos] = (self.low >> _W48).astype(np.uint16)
            self.low = self.low << _W16
            self.pos += 1
        return [self.out[i, :n].tobytes() for i, n in enumerate(self.pos.tolist())]


def _layout(n: int) -> tuple[int, int]:
    """Lanes of a block of ``n`` ids and their length."""
    lanes = min(LANES, -(-n // STEPS))
    return (lanes, -(-n // lanes)) if n else (0, 0)


def pack(ids: np.ndarray) -> tuple[int, list[bytes], int]:
    """Number of symbols, coded lanes and the checksum (crc32 of little-endian unsigned 32-bit ids)."""
    ids = ids.astype(np.uint32)
    check, (lanes, steps) = zlib.crc32(ids.astype("<u4").tobytes()), _layout(len(ids))
    if not lanes:
        return 1, [], check
    if int(ids.max()) >= 1 << 20:
        raise ValueError("ids reach beyond 2**20")
    symbols = int(ids.max()) + 1
    full = np.zeros(lanes * steps, np.uint32)
    full[:len(ids)] = ids
    columns = np.ascontiguousarray(full.reshape(lanes, steps).T)
    coder, a, b = _Coder(lanes, steps, symbols), np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    with np.errstate(over="ignore"):
        for column in columns:
            a, b = coder.step(a, b, column), a
    return symbols, coder.finish(), check


def unpack(n: int, symbols: int, coded: list[bytes], check: int) -> np.ndarray:
    """The ids of ``pack``; raises ``ValueError`` where they don't match the checksum."""
    lanes, steps = _layout(n)
    if lanes != len(coded):
        raise ValueError("block holds a wrong number of lanes")
    words = np.zeros((lanes, max(map(len, coded), default=0) // 2 + 3 * steps + 16), np.uint16)
    for i, lane in enumerate(coded):
        words[i, :len(lane) // 2] = np.frombuffer(lane, np.uint16)
    out = np.zeros((steps, lanes), np.uint32)
    if lanes:
        coder, a, b = _Coder(lanes, steps, symbols, words), np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        try:
            with np.errstate(over="ignore", divide="raise"):
                for t in range(steps):
                    a, b = coder.step(a, b, None), a
                    out[t] = a
        except (IndexError, FloatingPointError, ValueError) as e:
            raise ValueError("damaged block") from e
    ids = out.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("checksum of block differs")
    return ids


def to_block(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Magic, counts and checksum; then per document its id, whether it has one and its length; per lane its size; lanes."""
    symbols, coded, check = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([_HEAD.pack(MAGIC, len(coded), len(doc_ids), symbols, len(ids), check, 0), keys.tobytes(), known.tobytes(), lengths.astype("<u4").tobytes(),
                     np.array(list(map(len, coded)), "<u4").tobytes(), *coded])


def from_block(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a block."""
    magic, lanes, docs, symbols, n, check, _ = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of tokens")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    keys, known, lengths, sizes = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", lanes)
    coded = []
    for size in sizes.tolist():
        coded.append(data[at:at + size])
        at += size
    return [k if v else None for k, v in zip(keys.tolist(), known.tolist(), strict=True)], lengths, unpack(n, symbols, coded, check)


class Words:
    """The tokenizer of a file that drops white space: each distinct run of visible characters is encoded once.

    Such a file splits at white space whatever its normaliser does to the
    rest, so the ids of a text are those of its runs, in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        x, y = (self.tokenizer.encode(c, add_special_tokens=False).ids for c in "xy")
        if any(self.tokenizer.encode(f"{c}x{c}y{c}", add_special_tokens=False).ids != x + y for c in SPACES):
            raise ValueError("the tokenizer file does not drop white space")
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        runs = [t.split() for t in texts]
        new = {w for r in runs for w in r} - self.known.keys()
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = {w for r in runs for w in r}
        new = list(new)
        got = self.tokenizer.encode_batch([w.decode("utf-8") for w in new], add_special_tokens=False)
        self.known.update((w, np.array(e.ids, np.uint32).tobytes()) for w, e in zip(new, got, strict=True))
        known = self.known
        return [np.frombuffer(b"".join([known[w] for w in r]), np.uint32) for r in runs]


@functools.cache
def words_of(path: str) -> Words:
    """The tokenizer of a file, made once per Python worker, whose tasks follow each other."""
    return Words(path)


def write_blocks(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Encode ``docs`` in ascending order of their id and write blocks: a table ``shard, seq, before, n_ids, data``.

    ``path`` is a tokenizer file that drops white space. Each document's ids
    are followed by ``end``. Null texts count as empty; null ids come first;
    rows with equal ids follow each other in the order of their text's hash.
    A shard is a range of ids, ``before`` counts the ids ahead in its shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seq, before = words_of(path), 0, 0
        ids, lengths, parts, size = [], [], [], 0

        def block():
            nonlocal ids, lengths, parts, size, seq, before
            data = to_block(ids, np.array(lengths), np.concatenate(parts))
            row = pa.RecordBatch.from_pydict({"seq": pa.array([seq], pa.int64()), "before": pa.array([before], pa.int64()),
                                              "n_ids": pa.array([size], pa.int64()), "data": pa.array([data], pa.binary())})
            seq, before = seq + 1, before + size
            ids, lengths, parts, size = [], [], [], 0
            return row

        tail = np.array([end], np.uint32)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for at in range(0, len(texts), 200):
                for key, got in zip(keys[at:at + 200], words.encode(texts[at:at + 200]), strict=True):
                    ids.append(key)
                    lengths.append(len(got) + 1)
                    parts += [got, tail]
                    size += len(got) + 1
                    if size >= BLOCK:
                        yield block()
        if ids:
            yield block()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = base.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    return cut(dealt.mapInArrow(run, "seq long, before long, n_ids long, data binary").withColumn("shard", F.spark_partition_id()))


def read_blocks(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, read from the written blocks.

    ``start`` counts the ids of all documents before. Damaged data raise an error.
    """
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # one row per range of ids
    starts, ahead = {}, 0
    for r in sorted(totals, key=lambda r: r.shard):
        starts[r.shard] = ahead
        ahead += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                keys, lengths, ids = from_block(data.as_buffer().to_pybytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                first = starts[shard.as_py()] + before.as_py()
                for at in range(0, len(keys), 1000):
                    to = min(at + 1000, len(keys))
                    lo, hi = int(ends[at] - lengths[at]), int(ends[to - 1])
                    offsets = np.concatenate([[0], ends[at:to] - lo]).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[lo:hi].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at:to], pa.int64()), pa.array(first + ends[at:to] - lengths[at:to].astype(np.int64)), pa.array(lengths[at:to].astype(np.int64)), column],
                        ["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("shard", "before", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids array<int>")


def with_checksums(read: DataFrame) -> DataFrame:
    """The rows of ``read_blocks`` with the crc32 of each document's ids instead of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            values, offsets = column.values.to_numpy().astype("<u4"), column.offsets.to_numpy()
            crc = [zlib.crc32(values[lo:hi].tobytes()) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
