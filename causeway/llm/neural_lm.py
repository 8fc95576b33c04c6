"""A log-bilinear language model of words, trained by noise-contrastive estimation.

The most frequent words are outputs of their own; all other words fall into
classes by their last letters, and a word's share of its class comes from
exact counts. Scores are normalised over all outputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import as_bytes, cut, release

TOP = 512
TAILS = 256
OUTPUTS = TOP + TAILS
START = OUTPUTS
DIMS = 16
NOISE = 64
BATCH = 2048
RATE = 0.4
#: Rounds of training and averaging, and tokens of a bucket of texts that is trained in one go.
ROUNDS = 2
BUCKET = 1 << 20
SEED = 7
#: Parameters that are added up together.
PART = 512
SMOOTH = 0.1
#: Bytes of text whose words share one table of counts.
CHUNK_BYTES = 8 << 20
#: Stands for the end of a text among the hashes of words.
END_HASH = xxhash.xxh64_intdigest(b"\x00end of text")


class _Local(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_TOKENS = ("chunk long, n_docs long, docs binary, known binary, held binary, lengths binary, tokens binary, hashes binary, tails binary, counts binary")


def _tokenised(folds: int, held: int):
    """Whole chunks as one row each: tokens as places in the chunk's own list of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, out, lengths, local, size = [], [], [], _Local(), 0

        def chunk():
            nonlocal ids, out, lengths, local, size, seq
            end, n = len(local), np.array(lengths, np.int32)
            tokens = np.empty(int(n.sum()), np.uint32)
            stops = np.cumsum(n) - 1
            inner = np.ones(len(tokens), bool)
            inner[stops] = False
            tokens[inner] = np.concatenate(out) if out else []
            tokens[stops] = end
            hidden = np.array([zlib.crc32(str(i).encode() if i is not None else b"") % folds == held for i in ids], np.uint8)
            counts = np.bincount(tokens[np.repeat(hidden == 0, n)], minlength=end + 1)
            hashes = np.array([*(xxhash.xxh64_intdigest(w) for w in local), END_HASH], np.uint64)
            tails = np.array([*(zlib.crc32(w[-3:]) % TAILS for w in local), 0], np.uint8)
            cells = [np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], np.uint8), hidden, n, tokens, hashes, tails, counts.astype(np.int32)]
            row = pa.RecordBatch.from_arrays(
                [pa.array([part << 24 | seq], pa.int64()), pa.array([len(ids)], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)],
                ["chunk", "n_docs", "docs", "known", "held", "lengths", "tokens", "hashes", "tails", "counts"])
            seq += 1
            ids, out, lengths, local, size = [], [], [], _Local(), 0
            return row

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = text.lower().split()
                out.append(np.fromiter(map(local.__getitem__, words), np.uint32, count=len(words)))
                ids.append(key)
                lengths.append(len(words) + 1)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield chunk()
        if ids:
            yield chunk()

    return run


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, hashes, tails, counts in zip(*batch.columns, strict=True):
            h = np.frombuffer(hashes.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(h), chunk.as_py())), pa.array(h), pa.array(np.frombuffer(tails.as_buffer(), np.uint8).astype(np.int16)),
                 pa.array(np.frombuffer(counts.as_buffer(), np.int32))], ["chunk", "h", "tail", "n"])


@dataclass(frozen=True)
class Vocabulary:
    """The words with outputs of their own, and the counts per class of all other words."""

    top: np.ndarray  # sorted hashes
    order: np.ndarray  # output of each
    unigram: np.ndarray  # training tokens per output
    size: np.ndarray  # words per class of other words
    tokens: int
    words: int

    def outputs(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        if not len(self.top):
            return TOP + tails.astype(np.int64)
        at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
        return np.where(self.top[at] == hashes, self.order[at], TOP + tails.astype(np.int64))


def _vocabulary(counts: DataFrame) -> Vocabulary:
    seen = counts.filter("c > 0")
    first = seen.orderBy((F.col("h") == int(np.uint64(END_HASH).astype(np.int64))).desc(), F.col("c").desc(), "h").limit(TOP).collect()
    top = np.array([r.h for r in first], np.int64).astype(np.uint64)
    order = np.argsort(top)
    unigram, size = np.zeros(OUTPUTS), np.zeros(TAILS)
    unigram[:len(first)] = [r.c for r in first]
    for r in seen.groupBy("tail").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        unigram[TOP + r.tail], size[r.tail] = r.n, r.v
    for r in first:
        unigram[TOP + r.tail] -= r.c
        size[r.tail] -= 1
    return Vocabulary(top[order], order.astype(np.int64), unigram, size, int(unigram.sum()), int(size.sum()) + len(first))


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows at each place."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[at[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Model:
    """score(w | a, b) = (r_a A + r_b B) q_w + bias_w, with a the nearer word."""

    def __init__(self, unigram: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.noise = (unigram + 1.0) / (unigram + 1.0).sum()
        f = np.float32
        self.r = (rng.standard_normal((OUTPUTS + 1, DIMS)) * 0.1).astype(f)
        self.q = (rng.standard_normal((OUTPUTS, DIMS)) * 0.1).astype(f)
        self.a, self.b = np.eye(DIMS, dtype=f), (np.eye(DIMS) * 0.5).astype(f)
        self.bias = np.log(self.noise).astype(f)

    def parameters(self) -> list[np.ndarray]:
        return [self.r, self.q, self.a, self.b, self.bias]

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = vector[at:at + p.size].reshape(p.shape)
            at += p.size

    def hidden(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.r[a] @ self.a + self.r[b] @ self.b

    def train(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, squares: list[np.ndarray], rng: np.random.Generator) -> None:
        """One pass of noise-contrastive estimation; each batch shares its noise words."""
        log_kp = np.log(NOISE * self.noise).astype(np.float32)
        draws = rng.choice(OUTPUTS, size=(-(-len(w) // BATCH), NOISE), p=self.noise)
        for j, at in enumerate(range(0, len(w), BATCH)):
            x, y, t, n = a[at:at + BATCH], b[at:at + BATCH], w[at:at + BATCH], draws[j]
            rx, ry = self.r[x], self.r[y]
            h = rx @ self.a + ry @ self.b
            qt, qn = self.q[t], self.q[n]
            up = 1 / (1 + np.exp((h * qt).sum(axis=1) + self.bias[t] - log_kp[t]))  # 1 - P(data | word)
            down = -1 / (1 + np.exp(-(h @ qn.T + self.bias[n] - log_kp[n])))  # - P(data | noise)
            dh = up[:, None] * qt + down @ qn
            grads = [_summed(np.concatenate([x, y]), np.concatenate([dh @ self.a.T, dh @ self.b.T]), OUTPUTS + 1), _summed(t, up[:, None] * h, OUTPUTS),
                     rx.T @ dh, ry.T @ dh, np.bincount(t, up, OUTPUTS).astype(np.float32)]
            np.add.at(grads[1], n, down.T @ h)
            np.add.at(grads[4], n, down.sum(axis=0))
            for p, g, s in zip(self.parameters(), grads, squares, strict=True):
                g /= len(t)
                s += g * g
                p += RATE * g / np.sqrt(s + 1e-8)

    def log_probabilities(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalised over all outputs; each distinct context is normalised once, in blocks."""
        context, at = np.unique(a.astype(np.int64) * (OUTPUTS + 1) + b, return_inverse=True)
        h = self.hidden(context // (OUTPUTS + 1), context % (OUTPUTS + 1))
        z = np.empty(len(context), np.float32)
        for i in range(0, len(context), 1024):
            s = h[i:i + 1024] @ self.q.T + self.bias
            m = s.max(axis=1)
            z[i:i + 1024] = m + np.log(np.exp(s - m[:, None]).sum(axis=1))
        out = np.empty(len(w), np.float64)
        for i in range(0, len(w), 1 << 16):
            j, t = at[i:i + (1 << 16)], w[i:i + (1 << 16)]
            out[i:i + (1 << 16)] = (h[j] * self.q[t]).sum(axis=1) + self.bias[t] - z[j]
        return out


def _contexts(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and second nearest output before each token of its own text."""
    a, b = np.full_like(tokens, START), np.full_like(tokens, START)
    a[1:], b[2:] = tokens[:-1], tokens[:-2]
    starts = np.cumsum(lengths) - lengths
    a[starts] = b[starts] = START
    second = starts[lengths > 1] + 1
    b[second] = START
    return a, b


def _cells(row: dict, *names: str) -> list[np.ndarray]:
    kinds = {"docs": np.int64, "known": np.uint8, "held": np.uint8, "lengths": np.int32, "tokens": np.uint32, "hashes": np.uint64, "tails": np.uint8, "counts": np.int32}
    return [np.frombuffer(row[n], kinds[n]) for n in names]


def _added(table: pa.Table) -> pa.Table:
    """The sum of one part of all tasks' parameters, in an order of their own."""
    rows = sorted(x.as_py() for x in table.column("x"))
    total = np.sum([np.frombuffer(r) for r in rows], axis=0)
    return pa.Table.from_arrays([table.column("part").slice(0, 1).combine_chunks(), pa.array([total.tobytes()], pa.binary())], ["part", "x"])


def _dealt(chunks: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``bucket, lengths, w``: outputs of training texts, dealt by a hash of their id and outputs and in its order, wherever they were read."""
    buckets = max(1, -(-vocabulary.tokens // BUCKET))
    sent = chunks.sparkSession.sparkContext.broadcast(vocabulary)  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                docs, known, held, lengths, tokens, hashes, tails = _cells(row, "docs", "known", "held", "lengths", "tokens", "hashes", "tails")
                w = v.outputs(hashes, tails)[tokens].astype(np.int16)
                ends = np.cumsum(lengths).tolist()
                texts = {}
                for i in np.flatnonzero(held == 0).tolist():
                    data = w[ends[i] - lengths[i]:ends[i]].tobytes()
                    texts[xxhash.xxh64_intdigest(data, int(docs[i]) * 2 + int(known[i]) & (1 << 64) - 1)] = data
                key = np.fromiter(texts, np.uint64, count=len(texts))
                yield pa.RecordBatch.from_arrays([pa.array((key % np.uint64(buckets)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(list(texts.values()), pa.binary())],
                                                 ["bucket", "key", "w"])

    def packed(table: pa.Table) -> pa.Table:
        texts = dict(zip(table.column("key").to_pylist(), table.column("w").to_pylist(), strict=True))
        texts = [texts[k] for k in sorted(texts)]
        lengths = np.fromiter(map(len, texts), np.int64, count=len(texts)) // 2
        return pa.Table.from_arrays([table.column("bucket").slice(0, 1).combine_chunks(), pa.array([lengths.tobytes()], pa.binary()), pa.array([b"".join(texts)], pa.binary())],
                                    ["bucket", "lengths", "w"])

    kept = chunks.select("docs", "known", "held", "lengths", "tokens", "hashes", "tails").mapInArrow(run, "bucket int, key long, w binary")
    return cut(kept.groupBy("bucket").applyInArrow(packed, "bucket int, lengths binary, w binary"), "zstd")


def _fit(chunks: DataFrame, vocabulary: Vocabulary) -> Model:
    """In each round every bucket trains from the same start; the mean, weighted by tokens, starts the next.

    Buckets depend on the texts alone and are trained in the order of their
    hashes, so the model doesn't depend on how the input is partitioned.
    Step sizes (sums of squared gradients) are averaged and carried on too.
    """
    model = Model(vocabulary.unigram)
    squares = [np.full_like(p, 1e-3) for p in model.parameters()]
    dealt = _dealt(chunks, vocabulary)
    for turn in range(ROUNDS):
        sent = chunks.sparkSession.sparkContext.broadcast((vocabulary.unigram, model.vector(), squares))  # fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unigram, start, steps = sent.value
            for batch in batches:
                for bucket, lengths, w in zip(*batch.columns, strict=True):
                    mine, own = Model(unigram), [s.copy() for s in steps]
                    mine.load(start)
                    w = np.frombuffer(w.as_buffer(), np.int16)
                    a, b = _contexts(w, np.frombuffer(lengths.as_buffer(), np.int64))
                    rng = np.random.default_rng((SEED, turn, bucket.as_py()))
                    pick = rng.permutation(len(w))
                    mine.train(a[pick], b[pick], w[pick], own, rng)
                    x = np.append(np.concatenate([mine.vector(), *(s.ravel() for s in own)]) * np.float64(len(w)), len(w))
                    parts = [x[at:at + PART] for at in range(0, len(x), PART)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "x"])

        trained = dealt.select("bucket", "lengths", "w").mapInArrow(run, "part int, x binary")
        got = trained.groupBy("part").applyInArrow(_added, "part int, x binary").collect()
        if not got:
            break
        total = np.concatenate([np.frombuffer(r.x) for r in sorted(got, key=lambda r: r.part)])
        mean = (total[:-1] / total[-1]).astype(np.float32)
        half = len(mean) // 2
        model.load(mean[:half])
        for s in squares:
            s[...] = mean[half:half + s.size].reshape(s.shape)
            half += s.size
        sent.unpersist()
    release(dealt)
    return model


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Learns from documents whose crc32 of the id modulo ``folds`` isn't
    ``held``; a null id counts as the empty text. Tokens are the words of the
    text in lower case (A-Z) and one end; null texts count as empty.
    ``base_score`` is the smoothed unigram score, ``score`` that of the model,
    both as log10. A word is known by a 64-bit hash. A word without output of
    its own has the share ``(c + 0.1) / (n + 0.1 (v + 1))`` of its class, so
    unseen words of a class count as one. Other columns are ignored; equal
    rows get equal scores. The neural part takes texts that are equal in id and
    outputs once; counts count all of them. Scores don't depend on how the
    rows are partitioned, but for rounding.

    Words of a chunk of texts are looked up together: their counts come back
    in one joined table per chunk, never as a table of all words.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = cut(base.mapInArrow(_tokenised(folds, held), _TOKENS), "zstd")
    uses = chunks.select("chunk", "hashes", "tails", "counts").mapInArrow(_uses, "chunk long, h long, tail short, n int")
    counts = cut(uses.groupBy("h").agg(F.first("tail").alias("tail"), F.sum("n").alias("c")))
    vocabulary = _vocabulary(counts)
    model = _fit(chunks, vocabulary)
    replies = uses.join(counts.select("h", "c"), "h").select("chunk", "h", "c")
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, model))  # fixed size

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        v, m = sent.value
        known = right.column("h").to_numpy().view(np.uint64)
        order = np.argsort(known)
        sorted_h, sorted_c = known[order], right.column("c").to_numpy()[order]
        tables = []
        for row in left.to_pylist():
            ids, valid, hidden, lengths, tokens, hashes, tails = _cells(row, "docs", "known", "held", "lengths", "tokens", "hashes", "tails")
            c = sorted_c[np.searchsorted(sorted_h, hashes)].astype(np.float64)
            out = v.outputs(hashes, tails)
            share = np.zeros(len(c))
            rest = out >= TOP
            k = out[rest]
            share[rest] = np.log10((c[rest] + SMOOTH) / (v.unigram[k] + SMOOTH * (v.size[k - TOP] + 1)))
            plain = np.log10((c + SMOOTH) / (v.tokens + SMOOTH * (v.words + 1)))
            w = out[tokens].astype(np.int16)
            a, b = _contexts(w, lengths)
            per = m.log_probabilities(a, b, w) / np.log(10) + share[tokens]
            starts = np.cumsum(lengths) - lengths
            n = len(ids)
            tables.append(pa.Table.from_arrays(
                [pa.array(ids, mask=valid == 0), pa.array(hidden == 1), pa.array(lengths.astype(np.int64)), pa.array(np.add.reduceat((c > 0)[tokens].astype(np.int64), starts)),
                 pa.array(np.full(n, v.tokens, np.int64)), pa.array(np.add.reduceat(plain[tokens], starts)), pa.array(np.add.reduceat(per, starts))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(tables)

    out = chunks.drop("counts").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out
