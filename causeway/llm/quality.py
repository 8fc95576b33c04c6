"""Quality scores by voting of the nearest labelled texts in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm.common import as_bytes, crc_remainder

#: Hashed word features; after them come shapes of words and bucketed statistics of a text.
WORDS = 1024
SHAPES = 16
BUCKETS = 12
STATS = 11
WIDTH = WORDS + SHAPES + STATS * BUCKETS
#: Labelled rows per class that are kept as voters, the least by a hash of their id.
VOTERS = 2500
DIMS = 48
NEIGHBOURS = 25
#: Texts whose cosines with all voters are held at once.
BLOCK = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """Per raw word: hash of its lower-case letters, and its shape in the lowest four bits."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        text = word.decode("utf-8", "replace")
        core = text.strip(".,;:!?()[]\"'#$%&*|")
        tail = text[len(text.rstrip("!?#$%&*|")):]
        letters = sum(c.isalpha() for c in core)
        kind = 0 if not core else 1 if not letters else 2 if letters < len(core) else 3
        case = 3 if kind == 0 else 2 if len(core) > 1 and core.isupper() else 1 if core[:1].isupper() else 0
        shape = (kind if case != 2 else 4) + 5 * min(len(tail), 2)
        code = self[word] = (xxhash.xxh64_intdigest(core.lower().encode()) & ~15) | min(shape, 15)
        return code


def _bucket(share: float) -> int:
    """Fine near 0 and 1, where the shares of ordinary texts lie."""
    return int(round((BUCKETS - 1) * min(1.0, max(0.0, share))))


def features(text: bytes, codes: dict) -> np.ndarray:
    """Counts of hashed words and shapes, and one unit per bucketed statistic; zeros without words."""
    out = np.zeros(WIDTH, np.float32)
    raw = text.split()
    n = len(raw)
    if not n:
        return out
    code = np.fromiter(map(codes.__getitem__, raw), np.uint64, count=n)
    word, shape = code >> np.uint64(4), (code & np.uint64(15)).astype(np.int64)
    out[:WORDS] = np.bincount((word % np.uint64(WORDS)).astype(np.int64), minlength=WORDS)
    shapes = np.bincount(shape, minlength=SHAPES)
    out[WORDS:WORDS + SHAPES] = shapes
    ordered = np.sort(word)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    longest = int(np.diff(np.append(starts, n)).max())
    triples = word[:-2] * _STEP * _STEP + word[1:-1] * _STEP + word[2:] if n > 2 else word[:0]
    lines = text.split(b"\n")
    share = (
        np.log2(n + 1) / 16, len(starts) / n ** 0.85, (longest / n) ** 0.5, (float((word[1:] == word[:-1]).mean()) if n > 1 else 0.0) ** 0.5,
        1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0, 1 - len(set(lines)) / len(lines),
        shapes[[4, 9, 14]].sum() / n, shapes[5:].sum() / n, (shapes[[0, 5, 10, 15]].sum() / n) ** 0.5, len(text) / n / 16,
        sum(text.count(c) for c in (b"#", b"$", b"%", b"&", b"*", b"|", b"!")) / len(text) * 8,
    )
    for i, s in enumerate(share):
        out[WORDS + SHAPES + i * BUCKETS + _bucket(s)] = 1.0
    return out


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Three parts of fixed length side by side: words by tf-idf, shapes, statistics."""
    x = np.log1p(x) * idf
    for lo, hi, size in ((0, WORDS, 1.0), (WORDS, WORDS + SHAPES, 1.0), (WORDS + SHAPES, WIDTH, 1.5)):
        part = x[:, lo:hi]
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        x[:, lo:hi] = size * part / np.where(norm > 0, norm, 1.0)
    return x


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    projection: np.ndarray
    voters: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = weighted(x, self.idf) @ self.projection
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        return z / np.where(norm > 0, norm, 1.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Share of the votes for label 1 among the nearest voters; texts without words score 0."""
        empty = ~x.any(axis=1)
        if not len(self.voters):
            return np.where(empty, 0.0, self.prior)
        cos = self.latent(x) @ self.voters.T
        k = min(NEIGHBOURS, cos.shape[1])
        at = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cos, at, 1).astype(np.float64), 0.0) ** 8 * self.weights[at]
        total = vote.sum(axis=1)
        score = np.where(total > 0, (vote * self.labels[at]).sum(axis=1) / np.where(total > 0, total, 1.0), self.prior)
        return np.where(empty, 0.0, np.clip(score, 0.0, 1.0))


def _blocks(batches: Iterator[pa.RecordBatch], size: int):
    """Blocks of rows with the features of their texts, the last column."""
    codes = _Codes()
    for batch in batches:
        texts = as_bytes(batch.column(batch.num_columns - 1))
        for at in range(0, len(texts), size):
            part = texts[at:at + size]
            yield batch.slice(at, len(part)), np.stack([features(t, codes) for t in part])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(WIDTH, np.int64), 0
    for rows, x in _blocks(batches, BLOCK):
        df += (x > 0).sum(axis=0)
        n += rows.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1), pa.int32()), pa.array(np.append(df, n), pa.int64())], ["feature", "df"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, x in _blocks(batches, BLOCK):
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, voters: int = VOTERS, dims: int = DIMS) -> Model:
    """Fit on at most ``voters`` labelled rows per class; document frequencies come from all of ``docs(doc_id, text)``.

    ``labels(doc_id, y)``; rows with a null id or label are ignored, of
    several labels of a document the least counts. Voters are chosen among
    labelled ids that ``docs`` holds; of several rows of an id the one with
    the least hash of its text votes. Votes are weighted so that the classes
    have the shares of all given labels.
    """
    counts = docs.select("text").mapInArrow(_frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(WIDTH + 1)
    for r in counts:
        df[r.feature] = r.df
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 0.2).astype(np.float32)
    idf[WORDS:] = 1.0
    known = labels.filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").cast("int").alias("y"))
    share = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    present = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = [present.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(voters) for y in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * voters rows
    one = docs.join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = one.select("doc_id", "y", "text").mapInArrow(_rows, "doc_id long, y int, x binary").collect()
    total = sum(share.get(y, 0) for y in (0, 1))
    prior = share.get(1, 0) / total if total else 1.0
    if not rows:
        return Model(idf, np.zeros((WIDTH, dims), np.float32), np.zeros((0, dims), np.float32), np.zeros(0), np.zeros(0), prior)
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    y = np.array([r.y for r in rows], np.float64)
    a = weighted(np.stack([np.frombuffer(r.x, np.float32) for r in rows]), idf)
    _, vectors = np.linalg.eigh(a.T @ a)
    projection = np.ascontiguousarray(vectors[:, ::-1][:, :dims].astype(np.float32))
    z = a @ projection
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    per = np.array([share.get(int(v), 1) / max(1, (y == v).sum()) for v in (0, 1)])
    return Model(idf, projection, z, y, per[y.astype(int)], prior)


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """``docs`` with ``score`` appended; ``text`` is dropped unless asked for.

    Every text is compared with every voter, block by block. Null and blank
    texts score 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: voters and projection only
    rest = [c for c in docs.columns if c != "text"]
    kept = [*rest, "text"] if keep_text else rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for rows, x in _blocks(batches, BLOCK):
            yield pa.RecordBatch.from_arrays([*rows.columns[:len(kept)], pa.array(m.scores(x), pa.float64())], [*kept, "score"])

    return docs.select(*rest, "text").mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())]))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Model:
    """Fit on the usable labels of documents whose crc32 of the id modulo ``folds`` isn't ``held``."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).filter(F.col("y").isin(0, 1))
    return fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known.filter(crc_remainder(F.col("doc_id"), folds) != held))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Labels are learnt from documents whose crc32 of the id modulo ``folds``
    isn't ``held``. Language, source, id and labels are no inputs of a score.
    A text without words scores 0; without any usable label every other text
    scores 1. Other columns are ignored.
    """
    return score(docs.select("doc_id", "text"), learn(docs, labels, folds, held)).select(
        "doc_id", (crc_remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
