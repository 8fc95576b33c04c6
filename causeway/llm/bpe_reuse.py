"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts texts into chunks, so equal passages give equal chunks
wherever they stand. Documents that share their least chunk meet in one
partition, where a chunk is encoded once. The ends of two neighbouring chunks
are encoded anew, together, from the last place before the join to the first
place after it where the pre-tokeniser must split in any surrounding text.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import as_bytes

#: Bits of the rolling hash that must be zero at a cut: chunks of about 512 bytes.
CUT_BITS = 9
#: Chunks and pieces a task remembers; a full memory is emptied, which costs time only.
MEMORY = 500_000
BLOCK_BYTES = 1 << 21
#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_P = np.uint32(0x01000193)
#: A piece that starts with one of these bytes may start with white space: ASCII, or lead bytes of longer white space.
_UNSAFE = frozenset(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \xc2\xe1\xe2\xe3")


def cuts(text: bytes, bits: int = CUT_BITS) -> np.ndarray:
    """Ends of the chunks of a text, its length last: a window of 16 bytes decides each cut."""
    h = np.frombuffer(text, np.uint8).astype(np.uint32) + np.uint32(1)
    for step in (1, 2, 4, 8):
        power = np.uint32(pow(int(_P), step, 1 << 32))
        old = h.copy()
        h[step:] += power * old[:-step]
    at = np.flatnonzero((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits) == 0) + 1
    if not len(at) or at[-1] != len(text):
        at = np.append(at, len(text))
    return at


def pieces(text: bytes) -> list[bytes]:
    """Split before every single space after which a word surely starts.

    Whatever surrounds the text, the pre-tokeniser splits there too: a space
    ahead of a visible character always opens a new token.
    """
    out: list[bytes] = []
    for i, part in enumerate(text.split(b" ")):
        if not i:
            out.append(part)
        elif not part or part[0] in _UNSAFE:
            out[-1] += b" " + part
        else:
            out.append(b" " + part)
    return out


class Codec:
    """The tokenizer of a file, with remembered pieces and chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        alphabet = sorted(ByteLevel.alphabet())
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        assert set(alphabet) == set(byte_of)
        self.bytes_of = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.ranked = self._ranked(path)
        self.known: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes, bytes] | None] = {}

    def _ranked(self, path: str):
        """The same merges as ranks, several times as fast, where ids follow the order of the merges; else nothing."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, merges = spec.get("pre_tokenizer") or {}, spec["model"]["merges"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("sure splits are known for byte-level files without prefix space and normaliser only")
        vocab, pairs = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in merges]
        ids = [vocab["".join(p)] for p in pairs]
        if ids != list(range(256, 256 + len(ids))):
            return None
        ranks = {self.bytes_of[i]: i for i in range(256 + len(ids))}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _learn(self, parts: list[list[bytes]]) -> None:
        """Encode the pieces not seen before."""
        new = list({p for part in parts for p in part} - self.known.keys())
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = list({p for part in parts for p in part})
        # plain letters, on whose kind all libraries agree, and ahead of each a sure split
        plain = [p for p in new if self.ranked and p[:1] == b" " and (p.isascii() or max(p) < 0xC8) and not any(t in p for t in self.added)]
        for at in range(0, len(plain), 2000):
            part = plain[at:at + 2000]
            ids = np.array(self.ranked.encode_ordinary(b"".join(part).decode("utf-8")), np.int32)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p) for p in part])) + 1
            start = 0
            for p, end in zip(part, ends.tolist(), strict=True):
                self.known[p] = ids[start:end].tobytes()
                start = end
        rest = [p for p in new if p not in self.known]
        got = self.tokenizer.encode_batch([p.decode("utf-8") for p in rest], add_special_tokens=False)
        self.known.update((p, np.array(e.ids, np.int32).tobytes()) for p, e in zip(rest, got, strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, equal to the library's for the whole text."""
        out: list[list] = []
        asked: list[list[bytes]] = []

        def pending(text: bytes) -> list[bytes]:
            asked.append(pieces(text))
            return asked[-1]

        if len(self.chunks) > MEMORY // 10:
            self.chunks.clear()
        made: dict[bytes, list[bytes]] = {}
        for text in texts:
            if not text:
                out.append([])
                continue
            if any(t in text for t in self.added):  # splits at added tokens see the whole text
                asked.append([text])
                out.append([asked[-1]])
                continue
            line: list = []
            carry = start = 0
            for end in cuts(text).tolist():
                chunk = text[start:end]
                if chunk not in self.chunks:
                    first, last = chunk.find(b" "), chunk.rfind(b" ")
                    split = pieces(chunk)
                    # what stands before the first sure split and after the last one waits for the neighbours
                    self.chunks[chunk] = (len(split[0]), len(chunk) - len(split[-1]), b"") if first >= 0 and last >= 0 and len(split) > 2 else None
                    if self.chunks[chunk]:
                        made[chunk] = split[1:-1]
                        asked.append(split[1:-1])
                seen = self.chunks[chunk]
                if seen:
                    line.append(pending(text[carry:start + seen[0]]))
                    line.append(chunk)
                    carry = start + seen[1]
                start = end
            line.append(pending(text[carry:]))
            out.append(line)
        self._learn(asked)
        for chunk, split in made.items():
            head, tail, _ = self.chunks[chunk]
            self.chunks[chunk] = (head, tail, b"".join([self.known[p] for p in split]))
        chunks, known = self.chunks, self.known
        return [np.frombuffer(b"".join([chunks[x][2] if isinstance(x, bytes) else b"".join([known[p] for p in x]) for x in line]), np.int32) for line in out]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace").encode()


@functools.cache
def codec(path: str) -> Codec:
    """The codec of a file, made once per Python worker, whose tasks follow each other."""
    return Codec(path)


def _least_chunk(text: bytes) -> int:
    """Hash of the chunk with the least hash: equal for copies, mostly equal for near copies."""
    at, start, least = cuts(text).tolist() if text else [], 0, (1 << 64) - 1
    for end in at:
        least = min(least, xxhash.xxh3_64_intdigest(text[start:end]))
        start = end
    return (least >> 1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([_least_chunk(t) for t in as_bytes(batch.column(batch.num_columns - 1))], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "key"])


def _gathered(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` dealt out so that texts with the same least chunk meet; Spark splits what is too much for a task."""
    keyed = docs.mapInArrow(_keys, "doc_id long, text string, key long")
    return keyed.hint("rebalance", "key").select("doc_id", "text")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: the ids of every whole text and the text decoded from them.

    ``path`` is a byte-level BPE file that every worker can read. Ids equal
    those of the library for the whole text without special tokens added;
    the text of an added token in a document counts as that token, as there.
    Null texts count as empty and give no ids. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts, at = as_bytes(batch.column(1)), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
                    size += len(texts[end])
                    end += 1
                ids = coder.encode(texts[at:end])
                offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                decoded = pa.array([coder.decode(i) for i in ids], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), column, decoded], ["doc_id", "ids", "decoded"])
                at = end

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _gathered(base).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Token counts and digests of what ``encode`` gives."""
    ids = [F.col("ids")] if keep_ids else []
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *ids,
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
