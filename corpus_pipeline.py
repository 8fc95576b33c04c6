"""The corpus pipeline: from raw documents to the token ids of a training mix.

Each stage takes ``(spark, docs, sf_dir)`` and applies one operator to all
that its predecessor kept. The rows of a stage are written and read again
before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from causeway.llm import bpe_reuse, mix_budget, quality, sketch_dedup
from causeway.llm.common import cut, read
from causeway.llm.queries import tokenizer_path

THRESHOLD = 0.7


def _key():
    """A document's id; where it is null, its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; texts without words go."""
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep_text=True).filter(F.col("score") >= THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id. Repeated ids, and texts without id, keep one row."""
    named = docs.withColumn("node", sketch_dedup.node_id(F.col("doc_id"), F.col("text")))
    gone = sketch_dedup.near_duplicates(docs).filter("not kept").select("node").distinct()
    first = F.row_number().over(W.Window.partitionBy("key").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")]))
    left = named.join(gone, "node", "left_anti").withColumn("key", _key())
    return left.withColumn("first", first).filter("first = 1").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it was chosen, copies as rows of their own."""
    chosen = mix_budget.mix(docs.withColumn("key", _key()), id_col="key").filter("repeats > 0").select(F.col("doc_id").alias("key"), "repeats")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))
    return docs.withColumn("key", _key()).join(chosen, "key").withColumn("copy", copies).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of the ids and of the text decoded from them."""
    encoded = bpe_reuse.encode(docs, tokenizer_path("byte_bpe_50k.json"))
    return bpe_reuse.digests(encoded, keep_ids=True)


STAGES = [("quality classifier", keep_quality), ("MinHash near-dedup", drop_near_duplicates), ("mixing sources", mix_sources), ("BPE encoding", encode)]

#: Neither the classifier nor the tokenizer can be said in SQL: tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
