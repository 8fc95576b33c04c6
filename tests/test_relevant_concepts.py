"""Concepts of contexts are found once per kind of context."""

from pyspark.sql import functions as F

from causeway.operators import outcomes as O


def test_contexts_of_a_kind_are_scored_once(spark, monkeypatch):
    written = []

    def kept(df):
        written.append(df.cache())
        return written[-1]

    monkeypatch.setattr(O, "checkpointed", kept, raising=False)
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    concepts = spark.createDataFrame(
        [(f"c{i}", "view" if i % 2 else "click", ["specific"], 0.5 + i / 100, 1) for i in range(12)],
        "concept_id string, action_type string, tags array<string>, confidence double, evidence_count int").withColumn("last_used", now)
    contexts = spark.range(400).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("context_id"),
                                       F.when(F.col("id") % 2 == 0, "view").otherwise("other").alias("action_type"), F.array(F.lit("specific")).alias("tags"))
    # one more kind for an identifier: the best of both count
    contexts = contexts.unionByName(spark.createDataFrame([("x1", "view", ["specific"])], contexts.schema))
    got = O.relevant_concepts(concepts, contexts, now, k=3)
    rows = {(r["context_id"], r["rank"]): r["concept_id"] for r in got.collect()}
    assert len(rows) == 1200
    assert [rows["x0", r] for r in (1, 2, 3)] == ["c11", "c9", "c7"]
    assert [rows["x3", r] for r in (1, 2, 3)] == ["c11", "c10", "c9"]
    assert [rows["x1", r] for r in (1, 2, 3)] == ["c11", "c9", "c7"]
    assert [w.count() for w in written] == [6]
