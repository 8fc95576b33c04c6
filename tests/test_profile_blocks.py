"""Blocks of profiles score their pairs as ``match_score`` does."""

import random

from pyspark.sql import functions as F

from causeway.operators import profile_blocks as B
from causeway.operators import similarity as S

SCHEMA = "run_id string, algorithm string, complexity string, structures array<string>, control array<string>, variable_roles array<string>, invariant_set array<string>"


def fingerprints(spark, n=60):
    r = random.Random(4)
    some = lambda names, most: r.choice([None, *[sorted(r.sample(names, r.randint(0, most))) for _ in range(6)]])
    rows = [(str(i), r.choice(["a", "b", None]), r.choice(["x", "y", None]), some("pqrs", 3), some("tuv", 2), sorted(f"{v}:{w}" for v, w in zip("mn", r.sample("klj", 2))), some("efghi", 4)) for i in range(n)]
    rows += [("none", None, None, [], [], [], []), ("nulls", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def every_pair(distinct):
    side = F.struct(*S.PROFILE)
    a = distinct.select(F.col("profile").alias("profile_a"), side.alias("a"))
    b = distinct.select(F.col("profile").alias("profile_b"), side.alias("b"))
    return {(r.profile_a, r.profile_b): r.score for r in a.crossJoin(b).select("profile_a", "profile_b", S.match_score("a", "b").alias("score")).collect()}


def test_counts_and_search_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 7)
    fp = fingerprints(spark)
    distinct, of_run = S.profiles(fp)
    distinct = distinct.cache()
    want = every_pair(distinct)
    counts = {}
    for score in want.values():
        if score > 0:
            counts[score] = counts.get(score, 0) + 1
    assert {r.score: r.pairs for r in S.score_counts(distinct).collect()} == counts
    assert {(r.profile_a, r.profile_b): r.score for r in S.profile_pairs(distinct).collect()} == {k: v for k, v in want.items() if v > 0}
    best = {}
    for (a, b), score in want.items():
        if score > 0:
            best.setdefault(a, []).append((-score, b))
    rank = {a: sorted(of)[:4] for a, of in best.items()}
    runs = {r.run_id: r.profile for r in of_run.collect()}
    got = {}
    for r in S.search(fp, fp, 4).collect():
        got.setdefault(r.run_id, {})[r["rank"]] = (-r.score, r.profile)
    assert got == {run: dict(enumerate(rank[p], 1)) for run, p in runs.items() if p in rank}
    some = fp.filter("run_id < '3'")
    asked = {r.run_id for r in some.collect()}
    found = {}
    for r in S.search(fp, some, 4).collect():
        found.setdefault(r.run_id, {})[r["rank"]] = (-r.score, r.profile)
    assert found == {run: of for run, of in got.items() if run in asked}


def test_no_profiles(spark):
    none = fingerprints(spark).filter("false")
    assert S.search(none, none).count() == 0
    assert S.score_counts(S.profiles(none)[0]).count() == 0


def test_thousandths_are_rounded_half_up_by_their_text():
    import numpy as np

    assert B.thousandths(np.array([[0.0005, 0.0015], [1.0, 0.2345]])).tolist() == [[1, 2], [1000, 235]]
