"""Estimated percentiles against sorted values."""

import bisect
import random

from causeway.operators import outcomes


def test_estimates_are_within_their_error(spark):
    rng = random.Random(2)
    rows = [(k, rng.expovariate(1 / (20 + 30 * i))) for i, (k, n) in enumerate([("slice", 30_000), ("one", 1), ("same", 50)]) for _ in range(n)]
    rows = [(k, 5.0 if k == "same" else v) for k, v in rows] + [("none", None), (None, 3.0)]
    got = {r.query_type: r for r in outcomes.latency_estimate(spark.createDataFrame(rows, "query_type string, duration_ms double").repartition(5)).collect()}
    assert {k: r["count"] for k, r in got.items()} == {"slice": 30_000, "one": 1, "same": 50, "none": 1, None: 1}
    for kind, r in got.items():
        values = sorted(v for k, v in rows if k == kind and v is not None)
        for p, x in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            if not values:
                assert x is None
                continue
            at, slack = p * len(values), len(values) / 10_000 + 1
            assert x in values and bisect.bisect_left(values, x) - slack <= at <= bisect.bisect_right(values, x) + slack
