from causeway.operators import prepare as P


def _diff(spark, chunk_edge=1 << 15):
    a = chunk_edge - 1
    rows = [("r", a, "x", "1", 1), ("r", a + 1, "x", "2", 1), ("r", a + 2, "x", "2", 1), ("r", a + 4, "x", "2", 1), ("r", a, "y", "1", 2), ("s", a, "x", "1", 1)]
    snaps = spark.createDataFrame(rows, "run_id string, step long, var string, value string, memory_id long")
    steps = spark.createDataFrame([("r", a + i) for i in range(5)] + [("s", a)], "run_id string, step long")
    return P.step_diff(snaps, steps), a


def test_changes_at_the_edge_of_a_chunk_and_gaps(spark):
    d, a = _diff(spark)
    got = {(r["run_id"], r["step"] - a, r["var"], r["change"], r["how"]) for r in d.collect()}
    assert got == {("r", 0, "x", "new", None), ("r", 1, "x", "changed", "mutated"), ("r", 2, "x", "same", None), ("r", 3, "x", "removed", None),
                   ("r", 4, "x", "new", None), ("r", 0, "y", "new", None), ("r", 1, "y", "removed", None), ("s", 0, "x", "new", None)}


def test_values_are_shuffled_once(spark):
    plan = _diff(spark)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "RightOuter" not in plan and "LeftOuter" not in plan
