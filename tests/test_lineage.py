from causeway.operators import history as H


def test_events_and_search_are_read_not_made_again(loop):
    steps, snapshots, _ = loop
    found = H.lineage(steps, snapshots)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(op in plan for op in ("Window", "MapInArrow", "CoGroup"))
    assert {r["var"] for r in found.collect()} == {"total", "i", "n"}
