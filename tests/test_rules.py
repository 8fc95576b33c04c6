from causeway.operators import rules as R

FACTS = "run_id string, span_id long, id string, kind string, subject string, relation string, value string, first_step long, last_step long, confidence double"


def facts(spark, rows):
    return spark.createDataFrame([("r", s, f"{k}:{sub}:{rel}:None", k, sub, rel, None, i, i, c) for i, (s, k, sub, rel, c) in enumerate(rows)], FACTS)


def test_strata_follow_from_the_rules():
    flat = R._flat(R.RULES)
    for rules in (R.RULES, flat, flat[::-1]):
        groups = R.strata(rules)
        place = {name: i for i, (group, _) in enumerate(groups) for name, _, _ in group}
        assert not any(circular for _, circular in groups) and len(place) == len(flat)
        assert place["interval_shrinks"] < place["shrinking_interval_progress"] < place["no_progress_counterfactual"]
    loop = [("b", [("y", None, "")], [("x", "two", "")]), ("a", [("x", None, "")], [("y", "one", "")]), ("c", [("y", None, "")], [("z", "z", "")])]
    assert [(sorted(n for n, _, _ in g), c) for g, c in R.strata(loop)] == [["a", "b"], ["c"]] or [(sorted(n for n, _, _ in g), c) for g, c in R.strata(loop)] == [(["a", "b"], True), (["c"], False)]


def test_all_supports_are_kept(spark):
    known = facts(spark, [(0, "paired", "a,b", "interval", 0.9), (0, "monotonic", "a", "increasing", 0.5), (0, "monotonic", "c", "increasing", 0.8),
                          (0, "monotonic", "b", "decreasing", 0.7), (0, "looping", "3", "", 0.6), (0, "looping", "5", "", 0.4), (1, "looping", "9", "", 1.0)])
    derived, sources = R.derive(known)
    got = {(r.span_id, r.id): r.confidence for r in derived.collect()}
    assert got[0, "shrinks:a,b::None"] == 0.7  # the least of the surest fact of each need
    assert (1, "invariant:loop_invariant:guard_holds:None") in got and (1, "shrinks:a,b::None") not in got
    held = {(r.id, r.source_id) for r in sources.collect() if r.span_id == 0}
    assert {s for i, s in held if i == "shrinks:a,b::None"} == {"paired:a,b:interval:None", "monotonic:a:increasing:None", "monotonic:c:increasing:None", "monotonic:b:decreasing:None"}
    assert {s for i, s in held if i == "counterfactual:progress_violated:infinite_loop:None"} == {"invariant:progress:interval_shrinks:None", "looping:3::None", "looping:5::None"}
    deep = {(r.id, r.source_id): r.depth for r in R.proofs(sources).collect() if r.span_id == "0"}
    assert deep["counterfactual:progress_violated:infinite_loop:None", "paired:a,b:interval:None"] == 3


def test_rules_that_feed_themselves_end(spark):
    user = [("next", [("state", "a", "")], [("state", "s", "b")]), ("back", [("state", "b", "")], [("state", "s", "a")]), ("named", [("state", None, "same"), ("looping", None, "")], [("seen", "*", "")])]
    derived, sources = R.derive(facts(spark, [(0, "state", "s", "a", 1.0), (0, "looping", "1", "", 1.0)]), user)
    assert {r.id for r in derived.collect()} >= {"state:s:b:None", "seen:s::None"}
    assert {(r.id, r.source_id) for r in sources.collect()} >= {("state:s:b:None", "state:s:a:None"), ("state:s:a:None", "state:s:b:None"), ("seen:s::None", "looping:1::None")}


def test_conclusions_are_written_alone(spark, monkeypatch):
    """Known facts are not written again with the conclusions of every stratum."""
    written, write = [], R.checkpointed
    monkeypatch.setattr(R, "checkpointed", lambda df: written.append(write(df)) or written[-1])
    monkeypatch.setattr(R.ordered, "checkpointed", lambda df: written.append(write(df)) or written[-1])
    known = facts(spark, [(0, "looping", str(i), "", 1.0) for i in range(50)] + [(0, "changes", str(i), "", 1.0) for i in range(50)])
    R.derive(known)
    assert not any("changes" in {r["kind"] for r in df.select("kind").distinct().collect()} for df in written)


def test_facts_are_merged_in_the_parts_asked(spark):
    known = facts(spark, [(i, "looping", "1", "", 1.0) for i in range(20)] * 2)
    merged = R.canonical(known.drop("id"), 7)
    assert merged.rdd.getNumPartitions() == 7 and merged.count() == 20
