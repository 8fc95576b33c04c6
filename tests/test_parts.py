"""Derived tables are planned part by part, so the driver never holds all their joins at once."""

import re

from causeway.operators.facts import extract_facts, fact_parts
from causeway.operators.graph import dependence_parts
from causeway.operators.identity import deduplicate, identify, identity_parts
from causeway.sources import fixtures as X

SF = "/root/testdata/sf0.001"


def joins(df):
    return len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString()))


def test_no_part_of_a_derived_table_plans_many_joins(spark):
    t, kw = X.trace(spark, SF), X.fit(spark, SF)
    edges, diff, facts = X.edges(spark, SF), X.diff(spark, SF), X.facts(spark, SF)
    parts = fact_parts(t.steps, t.snapshots, edges, diff, **kw)
    whole = extract_facts(t.steps, t.snapshots, edges, diff, **kw)
    assert joins(whole) > 24 and max(map(joins, parts)) <= 8
    assert max(map(joins, dependence_parts(t.steps, t.snapshots, t.calls, t.blocks, **kw))) <= 1
    assert max(map(joins, identity_parts(t.steps, t.snapshots, facts, **kw))) <= 5


def test_tables_written_in_parts_are_whole(spark):
    t, kw = X.trace(spark, SF), X.fit(spark, SF)
    facts = X.facts(spark, SF)
    cols = ["run_id", "fact_id", "kind", "subject", "description", "part", "evidence"]
    whole = extract_facts(t.steps, t.snapshots, X.edges(spark, SF), X.diff(spark, SF), **kw)
    assert sorted(map(str, facts.select(cols).collect())) == sorted(map(str, whole.select(cols).collect()))
    ids = X.identities(spark, SF)
    # categories reduced apart give what the reduction of all of them gives
    assert sorted(map(str, deduplicate(ids).collect())) == sorted(map(str, ids.collect()))
    assert ids.count() == identify(t.steps, t.snapshots, facts, **kw).count()


def test_actions_read_goals_and_invariants_that_are_written(spark):
    from causeway.suite import QUERIES, load

    load()
    # goals, courses and invariants used to be planned anew inside each of their readers
    assert joins(QUERIES["m10_motifs"](spark, SF)) <= 4
    assert joins(QUERIES["m9_counterfactuals"](spark, SF)) == 0
    assert joins(QUERIES["m16_suggested_actions"](spark, SF)) <= 6
