"""Concepts found by templates inside titles, against a plain scan."""

import random

from causeway.operators import outcomes


def test_titles_against_a_scan(spark):
    rng = random.Random(8)
    parts = ["fix", "the", "loop", "a", "é", "日本", "", "loo", "fixed", "it"]
    titles = ["", None, "a", "ab", "the the the"] + [" ".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(80)]
    templates = ["", "a", "fi", "the", "fix the", "the loop", "no such", "日本", "é a", "the the the"] + [" ".join(rng.choices(parts, k=2)) for _ in range(15)]
    items = spark.createDataFrame([(i, None, t, []) for i, t in enumerate(titles)], "item long, action_type string, action_title string, tags array<string>")
    concepts = spark.createDataFrame([(f"c{i}", "none", t, []) for i, t in enumerate(templates)] + [("cn", "none", None, [])],
                                     "concept_id string, action_type string, action_template string, tags array<string>")
    got = {(r.item, r.concept_id) for r in outcomes.matches(items, concepts, "item").collect()}
    assert got == {(i, f"c{j}") for i, t in enumerate(titles) if t is not None for j, p in enumerate(templates) if p in t}
    assert outcomes.matches(items, concepts.limit(0), "item").collect() == []
    assert outcomes.matches(items.limit(0), concepts, "item").collect() == []
