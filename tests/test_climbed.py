"""Searches up a graph of which most nodes are leaves."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import deep
from causeway.operators import traverse as T

LINKS = "graph_id string, from_node string, to_node string"


def tree(seed, n=70):
    r = random.Random(seed)
    up = {f"n{i}": f"n{r.randrange(max(1, i // 4))}" for i in range(1, n)}
    return up | {"x1": "x2"}


def way(up, node, most):
    out = [(node, 0, None)]
    while node in up and (most is None or len(out) <= most):
        out.append((up[node], len(out), node))
        node = up[node]
    return out


@pytest.mark.parametrize("most", [None, 0, 1, 2])
def test_climbed_equals_the_way_up(spark, most):
    up = tree(5)
    edges = spark.createDataFrame([("g", a, b) for a, b in up.items()], LINKS)
    asked = ["n69", "n68", "n40", "n3", "n0", "x1", "x2", "unknown"]
    seeds = spark.createDataFrame([("g", s, s) for s in asked], "graph_id string, seed string, node string")
    want = sorted((s, *w) for s in asked for w in way(up, s, most))
    got = deep.climbed(edges, seeds, "graph_id", most, least=0).select("seed", "node", "depth", "parent").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    every = deep.peeled(edges, "graph_id", most, least=0).select("seed", "node", "depth", "parent").collect()
    assert sorted(map(tuple, every)) == sorted((s, *w) for s in up for w in way(up, s, most)[1:])


def test_climbed_leaves_circles_to_others(spark):
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "a"), *[("g", f"l{i}", "a") for i in range(9)]], LINKS)
    seeds = spark.createDataFrame([("g", "l1", "l1")], "graph_id string, seed string, node string")
    assert deep.climbed(edges, seeds, "graph_id", least=0) is None


def test_nodes_that_no_search_meets_do_not_climb(spark, monkeypatch):
    met, whole = [], deep.lifted
    monkeypatch.setattr(deep, "lifted", lambda edges, *a, **kw: met.append(edges.count()) or whole(edges, *a, **kw))
    monkeypatch.setattr(deep.climbed, "__defaults__", (None, 0))
    rows = [("g", "top", f"m{i}", "X") for i in range(3)] + [("g", f"m{i % 3}", f"low{i}", "X") for i in range(60)] + [("g", f"low{i}", f"below{i}", "X") for i in range(60)]
    edges = spark.createDataFrame(rows, "graph_id string, src string, dst string, edge_type string")
    starts = spark.createDataFrame([("g", f"low{i}") for i in range(40)], "graph_id string, node_id string")
    found = T.ancestors(edges, starts, local_work=0)
    assert {r.layer: r["count"] for r in found.groupBy("layer").count().collect()} == {0: 40, 1: 40, 2: 40}
    assert met and max(met) <= 3
    chain = T.root_cause_chain(edges, starts, local_work=0)
    assert chain.count() == 120 and chain.filter(F.col("on_chain")).count() == 120
    assert met and max(met) <= 3
