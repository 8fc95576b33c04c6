import random

import pytest

from causeway.operators import chains as C
from causeway.operators import traverse as T

EDGES = "graph_id string, src string, dst string, edge_type string"


def ladder(rungs):
    out = []
    for i in range(rungs):
        for a in "lr":
            out += [("l", f"{b}{i + 1}", f"{a}{i}", "DATA_DEPENDENCY" if a == b else "CALL_RELATION") for b in "lr"]
    return out


def random_graph(seed, n=14, rows=26):
    r = random.Random(seed)
    types = [*T.PRIORITY[:4], "OTHER"]
    return sorted({("g", *map(str, sorted(r.sample(range(10, 10 + n), 2))), r.choice(types)) for _ in range(rows)})


def nodes_of(spark, edges):
    return spark.createDataFrame(sorted({(g, n) for g, a, b, _ in edges for n in (a, b)}), "graph_id string, node_id string")


def order(chain):
    nodes, types = chain
    return [(T.PRIORITY.index(t) if t in T.PRIORITY else 99, n, t) for n, t in zip(nodes[1:], types)]


@pytest.mark.parametrize("types", [None, ["THROWS", "DATA_DEPENDENCY", "OTHER"]])
@pytest.mark.parametrize("work", [10**6, 0])
def test_counts_and_ranks_equal_enumeration(spark, work, types):
    edges = random_graph(2)
    df, starts = spark.createDataFrame(edges, EDGES), nodes_of(spark, edges)
    all_of = {}
    for r in T.causal_chains(df, starts, types).collect():
        all_of.setdefault(r.start, []).append((r.nodes, r.types))
    counts = {r.start: r.chains for r in C.count_chains(df, starts, types, local_work=work).collect()}
    assert counts == {n.node_id: len(all_of.get(n.node_id, [])) for n in starts.collect()}
    got = {}
    for r in C.best_chains(df, starts, 3, types, local_work=work).collect():
        got.setdefault(r.start, {})[r["rank"]] = (r.nodes, r.types)
    assert got == {s: dict(enumerate(sorted(of, key=order)[:3], 1)) for s, of in all_of.items()}


def test_ladder_of_forty_rungs(spark):
    edges = ladder(40)
    df, start = spark.createDataFrame(edges, EDGES), spark.createDataFrame([("l", "l0")], "graph_id string, node_id string")
    assert C.count_chains(df, start).first().chains == 2**40
    best = C.best_chains(df, start, 2).orderBy("rank").collect()
    assert best[0].nodes == [f"l{i}" for i in range(41)] and set(best[0].types) == {"DATA_DEPENDENCY"}
    assert best[1].nodes == [*(f"l{i}" for i in range(40)), "r40"]


@pytest.mark.parametrize("work", [10**6, 0])
def test_circles_have_no_count(spark, work):
    edges = [("g", "a", "b", "X"), ("g", "b", "c", "X"), ("g", "c", "b", "X"), ("g", "s", "d", "X")]
    df = spark.createDataFrame(edges, EDGES)
    starts = nodes_of(spark, edges)
    assert {r.start: r.chains for r in C.count_chains(df, starts, local_work=work).collect()} == {"a": 0, "b": None, "c": None, "d": 1, "s": 0}
    assert [(r.start, r.nodes) for r in C.best_chains(df, starts, 5, local_work=work).collect()] == [("d", ["d", "s"])]
