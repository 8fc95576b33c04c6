"""Chains of a graph of which most nodes are leaves that nothing leads to."""

import random

import pytest

from causeway.operators import chains as C
from causeway.operators import traverse as T

EDGES = "graph_id string, src string, dst string, edge_type string"


def layers(seed):
    r = random.Random(seed)
    kinds = [*T.PRIORITY[:3], "OTHER"]
    rows = {("g", f"a{r.randrange(2)}", f"b{i}", r.choice(kinds)) for i in range(3)}
    rows |= {("g", r.choice([f"b{r.randrange(3)}", "alone"]), f"c{i}", r.choice(kinds)) for i in range(8) for _ in range(2)}
    rows |= {("g", r.choice([f"c{r.randrange(8)}", f"b{r.randrange(3)}", "only"]), f"d{i}", r.choice(kinds)) for i in range(40) for _ in range(3)}
    return sorted(rows | {("g", "x", "y", "OTHER"), ("g", "y", "x", "OTHER"), ("g", "x", "d0", "OTHER"), ("g", "y", "d1", "OTHER")})


@pytest.mark.parametrize("types", [None, ["THROWS", "OTHER"]])
def test_leaves_add_to_the_chains_behind_them(spark, types, monkeypatch):
    edges = layers(3)
    df = spark.createDataFrame(edges, EDGES)
    starts = spark.createDataFrame(sorted({("g", n) for _, a, b, _ in edges for n in (a, b) if n not in ("d5", "c2")}), "graph_id string, node_id string")
    settled, whole = [], C._settled
    monkeypatch.setattr(C, "_settled", lambda e: settled.append(e.count()) or whole(e))
    small = {"edge_types": types, "local_work": 10**6}
    large = {"edge_types": types, "local_work": 0, "least": 0}
    count = lambda **kw: {r.start: r.chains for r in C.count_chains(df, starts, **kw).collect()}
    best = lambda **kw: sorted((r.start, r["rank"], r.nodes, r.types) for r in C.best_chains(df, starts, 3, **kw).collect())
    assert count(**large) == count(**small)
    got = best(**large)
    assert got == best(**small) and got
    assert max(settled) < len(edges) / 2
