import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from causeway.operators import deep
from causeway.operators import hierarchy as H
from causeway.operators import traverse as T


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(3)
    edges = {(f"g{g}", r.randint(0, 30), r.randint(0, 30)) for g in range(3) for _ in range(50)}
    return edges, spark.createDataFrame(sorted(edges), "run_id string, src long, dst long")


def search(edges, run, start):
    out, seen, queue = {}, {start}, deque([(start, 0)])
    while queue:
        n, d = queue.popleft()
        out[n] = d
        for g, a, b in edges:
            if g == run and a == n and b not in seen:
                seen.add(b)
                queue.append((b, d + 1))
    return out


@pytest.mark.parametrize("work", [10**6, 0, 400])
def test_reach_equals_search(graph, spark, work):
    edges, df = graph
    seeds = [("g0", 1), ("g0", 2), ("g1", 5), ("g2", 7), ("none", 1)]
    s = spark.createDataFrame([(g, n, n) for g, n in seeds], "run_id string, seed long, node long")
    links = df.select("run_id", F.col("src").alias("from_node"), F.col("dst").alias("to_node"))
    got = {}
    for r in T.reach(links, s, local_work=work).collect():
        got.setdefault((r["run_id"], r["seed"]), {})[r["node"]] = r["depth"]
    assert got == {(g, n): search(edges, g, n) for g, n in seeds}


def test_max_depth(graph, spark):
    edges, df = graph
    s = spark.createDataFrame([("g0", 1, 1)], "run_id string, seed long, node long")
    links = df.select("run_id", F.col("src").alias("from_node"), F.col("dst").alias("to_node"))
    want = {n: d for n, d in search(edges, "g0", 1).items() if d <= 2}
    for work in (10**6, 0):
        assert {r["node"]: r["depth"] for r in T.reach(links, s, max_depth=2, local_work=work).collect()} == want


def test_shortest_paths_are_paths(graph, spark):
    edges, df = graph
    far = [(g, a, b) for g in ("g0", "g1") for a in (1, 2, 3) for b in (9, 12)]
    pairs = spark.createDataFrame(far, "run_id string, source long, target long")
    paths = {}
    for r in T.shortest_paths(df, pairs).collect():
        paths.setdefault((r["run_id"], r["pair"]), {})[r["position"]] = r["step"]
    for g, a, b in far:
        dist = search(edges, g, a).get(b)
        p = paths.get((g, f"{a}>{b}"))
        assert (p is None) == (dist is None)
        if p:
            nodes = [p[i] for i in range(len(p))]
            assert nodes[0] == a and nodes[-1] == b and len(nodes) == dist + 1
            assert all((g, x, y) in edges for x, y in zip(nodes, nodes[1:]))


def test_chains_follow_every_path_and_no_cycle(spark):
    e = spark.createDataFrame(
        [("g", "a", "c", "X"), ("g", "b", "c", "X"), ("g", "c", "d", "Y"), ("g", "d", "c", "Y")],
        "graph_id string, src string, dst string, edge_type string")
    start = spark.createDataFrame([("g", "d")], "graph_id string, node_id string")
    got = {tuple(r["nodes"]) for r in T.causal_chains(e, start).collect()}
    assert got == {("d", "c", "a"), ("d", "c", "b")}
    assert T.causal_chains(e, start, edge_types=["Y"]).count() == 0


def test_root_cause_priority(spark):
    e = spark.createDataFrame(
        [("g", "x", "err", "CONTROL_FLOW"), ("g", "y", "err", "THROWS"), ("g", "cfg", "y", "CONFIG_INFLUENCE")],
        "graph_id string, src string, dst string, edge_type string")
    errs = spark.createDataFrame([("g", "err")], "graph_id string, node_id string")
    rows = {r["node"]: (r["depth"], r["on_chain"]) for r in T.root_cause_chain(e, errs).collect()}
    assert rows == {"err": (0, True), "y": (1, True), "cfg": (2, True), "x": (1, False)}


def test_taxonomy(spark):
    t = H.concepts(spark)
    e = H.parent_edges(t)
    up = {r["ancestor"] for r in H.ancestors_of(e).filter("node_id = 'memo_table'").collect()}
    assert up == {"state_cache", "state_management", "key_value_storage"}
    down = {r["descendant"] for r in H.descendants_of(e).filter("node_id = 'optimization'").collect()}
    assert {"dynamic_programming", "top_down_memo", "greedy"} <= down
    pair = spark.createDataFrame([("memo_table", "optimization")], "source string, target string")
    path = [r["step"] for r in H.taxonomy_path(t, pair).orderBy("position").collect()]
    assert path == ["memo_table", "dynamic_programming", "optimization"]
    assert H.with_behavior(t, "supports_lookup").count() == 2
    assert {r["target"] for r in H.related_by(t, "opposite_of").collect()} == {"brute_force", "dynamic_programming", "greedy"}


def random_dag(seed, n, rows, near=6):
    r = random.Random(seed)
    out = set()
    for _ in range(rows):
        a = r.randrange(n - 1)
        out.add(("r", a, min(n - 1, a + 1 + r.randrange(near)) if r.random() < 0.9 else r.randrange(a + 1, n)))
    return out


@pytest.mark.parametrize("falling", [False, True])
@pytest.mark.parametrize("hub", [False, True])
def test_swept_equals_search(spark, falling, hub):
    edges = random_dag(4, 400, 700)
    if hub:  # one value read by very many steps
        edges |= {("r", 3, b) for b in range(20, 400, 2)}
    edges = {(g, b, a) if falling else (g, a, b) for g, a, b in edges}
    links = spark.createDataFrame(sorted(edges), "run_id string, from_node long, to_node long")
    starts = [0, 3, 17] if not falling else [399, 398, 220]
    seeds = spark.createDataFrame([("r", f"s{n}", n) for n in starts], "run_id string, seed string, node long")
    for chunk, merged in ((16, 2), (64, 4), (1000, 2)):
        got = {}
        for r in deep.swept(links, seeds, "run_id", falling, chunk=chunk, merged=merged, spread=10**6).collect():
            assert r["node"] not in got.setdefault(r["seed"], {})
            got[r["seed"]][r["node"]] = r["depth"]
        assert got == {f"s{n}": search(edges, "r", n) for n in starts}
    assert deep.swept(links, seeds, "run_id", falling, chunk=16, merged=2, spread=0) is None


def test_reach_picks_a_form_per_key(spark):
    r = random.Random(6)
    edges = {("dag", b, a) for _, a, b in random_dag(1, 120, 200)}
    edges |= {("tree", i, i // 3) for i in range(1, 100)} | {("tree", 0, 0)}
    edges |= {("ring", i, (i + 1) % 40) for i in range(40)}
    edges |= {("any", r.randrange(40), r.randrange(40)) for _ in range(90)}
    links = spark.createDataFrame(sorted(edges), "run_id string, from_node long, to_node long")
    starts = [(g, n) for g in ("dag", "tree", "ring", "any") for n in (37, 5)] + [("none", 1)]
    seeds = spark.createDataFrame([(g, n, n) for g, n in starts], "run_id string, seed long, node long")
    for depth in (None, 3):
        got, parents = {}, {}
        for x in T.reach(links, seeds, local_work=0, max_depth=depth).collect():
            got.setdefault((x["run_id"], x["seed"]), {})[x["node"]] = x["depth"]
            parents[x["run_id"], x["seed"], x["node"]] = x["parent"]
        for g, n in starts:
            want = {v: d for v, d in search(edges, g, n).items() if depth is None or d <= depth}
            assert got[g, n] == want
            for v, d in want.items():
                before = [u for u, e in want.items() if e == d - 1 and (g, u, v) in edges]
                assert parents[g, n, v] == min(before, default=None)


def test_deep_run_in_few_rounds(spark):
    n = 100_000
    steps = spark.range(1, n).select(F.lit("r").alias("run_id"), F.col("id").alias("from_node"), (F.col("id") - 1).alias("to_node"))
    links = steps.unionByName(steps.filter("from_node % 100 = 0").withColumn("to_node", F.col("from_node") - 50))
    seeds = spark.createDataFrame([("r", n - 1, n - 1)], "run_id string, seed long, node long")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = T.reach(links, seeds, local_work=0, parents=False).agg(F.count("*"), F.max("depth")).first()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    depth = {n - 1: 0}
    for i in range(n - 1, 0, -1):
        for to in (i - 1, *([i - 50] if i % 100 == 0 else [])):
            depth[to] = min(depth.get(to, n), depth[i] + 1)
    assert tuple(got) == (n, max(depth.values()))
    assert jobs < 100  # a few for each of the rounds, however deep the run
    chain = T.reach(steps, seeds, local_work=0).agg(F.count("*"), F.max("depth")).first()
    assert tuple(chain) == (n, n - 1)


def test_squared_equals_search(spark):
    r = random.Random(8)
    edges = {("g", r.randrange(60), r.randrange(60)) for _ in range(90)} | {("g", 100 + i, 101 + i) for i in range(20)}
    links = spark.createDataFrame(sorted(edges), "run_id string, from_node long, to_node long")
    got = {(x["from_node"], x["to_node"]): x["depth"] for x in deep.squared(links, "run_id").collect()}
    want = {(a, b): d for a in {e[1] for e in edges} for b, d in search(edges, "g", a).items() if a != b}
    assert got == want


def test_key_with_loops_only_keeps_its_start(spark):
    links = spark.createDataFrame([("a", 5, 3), ("a", 5, 2), ("loop", 1, 1)], "run_id string, from_node long, to_node long")
    seeds = spark.createDataFrame([("a", 5, 5), ("loop", 1, 1)], "run_id string, seed long, node long")
    got = sorted((r["run_id"], r["node"], r["depth"]) for r in T.reach(links, seeds, local_work=0).collect())
    assert got == [("a", 2, 1), ("a", 3, 1), ("a", 5, 0), ("loop", 1, 0)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_keys_share_a_task(spark):
    """Many keys are searched per call, also where a key lies in several batches or is null."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    chains = {f"k{g}": list(range(g % 7 + 1)) for g in range(40)} | {None: [0, 1, 2]}
    edges = spark.createDataFrame([(g, a, a + 1) for g, c in chains.items() for a in c], "run_id string, from_node long, to_node long")
    seeds = spark.createDataFrame([(g, "s", 0) for g in chains if g] + [("none", "s", 5)], "run_id string, seed string, node long")
    spark.conf.set(size, 3)
    try:
        found = T.reach(edges, seeds)
        assert "CoGroup" not in _plan(found)
        got = sorted((r.run_id, r.node, r.depth, r.parent) for r in found.collect())
    finally:
        spark.conf.unset(size)
    want = [(g, n, n, n - 1 if n else None) for g, c in chains.items() if g for n in range(len(c) + 1)]
    assert sorted(got, key=str) == sorted([*want, ("none", 5, 0, None)], key=str)


def test_carried_search_runs_once(spark):
    edges = spark.createDataFrame([("r", 0, 1, "data", "x"), ("r", 1, 2, "data", "x"), ("r", 1, 3, "data", "y")], "run_id string, src long, dst long, kind string, var string")
    seeds = spark.createDataFrame([("r", 0, "x")], "run_id string, step long, var string")
    found = T.forward_impact(edges, seeds, carry_var=True)
    assert "MapInArrow" not in _plan(found) and "CoGroup" not in _plan(found)
    assert sorted(map(tuple, found.collect())) == [("r", 0, 0, 0, False), ("r", 0, 1, 1, False), ("r", 0, 2, 2, True)]


@pytest.mark.parametrize("depth", [None, 2])
def test_leaves_take_over_what_lies_above(spark, monkeypatch, depth):
    """Only the nodes above the leaves climb; two trees, one of them a bare chain, and a hot parent."""
    up = {("t", f"i{n}"): f"o{n // 4}" for n in range(120)} | {("t", f"o{n}"): f"c{n % 5}" for n in range(30)} | {("t", f"c{n}"): "n" for n in range(5)}
    up |= {("t", "n"): "r"} | {("t", f"s{n}"): "n" for n in range(40)} | {("u", f"k{n}"): f"k{n + 1}" for n in range(6)}
    edges = spark.createDataFrame([(g, a, b) for (g, a), b in up.items()], "graph_id string, from_node string, to_node string")
    climbed, plain = [], deep.lifted
    monkeypatch.setattr(deep, "lifted", lambda e, *a: climbed.append(e.count()) or plain(e, *a))
    got = sorted(map(tuple, deep.peeled(edges, "graph_id", depth, least=20).select("graph_id", "seed", "node", "depth").collect()))
    want = []
    for g, a in up:
        node, d = a, 0
        while (g, node) in up and (depth is None or d < depth):
            node, d = up[g, node], d + 1
            want.append((g, a, node, d))
    assert got == sorted(want) and climbed and max(climbed) < len(edges.collect()) // 4


def test_peeled_leaves_circles_to_others(spark):
    circle = [("g", f"a{n}", "x") for n in range(30)] + [("g", "x", "y"), ("g", "y", "x")]
    assert deep.peeled(spark.createDataFrame(circle, "graph_id string, from_node string, to_node string"), "graph_id", least=5) is None
