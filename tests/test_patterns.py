import random

import pytest

from causeway.operators import events as E

KINDS = ["pointer_move", "condition", "recursive_call", "return", "assignment", "loop", "list_op", "other"]
TAGS = {"condition": [[], ["null_check"]], "assignment": [[], ["initialization"], ["accumulation"]]}


@pytest.fixture(scope="module")
def events(spark):
    r = random.Random(5)
    rows = []
    for run, n in (("a", 45), ("b", 12), ("c", 1)):
        for s in range(n):
            k = r.choice(KINDS)
            rows.append((run, s, k, r.choice(TAGS.get(k, [[]])), r.randint(0, 3), 0, r.choice(["x", "y", None])))
    return rows, spark.createDataFrame(
        rows, "run_id string, step long, event_type string, tags array<string>, depth int, call_id long, target_var string")


def ok(ev, node):
    return any(ev[2] == s[0] and all(t in ev[3] for t in s[1]) for s in node.specs)


def brute(rows, p, window=30):
    """Every window from every start, scored the long way."""
    nodes = {n.name: n for n in p.nodes}
    out = []
    for a in range(len(rows)):
        for b in range(a + 1, min(a + window, len(rows) + 1)):
            part, best, roles = rows[a:b], 0.0, set()
            for path in p.paths:
                i, got, seen = 0, 0.0, set()
                for name in path:
                    while i < len(part) and not ok(part[i], nodes[name]):
                        i += 1
                    if i < len(part):
                        got += nodes[name].weight
                        seen.add(nodes[name].role)
                        i += 1
                share = got / sum(nodes[n].weight for n in path)
                if share > best:
                    best, roles = share, seen
            for x, y in p.parallel:
                if any(ok(e, nodes[x]) for e in part) and any(ok(e, nodes[y]) for e in part):
                    best = min(best + 0.1, 1.0)
            if best >= p.min_confidence:
                out.append((a, b - 1, round(min(best + len(roles) / len(p.nodes) * 0.15, 1.0), 6)))
    kept = []
    for m in sorted(out, key=lambda m: -m[2]):
        if not any(m[0] <= k[1] and k[0] <= m[1] for k in kept):
            kept.append(m)
    return set(kept)


@pytest.mark.parametrize("chunk", [None, 32])
def test_matches_equal_brute_force(events, chunk):
    rows, df = events
    got = {}
    for r in E.best_matches(E.candidates(df, chunk=chunk), chunk).collect():
        got.setdefault((r["run_id"], r["pattern"]), set()).add((r["start_step"], r["end_step"], round(r["confidence"], 6)))
    for run in ("a", "b", "c"):
        own = [r for r in rows if r[0] == run]
        for p in E.BUILTIN:
            assert got.get((run, p.name), set()) == brute(own, p), (run, p.name)


def test_dominated_matches_are_the_same_in_pieces(events):
    _, df = events
    whole = sorted(map(str, E.detect(df, chunk=None).collect()))
    parts = sorted(map(str, E.detect(df, chunk=32).collect()))
    assert whole == parts and whole


def test_user_pattern_with_target(events):
    rows, df = events
    p = E.Pattern("own", (E.Node("n", (("assignment", (), "x"),), "r", 1.0),), (("n",),), 0.5, "", "")
    got = {(r["run_id"], r["end_step"]) for r in E.candidates(df, (p,)).collect()}
    assert got == {(r[0], r[1]) for r in rows if r[2] == "assignment" and r[6] == "x"}


def test_line_events(spark):
    lines = {
        "cur = cur.next": ("pointer_move", "cur"), "xs.append(1)": ("list_op", "xs"), "dfs(node.left)": ("function_call", None),
        "x += 1": ("assignment", "x"), "a, b = b, a": ("assignment", "a"), "if not node:": ("condition", "node"),
        "while lo < hi:": ("condition", "lo"), "return f(x)": ("return", None), "for k in ks:": ("loop", "k"), "x = 3": ("assignment", "x"),
        "break": ("break", None), "x == 3": ("unknown", None), "node.val += 2": ("pointer_update", "node.val"),
    }
    df = spark.createDataFrame([(c,) for c in lines], "code string")
    assert {r["code"]: (r["event_type"], r["target_var"]) for r in E.line_events(df).collect()} == lines


@pytest.mark.parametrize("query", ["best_matches", "drop_dominated"])
def test_small_runs_share_a_task(events, query):
    """Matches of short runs are settled many in one task, not by one call per run and pattern."""
    _, df = events
    found = E.candidates(df, chunk=None)
    out = E.best_matches(found, None) if query == "best_matches" else E.drop_dominated(found, None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "regexp" not in plan.lower()


def test_equal_ends_count_once_with_the_highest_confidence():
    # the row of the best score stands for both, the confidence is the highest of any
    assert E._settled([0, 0, 2], [3, 3, 5], [0.9, 0.8, 0.7], [0.5, 0.6, 0.4]) == [(1, 0.9)]


def test_keys_may_reach_over_batches(spark):
    from causeway.functions.folding import settle_keys
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.range(100).selectExpr("id div 10 AS k", "id AS v", "0L AS n")
        got = settle_keys(df, ["k"], ["v"], lambda v: [(v.index(max(v)), len(v))], "n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(k, 10 * k + 9, 10) for k in range(10)]
