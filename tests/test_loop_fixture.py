from pyspark.sql import functions as F

from causeway.operators import facts as H
from causeway.operators import graph as G
from causeway.operators import identity as I
from causeway.operators import prepare as P
from causeway.operators import select as S
from causeway.operators import traverse as T


def edges_of(loop):
    steps, snapshots, blocks = loop
    return G.data_edges(steps, snapshots, chunk=None).unionByName(G.control_edges(steps, blocks))


def test_data_edges(loop):
    steps, snapshots, _ = loop
    for chunk in (None, 2):
        got = {(r["src"], r["dst"], r["var"]) for r in G.data_edges(steps, snapshots, chunk=chunk).collect()}
        assert got == {(0, 2, "total"), (1, 2, "i"), (2, 4, "total"), (3, 4, "i"), (4, 6, "total")}


def test_slice_of_result(loop, spark):
    data = edges_of(loop).filter("kind = 'data'")
    seeds = spark.createDataFrame([("r", 6)], "run_id string, step long")
    for work in (10**6, 0):
        got = {r["step"]: (r["depth"], r["is_root"]) for r in T.backward_slice(data, seeds, local_work=work).collect()}
        assert {s: d for s, (d, _) in got.items()} == {6: 0, 4: 1, 3: 2, 2: 2, 1: 3, 0: 3}
        assert {s for s, (_, root) in got.items() if root} == {0, 1, 3}


def test_impact_duality(loop, spark):
    e = edges_of(loop).filter("kind = 'data'")
    seeds = loop[0].select("run_id", "step")
    back = {(r["seed"], r["step"]) for r in T.backward_slice(e, seeds).collect()}
    ahead = {(r["step"], r["seed"]) for r in T.forward_impact(e, seeds).collect()}
    assert back == ahead


def test_impact_stops_where_the_name_changes(loop, spark):
    seeds = spark.createDataFrame([("r", 1, "i")], "run_id string, step long, var string")
    for work in (10**6, 0):
        data = edges_of(loop).filter("kind = 'data'")
        assert {r["step"] for r in T.forward_impact(data, seeds, carry_var=True, local_work=work).collect()} == {1, 2}
        # step 4 is reached by control, so what it writes counts whatever its name
        both = T.forward_impact(edges_of(loop), seeds, carry_var=True, local_work=work).collect()
        assert {r["step"] for r in both} == {1, 2, 4, 6}


def test_facts(loop):
    steps, snapshots, _ = loop
    diff = P.step_diff(snapshots, steps)
    kinds = {(r["kind"], r["subject"]): r for r in H.extract_facts(steps, snapshots, edges_of(loop), diff, chunk=None).collect()}
    assert kinds["loop.iteration", "for i in range(n):"]["metadata"]["iterations"] == "2"
    assert kinds["loop.accumulation", "total"]["evidence"] == [2, 4]
    assert kinds["variable.evolution", "total"]["metadata"]["pattern"] == "monotonic_increasing"
    assert ("causal.root_cause", "total = 0") in kinds


def test_whole_evidence_of_archetypes(spark):
    """Lines that decide a parameter may come after a variable's fifth step, and after its first chunk."""
    from causeway.functions.ordered import CHUNK

    last = CHUNK + 3
    code = {last: "total -= x", last - 1: "total = total + y"}
    steps = [("r", i, code.get(i, "total = total + x"), 0, ["total", "x"], ["total"]) for i in (*range(8), last - 1, last)]
    snapshots = [("r", i, "total", str(n), "int") for n, (_, i, *_) in enumerate(steps)]
    found = I.variable_archetypes(spark.createDataFrame(steps, "run_id string, step long, code string, indent int, reads array<string>, writes array<string>"),
                                  spark.createDataFrame(snapshots, "run_id string, step long, var string, value string, type string"), chunk=None)
    steps = spark.createDataFrame([s[:4] for s in steps], "run_id string, step long, code string, indent int")
    whole = I.deduplicate(found).filter("archetype = 'accumulator'")
    assert [r.evidence for r in whole.orderBy("part").collect()] == [list(range(8)), [last - 1, last]]
    got = I.normalize(whole, steps).collect()
    assert sorted(r.part for r in got) == [0, 1] and {(r.operator, r.direction) for r in got} == {("-", "decreasing")}
    looks = steps.select("run_id", "step", F.lit("print(a[0])").alias("code"))
    assert sum(len(r.evidence) for r in I.structure_archetypes(looks).filter("archetype = 'hash_lookup'").collect()) == 10


def test_archetypes(loop):
    steps, snapshots, _ = loop
    got = {(r["archetype"], r["subject"]): r["confidence"] for r in I.variable_archetypes(steps, snapshots, chunk=None).collect()}
    assert got["accumulator", "total"] == 0.9
    assert ("loop_counter", "n") in got


def test_selection_falls_back_to_last_step(loop):
    assert [r["step"] for r in S.select_nodes(loop[0], pattern="no such code").collect()] == [6]
    assert {r["step"] for r in S.select_nodes(loop[0], var="i").collect()} == {1, 2, 3, 4, 5}


def test_step_diff_and_rollup(loop):
    steps, snapshots, _ = loop
    rows = P.step_diff(snapshots, steps)
    changed = {(r["step"], r["var"]) for r in rows.filter("change = 'changed'").collect()}
    assert changed == {(4, "i"), (5, "total")}
    roll = {r["var"]: (r["first_value"], r["last_value"], r["changes"]) for r in P.variable_rollup(rows).collect()}
    assert roll["total"] == ("0", "1", 1)


def test_block_structure_is_the_same_in_pieces(loop):
    whole = P.block_structure(loop[0], chunk=None)
    parts = P.block_structure(loop[0], chunk=2)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    assert {r["step"]: r["block_id"] for r in whole.collect()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0}
    assert [r["condition_step"] for r in whole.collect() if r["condition_step"] is not None] == [1]


def test_enclosing_control(loop):
    for chunk in (None, 2):
        got = {r["step"]: r["control_step"] for r in P.enclosing_control(loop[0], chunk=chunk).collect()}
        assert got == {2: 1, 4: 3}


def test_line_accesses():
    assert P.line_accesses("total = total + i") == (["total", "i"], ["total"])
    assert P.line_accesses("x += y") == (["x", "y"], ["x"])
    assert P.line_accesses("for i in range(n):") == (["n"], ["i"])
    assert P.line_accesses("with open(p) as f:") == ([], ["f"])
    assert P.line_accesses("if x:") == ([], [])


def test_data_edges_do_not_cross_calls(spark):
    steps = spark.createDataFrame(
        [("r", 0, 0, [], ["a"]), ("r", 1, 1, [], ["a"]), ("r", 2, 0, ["a"], [])],
        "run_id string, step long, call_id long, reads array<string>, writes array<string>")
    got = [(r["src"], r["dst"]) for r in G.data_edges(steps, chunk=None).select(F.col("src"), F.col("dst")).collect()]
    assert got == [(0, 2)]
