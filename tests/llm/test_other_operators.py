"""Operators on vectors, conversations and edges, the pipeline, and queries with oracle SQL."""

import collections
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from causeway.llm import pivot_search, quality, sketch_dedup, tool_calls, vector_dedup
from causeway.llm.components import components
from causeway.llm.common import numbered


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: top(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_numbered(spark):
    rows = [(i * 7919 % 101,) for i in range(101)]
    got = numbered(spark.createDataFrame(rows, "x long"), "x").collect()
    assert sorted((r.x, r.pos) for r in got) == [(i, i) for i in range(101)]


VECTORS = "vec_id long, embedding array<float>, label int, n int, vec string, component long, rank int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng, rows = np.random.default_rng(2), []
    for g in range(5):
        centre = rng.standard_normal(12)
        for i in range(12):
            rows.append(((centre + rng.standard_normal(12) * 0.05 * (i % 4)).astype(np.float32).tolist(), g % 3))
    rows += [(rng.standard_normal(12).astype(np.float32).tolist(), None if i % 9 == 0 else i % 3) for i in range(120)]
    rows += [([0.0] * 12, 1), (None, 1), ([], 1), ([float("nan")] * 12, 1), ([float("inf"), 1.0], 1), ([None, 1.0], 1), ([1.0, 2.0], 1), ([1e-30, 2e-30], 1), ([3e4] * 12, 2)]
    table = [(i, v, y, 0, "x", 0, 0) for i, (v, y) in enumerate(rows)]
    table += [table[3], (None, *table[4][1:])]
    return table, spark.createDataFrame(table, VECTORS).repartition(3)


def test_vector_near_duplicates(vectors):
    rows, table = vectors

    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    def linked(a, b):
        if a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = (np.array(v, np.float32).astype(np.float64) for v in (a[1], b[1]))
        x, y = x / np.abs(x).max(), y / np.abs(y).max()
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    good = [i for i, r in enumerate(rows) if usable(r)]
    pairs = [(i, j) for i in good for j in good if i != j and linked(rows[i], rows[j])]
    n = collections.Counter(i for i, _ in pairs)
    comp = {r[0]: r[0] for r in rows}
    for _ in rows:
        for i, j in pairs:
            comp[rows[i][0]] = comp[rows[j][0]] = min(comp[rows[i][0]], comp[rows[j][0]])
    want = collections.Counter((r[0], n[i], comp[r[0]], r[0] == comp[r[0]]) for i, r in enumerate(rows))
    assert collections.Counter(map(tuple, vector_dedup.near_duplicates(table, window=4).collect())) == want
    assert vector_dedup.near_duplicates(table.limit(0)).collect() == []


def test_vector_star(spark):
    """Copies that link through their original only, far more of them than all windows reach."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(64))
    aside = rng.standard_normal((3000, 64))
    aside = unit(aside - (aside @ centre)[:, None] * centre)
    x = np.concatenate([centre[None], 0.981 * centre + math.sqrt(1 - 0.981 ** 2) * aside, rng.standard_normal((1500, 64))])
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(3)
    hit = unit(x) @ unit(x).T >= 0.98
    np.fill_diagonal(hit, False)
    assert hit[0, 1:3001].all() and not hit[3001:].any()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(table).collect()}
    assert got == {i: (int(n), 0 if i <= 3000 else i, i == 0 or i > 3000) for i, n in enumerate(hit.sum(axis=1))}


@pytest.mark.parametrize("block, meet", [(7, 1), (16, 2)])
def test_vector_blocks(vectors, monkeypatch, block, meet):
    """Many groups of blocks give the same rows as one."""
    table = vectors[1]
    want = collections.Counter(map(tuple, vector_dedup.near_duplicates(table).collect()))
    monkeypatch.setattr(vector_dedup, "MEET", meet)
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    assert collections.Counter(map(tuple, vector_dedup.near_duplicates(table).collect())) == want


def test_pivot_search(vectors):
    rows, table = vectors

    def ints(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * float(np.float32(x))) for x in v]

    known = {r[0]: ints(r[1]) for r in rows if r[0] is not None}
    known = {i: v for i, v in known.items() if v is not None}
    want = []
    for q in known:
        if q % 5 == 0:
            s = sorted((-sum(a * b for a, b in zip(known[q], v, strict=False)), i) for i, v in known.items() if i != q)[:5]
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert sorted(map(tuple, pivot_search.top_k(table, every=5, pivots=6).collect())) == sorted(want)
    few = table.filter("vec_id in (0, 7, 50)")
    assert len(pivot_search.top_k(few).collect()) == 4
    assert pivot_search.top_k(table.limit(0)).collect() == []


def test_canonical_json():
    value = {"b": [1, -0.0, 1e21, 1e-7, 0.000001, 1.5, True, None], "a": "é\n\"/\u0001", "\U0001f600": 1, "דּ": 2}
    assert tool_calls.canonical(value) == '{"a":"é\\n\\"/\\u0001","b":[1,0,1e+21,1e-7,0.000001,1.5,true,null],"\U0001f600":1,"דּ":2}'
    for bad in ("{", "NaN", '{"a":1,"a":2}', None, "1e999", "[" * 100_000):
        with pytest.raises(ValueError):
            tool_calls.parsed(bad)


def test_violations():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
        "a": {"type": "integer", "minimum": 1, "maximum": 3}, "b": {"type": "array", "items": {"type": "string", "minLength": 2}, "maxItems": 2}, "c": {"enum": [1, "x"]}}}
    assert tool_calls.violations({"a": 2, "b": ["ab"], "c": "x"}, schema) == []
    assert tool_calls.violations({"a": True}, schema) == ["$.a: not integer"]
    assert sorted(tool_calls.violations({"b": ["a", "bc", "cd"], "c": 2, "d": 0}, schema)) == ["$.a: missing", "$.b: too long", "$.b[0]: too short", "$.c: not one of the choices", "$.d: unknown"]
    assert tool_calls.violations([], schema) == ["$: not object"]


def test_linked_calls(spark):
    schemas = {"t": {"type": "object"}}
    ref = lambda *ids: '{"z": [' + ",".join(f'{{"$ref": "{i}"}}' for i in ids) + "]}"
    calls = spark.createDataFrame([
        ("c", "1", 5, "t", ref("2", "3"), 0), ("c", "2", 1, "t", ref("3"), 0), ("c", "3", 9, "t", "{}", 0), ("c", "4", 1, "t", ref("5"), 0), ("c", "5", 1, "t", ref("4"), 0),
        ("c", "6", 2, "t", ref("nope"), 0), ("c", "3", 10, "t", '{"a": 1}', 0), ("d", "1", 1, "u", "{}", 0), ("d", "2", None, "t", "no", 0), (None, "1", 1, "t", "{}", 0), ("d", None, 1, None, None, 0),
        ("e", "1", 1, "t", "{}", 0), ("e", "1", 1, "t", "{}", 0)], "conv_id string, call_id string, turn long, name string, arguments string, level int")
    results = spark.createDataFrame([("c", "1", 6, "r", 0), ("c", "1", 7, None, 0), ("d", "9", 2, "r", 0), (None, None, None, None, 0), ("c", "4", 2, "", 0)],
                                    "conv_id string, call_id string, turn long, content string, status int")
    got = tool_calls.link_tool_calls(calls, results, schemas).collect()
    assert len(got) == 18
    at = {(r.conv_id, r.call_id, r.kind, r.turn): r for r in got}
    assert [at["c", str(i), "call", t].level for i, t in ((1, 5), (2, 1), (3, 9), (4, 1), (5, 1), (6, 2))] == [2, 1, 0, None, None, 0]
    assert at["c", "1", "call", 5].status == "linked" and at["c", "1", "result", 7].status == "linked" and at["c", "1", "result", 7].level == 2
    assert at["c", "3", "call", 10].status == "duplicate" and at["c", "2", "call", 1].status == "unanswered"
    assert at["d", "9", "result", 2].status == "orphan" and at[None, "1", "call", 1].status == at["d", None, "call", 1].status == at[None, None, "result", None].status == "unidentified"
    assert at["c", "6", "call", 2].errors == ["$: unknown reference nope"] and at["d", "1", "call", 1].errors == ["$: unknown tool"] and at["d", "2", "call", None].errors == ["$: not JSON"]
    assert at["c", "1", "result", 7].message == '{"content":null,"id":"1","type":"result"}'
    assert [r.status for r in got if r.conv_id == "e"] == ["unanswered"] * 2
    order = sorted((r for r in got if r.conv_id == "c" and r.level is not None), key=lambda r: (r.level, r.turn, r.call_id, r.kind))
    assert [r.call_id for r in order if r.kind == "call" and r.status != "duplicate"] == ["6", "3", "2", "1"]
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), schemas).collect() == []


def test_odd_turns(spark):
    turns = spark.createDataFrame([(1, 0, "system", None), (1, 1, "user", ""), (1, 2, "assistant", "x"), (1, 4, "tool", "y"), (2, None, None, None), (None, 0, "user", "q")],
                                  "conv_id long, turn long, role string, text string")
    got = tool_calls.link_tool_calls(*tool_calls.turns_as_calls(turns), tool_calls.TURN_SCHEMAS).collect()
    assert len(got) == 6
    by = {(r.conv_id, r.turn): r for r in got}
    assert by["1", 0].errors == ["$.instructions: not string"] and by["1", 1].errors == ["$.prompt: too short"] and by["1", 1].level == 1
    assert by["1", 2].status == "linked" and by["1", 4].status == "orphan" and by["2", None].status == by[None, 0].status == "unidentified"


def test_pipeline(spark):
    """Each stage against its operator's plain meaning, on its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(None, "some words of no id", "en", "src0", 5), (None, None, None, None, None), (10**9, "", "en", "src1", 0)], docs.schema)
    docs = docs.union(docs.filter("doc_id = 1")).union(extra)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    good = corpus_pipeline.keep_quality(spark, docs, sf)
    model = quality.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = quality.score(docs, model, keep_text=True).filter("score >= 0.7").select(*docs.columns)
    rows = lambda df: collections.Counter(map(tuple, df.collect()))
    assert rows(good) == rows(want) and good.columns == docs.columns
    left = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    kept = {r.doc_id for r in sketch_dedup.near_duplicates(docs).filter("kept").collect()}
    assert collections.Counter(r.doc_id for r in left.collect() if r.doc_id is not None) == collections.Counter(kept - {None})
    assert left.filter("doc_id is null").count() == 2
    mixed = corpus_pipeline.mix_sources(spark, left, sf)
    copies = collections.Counter(map(tuple, mixed.collect()))
    assert max(copies.values()) <= 3 and set(copies) <= set(map(tuple, left.collect()))
    size = sum(len((r.text or "").encode().split()) for r in left.collect())
    assert abs(sum(len((r[1] or "").encode().split()) * n for r, n in copies.items()) - size) <= 0.02 * size
    out = corpus_pipeline.encode(spark, mixed, sf)
    assert out.count() == sum(copies.values()) and "ids_sha256" in out.columns


def test_numbers_and_lone_surrogates_have_one_text():
    c = lambda text: tool_calls.canonical(tool_calls.parsed(text))
    assert c("1e30") == c("1" + "0" * 30) == c("10.0e29") == "1e+30"
    assert c("[0.10, 100e-2, -0, -0.0, 123456789012345678901234567890, 1e-400]") == "[0.1,1,0,0,1.2345678901234567890123456789e+29,1e-400]"
    assert c('{"a":"\\ud800x","\\udc00":1}') == '{"a":"\\ud800x","\\udc00":1}'
    assert c('"\\ud83d\\ude00"') == '"\U0001f600"'


def test_odd_arguments_crash_no_task(spark):
    nested = lambda n: '{"a":' * n + "1" + "}" * n
    rows = [("c", str(i), i, "tool", a) for i, a in enumerate(
        [nested(tool_calls.DEPTH), nested(tool_calls.DEPTH + 1), nested(100_000), '"' + "[" * 1000 + '"', '{"\\ud800":{"$ref":"\\udfff"}}', '{"a":"' + "x" * 10_000_000 + '"}', '{"a":1e999999999999999999999}'])]
    calls = spark.createDataFrame(rows, "conv_id string, call_id string, turn long, name string, arguments string")
    results = spark.createDataFrame([], "conv_id string, call_id string, turn long, content string")
    schema = {"type": "object", "properties": {"a": {"maxLength": 5}}, "additionalProperties": False}
    got = {r.call_id: r for r in tool_calls.link_tool_calls(calls, results, {"tool": schema}).collect()}
    assert [list(got[str(i)].errors) for i in range(7)] == [
        [], ["$: nested too deeply"], ["$: nested too deeply"], ["$: not object"], ["$.\\ud800: unknown", "$: unknown reference \\udfff"], ["$.a: too long"], ["$: not JSON"]]
    assert got["0"].message.startswith('{"arguments":{"a":{"a":') and len(got["5"].message) > 10_000_000


def test_scores_of_large_components(spark):
    big = [2.0**24, 2.0**23, 1.0, 0.0]
    rows = [(0, big), (1, big), (2, [2.0**24, 0.0, 0.0, 1.0]), (3, [1e300, 0.0, 0.0, 0.0]), (4, [-1e300, 0.0, 0.0, 0.0]), (5, [2.0**22 + 1 / 256, 1.0, 3.0, 5.0]), (6, [1.0, 2.0, 3.0, 4.0]), (7, [float("inf"), 0.0, 0.0, 0.0])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in pivot_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1).collect()]
    top = 2**63 - 1
    ints = {i: [max(-top, min(top, math.floor(256 * x))) for x in v] for i, v in rows if i != 7}
    for q in ints:
        scores = {i: max(-top, min(top, sum(a * b for a, b in zip(ints[q], v)))) for i, v in ints.items() if i != q}
        want = sorted(scores, key=lambda i: (-scores[i], i))[:5]
        assert sorted(g[1:] for g in got if g[0] == q) == [(k + 1, i, scores[i]) for k, i in enumerate(want)]
