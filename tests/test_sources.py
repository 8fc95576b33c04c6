from pyspark.sql import functions as F

from causeway.operators import scores as L
from causeway.operators import static as G
from causeway.sources import corpus as R
from causeway.sources import trace as S


def test_corpus_and_config(spark, tmp_path):
    (tmp_path / "auth.py").write_text("ttl = config['auth']['ttl']\ndef login(u):\n    t = ttl\n    return t\nx = login(1)\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "app.ts").write_text("const f = (a) => a\nlet x = 1\nlet y = x + 2\nf(y)\n")
    (tmp_path / "c.yaml").write_text("auth:\n  ttl: 60\n  deep:\n    a: [1, 2]\n")
    (tmp_path / "d.json").write_text('{"db": {"host": "h"}, "on": true}')
    (tmp_path / "bad.json").write_text("{")
    root = str(tmp_path)
    lines = R.read_lines(spark, root)
    assert lines.count() == 5 and lines.filter("line = 3").first()["text"] == "    t = ttl"
    assert R.read_lines(spark, root, R.SCRIPT).filter("text <> ''").count() == 4
    config = {(r["path"], r["value"]) for r in R.read_config(spark, root).filter("error IS NULL").collect()}
    assert [r["file"].rsplit("/", 1)[1] for r in R.read_config(spark, root).filter("error IS NOT NULL").collect()] == ["bad.json"]
    assert config == {("auth.ttl", "60"), ("auth.deep.a", "[1, 2]"), ("db.host", "h"), ("on", "True")}
    links = G.config_influence(lines, R.read_config(spark, root)).collect()
    assert [(r["src"], r["dst"].rsplit("/", 1)[1]) for r in links] == [("config:auth.ttl", "auth.py:1")]


def test_python_graph(spark):
    files = spark.createDataFrame([("f", "a = 1\ndef g(x):\n    b = a\n    return b\na = 2\nc = a + g(a)\n"), ("bad", "def (")], "file string, text string")
    names = G.scan_python(files)
    got = {(r["src"], r["dst"], r["edge_type"]) for r in G.python_edges(names).collect()}
    assert got == {("f:1", "f:3", "DATA_DEPENDENCY"), ("f:5", "f:6", "DATA_DEPENDENCY"), ("f:6", "f:2", "CALL_RELATION")}
    labels = {r["line"]: r["semantic_label"] for r in G.python_nodes(names, R.to_lines(files)).collect()}
    assert labels[2] == "function g" and labels[4] == "return"


def test_traceback(spark):
    text = 'Traceback (most recent call last):\n  File "/a.py", line 3, in f\n    g()\n  File "/b.py", line 9, in g\n    raise E("x")\nE: x: y'
    df = spark.createDataFrame([("t", text), ("none", "all fine")], "trace_id string, text string")
    nodes, edges = G.exception_graph(df)
    assert {(r["node_id"], r["node_type"], r["semantic_label"]) for r in nodes.collect()} == {
        ("/a.py:3", "CODE", "in f"), ("/b.py:9", "ERROR", "E: x: y")}
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("/a.py:3", "/b.py:9")]
    assert [r["code_line"] for r in G.exception_frames(df).orderBy("frame").collect()] == ["g()", 'raise E("x")']


def test_result_round_trip(spark, tmp_path):
    df = spark.range(100).select(F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("run_id"), "id")
    S.write_result(df, str(tmp_path / "out"), buckets=4)
    back = S.read_result(spark, str(tmp_path / "out"), "run_id string, id long").drop("bucket")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_statement_scores(spark):
    want = {
        "if n <= 1:": 0.8, "if not xs:": 0.8, "if len(xs) == 0:": 0.8, "if x == 0:": 0.8, "if i >= len(xs):": 0.7, "if a < b:": 0.6,
        "for x in xs:": 0.6, "while lo < hi:": 0.6, "return x": 0.65, "raise ValueError()": 0.6, "break": 0.55, "continue": 0.45,
        "x += 1": 0.35, "x = 1": 0.15, "foo(x)": 0.15, "print(x)": 0.0, "# note": 0.0, "": 0.0, "x = yield y": 0.45,
    }
    lines = spark.createDataFrame([(k,) for k in want], "code string")
    assert {r.code: r.structural for r in L.structural_scores(lines).collect()} == want


def test_unreadable_configurations_give_error_rows(spark):
    from causeway.sources import corpus

    docs = [("a.json", '{"a": {"b": 1, "c": [1, true]}, "d": null}'), ("b.json", "{"), ("c.json", None), ("d.json", '{"x":' * 200_000), ("e.json", '{"s": "\\ud800"}'), ("f.json", "[1]"), ("g.json", "{}")]
    rows = corpus.flatten_config(spark.createDataFrame(docs, "file string, text string")).collect()
    assert sorted((r.file, r.path, r.value) for r in rows if r.error is None) == [("a.json", "a.b", "1"), ("a.json", "a.c", "[1, True]"), ("a.json", "d", "None"), ("e.json", "s", "?")]
    assert {r.file for r in rows if r.error is not None and r.path is None and r.value is None} == {"b.json", "c.json", "d.json"}
