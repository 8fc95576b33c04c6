from causeway.operators import evidence as E


def history(spark, values):
    rows = [("r", "x", i, v, "str" if v is not None and v.isalpha() else "int") for i, v in enumerate(values)]
    return spark.createDataFrame(rows + [("r", "y", 7, "1", "int")], "run_id string, var string, step long, value string, type string")


def spans(df):
    return [(r.behavior, r.first_step, r.last_step, r.steps, r.first_value, r.last_value) for r in df.filter("var = 'x'").orderBy("span").collect()]


def test_spans_turn_where_the_behaviour_does(spark):
    h = history(spark, ["1", "2", "5", "5", "4", "a", "b", "b"])
    want = [("rises", 0, 2, 2, "1", "5"), ("steady", 2, 3, 1, "5", "5"), ("falls", 3, 4, 1, "5", "4"), ("retyped", 4, 5, 1, "4", "a"),
            ("changes", 5, 6, 1, "a", "b"), ("steady", 6, 7, 1, "b", "b")]
    for chunk in (None, 3, 1):
        assert spans(E.variable_spans(h, chunk=chunk)) == want


def test_variable_is_explained_from_origin_to_end(spark):
    said = {(r.var, r.role): (r.items, r.text) for r in E.explain_variable(E.variable_evidence(history(spark, ["1", "2", "1"]), chunk=None)).collect()}
    assert said == {
        ("x", "origin"): (1, "`x` is first seen at step #0 with value `1`"),
        ("x", "evolution"): (2, "rises from `1` to `2` over 1 steps; falls from `2` to `1` over 1 steps"),
        ("x", "final"): (3, "`x` ends at step #2 with value `1`, seen 3 times"),
        ("y", "origin"): (1, "`y` is first seen at step #7 with value `1`"),
        ("y", "final"): (1, "`y` ends at step #7 with value `1`, seen 1 times"),
    }


def test_empty_history(spark):
    empty = spark.createDataFrame([], "run_id string, var string, step long, value string, type string")
    assert E.explain_variable(E.variable_evidence(empty)).count() == 0
