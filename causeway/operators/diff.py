"""What changed between two runs, for a table of pairs ``(run_a, run_b)``.

Every comparison gives rows ``run_a, run_b, category, severity, item, a, b``;
``a`` and ``b`` are the two sides as text. Measures are reduced per run before
pairs are joined, and element sets are compared by full outer joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAIR = ["run_a", "run_b"]
_COLS = [*_PAIR, "category", "severity", "item", "a", "b"]


def _items(df: DataFrame, category: str, severity: Column | str, item: Column, a: Column, b: Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(*_PAIR, F.lit(category).alias("category"), sev.alias("severity"), item.alias("item"),
                     a.cast("string").alias("a"), b.cast("string").alias("b"))


def _side(df: DataFrame, pairs: DataFrame, run: str) -> DataFrame:
    return pairs.join(df.withColumnRenamed("run_id", run), run)


def _measures(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides' measures (columns beside ``run_id``) as structs ``x`` and ``y``; zero where absent."""
    cols = [c for c in df.columns if c != "run_id"]
    s = df.select("run_id", F.struct(*cols).alias("s"))
    return pairs.join(s.select(F.col("run_id").alias("run_a"), F.col("s").alias("x")), "run_a", "left").join(
        s.select(F.col("run_id").alias("run_b"), F.col("s").alias("y")), "run_b", "left")


def matched(df: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the two runs side by side: keys plus ``in_a`` and ``in_b`` row structs."""
    rest = [c for c in df.columns if c not in ("run_id", *keys)]
    row = F.struct(F.lit(True).alias("here"), *rest)
    a = _side(df.select("run_id", *keys, row.alias("in_a")), pairs, "run_a")
    b = _side(df.select("run_id", *keys, row.alias("in_b")), pairs, "run_b")
    return a.join(b, [*_PAIR, *keys], "full")


def topology(steps: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Steps that appeared or disappeared, and the change in the number of edges."""
    m = matched(steps.select("run_id", "step"), pairs, ["step"])
    g = m.groupBy(*_PAIR).agg(
        F.count("in_a").alias("na"), F.count("in_b").alias("nb"),
        F.count_if(F.col("in_a").isNull()).alias("added"), F.count_if(F.col("in_b").isNull()).alias("removed"))
    out = None
    for name in ("added", "removed"):
        part = _items(g.filter(F.col(name) > 0), "topology", F.when(F.col(name) < 5, "info").otherwise("warning"),
                      F.concat(F.lit(f"steps_{name}:"), F.col(name).cast("string")), F.col("na"), F.col("nb"))
        out = part if out is None else out.unionByName(part)
    n = _measures(edges.groupBy("run_id").agg(F.count("*").alias("edges")), pairs)
    a, b = F.coalesce("x.edges", F.lit(0)), F.coalesce("y.edges", F.lit(0))
    big = F.abs(b - a) > a * 0.3
    severity = F.when(big & (b > a), "regression").when(big, "improvement").otherwise("info")
    return out.unionByName(_items(n.filter(a != b), "topology", severity, F.lit("edges"), a, b))


def dependencies(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Data edges gained and lost per variable, and edges that turned round."""
    data = edges.filter("kind = 'data'").select("run_id", "src", "dst", "var").distinct()
    m = matched(data, pairs, ["src", "dst", "var"])
    moved = m.filter("in_a IS NULL OR in_b IS NULL").withColumn("gained", F.col("in_a").isNull())
    g = moved.groupBy(*_PAIR, "var", "gained").agg(F.count("*").alias("n"))
    per_var = _items(g, "dependency", F.when(F.col("gained"), "warning").otherwise("regression"),
                     F.concat_ws(":", F.when(F.col("gained"), "gained").otherwise("lost"), "var"),
                     F.when(~F.col("gained"), F.col("n")), F.when(F.col("gained"), F.col("n")))
    lost = moved.filter("NOT gained").select(*_PAIR, "src", "dst", "var")
    gained = moved.filter("gained").select(*_PAIR, F.col("src").alias("dst"), F.col("dst").alias("src"), "var")
    turned = lost.join(gained, [*_PAIR, "src", "dst", "var"], "left_semi").groupBy(*_PAIR).agg(F.count("*").alias("n"))
    return per_var.unionByName(_items(turned, "dependency", "regression", F.lit("reversed"), F.col("n"), F.lit(None)))


def variables(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Variables that appeared or vanished, their version counts and final values."""
    v = versions.groupBy("run_id", "var").agg(
        F.max("version").alias("top"), F.max_by("value", "step").alias("final"))
    m = matched(v, pairs, ["var"])
    a, b = "in_a", "in_b"
    appeared = _items(m.filter("in_a IS NULL"), "variable", "info", F.concat(F.lit("appeared:"), "var"), F.lit(None), F.lit(None))
    vanished = _items(m.filter("in_b IS NULL"), "variable", "warning", F.concat(F.lit("vanished:"), "var"), F.lit(None), F.lit(None))
    both = m.filter("in_a IS NOT NULL AND in_b IS NOT NULL")
    ta, tb = F.col(f"{a}.top"), F.col(f"{b}.top")
    counts = _items(both.filter(ta != tb), "variable", F.when(tb > ta * 1.5, "warning").otherwise("info"),
                    F.concat(F.lit("versions:"), "var"), ta, tb)
    fa, fb = F.col(f"{a}.final"), F.col(f"{b}.final")
    finals = _items(both.filter(~fa.eqNullSafe(fb)), "variable", "regression", F.concat(F.lit("final:"), "var"), fa, fb)
    return appeared.unionByName(vanished).unionByName(counts).unionByName(finals)


def root_causes(steps: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Steps without incoming data that are new or gone."""
    into = edges.filter("kind = 'data'").select("run_id", F.col("dst").alias("step"))
    roots = steps.select("run_id", "step").join(into, ["run_id", "step"], "left_anti")
    g = matched(roots, pairs, ["step"]).groupBy(*_PAIR).agg(
        F.count_if(F.col("in_a").isNull()).alias("added"), F.count_if(F.col("in_b").isNull()).alias("removed"))
    return _items(g.filter("added > 0"), "root_cause", "warning", F.lit("gained"), F.lit(None), F.col("added")).unionByName(
        _items(g.filter("removed > 0"), "root_cause", "info", F.lit("lost"), F.col("removed"), F.lit(None)))


def facts(facts_: DataFrame, pairs: DataFrame) -> DataFrame:
    """Change in facts per kind, and descriptions that are new or lost."""
    whole = facts_.filter("part = 0")
    m = matched(whole.groupBy("run_id", "kind").agg(F.count("*").alias("n")), pairs, ["kind"])
    a, b = F.coalesce("in_a.n", F.lit(0)), F.coalesce("in_b.n", F.lit(0))
    severity = (
        F.when(F.col("kind").startswith("causal.") & (b < a), "improvement")
        .when(F.col("kind").startswith("variable.mutation") & (b - a > a * 0.5), "warning").otherwise("info")
    )
    counts = _items(m.filter(a != b), "fact", severity, F.col("kind"), a, b)
    said = whole.select("run_id", "description").distinct()
    g = matched(said, pairs, ["description"]).groupBy(*_PAIR).agg(
        F.count_if(F.col("in_b").isNull()).alias("lost"), F.count_if(F.col("in_a").isNull()).alias("new")
    ).filter("lost > 0 OR new > 0")
    return counts.unionByName(_items(g, "fact", "info", F.lit("descriptions"), F.col("lost"), F.col("new")))


_METRICS = ["nodes", "edges", "max_fan_in", "max_fan_out", "depth", "data_density"]


def complexity_metrics(steps: DataFrame, edges: DataFrame) -> DataFrame:
    def peak(end, name):
        per_step = edges.groupBy("run_id", end).agg(F.count("*").alias("n"))
        return per_step.groupBy("run_id").agg(F.max("n").alias(name))

    n = steps.groupBy("run_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))
    e = edges.groupBy("run_id").agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "data").alias("_data"))
    m = n.join(e, "run_id", "left").join(peak("dst", "max_fan_in"), "run_id", "left").join(
        peak("src", "max_fan_out"), "run_id", "left").na.fill(0)
    return m.withColumn("data_density", F.round(F.col("_data") / F.col("nodes"), 2)).select(
        "run_id", *[F.col(c).cast("double").alias(c) for c in _METRICS])


def complexity(steps: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Size, fan, depth and density of the two runs, where they differ."""
    m = _measures(complexity_metrics(steps, edges), pairs).filter("x IS NOT NULL AND y IS NOT NULL")
    rows = m.select(*_PAIR, F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"x.{c}").alias("va"), F.col(f"y.{c}").alias("vb")) for c in _METRICS])))
    delta = F.col("vb") - F.col("va")
    severity = (
        F.when((F.col("metric") == "max_fan_in") & (delta > 3), "regression").when((F.col("metric") == "depth") & (delta > 2), "regression")
        .when((F.col("metric") == "data_density") & (delta > 0.5), "warning").otherwise("info")
    )
    return _items(rows.filter("va <> vb"), "complexity", severity, F.col("metric"), F.col("va"), F.col("vb"))


def narrative(explanations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Drift of explanations: target text, number of units and sequence of roles."""
    g = explanations.groupBy("run_id").agg(
        F.count("*").alias("units"), F.min_by("text", "position").alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "role"))), lambda r: r["role"]), ">").alias("roles"))
    m = _measures(g, pairs).filter("x IS NOT NULL AND y IS NOT NULL")
    out = None
    for c in ("title", "units", "roles"):
        a, b = F.col(f"x.{c}"), F.col(f"y.{c}")
        part = _items(m.filter(~a.eqNullSafe(b)), "narrative", "info", F.lit(c), a, b)
        out = part if out is None else out.unionByName(part)
    return out


def compare_runs(steps, edges, versions, facts_, pairs) -> DataFrame:
    """The whole report of every pair."""
    return (
        topology(steps, edges, pairs).unionByName(dependencies(edges, pairs)).unionByName(variables(versions, pairs))
        .unionByName(root_causes(steps, edges, pairs)).unionByName(facts(facts_, pairs)).unionByName(complexity(steps, edges, pairs))
    ).select(*_COLS)


def rollup(report: DataFrame) -> DataFrame:
    """Items of each pair by category and severity, with subtotals."""
    return report.groupBy(*_PAIR, "category", "severity").agg(F.count("*").alias("items")).rollup(
        *_PAIR, "category", "severity").agg(F.sum("items").alias("items")).filter("run_b IS NOT NULL")
