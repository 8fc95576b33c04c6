"""Questions a user asks of traces, composed from the operators.

Each returns DataFrames; chain them with ``transform``, ``filter`` and
``orderBy`` like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.ordered import CHUNK
from causeway.operators import evidence as E
from causeway.operators import graph as G
from causeway.operators import history as H
from causeway.operators import select as S
from causeway.operators import traverse as T


@dataclass(frozen=True)
class Runs:
    """The tables of a set of runs."""

    steps: DataFrame
    snapshots: DataFrame
    edges: DataFrame
    facts: DataFrame
    diff: DataFrame
    chunk: int | None = CHUNK

    def last_match(self, var: str | None = None, step: int | None = None, pattern: str | None = None) -> DataFrame:
        """The step a question is about: the last one selected in each run."""
        return S.select_nodes(self.steps, step, var, pattern).groupBy("run_id").agg(F.max("step").alias("step"))


def resolved(runs: Runs, rows: DataFrame) -> DataFrame:
    """Rows with the line and code of their step."""
    return rows.join(runs.steps.select("run_id", "step", "line", "code"), ["run_id", "step"])


def why(runs: Runs, var: str | None = None, step: int | None = None) -> DataFrame:
    """Backward slice from the last step that matches."""
    return resolved(runs, T.backward_slice(runs.edges, runs.last_match(var, step)))


def impact(runs: Runs, var: str | None = None, step: int | None = None) -> DataFrame:
    return resolved(runs, T.forward_impact(runs.edges, runs.last_match(var, step)))


def roots(runs: Runs, var: str | None = None, step: int | None = None) -> DataFrame:
    return S.filter_slice(why(runs, var, step), "is_root")


def trace(runs: Runs, var: str) -> DataFrame:
    """History of a variable with versions and code."""
    versions = G.snapshot_versions(runs.steps, H.variable_history(runs.snapshots, var), chunk=runs.chunk)
    return resolved(runs, versions)


def show(runs: Runs, pattern: str = "all", limit: int = 20, where: tuple | None = None) -> DataFrame:
    return S.select_facts(runs.facts, pattern, limit, where)


def compare(runs: Runs, step_a: int, step_b: int, var: str | None = None) -> DataFrame:
    pairs = runs.steps.filter(F.col("step").isin(step_a, step_b)).groupBy("run_id").agg(
        F.countDistinct("step").alias("n")).filter("n = 2").select(
        "run_id", F.lit(step_a).cast("long").alias("step_a"), F.lit(step_b).cast("long").alias("step_b"))
    versions = G.snapshot_versions(runs.steps, runs.snapshots, chunk=runs.chunk)
    return H.compare_steps(versions, pairs, var)


def stats(runs: Runs) -> DataFrame:
    return T.graph_stats(runs.steps, runs.snapshots, runs.edges)


def then(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("run_id",),
         where: tuple | None = None, order_by: str | None = None, desc: bool = False) -> DataFrame:
    """The second answer, filled from the first for runs it says nothing about."""
    filled = second.unionByName(first.join(second.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)
    if where:
        field, op, value = where
        asked = S.fact_field(field) if "metadata" in filled.columns else F.col(field)
        filled = filled.filter(S.compare(asked, op, value))
    return S.sort_rows(filled, order_by, desc) if order_by else filled


def full_analysis(runs: Runs, var: str) -> dict[str, DataFrame]:
    """Slice, impact and trace around one variable."""
    return {"why": why(runs, var), "impact": impact(runs, var), "trace": trace(runs, var)}


def explain_why(runs: Runs, var: str) -> DataFrame:
    """Explanation units of the slice behind a variable."""
    found = T.backward_slice(runs.edges, runs.last_match(var))
    followed = T.slice_edges(runs.edges, found)
    return E.explain(E.slice_evidence(found, followed, runs.steps, runs.facts))


def explain_impact(runs: Runs, var: str) -> DataFrame:
    found = T.forward_impact(runs.edges, runs.last_match(var))
    return E.explain(E.impact_evidence(found, runs.edges, runs.steps, runs.facts))


def explain_variable(runs: Runs, var: str) -> DataFrame:
    """Origin, spans of equal behaviour and final value of a variable in each run."""
    return E.explain_variable(E.variable_evidence(H.variable_history(runs.snapshots, var), chunk=runs.chunk))
