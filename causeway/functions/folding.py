"""Sequential folds over long runs in bounded pieces.

Some rules depend on everything that came before in an order no window can
express (a stack of open blocks, non-overlapping matches). ``fold_runs`` hands
a run to a Python function one chunk of steps at a time and carries a small
text state between chunks, so no task ever holds more than one chunk of a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.ordered import CHUNK, chunk_of
from causeway.session import checkpointed


def fold_runs(
    df: DataFrame,
    keys: list[str],
    step: str,
    fn: Callable[[pd.DataFrame, str], tuple[pd.DataFrame, str]],
    schema: str,
    chunk: int | None = CHUNK,
    keep_state: bool = False,
) -> DataFrame:
    """Apply ``fn(rows, state) -> (rows, state)`` along each key in step order.

    Chunks are taken in rounds, all keys together; as many rounds run as the
    longest key has chunks. ``schema`` describes the rows ``fn`` returns.
    ``keep_state`` is for rows that are not dense: the state of a key then
    outlives chunks in which it has no rows.
    """
    last_chunk = 0 if chunk is None else df.agg(F.max(chunk_of(step, chunk)).alias("m")).first()["m"] or 0

    def run_one(pdf: pd.DataFrame) -> pd.DataFrame:
        state = pdf["_state"].iloc[0]
        state = state if isinstance(state, str) else ""
        rows, state = fn(pdf.drop(columns=["_state"]).sort_values(step, ignore_index=True), state)
        # the state rides on one marker row that holds nothing else but the key
        marker = pd.DataFrame({c: pd.Series([None], dtype=object) for c in out_cols})
        for k in keys:
            marker.at[0, k] = pdf[k].iloc[0]
        marker.at[0, "_state"] = state
        return pd.concat([rows.astype(object).assign(_state=None), marker], ignore_index=True)[out_cols]

    fields = [part.split()[0] for part in _split(schema)]
    out_cols = [*fields, "_state"]
    out_schema = schema + ", _state string"
    pieces: list[DataFrame] = []
    state = None
    for c in range(int(last_chunk) + 1):
        part = df.filter(chunk_of(step, chunk) == c) if last_chunk else df
        part = part.withColumn("_state", F.lit(None).cast("string")) if state is None else part.join(state, keys, "left")
        done = part.groupBy(*keys).applyInPandas(run_one, out_schema)
        if last_chunk:
            done = checkpointed(done)
            fresh = done.filter("_state IS NOT NULL").select(*keys, "_state")
            if state is not None and keep_state:
                fresh = fresh.unionByName(state.join(fresh.select(*keys), keys, "left_anti"))
                fresh = checkpointed(fresh)
            state = fresh
        pieces.append(done.filter("_state IS NULL").drop("_state"))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


def settle_keys(df: DataFrame, keys: list[str], reads: list[str], settle: Callable[..., list[tuple[int, Any]]], gives: str) -> DataFrame:
    """Rows of each key that ``settle(*reads)`` names, with its value in column ``gives``.

    For keys that fit in memory one by one, such as runs of one chunk. Rows are
    shuffled and sorted by key and read in batches that hold many keys, so that
    small keys cost no table of their own.
    """
    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            starts = _starts(rows, keys)
            yield settled(rows, starts)
            held = rows.slice(starts[-1]) if starts else None
        if held is not None:
            yield settled(held, [0, held.num_rows])

    def settled(rows: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
        columns = [rows.column(c).to_pylist() for c in reads]
        picked, values = [], []
        for a, b in zip(starts, starts[1:]):
            for i, value in settle(*[c[a:b] for c in columns]):
                picked.append(a + i)
                values.append(value)
        out = rows.take(pa.array(picked, pa.int64()))
        at = out.schema.get_field_index(gives)
        return out.set_column(at, out.schema.field(at), pa.array(values, out.schema.field(at).type))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(along, df.schema)


def _starts(rows: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Where each key begins in sorted rows."""
    if not rows.num_rows:
        return []
    now = [rows.column(k).to_pylist() for k in keys]
    at = list(zip(*now))
    return [0, *[i for i in range(1, len(at)) if at[i] != at[i - 1]]]


def _split(schema: str) -> list[str]:
    parts, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*parts, cur.strip()]
