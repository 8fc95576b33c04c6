"""Ordered (window) computations that stay safe when one key is huge.

A plain ``Window.partitionBy(key).orderBy(step)`` sends every row of a key to
one task. Here the order axis is cut into chunks of ``chunk`` steps:

* unbounded frames (``running``): window inside ``(key, chunk)``, plus one
  carried value per chunk found by a window over the per-chunk aggregates;
* bounded frames (``with_halo``): rows near a chunk edge are repeated in the
  neighbouring chunk, so a single shuffle is enough.

Results are the same as with the plain window. ``fitting_chunk`` checks the
longest key: where every key fits in one chunk it answers ``None`` and the
operators use the plain window, which then holds at most ``CHUNK`` steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.session import checkpointed

CHUNK = 1 << 15


def chunk_of(step: str, chunk: int = CHUNK) -> Column:
    return F.floor(F.col(step) / F.lit(chunk)).cast("long")


def fitting_chunk(df: DataFrame, step: str = "step", chunk: int = CHUNK) -> int | None:
    """``None`` when no key reaches beyond one chunk of steps, else ``chunk``."""
    longest = df.agg(F.max(step)).first()[0]
    return None if longest is None or longest < chunk else chunk


def read_twice(df: DataFrame) -> DataFrame:
    """``df`` ready to be read by two branches of a plan.

    A plan that already shuffles is written once, so that chained operators do
    not repeat it per branch; a plain scan is cheaper to read again.
    """
    text = df._jdf.queryExecution().optimizedPlan().toString()
    heavy = any(op in text for op in ("Join", "Window", "Aggregate", "Sort"))
    return checkpointed(df) if heavy else df


def running(
    df: DataFrame,
    keys: Sequence[str],
    step: str,
    aggs: dict[str, tuple],
    *,
    order: Sequence[str] = (),
    reverse: bool = False,
    bucket: Column | None = None,
    chunk: int | None = CHUNK,
) -> DataFrame:
    """Add running aggregates per ``keys`` in ``step`` order.

    ``aggs`` maps a new column to ``(kind, value)`` or ``(kind, value,
    inclusive)``; kinds are ``last`` (last non-null), ``sum``, ``max`` and
    ``min``; ``inclusive`` says whether the current row counts (default: it
    does not). ``order`` breaks ties inside a step, ``reverse`` looks at the
    rows after the current one. ``bucket`` replaces the step chunk by any
    expression that grows with ``step``. ``chunk`` ``None`` says that every key
    fits in one chunk (see ``fitting_chunk``).
    """
    if chunk is None and bucket is None:
        return _plain(df, keys, step, aggs, order, reverse)
    df = read_twice(df)
    part = [*keys, "_chunk"]
    base = df.withColumn("_chunk", bucket if bucket is not None else chunk_of(step, chunk))
    for name, spec in aggs.items():
        base = base.withColumn(f"_v_{name}", spec[1])

    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    ordering = [direction(c) for c in (step, *order)]
    ordinal = F.struct(step, *order) if order else F.col(step)
    pick = F.min_by if reverse else F.max_by
    across = Window.partitionBy(*keys).orderBy(direction("_chunk")).rowsBetween(Window.unboundedPreceding, -1)

    local, per_chunk, carried, merged = [], [], [], []
    for name, spec in aggs.items():
        kind, inclusive = spec[0], len(spec) > 2 and spec[2]
        value = F.col(f"_v_{name}")
        inside = (
            Window.partitionBy(*part).orderBy(*ordering)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        )
        loc, car = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "last":
            local.append(F.last(value, ignorenulls=True).over(inside).alias(f"_l_{name}"))
            per_chunk.append(pick(value, F.when(value.isNotNull(), ordinal)).alias(f"_g_{name}"))
            carried.append(F.last(f"_g_{name}", ignorenulls=True).over(across).alias(f"_c_{name}"))
            merged.append(F.coalesce(loc, car).alias(name))
            continue
        fn = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
        local.append(fn(value).over(inside).alias(f"_l_{name}"))
        per_chunk.append(fn(value).alias(f"_g_{name}"))
        carried.append(fn(f"_g_{name}").over(across).alias(f"_c_{name}"))
        if kind == "sum":
            merged.append((F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))).alias(name))
        else:
            merged.append((F.greatest if kind == "max" else F.least)(loc, car).alias(name))

    windowed = base.select(*df.columns, "_chunk", *local)
    carry = (
        base.groupBy(*part).agg(*per_chunk)
        .select(*part, *carried)
        .filter(" OR ".join(f"_c_{n} IS NOT NULL" for n in aggs))
    )
    kept = [c for c in df.columns if c not in aggs]
    return windowed.join(carry, part, "left").select(*kept, *merged)


def _plain(df, keys, step, aggs, order, reverse) -> DataFrame:
    ordering = [F.col(c).desc() if reverse else F.col(c).asc() for c in (step, *order)]
    fns = {"sum": F.sum, "max": F.max, "min": F.min}
    added = []
    for name, spec in aggs.items():
        kind, inclusive = spec[0], len(spec) > 2 and spec[2]
        frame = (
            Window.partitionBy(*keys).orderBy(*ordering)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        )
        out = F.last(spec[1], ignorenulls=True).over(frame) if kind == "last" else fns[kind](spec[1]).over(frame)
        added.append((F.coalesce(out, F.lit(0)) if kind == "sum" else out).alias(name))
    return df.select(*[c for c in df.columns if c not in aggs], *added)


def previous_row(df, keys, step, cols: dict[str, Column], **kw) -> DataFrame:
    """Values of the previous row of the key (the next row when ``reverse``)."""
    packed = F.struct(*[c.alias(n) for n, c in cols.items()])
    out = running(df, keys, step, {"_prev": ("last", packed)}, **kw)
    return out.select(
        *[c for c in df.columns if c not in cols],
        *[F.col(f"_prev.{n}").alias(n) for n in cols],
    )


def dense_index(df, keys, step, name: str = "idx", **kw) -> DataFrame:
    """0-based position of each row in its key (``row_number`` minus one)."""
    out = running(df, keys, step, {name: ("sum", F.lit(1).cast("long"), True)}, **kw)
    return out.withColumn(name, F.col(name) - 1)


def with_halo(
    df: DataFrame, step: str, before: int = 0, after: int = 0, chunk: int | None = CHUNK
) -> DataFrame:
    """Repeat rows next to chunk edges so bounded frames fit inside a chunk.

    ``step`` must be dense per key. The result has ``_chunk`` to partition
    windows by and ``_halo``, true on repeated rows: filter those out after
    the window has been computed.
    """
    if chunk is None:
        return df.withColumn("_chunk", F.lit(0).cast("long")).withColumn("_halo", F.lit(False))
    home = chunk_of(step, chunk)
    offset = F.col(step) - home * chunk
    reach = max(before, after)
    if reach >= chunk:
        raise ValueError("the frame must be shorter than a chunk")
    copies = F.array_compact(F.array(
        home,
        F.when(offset >= chunk - before, home + 1) if before else F.lit(None).cast("long"),
        F.when((offset < after) & (home > 0), home - 1) if after else F.lit(None).cast("long"),
    ))
    return (
        df.withColumn("_chunk", F.explode(copies))
        .withColumn("_halo", F.col("_chunk") != home)
    )
