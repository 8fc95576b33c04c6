"""Column expressions over values held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column | str) -> Column:
    """The value as a double, or null when it is not a number (``1d`` is not)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~c.rlike(r"[0-9.][dDfF]\s*$"), c.try_cast("double"))


def repr_size(c: Column) -> Column:
    """Entries of a container shown as text, by top-level commas.

    Text inside nested brackets is removed innermost first; values are never
    evaluated.
    """
    inner = F.regexp_replace(F.trim(c), r"^.|.$", "")
    for _ in range(4):
        inner = F.regexp_replace(inner, r"[\[({][^\[\](){}]*[\])}]", "x")
    return F.when(F.trim(inner) == "", F.lit(0)).otherwise(F.regexp_count(inner, F.lit(",")) + 1)


def round3(c: Column) -> Column:
    return F.round(c, 3)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def joined(c: Column | str, sep: str = ",") -> Column:
    """A set of strings as one sorted text, for reports."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat_ws(sep, F.array_sort(c))
