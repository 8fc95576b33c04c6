"""Column expressions over lines of source code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_branch(code: Column) -> Column:
    return F.ltrim(code).rlike(r"^(if |elif |else:)")


def is_loop_header(code: Column) -> Column:
    return F.ltrim(code).rlike(r"^(for |while )")


def is_return(code: Column) -> Column:
    return F.ltrim(code).rlike(r"^return")


def right_hand_side(code: Column) -> Column:
    """The text after the first ``=``, or the whole line without one."""
    return F.when(code.contains("="), F.regexp_extract(code, r"^[^=]*=([\s\S]*)$", 1)).otherwise(code)


def words(text: Column) -> Column:
    """Distinct identifiers named in the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1))


def mentions(text: Column, name: Column) -> Column:
    """Whether ``name`` occurs in ``text`` as a whole word."""
    return F.array_contains(words(text), name)
