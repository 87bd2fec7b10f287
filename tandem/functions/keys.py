"""Joins on keys of which NULL is a value like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """`left` joined with `right` on `by`, NULL equal to NULL: columns of `left`, then those of `right` but `by`. Without keys both are single rows."""
    named = right.select(*(F.col(b).alias(f"_g_{b}") for b in by), *(c for c in right.columns if c not in by))
    if not by:
        return left.crossJoin(F.broadcast(named))  # single rows
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    joined = left.join(named.hint("merge"), on, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*(f"_g_{b}" for b in by))
