"""Statistics and groupings that users bring themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped_statistic(df: DataFrame, by: list[str], value: str, statistic: Callable, unit: str = "unit_id", size: int = 5000, seed: int = 20260722) -> DataFrame:
    """Any statistic of a pandas Series, per group, on a sample of at most `size` rows of it: the first by hash of the unit, all of them in smaller groups.

    The slow way, for statistics that no pair of sum expressions gives: a group's sample meets one task, whatever the group's size.
    """
    from tandem.operators.sampling import ranked_in

    def one(pdf):
        return pdf[by].head(1).assign(statistic=statistic(pdf[value]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    sample = ranked_in(df.select(*by, unit, value), by, unit, seed).where(F.col("rank") <= size)
    return sample.select(*by, value).groupBy(*by).applyInPandas(one, f"{schema}, statistic double")


def group_membership(df: DataFrame, column: str, name: str = "group", separator: str = "|") -> DataFrame:
    """One row per group that 'a|b|c' names."""
    import re

    return df.withColumn(name, F.explode(F.split(column, re.escape(separator)))).where(F.col(name) != "")
