"""A column that is computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` behind a generator.

    The optimizer moves filters below projections and repeats the expressions the
    filter reads. That is wanted for cheap columns, but not for a parse or a long
    chain of rules; no filter on ``name`` moves below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_all_pinned(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add several such columns at once; columns of the same names are replaced."""
    known = [F.col(c) for c in df.columns if c not in values]
    return df.select(*known, F.inline(F.array(F.struct(*[v.alias(name) for name, v in values.items()]))))
