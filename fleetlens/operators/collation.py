"""Grouping and joining by keys that are compared under a collation.

Every operator that compares texts takes ``collation``, a collation of Spark's by name, such as
``functions.cells.CASE_BLIND``; None compares byte by byte. It holds for that call alone, whatever
the session says. Results are ordinary texts: a key is shown as it is spelled in the rows, and one
that stands for several spellings as the smallest of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.cells import under
from fleetlens.operators.skew import join_checked


def group_under(df: DataFrame, keys: list[str], collation: str | None, *sums: Column) -> DataFrame:
    """``df`` grouped by ``keys``, each shown as its smallest spelling."""
    if collation is None:
        return df.groupBy(*keys).agg(*sums)
    named = {f"_of_{k}": under(k, collation) for k in keys}
    spelled = [F.min(k).alias(k) for k in keys]
    return df.withColumns(named).groupBy(*named).agg(*spelled, *sums).drop(*named)


def join_under(
    fact: DataFrame, dim: DataFrame, on: list[str], how: str, collation: str | None, spread_by: list[str]
) -> DataFrame:
    """``join_checked`` under a collation, in which ``dim`` must be unique; keys are spelled as in ``fact``."""
    if collation is None:
        return join_checked(fact, dim, on, how, spread_by)
    keys = [f"_of_{k}" for k in on]
    facts = fact.withColumns({f"_of_{k}": under(k, collation) for k in on})
    dims = dim.withColumns({f"_of_{k}": under(k, collation) for k in on}).drop(*on)
    return join_checked(facts, dims, keys, how, spread_by).drop(*keys)
