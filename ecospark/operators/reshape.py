"""Long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q


def to_wide(
    df: DataFrame, site: str, taxon: str, value: str, taxa: Sequence, fill: float = 0.0
) -> DataFrame:
    """One row per site and one column per listed taxon, absent cells filled."""
    wide = df.groupBy(site).pivot(taxon, list(taxa)).agg(F.sum(q(value)))
    return wide.fillna(fill, subset=[str(t) for t in taxa])


def pivot_mean(
    df: DataFrame, ids: Sequence[str], name: str, value: str, names: Sequence[str]
) -> DataFrame:
    """One column per listed name holding the mean of its duplicates.

    A missing value makes its mean missing; an absent cell is missing.
    """
    cell = F.when(F.count(q(value)) == F.count(F.lit(1)), F.avg(q(value)))
    return df.groupBy(*ids).pivot(name, list(names)).agg(cell)


def to_long(
    df: DataFrame, ids: Sequence[str], name: str = "taxon", value: str = "value",
    cols: Sequence[str] | None = None,
) -> DataFrame:
    """One row per id and remaining column."""
    cols = list(cols or [c for c in df.columns if c not in ids])
    return df.unpivot([q(i) for i in ids], [q(c) for c in cols], name, value)
