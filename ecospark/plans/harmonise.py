"""One schema for the site tables of all surveys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q, row_mean
from ..operators.clean import add_literals
from ..vocabulary import HARMONISE_MEANS, HARMONISE_RENAMES, HARMONISE_UNITS, HARMONISED, UNMEASURED


def harmonise(df: DataFrame, kind: str, placeholder: float | None = None) -> DataFrame:
    """Rename, convert and order the columns of one survey's site table.

    Quantities the survey does not measure are missing, or ``placeholder`` if given. pH and
    oxygen are the means of their own surface and bottom columns.
    """
    out = df.withColumns({new: q(old) * F.lit(factor) for old, factor, new in HARMONISE_UNITS[kind]})
    if kind == "long":
        out = out.withColumns({
            new: row_mean(cols) for new, cols in HARMONISE_MEANS.items() if all(c in df.columns for c in cols)
        })
    renames = {a: b for a, b in HARMONISE_RENAMES[kind].items() if b not in out.columns}
    out = add_literals(out.withColumnsRenamed(renames), UNMEASURED.get(kind, ()), placeholder)
    return out.select(*[
        q(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in HARMONISED[kind]
    ])


def harmonised_union(tables: Mapping[str, DataFrame], placeholder: float | None = None) -> DataFrame:
    """All surveys in one table, a column naming the survey; absent columns are missing."""
    parts = [harmonise(df, kind, placeholder).withColumn("dataset", F.lit(kind)) for kind, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
