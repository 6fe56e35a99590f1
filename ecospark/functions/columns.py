"""Scalar building blocks.

The engine has a single missing value, NULL: divisions go through ``try_divide`` and
logarithms are guarded, so NaN and infinities never enter a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col(f"`{name}`")


def rounded(col, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0, so that equal results print equally."""
    return F.round(col, digits) + F.lit(0.0)


def safe_ln(col: Column) -> Column:
    """Natural log of a positive value, NULL otherwise."""
    return F.when(col > 0, F.ln(col))


def positive(col: Column) -> Column:
    """Above zero; NaN, which Spark orders above every number, is not."""
    return (col > 0) & ~F.isnan(col)


def ratio(num, den) -> Column:
    """Quotient, NULL on a zero or missing denominator."""
    return F.try_divide(num, den)


def percent(num, den) -> Column:
    return F.lit(100.0) * F.try_divide(num, den)


def biovolume(density, cell_volume) -> Column:
    """Biovolume in um3 per mL from cell density and cell volume."""
    return density * cell_volume / F.lit(1e6)


def decimal_comma(col) -> Column:
    """Text with a decimal comma as a double; unreadable text becomes NULL."""
    return F.regexp_replace(col, ",", ".").try_cast("double")


def paste_key(*cols, sep: str = "_") -> Column:
    """Composite text key; a missing part is spelled NA instead of being skipped."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def recode(col: Column, mapping: Mapping[str, str]) -> Column:
    """Replace the listed values and keep every other one."""
    out = col
    for old, new in mapping.items():
        out = F.when(col == old, F.lit(new)).otherwise(out)
    return out


def row_sum(cols: Sequence[str]) -> Column:
    """Sum across columns, missing cells skipped; 0 when all are missing."""
    return reduce(add, [F.coalesce(q(c), F.lit(0.0)) for c in cols])


def row_mean(cols: Sequence[str]) -> Column:
    """Mean across columns, missing cells skipped; NULL when all are missing."""
    present = reduce(add, [q(c).isNotNull().cast("int") for c in cols])
    return F.try_divide(row_sum(cols), present)


def row_count_positive(cols: Sequence[str]) -> Column:
    """Number of columns holding a positive value."""
    return reduce(add, [F.coalesce((q(c) > 0).cast("long"), F.lit(0)) for c in cols])


def floor_bin(col, width: float) -> Column:
    """Fixed-step bin number starting at 1; a value of 100 with width 10 is in bin 11."""
    return (F.floor(col / F.lit(float(width))) + 1).cast("int")


def day_of_year(col) -> Column:
    return F.dayofyear(F.to_date(col))


def hash_fraction(key: Column, seed: int) -> Column:
    """Uniform number in [0, 1) that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
