"""Joins and key alignment.

Plain joins carry no broadcast hint: Spark broadcasts a side whose size it knows to be
below its threshold and otherwise sort-merges, splitting hot keys at run time. A hint is
given only to tables whose row count is bounded by construction or checked first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def attach(df: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join on one key or several."""
    return df.join(dim, [on] if isinstance(on, str) else list(on), "left")


def attach_all(tables: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Left joins folded over a list of tables, the first one leading."""
    return reduce(lambda left, right: attach(left, right, on), tables)


def outer_merge(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, [on] if isinstance(on, str) else list(on), "full_outer")


def keep_sites(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the other table."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(other.select(*keys), keys, "left_semi")


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys present in both tables."""
    return left.select(key).intersect(right.select(key))


def bind_by_key(features: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Features and target side by side, paired by key and not by position."""
    return features.join(target, key, "inner")


def join_nullsafe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join in which a missing key matches a missing key; the keys are kept once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def single_row(df: DataFrame) -> Column:
    """A one-row aggregate as a struct column, evaluated once as a scalar subquery."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns])).scalar()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint, given only when a row count proves the table small.

    Meant for materialised tables, where counting reads file footers only.
    """
    return F.broadcast(df) if df.count() <= max_rows else df
