"""Selecting, renaming, repairing and profiling tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import decimal_comma, numeric_columns, q, ratio
from ..sources.tables import checkpointed
from ..vocabulary import AUTOTROPH, MIXOTROPH
from .joins import attach, join_nullsafe, single_row
from .order import bucket_number, exact_quantiles, with_buckets


def select_cols(
    df: DataFrame, keep: Sequence[str] | None = None, drop: Iterable[str] = (), first: Sequence[str] = ()
) -> DataFrame:
    """Keep, drop and move columns to the front in one projection."""
    drop = set(drop)
    names = [c for c in (keep or df.columns) if c not in drop]
    return df.select(*[q(c) for c in [*first, *(c for c in names if c not in first)]])


def select_pos(df: DataFrame, positions: Sequence[int], drop: bool = False) -> DataFrame:
    """Keep (or drop) columns by 1-based position."""
    picked = set(positions)
    if drop:
        return df.select(*[q(c) for i, c in enumerate(df.columns, 1) if i not in picked])
    return df.select(*[q(df.columns[i - 1]) for i in positions])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def add_literals(df: DataFrame, names: Iterable[str], value: float | None = None) -> DataFrame:
    """Placeholder columns for quantities a survey did not measure."""
    return df.withColumns({n: F.lit(value).cast("double") for n in names})


def convert_units(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: q(c) * F.lit(float(f)) for c, f in factors.items()})


def fill_null(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(q(c)), q(c)) for c in floating})


def to_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: decimal_comma(q(c)) for c in cols})


def merge_synonyms(
    df: DataFrame,
    site: str,
    taxon: str,
    value: str,
    pattern: str = r"\.\d+$",
    synonyms: Mapping[str, str] | None = None,
    skip_null: bool = False,
) -> DataFrame:
    """Add up the columns of one taxon, on the long form.

    The suffix ``pattern`` is cut from the taxon name and synonyms are replaced. One
    missing part makes the sum missing unless ``skip_null``.
    """
    name = F.regexp_replace(taxon, pattern, "")
    for old, new in (synonyms or {}).items():
        name = F.when(F.col(taxon) == old, F.lit(new)).otherwise(name)
    total = F.sum(q(value))
    if not skip_null:
        total = F.when(F.count(q(value)) == F.count("*"), total)
    return df.groupBy(F.col(site), name.alias(taxon)).agg(total.alias(value))


def merge_synonym_columns(
    df: DataFrame, key: str, pattern: str = r"\.\d+$", synonyms: Mapping[str, str] | None = None
) -> DataFrame:
    """``merge_synonyms`` on the columns of an abundance matrix: sums within a row, no shuffle."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        if c != key:
            groups.setdefault((synonyms or {}).get(c, re.sub(pattern, "", c)), []).append(c)
    sums = [reduce(add, [q(c) for c in parts]).alias(name) for name, parts in groups.items()]
    return df.select(q(key), *sums)


def trait_set(traits: DataFrame, taxon: str = "Genus", label: str = MIXOTROPH) -> DataFrame:
    """Distinct taxa that carry a trait; a missing taxon is never a member."""
    return traits.where((F.col("strat") == label) & F.col(taxon).isNotNull()).select(taxon).distinct()


def tag_trait(
    df: DataFrame, members: DataFrame, taxon: str, unmatched: str = AUTOTROPH, label: str = MIXOTROPH, name: str = "strat"
) -> DataFrame:
    """Label each row by membership of its taxon; every other taxon gets ``unmatched``.

    ``attach_trait`` is for surveys in which a taxon without a recorded trait is left out.
    """
    flags = members.select(F.col(members.columns[0]).alias(taxon)).distinct().withColumn("_in", F.lit(True))
    return attach(df, flags, taxon).withColumn(
        name, F.when(F.col("_in"), F.lit(label)).otherwise(F.lit(unmatched))
    ).drop("_in")


def attach_trait(df: DataFrame, traits: DataFrame, taxon: str) -> DataFrame:
    """Rows whose taxon has a recorded trait, with that trait and the other trait columns."""
    return attach(df, traits, taxon).where(F.col("strat").isNotNull())


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which every listed metric is present and not NaN."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    present = [q(c).isNotNull() & ~F.isnan(q(c)) if c in floating else q(c).isNotNull() for c in cols]
    return df.where(reduce(and_, present))


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def complete_cases(features: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Features and target of the rows whose features are all present."""
    return features.dropna("any").join(target, key, "inner")


def exclude_value(df: DataFrame, col: str, value) -> DataFrame:
    """Drop rows equal to a value; missing values stay."""
    return df.where(~q(col).eqNullSafe(F.lit(value)))


def filter_stratum(df: DataFrame, col: str, stratum: str | None) -> DataFrame:
    """Rows of one stratum, or all rows when none is asked for."""
    return df if stratum is None else df.where(q(col) == stratum)


def drop_by_dataset(df: DataFrame, kind: str, drops: Mapping[str, Sequence[str]]) -> DataFrame:
    """Leave out the predictors listed for a survey kind."""
    return select_cols(df, drop=drops.get(kind, ()))


def disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows in which two present classifications differ."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))


def above(df: DataFrame, col: str, threshold: float) -> DataFrame:
    return df.where(q(col) > threshold)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a given order.

    An aggregate instead of a window: every task reduces its rows before the shuffle, so a
    key that fills the table costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(c) for c in order], *[q(c) for c in rest if c not in order])
    picked = F.min_by(F.struct(*[q(c) for c in rest]), ordering)
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, "_row.*").select(
        *[q(c) for c in df.columns]
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Number of missing values per column: ``variable, nulls``."""
    counts = df.agg(*[F.count_if(q(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], [q(c) for c in df.columns], "variable", "nulls")


def row_loss(df: DataFrame, step: str) -> DataFrame:
    """Row counts before and after dropping incomplete rows, in one pass."""
    whole = F.lit(True)
    for c in df.columns:
        whole = whole & q(c).isNotNull()
    return df.agg(F.count("*").alias("rows_before"), F.count_if(whole).alias("rows_after")).select(
        F.lit(step).alias("step"), "rows_before", "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_lost"),
    )


def column_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count of each numeric column."""
    cols = list(cols or numeric_columns(df))
    means = df.agg(*[
        F.struct(F.avg(q(c)).alias("mean"), F.count_if(q(c).isNull()).alias("nulls")).alias(c) for c in cols
    ]).unpivot([], [q(c) for c in cols], "variable", "_m")
    quantiles = exact_quantiles(df, cols, [0.0, 0.25, 0.5, 0.75, 1.0])
    at = lambda i: F.col("quantiles")[i]
    return means.join(quantiles, "variable", "left").select(
        "variable", at(0).alias("min"), at(1).alias("q1"), at(2).alias("median"),
        F.col("_m.mean").alias("mean"), at(3).alias("q3"), at(4).alias("max"), F.col("_m.nulls").alias("nulls"),
    )


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace missing values by the exact median of their column."""
    medians = exact_quantiles(df, cols, [0.5]).agg(*[
        F.max(F.when(F.col("variable") == c, F.col("quantiles")[0])).alias(c) for c in cols
    ])
    filled = df.withColumn("_median", single_row(medians))
    return filled.withColumns({
        c: F.coalesce(q(c), F.col("_median")[c]) for c in cols
    }).drop("_median")


def interpolate(
    df: DataFrame, x: str, cols: Sequence[str], by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Replace each column by its linear interpolation over ``x``.

    Points with a missing value are left out, values at one ``x`` are averaged, and outside
    the observed range the result is missing. The axis is cut into ``buckets`` of about equal size, by default
    as many as its points call for: neighbours are searched inside a bucket, and the nearest known
    point of the earlier and later buckets comes from a table with one row per bucket.
    """
    by = list(by)
    axis = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(*[F.avg(q(c)).alias(c) for c in cols])
    # Read several times: by the count, the edges, the ends and the points.
    axis = checkpointed(axis.withColumn("_v", q(x).cast("double")))
    binned, _ = with_buckets(axis, ["_v"], buckets or bucket_number(axis.count()))
    axis = binned.withColumnRenamed("_b__v", "_b")
    at = {c: i for i, c in enumerate(cols)}
    point = {c: F.when(q(c).isNotNull(), F.struct(q(x).cast("double").alias("x"), q(c).alias("y"))) for c in cols}
    ends = axis.groupBy(*by, "_b").agg(*[
        e for c in cols for e in (F.min(point[c]).alias(f"_f{at[c]}"), F.max(point[c]).alias(f"_l{at[c]}"))
    ])
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # Backwards, as Spark goes through a frame that ends with the partition anew for every row.
    later = Window.partitionBy(*by).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_b", *[
        e for i in at.values() for e in (
            F.last(f"_l{i}", ignorenulls=True).over(earlier).alias(f"_p{i}"),
            F.last(f"_f{i}", ignorenulls=True).over(later).alias(f"_n{i}"),
        )
    ])
    inside = Window.partitionBy(*by, "_b")
    upto = inside.orderBy(q(x)).rowsBetween(Window.unboundedPreceding, 0)
    onward = inside.orderBy(q(x).desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = join_nullsafe(axis, carried, [*by, "_b"], "left")

    def lerp(c: str) -> Column:
        lo = F.coalesce(F.last(point[c], ignorenulls=True).over(upto), F.col(f"_p{at[c]}"))
        hi = F.coalesce(F.last(point[c], ignorenulls=True).over(onward), F.col(f"_n{at[c]}"))
        step = ratio(F.col(x) - lo["x"], hi["x"] - lo["x"])
        between = lo["y"] + (hi["y"] - lo["y"]) * step
        return F.when(lo["x"] == hi["x"], lo["y"]).otherwise(between)

    # Materialised, so that Spark knows its size when it joins it back to the rows.
    curve = checkpointed(near.select(*by, x, *[lerp(c).alias(c) for c in cols]))
    kept = select_cols(df, drop=cols)
    return join_nullsafe(kept, curve, [*by, x], "left").select(*[q(c) for c in df.columns])
