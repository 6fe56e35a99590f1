"""Binned curves, histograms, box statistics, model metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normal
from ..functions.columns import q, ratio
from .joins import attach, single_row
from .order import exact_quantiles, global_rank


def cut(df: DataFrame, col: str, k: int = 20, name: str = "bin") -> DataFrame:
    """Number the k equal-width, right-closed bins over the observed range, from 1."""
    bounds = df.agg(F.min(q(col)).cast("double").alias("lo"), F.max(q(col)).cast("double").alias("hi"))
    out = df.withColumn("_range", single_row(bounds))
    width = (F.col("_range.hi") - F.col("_range.lo")) / F.lit(float(k))
    index = F.greatest(F.ceil(ratio(q(col) - F.col("_range.lo"), width)), F.lit(1))
    index = F.when(q(col).isNotNull(), F.least(F.coalesce(index, F.lit(1)), F.lit(k)))
    return out.withColumn(name, index.cast("int")).withColumns({
        f"{name}_lo": F.col("_range.lo") + width * (F.col(name) - 1),
        f"{name}_hi": F.col("_range.lo") + width * F.col(name),
    }).drop("_range")


def binned_curve(df: DataFrame, x: str, y: str, k: int = 20) -> DataFrame:
    """Mean response per bin of x with a 95 % band; bins of a single row are left out."""
    half = F.lit(1.96) * F.col("y_sem")
    return (
        cut(df, x, k).where(F.col("bin").isNotNull()).groupBy("bin")
        .agg(F.avg(q(x)).alias("x_mean"), F.avg(q(y)).alias("y_mean"),
             ratio(F.stddev_samp(q(y)), F.sqrt(F.count(q(y)))).alias("y_sem"))
        .dropna("any")
        .select("bin", "x_mean", "y_mean", "y_sem",
                (F.col("y_mean") - half).alias("ci95_lo"), (F.col("y_mean") + half).alias("ci95_hi"))
    )


def histogram(df: DataFrame, col: str, k: int = 50) -> DataFrame:
    """Row count of each non-empty equal-width bin with its bounds."""
    return (
        cut(df, col, k).where(F.col("bin").isNotNull())
        .groupBy("bin").agg(F.min("bin_lo").alias("lo"), F.min("bin_hi").alias("hi"), F.count("*").alias("n"))
    )


def box_stats(df: DataFrame, by: str, col: str) -> DataFrame:
    """Five-number summary per category."""
    out = exact_quantiles(df, [col], [0.0, 0.25, 0.5, 0.75, 1.0], [by])
    names = ["min", "q1", "median", "q3", "max"]
    return out.select(by, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)], "n")


def quantile_class(df: DataFrame, col: str, classes: int = 4, name: str = "quantile_class") -> DataFrame:
    """Class number 1..k by the exact quantiles; a value on a cut belongs to the lower class."""
    probs = [i / classes for i in range(1, classes)]
    cuts = exact_quantiles(df, [col], probs).select("quantiles").scalar()
    index = F.lit(1)
    out = df.withColumn("_cuts", cuts)
    for i in range(classes - 1):
        index = index + (q(col) > F.col("_cuts")[i]).cast("int")
    return out.withColumn(name, index).drop("_cuts")


def qq_pairs(df: DataFrame, col: str, key: Column, offset: float = 0.0) -> DataFrame:
    """Ordered values against normal quantiles at (rank - a) / (n + 1 - 2a)."""
    values = df.where(q(col).isNotNull())
    n = values.agg(F.count("*").alias("n")).select("n").scalar()
    ranked = global_rank(values.select(q(col), key.alias("_key")), col, F.col("_key"))
    p = (F.col("rank") - F.lit(float(offset))) / (n + F.lit(1.0 - 2.0 * offset))
    return ranked.select(
        F.col("rank").cast("long").alias("rank"), normal.quantile(p).alias("theoretical"), q(col).alias("sample")
    )


def step_curve(df: DataFrame, x: str, y: str, key: Column) -> DataFrame:
    """Points in the order of a predictor, the position being a column."""
    ranked = global_rank(df.select(q(x), q(y), key.alias("_key")), x, F.col("_key"), "position")
    return ranked.select(F.col("position").cast("long").alias("position"), q(x), q(y))


def residuals(df: DataFrame, y: str, predicted: str, name: str = "residual") -> DataFrame:
    return df.withColumn(name, q(y) - q(predicted))


def linear_fit(df: DataFrame, x: str, ys: str | Sequence[str]) -> DataFrame:
    """Least-squares line of each response on x: ``variable, n, slope, intercept, r2``."""
    ys = [ys] if isinstance(ys, str) else list(ys)
    long = df.unpivot([q(x).alias("_x")], [q(c).cast("double").alias(c) for c in ys], "variable", "_y")
    return long.dropna("any").groupBy("variable").agg(
        F.count("*").alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"),
    )


def regression_metrics(
    df: DataFrame, y: str, predicted: str, n_features: int, by: str | None = None
) -> DataFrame:
    """MSE, MAE, RMSE, R2 and adjusted R2 in one pass, per model when ``by`` is given."""
    e = q(y) - q(predicted)
    sums = df.groupBy(*([by] if by else [])).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.var_pop(q(y)).alias("_var"),
    )
    n = F.col("n")
    r2 = F.lit(1.0) - ratio(F.col("mse"), F.col("_var"))
    return sums.withColumn("rmse", F.sqrt("mse")).withColumn("r2", r2).withColumn(
        "r2_adj", F.lit(1.0) - (F.lit(1.0) - F.col("r2")) * ratio(n - 1, n - n_features - 1)
    ).select(*([by] if by else []), "n", "mse", "mae", "rmse", "r2", "r2_adj")


def target_variance(df: DataFrame, y: str, split: str) -> DataFrame:
    """Population variance of the target per split."""
    return df.groupBy(split).agg(F.count(q(y)).alias("n"), F.var_pop(q(y)).alias("variance"))


def compare_models(predictions: DataFrame, y: str, model_cols: Sequence[str], n_features: int) -> DataFrame:
    """Metrics of several prediction columns side by side, one job for all."""
    long = predictions.unpivot([y], list(model_cols), "model", "_yhat")
    return regression_metrics(long, y, "_yhat", n_features, by="model")


def site_points(df: DataFrame, site: str, x: Column, y: Column, metrics: Sequence[str]) -> DataFrame:
    """Coordinates and metrics per site."""
    return df.select(F.col(site).alias("site"), x.alias("x"), y.alias("y"), *metrics)


def with_metrics(sites: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    return attach(sites, metrics, key)
