"""End-to-end modelling of a diversity metric on its predictors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.columns import q
from ..operators import clean, smooth, stats, trees
from ..sources.tables import checkpointed
from ..vocabulary import INTERPOLATED, SMOOTH_DROPS


@dataclass(frozen=True)
class ModelRun:
    """Tables of one modelling run."""

    features: list[str]
    predictions: DataFrame
    metrics: DataFrame
    learning: DataFrame
    importance: DataFrame
    attribution: DataFrame | None
    curve: DataFrame
    residual_histogram: DataFrame
    qq: DataFrame


def run_trees(
    table: DataFrame, key: str, config: RunConfig, focal: str = "prev_Mixo",
    features: Sequence[str] | None = None, background: int = 100, nperm: int = 10, attribute: bool = True,
) -> ModelRun:
    """Split, fit boosted trees, and derive every table the evaluation needs.

    A tenth of the training rows, picked by key hash, decides where to stop adding trees,
    so the test rows stay unseen.
    """
    target = config.target
    names = list(features or trees.feature_set(table, key, target))
    rows = clean.require(table.select(key, target, *[q(n) for n in names]), [target])
    rows = trees.split(rows, F.col(key), config.test_size, config.seed)
    rows, filled = trees.filled_vectors(rows, names)
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    inner = trees.split(train, F.col(key), 0.1, config.seed + 1, "part")
    fitted, valid = (inner.where(F.col("part") == part).select(key, "features", target) for part in ("train", "test"))
    model = trees.fit_gbt(fitted, target, config.tree_params(fitted.count()), valid)
    scored = stats.residuals(trees.predict(model, rows), target, "prediction")
    scored = checkpointed(scored.select(*map(q, dict.fromkeys([key, "split", target, "prediction", "residual", focal]))))
    tested = scored.where(F.col("split") == "test")
    attribution = None
    if attribute:
        sample = trees.background_sample(train, F.col(key), filled, background, config.seed)
        attribution = trees.shapley(model, test, key, filled, sample, nperm, config.seed)
    return ModelRun(
        filled,
        scored.select(key, "split", target, "prediction", "residual", q(focal)),
        stats.regression_metrics(scored, target, "prediction", len(names), by="split"),
        trees.staged_rmse(model, {"train": train, "test": test}, target),
        trees.split_counts(table.sparkSession, model, filled),
        attribution,
        stats.binned_curve(tested, focal, "prediction"),
        stats.histogram(tested, "residual", 50),
        stats.qq_pairs(tested, "residual", F.col(key)),
    )


def run_smooth(
    table: DataFrame, key: str, kind: str, config: RunConfig, features: Sequence[str] | None = None,
    focal: str = "prev_Mixo", k: int = 10,
) -> tuple[smooth.AdditiveModel, DataFrame]:
    """Fit the additive model on the training rows; return it with the export of the test rows."""
    target = config.target
    names = [n for n in (features or trees.feature_set(table, key, target)) if n not in SMOOTH_DROPS.get(kind, ())]
    rows = trees.split(table, F.col(key), config.test_size, config.seed)
    if kind == "dated":
        gaps = [c for c in INTERPOLATED if c in names]
        rows = clean.interpolate(rows, "doy", gaps, by=["split"])
    rows = clean.require(rows, [*names, target])
    train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
    model = smooth.AdditiveModel.fit(train, target, names, k)
    return model, smooth.export_fit(model, test, focal)


def model_report(run: ModelRun) -> DataFrame:
    """Metrics, learning curve, importance, response curve and residuals as one long table."""

    def part(section: str, df: DataFrame, item, x, value) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"), item.cast("string").alias("item"), x.cast("double").alias("x"),
            value.cast("double").alias("value"),
        )

    names = ["mse", "mae", "rmse", "r2", "r2_adj"]
    metrics = run.metrics.unpivot(["split"], [F.col(n) for n in names], "metric", "value")
    nothing = F.lit(None)
    parts = [
        part("metrics", metrics, F.concat_ws("_", "metric", "split"), nothing, F.col("value")),
        part("learning", run.learning, F.col("dataset"), F.col("iteration"), F.col("rmse")),
        part("importance", run.importance, F.col("feature"), nothing, F.col("splits")),
        part("curve", run.curve, F.col("bin"), F.col("x_mean"), F.col("y_mean")),
        part("residuals", run.residual_histogram, F.col("bin"), F.col("lo"), F.col("n")),
    ]
    if run.attribution is not None:
        mean_size = run.attribution.groupBy("feature").agg(F.avg(F.abs("phi")).alias("phi"))
        parts.append(part("attribution", mean_size, F.col("feature"), nothing, F.col("phi")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
