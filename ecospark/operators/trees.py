"""Boosted-tree regression on tables: features, split, fit, curves, importance, attribution."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Mapping, Sequence

from pyspark import SparkContext
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_fraction, q
from ..sources.tables import checkpointed, drop_path, save_model, scratch_path
from ..vocabulary import DIVERSITY, DIVERSITY_CORR
from .clean import impute_median
from .order import exact_quantiles

RESPONSE_COLUMNS = [*DIVERSITY, "log_LCBD", *DIVERSITY_CORR, "log_LCBD_corr"]
PATIENCE = 50


def feature_set(df: DataFrame, key: str, target: str, drop: Iterable[str] = RESPONSE_COLUMNS) -> list[str]:
    """Predictor names: everything but the key and the diversity columns."""
    if target not in df.columns:
        raise ValueError(f"the table has no column {target}")
    gone = {key, target, *drop}
    return [c for c in df.columns if c not in gone]


def split(df: DataFrame, key: Column, test_size: float, seed: int = 42, name: str = "split") -> DataFrame:
    """Mark rows test or train by the hash of their key: stable under any partitioning."""
    return df.withColumn(name, F.when(hash_fraction(key, seed) < test_size, "test").otherwise("train"))


def exact_split(df: DataFrame, key: Column, test_size: float, seed: int = 42, name: str = "split") -> DataFrame:
    """Mark exactly ceil(n * test_size) rows test: those with the smallest hashes of their keys.

    The bound is an exact quantile of 52 hash bits, selected by radix, so no row is sorted and one number
    reaches the driver. Rows of one key stay together, also where that makes the test part larger; rows
    without a key are train.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    hashed = df.withColumn("_h", F.conv(F.substring(digest, 1, 13), 16, 10).cast("double"))
    n = hashed.where(F.col("_h").isNotNull()).count()
    most = min(math.ceil(n * test_size), n)
    if most < 1 or most == n:
        return hashed.withColumn(name, F.when(F.col("_h").isNotNull() & F.lit(most > 0), "test").otherwise("train")).drop("_h")
    # Half-way between the last test row and the first train row.
    bound = exact_quantiles(hashed, ["_h"], [(most - 0.5) / (n - 1)]).head()["quantiles"][0]
    return hashed.withColumn(name, F.when(F.col("_h") <= F.lit(bound), "test").otherwise("train")).drop("_h")


def fill_features(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Median-filled features, with an indicator column for each one that has gaps."""
    gaps = df.agg(*[F.count_if(q(c).isNull()).alias(c) for c in features]).head()
    holed = [c for c in features if gaps[c]]
    if not holed:
        return df, list(features)
    flags = {f"{c}_missing": q(c).isNull().cast("double") for c in holed}
    return impute_median(df.withColumns(flags), holed), [*features, *flags]


def with_vector(df: DataFrame, features: Sequence[str], name: str = "features", gap: float | None = None) -> DataFrame:
    """Add the feature vector; the assembler needs names without dots and fails on gaps, unless ``gap`` stands in for them."""
    plain = {f"_f{i}": F.coalesce(q(f).cast("double"), F.lit(gap)) for i, f in enumerate(features)}
    assembled = VectorAssembler(inputCols=list(plain), outputCol=name).transform(df.withColumns(plain))
    return assembled.drop(*plain)


def filled_vectors(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Materialised rows with gaps filled and the feature vector, and the names of its entries.

    ``df`` is evaluated once: gaps are counted in what was written, and only rows with gaps are written again.
    """
    path = scratch_path(df.sparkSession, "table")
    rows = checkpointed(with_vector(df, features, gap=0.0), path)
    filled, names = fill_features(rows.drop("features"), features)
    if len(names) == len(features):
        return rows, names
    whole = checkpointed(with_vector(filled, names))
    drop_path(df.sparkSession, path)
    return whole, names


def fit_gbt(
    train: DataFrame, target: str, params: Mapping, valid: DataFrame | None = None, patience: int = PATIENCE
) -> GBTRegressionModel:
    """Boosted trees on a table with a ``features`` vector.

    With a validation table the model keeps the trees up to the lowest validation error
    before ``patience`` trees bring no improvement; nothing is trained twice.
    """
    model = GBTRegressor(featuresCol="features", labelCol=target, **params).fit(train)
    if valid is None:
        return model
    errors = staged_errors(model, valid, target)
    return leading_trees(model, best_iteration(errors, patience))


def leading_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first n trees. Boosting only adds trees, so it is what n iterations would have made."""
    whole = model._java_obj
    if n >= model.getNumTrees:
        return model
    context = SparkContext._active_spark_context
    jvm, gateway = context._jvm, context._gateway
    regression = jvm.org.apache.spark.ml.regression
    trees, weights = gateway.new_array(regression.DecisionTreeRegressionModel, n), gateway.new_array(jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = whole.trees()[i], float(model.treeWeights[i])
    head = GBTRegressionModel(regression.GBTRegressionModel(whole.uid(), trees, weights, model.numFeatures))
    return model._copyValues(head)


def best_iteration(errors: Sequence[float], patience: int) -> int:
    """Number of trees at the lowest error, the search ending after ``patience`` worse ones."""
    best, at = float("inf"), 0
    for i, e in enumerate(errors, 1):
        if e < best:
            best, at = e, i
        elif i - at >= patience:
            break
    return at


def staged_errors(model: GBTRegressionModel, df: DataFrame, target: str) -> list[float]:
    """Mean squared error after each tree: one number per tree."""
    return list(model.evaluateEachIteration(df.select("features", F.col(target).alias(model.getLabelCol())), "squared"))


def staged_rmse(model: GBTRegressionModel, tables: Mapping[str, DataFrame], target: str) -> DataFrame:
    """RMSE of every table after each tree: ``dataset, iteration, rmse``."""
    rows = [
        (name, i, float(e) ** 0.5)
        for name, df in tables.items()
        for i, e in enumerate(staged_errors(model, df, target), 1)
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "dataset string, iteration int, rmse double")


def predict(model, df: DataFrame, name: str = "prediction") -> DataFrame:
    scored = model.transform(df)
    return scored if name == "prediction" else scored.withColumnRenamed("prediction", name)


def split_counts(spark, model: GBTRegressionModel, features: Sequence[str]) -> DataFrame:
    """Number of splits and gain share per feature: ``feature, splits, gain``.

    The nodes come from the saved model, which is a table.
    """
    path = scratch_path(spark, "model")
    save_model(model, path)
    nodes = spark.read.parquet(f"{path}/data").select(F.col("nodeData.split.featureIndex").alias("i"))
    gains = list(model.featureImportances.toArray())
    names = spark.createDataFrame(
        [(i, f, float(gains[i])) for i, f in enumerate(features)], "i int, feature string, gain double"
    )
    counts = nodes.where(F.col("i") >= 0).groupBy("i").agg(F.count("*").alias("splits"))
    return names.join(counts, "i", "left").select(
        "feature", F.coalesce("splits", F.lit(0)).alias("splits"), "gain"
    )


def background_sample(df: DataFrame, key: Column, features: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """The background of an attribution: ``size`` rows with the smallest key hashes."""
    tag = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    picked = df.select(tag.alias("_h"), *[q(f) for f in features]).orderBy("_h").limit(size)
    return picked.select(F.array(*[q(f).cast("double") for f in features]).alias("z"))


def shapley(
    model, rows: DataFrame, key: str, features: Sequence[str], background: DataFrame, nperm: int = 10, seed: int = 42
) -> DataFrame:
    """Additive attribution of each prediction by sampled feature orders: ``key, feature, phi``.

    Every row is repeated ``nperm`` times with its own feature order and background row; in
    step t its first t features are its own and the others are the background's. One model
    call scores all steps, and a feature's attribution is the mean change at its step, so
    the attributions of a row add up to its prediction minus the mean background one.
    ``background`` is a sample of bounded size and is shared with every task as one array.
    """
    p = len(features)
    pool = background.agg(F.collect_list("z")).scalar()
    base = rows.select(F.col(key), F.array(*[q(f).cast("double") for f in features]).alias("x"))
    drawn = base.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(nperm))))
    draw = F.concat_ws(":", F.lit(str(seed)), F.col("perm"), F.col(key).cast("string"))
    slot = F.pmod(F.xxhash64(draw), F.size(pool)).cast("int") + 1
    order = F.sort_array(F.array(*[
        F.struct(F.xxhash64(draw, F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(p)
    ]))
    drawn = drawn.select(key, "x", F.element_at(pool, slot).alias("z"), order["i"].alias("order"))
    steps = drawn.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(p))))
    hybrid = [
        F.when(F.array_position("order", F.lit(i)) <= F.col("step"), F.col("x")[i]).otherwise(F.col("z")[i]).alias(f"_v{i}")
        for i in range(p)
    ]
    vectors = steps.select(key, "order", "step", *hybrid)
    scored = model.transform(with_vector(vectors, [f"_v{i}" for i in range(p)], model.getFeaturesCol()))
    gain = F.struct(F.try_element_at("order", F.col("step")).alias("i"), F.col("prediction").alias("d"))
    loss = F.struct(F.try_element_at("order", F.col("step") + 1).alias("i"), (-F.col("prediction")).alias("d"))
    moves = F.when(F.col("step") == 0, F.array(loss)).when(F.col("step") == p, F.array(gain)).otherwise(F.array(gain, loss))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_m.i") + 1)
    return (
        scored.select(key, F.explode(moves).alias("_m"))
        .groupBy(key, name.alias("feature")).agg((F.sum("_m.d") / F.lit(float(nperm))).alias("phi"))
    )


# The search space of the hyper-parameter search, as lists of choices or
# (low, width) of a uniform draw.
SEARCH_SPACE = {
    "maxIter": [50, 100, 300, 500, 1000, 2000, 2500],
    "maxDepth": [3, 6, 9, 12, 15, 20, 25, 30],
    "stepSize": (0.001, 0.3),
    "subsamplingRate": (0.5, 0.5),
    "featureSubsetStrategy": (0.5, 0.5),
    "minInfoGain": (0.0, 0.5),
}


def sample_params(space: Mapping, n: int, seed: int = 42) -> list[dict]:
    """``n`` seeded draws from a search space."""
    rng = random.Random(seed)
    draws = []
    for _ in range(n):
        row = {}
        for name, choices in space.items():
            value = rng.choice(choices) if isinstance(choices, list) else choices[0] + choices[1] * rng.random()
            row[name] = str(value) if name == "featureSubsetStrategy" else value
        draws.append(row)
    return draws


def random_search(
    train: DataFrame, key: Column, features: Sequence[str], target: str, draws: Sequence[Mapping],
    folds: int = 5, seed: int = 42, parallelism: int = 4,
) -> DataFrame:
    """Cross-validated R2 of every draw: ``draw, <parameters>, r2, best``."""
    folded = train.withColumn("_fold", F.floor(hash_fraction(key, seed) * folds).cast("int"))
    tree = GBTRegressor(featuresCol="features", labelCol=target, seed=seed)
    maps = [{tree.getParam(k): v for k, v in d.items()} for d in draws]
    cv = CrossValidator(
        estimator=tree, estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol=target, metricName="r2"),
        numFolds=folds, foldCol="_fold", parallelism=parallelism, collectSubModels=False,
    )
    scores = cv.fit(with_vector(folded, features).select("features", q(target), "_fold")).avgMetrics
    best = max(range(len(scores)), key=lambda i: scores[i])
    names = list(draws[0])
    rows = [(i, *[str(d[k]) for k in names], float(s), i == best) for i, (d, s) in enumerate(zip(draws, scores))]
    columns = ", ".join(["draw int", *[f"{k} string" for k in names], "r2 double", "best boolean"])
    return train.sparkSession.createDataFrame(rows, columns)

