"""Additive smooth models.

The data are read once to accumulate cross-products of the spline bases: each task reduces
its rows to one small matrix, the matrices are summed by a shuffle of their entries, and
only the summed matrix, whose size depends on the number of terms, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spline import Basis, Fit, penalised_fit
from .beta import shuffle_keys, shuffled_index
from ..functions.columns import q
from .clean import require
from .order import dense_index


def _ranges(df: DataFrame, xs: Sequence[str], ys: Sequence[str]) -> tuple[dict, dict]:
    """Range of each predictor and mean of each response: one row."""
    row = df.agg(*[F.struct(F.min(q(x)), F.max(q(x))).alias(f"r{i}") for i, x in enumerate(xs)],
                 *[F.avg(q(y)).alias(f"m{i}") for i, y in enumerate(ys)]).head()
    return (
        {x: (float(row[f"r{i}"][0]), float(row[f"r{i}"][1])) for i, x in enumerate(xs)},
        {y: float(row[f"m{i}"]) for i, y in enumerate(ys)},
    )


def _summed(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    return entries.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def _matrix(rows, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out


def _grams(df: DataFrame, bases: dict[str, Basis], ys: dict[str, float]) -> dict[str, np.ndarray]:
    """Cross-products of [1, B1, ..., Bp, y - mean] per response, over its complete rows."""
    xs = list(bases)
    size = 2 + sum(b.k for b in bases.values())
    means = dict(ys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {y: np.zeros((size, size)) for y in means}
        for pdf in batches:
            design = [np.ones((len(pdf), 1)), *[bases[x](pdf[f"x{i}"].to_numpy(float)) for i, x in enumerate(xs)]]
            design = np.hstack(design)
            for j, (y, mean) in enumerate(means.items()):
                value = pdf[f"y{j}"].to_numpy(float)
                present = ~np.isnan(value)
                full = np.hstack([design[present], (value[present] - mean)[:, None]])
                sums[y] += full.T @ full
        i, j = np.indices((size, size)).reshape(2, -1)
        for y, m in sums.items():
            if m[0, 0] > 0:
                yield pd.DataFrame({"y": y, "i": i, "j": j, "v": m.ravel()})

    columns = df.select(*[q(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)],
                        *[q(y).cast("double").alias(f"y{j}") for j, y in enumerate(means)])
    columns = columns.dropna(subset=[f"x{i}" for i in range(len(xs))])
    entries = columns.mapInPandas(partial, "y string, i int, j int, v double")
    rows = _summed(entries, ["y"]).collect()
    return {y: _matrix([r for r in rows if r["y"] == y], size) for y in means}


@dataclass(frozen=True)
class AdditiveModel:
    """y = intercept + sum of smooths, fitted from cross-products."""

    response: str
    bases: dict[str, Basis]
    mean: float
    fit_: Fit

    @classmethod
    def fit(
        cls, df: DataFrame, y: str, xs: Sequence[str], k: int = 10, select: bool = True, method: str = "REML"
    ) -> AdditiveModel:
        """Fit on the complete rows; k basis functions per predictor."""
        ranges, means = _ranges(require(df, [*xs, y]), xs, [y])
        bases = {x: Basis(*ranges[x], k) for x in xs}
        gram = _grams(df, bases, means)[y]
        result = penalised_fit(gram, [k] * len(xs), [b.penalty() for b in bases.values()], select, method)
        return cls(y, bases, means[y], result)

    @property
    def r2_adj(self) -> float:
        return self.fit_.r2_adj

    def transform(self, df: DataFrame, fit: str = "fit", se: str | None = "se") -> DataFrame:
        """Add the prediction and its standard error; NULL where a predictor is missing."""
        bases, beta, cov, mean = list(self.bases.values()), self.fit_.beta, self.fit_.cov, self.mean

        @F.pandas_udf("fit double, se double")
        def predict(*columns: pd.Series) -> pd.DataFrame:
            values = [c.to_numpy(float) for c in columns]
            known = ~np.isnan(np.column_stack(values)).any(axis=1)
            design = np.hstack([np.ones((known.sum(), 1)), *[b(v[known]) for b, v in zip(bases, values)]])
            out = pd.DataFrame({"fit": pd.Series([None] * len(known), dtype=object), "se": None})
            out.loc[known, "fit"] = mean + design @ beta
            out.loc[known, "se"] = np.sqrt(np.maximum(((design @ cov) * design).sum(axis=1), 0.0))
            return out.astype("Float64")

        scored = df.withColumn("_fit", predict(*[q(x).cast("double") for x in self.bases]))
        scored = scored.withColumn(fit, F.col("_fit.fit"))
        if se:
            scored = scored.withColumn(se, F.col("_fit.se"))
        return scored.drop("_fit")

    def summary(self, spark: SparkSession) -> DataFrame:
        f = self.fit_
        return spark.createDataFrame(
            [(self.response, f.n, f.edf, f.r2_adj, f.score, f.scale)],
            "response string, n bigint, edf double, r2_adj double, score double, scale double",
        )

    def terms(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(zip(self.bases, self.fit_.term_edf, self.fit_.lambdas)), "term string, edf double, lambda double"
        )


def export_fit(model: AdditiveModel, df: DataFrame, focal: str) -> DataFrame:
    """Focal predictor, fit and adjusted R2 of every row."""
    return model.transform(df, se=None).select(q(focal), "fit", F.lit(model.r2_adj).alias("r2_adj"))


def _fit_each(df: DataFrame, x: str, ys: Sequence[str], k: int, method: str) -> tuple[Basis, dict, dict[str, Fit]]:
    ranges, means = _ranges(df.where(q(x).isNotNull()), [x], ys)
    basis = Basis(*ranges[x], k)
    grams = _grams(df, {x: basis}, means)
    fits = {y: penalised_fit(g, [k], [basis.penalty()], False, method) for y, g in grams.items()}
    return basis, means, fits


def smooth_all(df: DataFrame, x: str, ys: Sequence[str], k: int = 10, method: str = "REML") -> DataFrame:
    """One smooth of x per response, all from one pass: ``variable, n, edf, r2_adj, lambda``."""
    _, _, fits = _fit_each(df, x, ys, k, method)
    rows = [(y, f.n, f.edf, f.r2_adj, f.lambdas[0]) for y, f in fits.items()]
    return df.sparkSession.createDataFrame(rows, "variable string, n bigint, edf double, r2_adj double, lambda double")


def smooth_curves(
    df: DataFrame, x: str, ys: Sequence[str], k: int = 10, points: int = 80, method: str = "REML"
) -> DataFrame:
    """Fitted curves with their standard errors on an even grid: ``variable, x, fit, se``."""
    basis, means, fits = _fit_each(df, x, ys, k, method)
    grid = np.linspace(basis.lo, basis.hi, points)
    design = np.hstack([np.ones((points, 1)), basis(grid)])
    rows = [
        (y, float(g), float(means[y] + d @ f.beta), float(np.sqrt(max(d @ f.cov @ d, 0.0))))
        for y, f in fits.items() for g, d in zip(grid, design)
    ]
    return df.sparkSession.createDataFrame(rows, "variable string, x double, fit double, se double")


def smooth_permutation(
    df: DataFrame, x: str, y: str, key: str, nperm: int = 1000, seed: int = 123, k: int = 10,
    method: str = "GCV", plus_one: bool = False,
) -> DataFrame:
    """Permutation test of the adjusted R2 of y ~ s(x): ``r2_obs, pval, nperm``.

    The predictor is shuffled over the rows by a keyed bijection of the row numbers. The
    cross-products of the basis do not change, so a shuffle needs only the k sums of
    basis times response, and the penalised fits run where those sums are.
    """
    rows = df.select(key, q(x).cast("double").alias("x"), q(y).cast("double").alias("y")).dropna("any")
    ranges, means = _ranges(rows, ["x"], ["y"])
    basis = Basis(*ranges["x"], k)
    gram = _grams(rows, {"x": basis}, means)["y"]
    penalty = basis.penalty()
    observed = penalised_fit(gram, [k], [penalty], False, method).r2_adj
    mean, n = means["y"], int(gram[0, 0])

    numbered = rows.join(dense_index(rows, key), key)
    moved = numbered.select("x", F.explode(F.sequence(F.lit(1), F.lit(nperm))).alias("perm"), "idx")
    keys = shuffle_keys(F.lit(seed), F.col("perm"))
    paired = moved.select("perm", "x", shuffled_index(F.col("idx"), keys, F.lit(n)).alias("idx")).join(
        numbered.select("idx", "y"), "idx"
    ).select("perm", "x", "y")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((nperm + 1, k))
        for pdf in batches:
            np.add.at(sums, pdf["perm"].to_numpy(), basis(pdf["x"].to_numpy()) * (pdf["y"].to_numpy() - mean)[:, None])
        perm, i = np.nonzero(sums)
        yield pd.DataFrame({"perm": perm, "i": i, "j": 0, "v": sums[perm, i]})

    def refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = []
            for c in pdf["c"]:
                shuffled = gram.copy()
                shuffled[1:-1, -1] = shuffled[-1, 1:-1] = np.asarray(c, float)
                values.append(penalised_fit(shuffled, [k], [penalty], False, method).r2_adj)
            yield pd.DataFrame({"r2": values})

    sums = _summed(paired.mapInPandas(partial, "perm int, i int, j int, v double"), ["perm"])
    vectors = sums.groupBy("perm").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("i") == i, F.col("v"))), F.lit(0.0)) for i in range(k)
    ]).alias("c"))
    r2 = vectors.select("c").mapInPandas(refit, "r2 double")
    one = 1 if plus_one else 0
    hits = F.count_if(F.round("r2", 9) >= F.lit(round(observed, 9)))
    return r2.agg(
        F.lit(observed).alias("r2_obs"), ((hits + one) / F.lit(float(nperm + one))).alias("pval"), F.count("*").alias("nperm")
    )


def key_of(*cols: str) -> Column:
    """A row key made of several columns."""
    return F.concat_ws("-", *[q(c).cast("string") for c in cols])
