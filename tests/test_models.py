import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ecospark.bindings import products
from ecospark.bindings.registry import Tables
from ecospark.config import RunConfig
from ecospark.functions.spline import Basis, penalised_fit
from ecospark.operators import smooth, trees
from ecospark.plans import modelling


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.random((1500, 3))
    y = np.sin(6 * x[:, 0]) + 2 * x[:, 1] + rng.normal(0, 0.2, 1500)
    pdf = pd.DataFrame({"id": range(1500), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    return spark.createDataFrame(pdf).repartition(6), pdf


def test_basis_is_a_partition_of_unity():
    b = Basis(0.0, 2.0, 8)
    x = np.linspace(0, 2, 101)
    np.testing.assert_allclose(b(x).sum(1), 1)
    out = b(np.array([-1.0, -0.5, 0.0]))
    np.testing.assert_allclose(out[0] - out[1], out[1] - out[2])


def test_gram_equals_dense(data):
    df, pdf = data
    basis = Basis(pdf.a.min(), pdf.a.max(), 10)
    gram = smooth._grams(df, {"a": basis}, {"y": pdf.y.mean()})["y"]
    full = np.column_stack([np.ones(len(pdf)), basis(pdf.a.to_numpy()), pdf.y - pdf.y.mean()])
    np.testing.assert_allclose(gram, full.T @ full, atol=1e-8)


def test_fit_solves_the_penalised_equations(data):
    _, pdf = data
    basis = Basis(0.0, 1.0, 10)
    full = np.column_stack([np.ones(len(pdf)), basis(pdf.a.to_numpy()), pdf.y - pdf.y.mean()])
    fit = penalised_fit(full.T @ full, [10], [basis.penalty()], select=False)
    x, y = full[:, :-1], full[:, -1]
    resid = y - x @ fit.beta
    # Scale and adjusted R2 follow from the residuals and the effective degrees of freedom.
    assert fit.scale == pytest.approx((resid**2).sum() / (len(y) - fit.edf), rel=1e-6)
    assert fit.r2_adj == pytest.approx(1 - fit.scale / (y**2).sum() * (len(y) - 1), rel=1e-6)
    # The smooth sums to zero and more smoothing cannot lower the restricted likelihood score.
    assert abs((basis(pdf.a.to_numpy()) @ fit.beta[1:]).sum()) < 1e-6


def test_additive_model_recovers_smooths(spark, data):
    df, pdf = data
    model = smooth.AdditiveModel.fit(df, "y", ["a", "b", "c"])
    out = model.transform(df).toPandas().sort_values("id")
    truth = np.sin(6 * pdf.a) + 2 * pdf.b
    assert np.sqrt(((out["fit"].to_numpy(float) - truth) ** 2).mean()) < 0.05
    assert model.r2_adj > 0.9
    terms = {r.term: r for r in model.terms(spark).collect()}
    assert terms["a"].edf > 3 and terms["b"].edf < 2.5 and terms["c"].edf < 1.2
    assert (out["se"].to_numpy(float) > 0).all()
    assert model.summary(spark).head().n == 1500


def test_missing_predictor_gives_missing_fit(spark, data):
    df, _ = data
    model = smooth.AdditiveModel.fit(df, "y", ["a", "b"])
    holes = spark.createDataFrame([(0.5, None), (0.5, 0.5)], "a double, b double")
    got = model.transform(holes).collect()
    assert [r.fit is None for r in got] == [True, False]


def test_smooth_all_matches_single_fits(data):
    df, _ = data
    holes = df.withColumn("h", F.when(F.col("b") > 0.1, F.col("y")))
    rows = {r.variable: r for r in smooth.smooth_all(holes, "a", ["y", "h", "b"]).collect()}
    assert rows["y"].n == 1500 and rows["h"].n < 1500
    assert rows["y"].r2_adj > 0.3 and rows["b"].r2_adj < 0.05
    assert smooth.smooth_curves(df, "a", ["y", "b"], points=20).count() == 40


def test_smooth_permutation(data):
    df, _ = data
    linked = smooth.smooth_permutation(df, "a", "y", "id", nperm=49).head()
    free = smooth.smooth_permutation(df, "c", "y", "id", nperm=49).head()
    assert linked.pval == 0.0 and linked.r2_obs > 0.3
    assert free.pval > 0.02 and linked.nperm == 49


@pytest.fixture(scope="module")
def fitted(data):
    df, _ = data
    rows = trees.with_vector(trees.split(df, F.col("id"), 0.25), ["a", "b", "c"])
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    model = trees.fit_gbt(train, "y", {"maxIter": 15, "maxDepth": 3, "stepSize": 0.3, "seed": 1})
    return model, train, test


def test_importance_and_curve(spark, fitted):
    model, train, test = fitted
    counts = {r.feature: r for r in trees.split_counts(spark, model, ["a", "b", "c"]).collect()}
    assert sum(r.splits for r in counts.values()) == sum((t.numNodes - 1) // 2 for t in model.trees)
    assert counts["a"].gain > counts["c"].gain
    curve = trees.staged_rmse(model, {"train": train, "test": test}, "y").toPandas()
    first = curve[curve.dataset == "train"].sort_values("iteration").rmse.to_numpy()
    assert len(first) == 15 and first[-1] < first[0]


def test_attributions_add_up(fitted):
    model, train, test = fitted
    names = ["a", "b", "c"]
    background = trees.background_sample(train, F.col("id"), names, 1)
    phi = trees.shapley(model, test, "id", names, background, nperm=3).groupBy("id").agg(F.sum("phi").alias("s"))
    base = model.transform(trees.with_vector(background.select(*[F.col("z")[i].alias(n) for i, n in enumerate(names)]), names)).head().prediction
    rows = model.transform(test).join(phi, "id").select("prediction", "s").collect()
    assert len(rows) == test.count()
    assert all(r.s == pytest.approx(r.prediction - base, abs=1e-9) for r in rows)


def test_best_iteration():
    assert trees.best_iteration([5, 4, 3, 3.5, 3.6, 1.0], 2) == 3
    assert trees.best_iteration([5, 4, 3, 3.5, 3.6, 1.0], 9) == 6


def test_missing_features_get_indicators(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "id int, x double")
    out, names = trees.fill_features(df, ["x"])
    assert names == ["x", "x_missing"]
    assert {(r.id, r.x, r.x_missing) for r in out.collect()} == {(1, 1.0, 0.0), (2, 3.0, 1.0), (3, 5.0, 0.0)}


def test_config():
    with pytest.raises(ValueError, match="max_depth"):
        RunConfig(max_depth=40)
    with pytest.raises(ValueError, match="corrected"):
        RunConfig(kind="wide", corrected=True)
    assert RunConfig().target == "shannon_corr"
    with pytest.warns(UserWarning):
        assert RunConfig().tree_params(1000)["maxIter"] == 1000


def test_split_is_stable(data):
    df, _ = data
    a = {r.id for r in trees.split(df, F.col("id"), 0.2).where("split = 'test'").collect()}
    b = {r.id for r in trees.split(df.coalesce(1), F.col("id"), 0.2).where("split = 'test'").collect()}
    assert a == b and 0.15 < len(a) / 1500 < 0.25


def test_smooth_run_interpolates_dated_chemistry(spark):
    rng = np.random.default_rng(9)
    n = 400
    pdf = pd.DataFrame({
        "lake_id": [f"l{i}" for i in range(n)], "doy": rng.integers(100, 250, n), "pH": rng.random(n), "prev_Mixo": rng.random(n) * 100,
        "lat": 1.0, "shannon": rng.random(n),
    })
    pdf.loc[::5, "pH"] = None
    config = RunConfig(kind="dated", response="shannon", corrected=False)
    model, export = modelling.run_smooth(spark.createDataFrame(pdf), "lake_id", "dated", config)
    assert set(model.bases) == {"doy", "pH", "prev_Mixo"}
    assert export.columns == ["prev_Mixo", "fit", "r2_adj"] and export.where("fit is null").count() == 0


def test_run_on_harmonised_names(spark):
    """Harmonised columns carry dots and gaps."""
    rng = np.random.default_rng(10)
    n = 300
    pdf = pd.DataFrame({
        "lake_id": [f"l{i}" for i in range(n)], "lat": rng.random(n), "DO_mg.L": rng.random(n), "TP_ug.L": rng.random(n) * 30,
        "prev_Mixo": rng.random(n) * 100, "rich_genus": rng.integers(1, 20, n).astype(float), "shannon_corr": rng.random(n),
    })
    pdf["shannon"] = pdf["DO_mg.L"] + pdf["prev_Mixo"] / 100 + rng.normal(0, 0.1, n)
    df = spark.createDataFrame(pdf).withColumn("TP_ug.L", F.when(F.col("lat") > 0.2, F.col("`TP_ug.L`")))
    config = RunConfig(kind="long", response="shannon", corrected=False, n_estimators=100, learning_rate=0.1, max_depth=2, gamma=0.0, reg_alpha=0, reg_lambda=0)
    run = modelling.run_trees(df, "lake_id", config, nperm=1, background=5)
    assert run.features == ["lat", "DO_mg.L", "TP_ug.L", "prev_Mixo", "TP_ug.L_missing"]
    metrics = {r.split: r for r in run.metrics.collect()}
    assert metrics["train"].r2 > 0.5
    report = modelling.model_report(run)
    assert {r.section for r in report.select("section").distinct().collect()} == {
        "metrics", "learning", "importance", "curve", "residuals", "attribution",
    }
    assert run.qq.count() == metrics["test"].n
    model, export = modelling.run_smooth(df, "lake_id", "long", config)
    assert "DO_mg.L" in model.bases and model.r2_adj > 0.5
    draws = trees.sample_params({"maxIter": [2], "maxDepth": [2], "stepSize": (0.1, 0.1)}, 1)
    assert trees.random_search(df, F.col("lake_id"), ["lat", "DO_mg.L"], "shannon", draws, folds=2).count() == 1


def test_early_stop_keeps_the_head_of_one_training(spark, monkeypatch):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.xxhash64("id") % 100).cast("double").alias("b"))
    rows = trees.with_vector(df.withColumn("y", F.col("a") * 2 + F.col("b") / 10), ["a", "b"])
    params = {"maxIter": 12, "maxDepth": 3, "stepSize": 0.9, "subsamplingRate": 0.7, "seed": 5}
    whole, short = (trees.fit_gbt(rows, "y", {**params, "maxIter": n}) for n in (12, 4))
    head = trees.leading_trees(whole, 4)
    assert head.getNumTrees == 4 and head.numFeatures == 2 and len(head.featureImportances) == 2
    both = trees.predict(short, trees.predict(head, rows, "head"))
    assert both.where("head <> prediction").count() == 0
    fits = []
    fit = trees.GBTRegressor.fit
    monkeypatch.setattr(trees.GBTRegressor, "fit", lambda self, data: fits.append(1) or fit(self, data))
    model = trees.fit_gbt(rows.where("id % 2 = 0"), "y", params, rows.where("id % 2 = 1"))
    errors = trees.staged_errors(whole, rows, "y")
    assert fits == [1] and 1 <= model.getNumTrees <= 12 and len(errors) == 12


def test_exact_split_has_the_asked_size(spark):
    for n, share, want in ((10, 0.25, 3), (101, 0.2, 21), (1, 0.2, 1), (0, 0.2, 0), (7, 0.0, 0), (7, 1.0, 7)):
        marked = trees.exact_split(spark.range(n), F.col("id"), share)
        assert marked.where("split = 'test'").count() == want and marked.count() == n
    twice = spark.range(20).select((F.col("id") % 5).alias("k"))
    marked = trees.exact_split(twice, F.col("k"), 0.3)
    assert marked.groupBy("k").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    lost = spark.createDataFrame([(None,), (1,)], "k int")
    assert {r.k: r.split for r in trees.exact_split(lost, F.col("k"), 0.5).collect()} == {None: "train", 1: "test"}


class Stop(Exception):
    pass


@pytest.mark.parametrize("gaps", [False, True])
def test_tree_rows_are_evaluated_once(spark, monkeypatch, gaps):
    """Counting gaps, filling them and fitting read what was written, not the joins below."""
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return None if gaps and x % 3 == 0 else float(x)

    df = spark.range(200).select(
        F.col("id").cast("string").alias("lake_id"), F.udf(look, "double").asNondeterministic()("id").alias("prev_Mixo"),
        (F.col("id") % 7).cast("double").alias("shannon"),
    )
    made = []

    def stop(train, *rest):
        made.append(train)
        raise Stop

    monkeypatch.setattr(trees, "fit_gbt", stop)
    config = RunConfig(response="shannon", corrected=False, reg_alpha=0, reg_lambda=0)
    with pytest.raises(Stop):
        modelling.run_trees(df, "lake_id", config)
    assert seen.value == 200
    assert made[0].where("features is null").count() == 0 and made[0].count() > 100
    assert seen.value == 200


def test_filled_vectors(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, 5.0, 4.0)], "id int, `x.y` double, z double")
    out, names = trees.filled_vectors(df, ["x.y", "z"])
    assert names == ["x.y", "z", "x.y_missing"]
    assert {(r.id, tuple(r.features)) for r in out.collect()} == {(1, (1.0, 2.0, 0.0)), (2, (3.0, 3.0, 1.0)), (3, (5.0, 4.0, 0.0))}
    out, names = trees.filled_vectors(df.where("id <> 2"), ["x.y", "z"])
    assert names == ["x.y", "z"] and {(r.id, tuple(r.features)) for r in out.collect()} == {(1, (1.0, 2.0)), (3, (5.0, 4.0))}
    with pytest.raises(Exception, match="(?i)nan"):
        trees.filled_vectors(df.fillna({"z": 0.0}).withColumn("z", F.lit(float("nan"))), ["z"])


def test_many_lines_are_dealt_by_their_order(spark, tmp_path, monkeypatch, capsys):
    lines = [(o, p, float(p), 0.1, 0.2) for o in (1, 2, 2, 9, None) for p in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a", "SMALL"), (2, "b", "ECONOMY")], "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 10.0), (2, 20.0), (None, 30.0)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    t = Tables(spark, str(tmp_path))
    few = products.order_sites(t).collect()
    monkeypatch.setattr(products, "DEALT_LINES", 0)
    df = products.order_sites(t)
    df.explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(l_orderkey" in plan and "p_brand#" not in plan.split("REPARTITION_BY_NUM")[0].split("hashpartitioning")[-1]
    many = df.collect()
    assert sorted(many) == sorted(few) and [(r.lake_id, r.rich_genus, r.area_m2) for r in sorted(many)] == [(1, 2.0, 10.0), (2, 2.0, 20.0)]
