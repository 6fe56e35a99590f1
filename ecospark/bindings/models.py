"""Model queries. Fitted models have no SQL form in general; the tests check them against numpy.

A single split has one: queries named ``stump_`` run the same operators on one tree of depth one.
"""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import smooth, trees
from ..sources.tables import load_model, save_model, scratch_path
from .registry import query

FEATURES = ["l_quantity", "l_discount", "l_tax"]
TREES = {"maxIter": 10, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 10, "seed": 42}


def order_table(t):
    """One modelling row per order, keyed by order."""
    sums = t.lineitem.groupBy("l_orderkey").agg(
        F.avg("l_quantity").alias("l_quantity"), F.avg("l_discount").alias("l_discount"), F.avg("l_tax").alias("l_tax"),
        F.sum("l_extendedprice").alias("price"),
    )
    return trees.split(sums, F.col("l_orderkey"), 0.2)


def train_test(t):
    rows, names = trees.fill_features(order_table(t), FEATURES)
    rows = trees.with_vector(rows, names).select("l_orderkey", *FEATURES, "features", "price", "split")
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test"), names


@query("gbt_fit")
def gbt_fit(t):
    train, test, _ = train_test(t)
    inner = trees.split(train, F.col("l_orderkey"), 0.1, 43, "part")
    model = trees.fit_gbt(inner.where("part = 'train'"), "price", TREES, valid=inner.where("part = 'test'"))
    return trees.predict(model, test).select("l_orderkey", "price", rounded(F.col("prediction")).alias("prediction"))


@query("staged_rmse")
def staged_rmse(t):
    train, test, _ = train_test(t)
    model = trees.fit_gbt(train, "price", TREES)
    return trees.staged_rmse(model, {"train": train, "test": test}, "price")


@query("split_counts")
def split_counts(t):
    train, _, names = train_test(t)
    return trees.split_counts(t.spark, trees.fit_gbt(train, "price", TREES), names)


@query("shapley")
def shapley(t):
    train, test, _ = train_test(t)
    model = trees.fit_gbt(train, "price", TREES)
    background = trees.background_sample(train, F.col("l_orderkey"), FEATURES, 100)
    return trees.shapley(model, test, "l_orderkey", FEATURES, background, nperm=4)


@query("random_search")
def random_search(t):
    space = {"maxIter": [5, 10], "maxDepth": [3, 5], "stepSize": (0.05, 0.2)}
    train = order_table(t).where(F.col("split") == "train")
    draws = trees.sample_params(space, 2)
    return trees.random_search(train, F.col("l_orderkey"), FEATURES, "price", draws, folds=3)


@query("model_store")
def model_store(t):
    train, test, _ = train_test(t)
    model = trees.fit_gbt(train, "price", {**TREES, "maxIter": 5})
    path = scratch_path(t.spark, "gbt")
    save_model(model, path)
    again = load_model(GBTRegressionModel, path)
    both = trees.predict(again, trees.predict(model, test, "before"))
    return both.select("l_orderkey", "before", F.col("prediction").alias("after"))


@query("additive_model")
def additive_model(t):
    model = smooth.AdditiveModel.fit(t.lineitem, "l_extendedprice", FEATURES)
    scored = model.transform(t.lineitem)
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", rounded(F.col("fit"), 3).alias("fit"), rounded(F.col("se"), 3).alias("se"))


@query("additive_terms")
def additive_terms(t):
    return smooth.AdditiveModel.fit(t.lineitem, "l_extendedprice", FEATURES).terms(t.spark)


@query("export_fit")
def export_fit(t):
    model = smooth.AdditiveModel.fit(t.lineitem, "l_extendedprice", FEATURES)
    return smooth.export_fit(model, t.lineitem, "l_quantity")


@query("smooth_all")
def smooth_all(t):
    return smooth.smooth_all(t.lineitem, "l_quantity", ["l_extendedprice", "l_discount", "l_tax"])


@query("smooth_curves")
def smooth_curves(t):
    return smooth.smooth_curves(t.lineitem, "l_quantity", ["l_extendedprice", "l_discount", "l_tax"])


@query("smooth_permutation")
def smooth_permutation(t):
    sites = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"))
    return smooth.smooth_permutation(sites, "q", "p", "l_suppkey", nperm=99)


STUMP = """with o as (select o_orderkey, o_totalprice, count(*) as n_lines from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
    c as (select v, sum(o_totalprice) filter (n_lines <= v) as s1, count(*) filter (n_lines <= v) as n1,
        sum(o_totalprice) filter (n_lines > v) as s2, count(*) filter (n_lines > v) as n2 from o, (select distinct n_lines as v from o) group by v),
    b as (select v, s1 / n1 as lo, s2 / n2 as hi from c where n2 > 0 order by s1 * s1 / n1 + s2 * s2 / n2 desc limit 1),
    p as (select o_orderkey, o_totalprice, case when n_lines <= v then lo else hi end as prediction from o, b)"""


def stump(t):
    """Orders with their number of lines, and one split of their price on it."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    rows = trees.with_vector(t.orders.join(lines, "o_orderkey").select("o_orderkey", "o_totalprice", "n_lines"), ["n_lines"])
    return rows, trees.fit_gbt(rows, "o_totalprice", {"maxIter": 1, "maxDepth": 1, "seed": 1})


@query("stump_fit", STUMP + " select o_orderkey, round(prediction, 4) as prediction from p")
def stump_fit(t):
    rows, model = stump(t)
    return trees.predict(model, rows).select("o_orderkey", rounded(F.col("prediction"), 4).alias("prediction"))


@query("stump_rmse", STUMP + """ select 'all' as dataset, 1::int as iteration,
    round(sqrt(avg((o_totalprice - prediction) * (o_totalprice - prediction))), 4) as rmse from p""")
def stump_rmse(t):
    rows, model = stump(t)
    return trees.staged_rmse(model, {"all": rows}, "o_totalprice").withColumn("rmse", rounded(F.col("rmse"), 4))


@query("stump_counts", STUMP + " select 'n_lines' as feature, count(*) as splits, 1.0::double as gain from b")
def stump_counts(t):
    return trees.split_counts(t.spark, stump(t)[1], ["n_lines"])


@query("stump_shapley", STUMP + """, z as (select prediction as base from p order by md5('42:' || o_orderkey) limit 1)
    select o_orderkey, 'n_lines' as feature, round(prediction - base, 4) + 0.0 as phi from p, z""")
def stump_shapley(t):
    rows, model = stump(t)
    background = trees.background_sample(rows, F.col("o_orderkey"), ["n_lines"], 1)
    df = trees.shapley(model, rows, "o_orderkey", ["n_lines"], background, nperm=4)
    return df.withColumn("phi", rounded(F.col("phi"), 4))


@query("stump_store", STUMP + " select count(*) as n, count(*) as same from p")
def stump_store(t):
    rows, model = stump(t)
    path = scratch_path(t.spark, "gbt")
    save_model(model, path)
    again = load_model(GBTRegressionModel, path)
    both = trees.predict(again, trees.predict(model, rows, "before"))
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("before") == F.col("prediction")).alias("same"))


@query("exact_split", """select o_orderkey, case when row_number() over (order by md5('42:' || o_orderkey)) <= ceil(count(*) over () * 0.2)
    then 'test' else 'train' end as split from orders""")
def exact_split(t):
    return trees.exact_split(t.orders.select("o_orderkey"), F.col("o_orderkey"), 0.2)
