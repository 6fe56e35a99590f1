import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ecospark.operators import order, stats


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    v = np.where(rng.random(5000) < 0.34, 7.0, rng.normal(5, 3, 5000).round(2))
    return spark.createDataFrame(pd.DataFrame({"id": range(5000), "v": v, "g": rng.integers(0, 3, 5000)})), v


def test_bucketed_quantiles_equal_numpy(values):
    df, v = values
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = order.exact_quantiles(df, ["v", "id"], probs, buckets=16).collect()
    got = {r.variable: r for r in got}
    np.testing.assert_allclose(got["v"].quantiles, np.quantile(v, probs))
    np.testing.assert_allclose(got["id"].quantiles, np.quantile(np.arange(5000), probs))
    assert got["v"].n == 5000


def test_bucketed_quantiles_by_group(values):
    df, _ = values
    probs = [0.25, 0.5]
    a = order.exact_quantiles(df, ["v"], probs, by=["g"], buckets=8).orderBy("g").collect()
    b = order.exact_quantiles(df, ["v"], probs, by=["g"]).orderBy("g").collect()
    for x, y in zip(a, b, strict=True):
        assert x.n == y.n
        np.testing.assert_allclose(x.quantiles, y.quantiles)


def test_rank_is_a_total_order_with_a_hot_value(values):
    df, v = values
    for parts in (1, 7):
        out = order.global_rank(df.repartition(parts), "v", F.col("id"), buckets=16).orderBy("rank").collect()
        assert [r["rank"] for r in out] == list(range(1, 5001))
        np.testing.assert_array_equal([r.v for r in out], np.sort(v))
    again = {r.id: r["rank"] for r in order.global_rank(df, "v", F.col("id"), buckets=64).collect()}
    assert again == {r.id: r["rank"] for r in out}


def test_dense_index(values):
    df, _ = values
    out = order.dense_index(df, "id").collect()
    assert sorted(r.idx for r in out) == list(range(5000))


def test_qq_positions(spark):
    from statistics import NormalDist

    df = spark.createDataFrame([(i, float(i * i)) for i in range(5)], "id int, v double")
    out = stats.qq_pairs(df, "v", F.col("id")).orderBy("rank").collect()
    assert [r.theoretical for r in out] == pytest.approx([NormalDist().inv_cdf(i / 6) for i in range(1, 6)], abs=1e-7)
    assert [r.sample for r in out] == [0.0, 1.0, 4.0, 9.0, 16.0]


def test_quantile_class(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 10)], "v double")
    got = [r.quantile_class for r in stats.quantile_class(df, "v").orderBy("v").collect()]
    assert got == [1, 1, 1, 2, 2, 3, 3, 4, 4]


def test_quantiles_keep_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, v double")
    got = {r["g"]: (r["n"], r["quantiles"]) for r in order.exact_quantiles(df, ["v"], [0.5], by=["g"]).collect()}
    assert got == {"a": (2, [2.0]), "b": (0, None)}


def test_order_key_follows_the_order_of_doubles(spark):
    rng = np.random.default_rng(9)
    powers = np.concatenate([2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1022, 1024), 0), np.nextafter(2.0 ** np.arange(-1022, 1023), np.inf)])
    some = np.concatenate([powers, -powers, [0.0, -0.0, np.inf, -np.inf, 1.7976931348623157e308], rng.normal(0, 1, 500), rng.normal(0, 1e-300, 100)])
    rows = spark.createDataFrame([(float(v),) for v in some], "v double").select("v", order.order_key(F.col("v")).alias("k")).collect()
    v, k = np.array([r.v for r in rows]), np.array([r.k for r in rows])
    at = np.argsort(v, kind="stable")
    assert ((np.diff(v[at]) > 0) == (np.diff(k[at]) > 0)).all() and (np.diff(k[at]) >= 0).all()
    assert len(set(k.tolist())) == len(set(v.tolist()))


def test_quantiles_of_values_in_one_bucket(spark):
    """Values whose leading bits agree are cut by further bits."""
    v = 1.0 + np.random.default_rng(4).integers(0, 900, 3000) * 2.0**-52
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    got = order.exact_quantiles(df, ["v"], [0.0, 0.5, 0.9, 1.0], piece=50).head()
    assert got["quantiles"] == np.quantile(v, [0.0, 0.5, 0.9, 1.0]).tolist() and got["n"] == 3000
