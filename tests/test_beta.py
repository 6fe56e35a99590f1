import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ecospark.operators import beta


def table(spark, m):
    rows = [(f"s{i:03}", f"t{j:02}", float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "site string, taxon string, v double")


def dense(m):
    h = np.sqrt(m / np.where(m.sum(1, keepdims=True) > 0, m.sum(1, keepdims=True), 1))
    return h, (h - h.mean(0)) ** 2


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(4)
    m = rng.integers(0, 5, (37, 9)).astype(float)
    m[3] = 0
    return m


def test_sparse_equals_dense(spark, matrix):
    df = table(spark, matrix)
    _, s = dense(matrix)
    lcbd = {r.site: r.lcbd for r in beta.lcbd(df, "site", "taxon", "v").collect()}
    scbd = {r.taxon: r.scbd for r in beta.scbd(df, "site", "taxon", "v").collect()}
    np.testing.assert_allclose([lcbd[f"s{i:03}"] for i in range(37)], s.sum(1) / s.sum(), atol=1e-12)
    np.testing.assert_allclose([scbd[f"t{j:02}"] for j in range(9)], s.sum(0) / s.sum(), atol=1e-12)
    assert sum(lcbd.values()) == pytest.approx(1) and sum(scbd.values()) == pytest.approx(1)
    total = beta.beta_total(df, "site", "taxon", "v").head()
    assert (total.n_sites, total.bd_total) == (37, pytest.approx(s.sum() / 36))


def test_zero_site_counts_and_missing_taxon(spark):
    df = spark.createDataFrame([("s1", "a", 0.0), ("s1", "b", 0.0), ("s2", "a", 1.0), ("s2", None, 1.0)], "site string, taxon string, v double")
    got = {r.site: r.lcbd for r in beta.lcbd(df, "site", "taxon", "v").collect()}
    assert got == {"s1": pytest.approx(0.5), "s2": pytest.approx(0.5)}


def test_shuffled_index_is_a_bijection(spark):
    for n in (1, 2, 7, 100, 1003):
        df = spark.range(n).select("id", beta.shuffle_keys(F.lit(1), F.lit("x"))[0].alias("k")).drop("k")
        keys = beta.shuffle_keys(F.lit(5), F.lit("t"))
        out = [r[0] for r in df.select(beta.shuffled_index(F.col("id"), keys, F.lit(n))).collect()]
        assert sorted(out) == list(range(n))


def test_shuffles_are_spread_evenly(spark):
    n, perms = 20, 4000
    df = spark.range(perms).select(F.col("id").alias("p"))
    keys = beta.shuffle_keys(F.lit(3), F.col("p"))
    hits = df.select(beta.shuffled_index(F.lit(4).cast("long"), keys, F.lit(n)).alias("i")).groupBy("i").count().toPandas()
    expected = perms / n
    chi2 = ((hits["count"] - expected) ** 2 / expected).sum()
    assert len(hits) == n and chi2 < 45


def test_permutation_pvalues(spark):
    # One site is unlike all others; the rest share one composition up to noise.
    rng = np.random.default_rng(5)
    m = rng.integers(5, 9, (30, 6)).astype(float)
    m[0] = [0, 0, 0, 0, 0, 50]
    out = {r.site: r for r in beta.lcbd_permutation(table(spark, m), "site", "taxon", "v", nperm=199, seed=2).collect()}
    h, s = dense(m)
    assert out["s000"].lcbd == pytest.approx(s.sum(1)[0] / s.sum())
    null = []
    for _ in range(400):
        hp = np.column_stack([rng.permutation(h[:, j]) for j in range(6)])
        null.append(((hp - hp.mean(0)) ** 2).sum(1) / s.sum())
    null = np.array(null)
    for i in (0, 5, 12):
        expected = ((null[:, i] >= s.sum(1)[i] / s.sum() - 1e-12).sum() + 1) / 401
        assert out[f"s{i:03}"].pval == pytest.approx(expected, abs=0.12)


def test_permutation_is_partition_independent(spark, matrix):
    df = table(spark, matrix)
    a = {r.site: r.pval for r in beta.lcbd_permutation(df.coalesce(1), "site", "taxon", "v", 19).collect()}
    b = {r.site: r.pval for r in beta.lcbd_permutation(df.repartition(11), "site", "taxon", "v", 19).collect()}
    assert a == b and all(0 < p <= 1 for p in a.values())


def test_varpart_equals_least_squares(spark, matrix):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(37, 3))
    x = np.column_stack([x, 2 * x[:, 2]])  # a collinear environment column
    sites = pd.DataFrame({"site": [f"s{i:03}" for i in range(37)], **{f"x{k}": x[:, k] for k in range(4)}})
    h_df = beta.hellinger(table(spark, matrix), "site", "taxon", "v")
    out = beta.varpart(h_df, spark.createDataFrame(sites), "site", "taxon", ["x0", "x1"], ["x2", "x3"])
    got = {r.fraction: r.adj_r2 for r in out.collect()}
    h, _ = dense(matrix)
    y = h - h.mean(0)

    def adj(cols, m):
        d = x[:, cols] - x[:, cols].mean(0)
        fit = d @ np.linalg.lstsq(d, y, rcond=None)[0]
        return 1 - (1 - (fit**2).sum() / (y**2).sum()) * 36 / (37 - m - 1)

    a, b, c = adj([0, 1], 2), adj([2], 1), adj([0, 1, 2], 3)
    assert got["a"] == pytest.approx(c - b) and got["c"] == pytest.approx(c - a)
    assert got["b"] == pytest.approx(a + b - c) and sum(got.values()) == pytest.approx(1)
