import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ecospark.plans import survey
from ecospark.operators import alpha, clean, reshape


def cells(spark, rows):
    return spark.createDataFrame(rows, "site string, taxon string, value double")


def row(df, **key):
    return [r for r in df.collect() if all(r[k] == v for k, v in key.items())][0]


def test_single_taxon_has_no_evenness(spark):
    r = row(alpha.alpha_diversity(cells(spark, [("s1", "a", 5.0)]), "site", "taxon", "value"))
    assert (r.richness, r.shannon, r.op_simpson, r.evenness) == (1, 0.0, 0.0, None)


def test_missing_taxon_counts_as_one(spark):
    df = cells(spark, [("s1", None, 1.0), ("s1", "a", 2.0)])
    assert row(alpha.alpha_diversity(df, "site", "taxon", "value")).richness == 2
    assert row(alpha.richness(df, "site", "taxon")).richness == 2


def test_duplicate_rows_stay_separate_parts(spark):
    df = cells(spark, [("s1", "a", 1.0), ("s1", "a", 2.0)])
    r = row(alpha.alpha_diversity(df, "site", "taxon", "value"))
    p = np.array([1 / 3, 2 / 3])
    assert r.richness == 1
    assert r.shannon == pytest.approx(-(p * np.log(p)).sum())


def test_recorded_total_need_not_be_the_sum(spark):
    df = cells(spark, [("s1", "a", 1.0), ("s1", "b", 2.0)]).withColumn("t", F.lit(10.0))
    r = row(alpha.alpha_diversity(df, "site", "taxon", "value", total="t"))
    p = np.array([0.1, 0.2])
    assert r.shannon == pytest.approx(-(p * np.log(p)).sum())
    assert r.op_simpson == pytest.approx(1 - (p**2).sum())


def test_wide_zero_row(spark):
    df = spark.createDataFrame([("s1", 0.0, 0.0), ("s2", 1.0, 3.0)], "site string, a double, b double")
    out = alpha.alpha_diversity_wide(df, "site")
    z, r = row(out, site="s1"), row(out, site="s2")
    assert (z.richness, z.shannon, z.op_simpson, z.evenness) == (0, 0.0, 1.0, None)
    assert r.evenness == pytest.approx(-(0.25 * math.log(0.25) + 0.75 * math.log(0.75)) / math.log(2))


def test_wide_equals_long(spark):
    df = spark.createDataFrame([("s1", 0.0, 2.0, 5.0), ("s2", 1.0, 3.0, 0.0)], "site string, a double, b double, c double")
    wide = {tuple(r) for r in alpha.alpha_diversity_wide(df, "site").collect()}
    long = {tuple(r) for r in alpha.alpha_diversity_all_sites(reshape.to_long(df, ["site"]), "site", "taxon", "value").collect()}
    close = lambda a, b: all(x == pytest.approx(y) for x, y in zip(a, b))
    assert all(any(close(a, b) for b in long) for a in wide)


def test_cells_give_the_same_metrics_as_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{rng.integers(5)}", f"t{rng.integers(9)}", float(rng.integers(0, 4))) for _ in range(300)]
    df = cells(spark, rows).withColumn("strat", F.when(F.col("taxon") < "t4", "Mixotroph").otherwise("Autotroph"))
    trait = F.col("strat") == "Mixotroph"
    a = alpha.alpha_diversity(df, "site", "taxon", "value", trait=trait).orderBy("site").toPandas()
    b = alpha.alpha_from_cells(alpha.site_cells(df, "site", "taxon", "value", ["strat"]), "site", trait=trait).orderBy("site").toPandas()
    assert list(a.columns) == list(b.columns)
    np.testing.assert_allclose(a.drop(columns="site").astype(float), b.drop(columns="site").astype(float))


def test_corrected_and_trait_richness_add_up(spark):
    df = cells(spark, [("s", t, v) for t, v in zip("abcdef", (1.0, 2.0, 3.0, 4.0, 5.0, 6.0))])
    members = spark.createDataFrame([("a",), ("b",), (None,)], "g string")
    tagged = clean.tag_trait(df, members, "taxon")
    mixo = F.col("strat") == "Mixotroph"
    full = row(alpha.alpha_diversity(tagged, "site", "taxon", "value", trait=mixo))
    corr = row(alpha.alpha_diversity(tagged, "site", "taxon", "value", where=~mixo, suffix="_corr"))
    assert full.trait_rows + corr.richness_corr == full.richness
    assert full.prev == pytest.approx(100 * 3 / 21)


def test_hot_site_and_partitioning_do_not_change_results(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 == 0 else f"s{i % 50}", f"t{rng.integers(200)}", float(rng.random() + 0.1)) for i in range(6000)]
    df = cells(spark, rows)
    few = alpha.alpha_diversity(df.coalesce(1), "site", "taxon", "value").orderBy("site").toPandas()
    many = alpha.alpha_diversity(df.repartition(23), "site", "taxon", "value").orderBy("site").toPandas()
    np.testing.assert_allclose(few.drop(columns="site").astype(float), many.drop(columns="site").astype(float))
    plan = alpha.alpha_diversity(df, "site", "taxon", "value")._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Window" not in plan


def test_repeated_members_and_nan_change_nothing(spark):
    rows = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 3.0), ("s", "c", float("nan"))], "site string, taxon string, value double")
    twice = spark.createDataFrame([("a",), ("a",)], "taxon string")
    got = alpha.trait_summary(rows, twice, "site", "taxon", "value").head()
    assert (got["trait_richness"], got["trait_total"]) == (1, 1.0)
    metrics = alpha.alpha_diversity(rows, "site", "taxon", "value").head()
    assert metrics["richness"] == 2 and abs(metrics["shannon"] - 0.5623351446) < 1e-9


def test_taxon_in_two_groups(spark):
    rows = spark.createDataFrame(
        [("s", "survey", "A", "CYANOBACTERIA", 1.0, 4.0), ("s", "survey", "A", "OTHER", 3.0, 4.0)],
        ["lake_id", "Survey", "Target_taxon", "classic.group", "biovol", "total.biov"])
    members = spark.createDataFrame([("M",)], ["Genus"])
    cells = survey.phyto_cells(rows, members, groups=True)
    full = survey.cyano_summary(cells).head()
    assert (full["rich_genus"], full["biovol_cyano_um3.mL"], full["prev_Cyano"]) == (1, 1.0, 25.0)
    assert survey.corrected_metrics(cells, without_cyano=True).head()["rich_genus_corr"] == 1
    assert survey.full_metrics(cells).head()["rich_genus"] == survey.full_metrics(survey.phyto_cells(rows, members)).head()["rich_genus"] == 1
