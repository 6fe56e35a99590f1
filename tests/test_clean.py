import time

import pytest
from pyspark.sql import functions as F

from ecospark.functions import columns as C
from ecospark.operators import clean, compose, joins, stats
from ecospark.operators.names import normalise_names


def test_names_are_cut_valid_and_unique():
    assert normalise_names(["Daphnia.pulex", "Daphnia.magna", "", "1st", "Alona sp", "Daphnia"]) == [
        "Daphnia", "Daphnia.1", "X", "X1st", "Alona.sp", "Daphnia.2",
    ]


def test_interpolation(spark):
    df = spark.createDataFrame(
        [(1, 2.0), (1, 4.0), (3, None), (5, 8.0), (9, None), (0, None)], "x int, y double"
    )
    for buckets in (2, 5, None):
        got = {r.x: r.y for r in clean.interpolate(df, "x", ["y"], buckets=buckets).distinct().collect()}
        assert got == {0: None, 1: 3.0, 3: 5.5, 5: 8.0, 9: None}


def test_interpolation_of_many_points_in_a_bucket(spark):
    # A frame that ends with the bucket, gone through for every row, took minutes here.
    df = spark.range(60_000).select("id", F.when(F.col("id") % 10_000 == 0, F.col("id") * 2.0).alias("y"))
    start = time.time()
    got = {r.id: r.y for r in clean.interpolate(df, "id", ["y"], buckets=2).collect()}
    assert time.time() - start < 60
    assert len(got) == 60_000 and all(got[i] == pytest.approx(2.0 * i) for i in range(50_001)) and got[50_001] is None


def test_interpolation_by_group(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 2, None), ("a", 3, 2.0), (None, 1, 5.0), (None, 2, None)], "g string, x int, y double")
    got = {(r.g, r.x): r.y for r in clean.interpolate(df, "x", ["y"], by=["g"]).collect()}
    assert got[("a", 2)] == 1.0 and got[(None, 2)] is None and got[(None, 1)] == 5.0


def test_merge_synonyms_propagates_missing(spark):
    df = spark.createDataFrame([("s", "a", 1.0), ("s", "a.1", 2.0), ("s", "b", 1.0), ("s", "b.1", None)], "site string, taxon string, v double")
    got = {r.taxon: r.v for r in clean.merge_synonyms(df, "site", "taxon", "v").collect()}
    assert got == {"a": 3.0, "b": None}
    got = {r.taxon: r.v for r in clean.merge_synonyms(df, "site", "taxon", "v", skip_null=True).collect()}
    assert got == {"a": 3.0, "b": 1.0}


def test_merge_synonym_columns(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0, None)], "k string, a double, `a.1` double, `Diaph.1` double")
    out = clean.merge_synonym_columns(df, "k", synonyms={"Diaph.1": "d"})
    assert out.columns == ["k", "a", "d"] and out.head()["a"] == 3.0


def test_mode_tie_takes_the_smaller(spark):
    df = spark.createDataFrame([("g", "y"), ("g", "x"), ("h", None), ("k", "z"), ("k", "z"), ("k", "a")], "g string, v string")
    assert {(r.g, r["mode"], r.n) for r in compose.mode_by(df, "g", "v").collect()} == {("g", "x", 1), ("k", "z", 2)}


def test_lump_keeps_all_when_one_level_would_go(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbc"] + [(None,)], "v string")
    two = {r.lumped for r in compose.lump_top_n(df, "v", top=2).collect()}
    one = {r.lumped for r in compose.lump_top_n(df, "v", top=1).collect()}
    assert two == {"a", "b", "c", None}
    assert one == {"a", "Other", None}


def test_lump_keeps_ties(spark):
    df = spark.createDataFrame([(v,) for v in "aaabbccde"], "v string")
    assert {r.lumped for r in compose.lump_top_n(df, "v", top=2).collect()} == {"a", "b", "c", "Other"}


def test_bins_and_missing_bin(spark):
    df = spark.createDataFrame([(100.0, "a", 1.0), (None, "b", 2.0), (0.0, "c", 3.0), (9.99, "c", 1.0)], "prev double, t string, v double")
    out = compose.composition(df, C.floor_bin(F.col("prev"), 10), "t", "v")
    got = {r.bin: r for r in out.collect()}
    assert set(got) == {11, None, 1}
    assert got[None].percent_freq == 100.0 and got[1].freq == 2 and got[1].percent_abundance == 100.0


def test_percent_sums_to_100_per_bin(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("b"), (F.col("id") % 31).cast("string").alias("t"), F.rand(1).alias("v"))
    sums = compose.composition(df, F.col("b").cast("int"), "t", "v").groupBy("bin").agg(F.sum("percent_abundance").alias("a"), F.sum("percent_freq").alias("f"))
    for r in sums.collect():
        assert r.a == pytest.approx(100) and r.f == pytest.approx(100)


def test_single_row_bin_is_dropped(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.1, 2.0), (100.0, 3.0)], "x double, y double")
    out = stats.binned_curve(df, "x", "y").collect()
    assert [r.bin for r in out] == [1]


def test_cut_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert {r.bin for r in stats.cut(df, "x", 20).collect()} == {1}


def test_perfect_prediction(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (4.0, 4.0)], "y double, p double")
    r = stats.regression_metrics(df, "y", "p", 1).head()
    assert (r.mse, r.mae, r.r2, r.r2_adj) == (0.0, 0.0, 1.0, 1.0)


def test_first_per_key_and_fill(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 9, None)], "k int, o int, v string")
    assert {tuple(r) for r in clean.first_per_key(df, ["k"], ["o"]).collect()} == {(1, 1, "a"), (2, 9, None)}


def test_exclude_value_keeps_missing(spark):
    df = spark.createDataFrame([(100.0,), (None,), (3.0,)], "p double")
    assert {r.p for r in clean.exclude_value(df, "p", 100.0).collect()} == {None, 3.0}


def test_nan_and_nullsafe_join(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, None)], "v double, k string")
    assert {r.v for r in clean.nan_to_null(df).collect()} == {None, 1.0}
    dim = spark.createDataFrame([(None, 7), ("a", 8)], "k string, w int")
    assert {(r.k, r.w) for r in joins.join_nullsafe(df, dim, ["k"]).collect()} == {("a", 8), (None, 7)}


def test_row_functions(spark):
    r = spark.createDataFrame([(1.0, None, 0.0)], "a double, b double, c double").select(
        C.row_mean(["a", "b"]).alias("m"), C.row_sum(["a", "b", "c"]).alias("s"), C.row_count_positive(["a", "b", "c"]).alias("n"),
        C.row_mean(["b"]).alias("none"), C.paste_key("a", "b").alias("k"),
    ).head()
    assert (r.m, r.s, r.n, r.none, r.k) == (1.0, 1.0, 1, None, "1.0_NA")


def test_normal(spark):
    from statistics import NormalDist
    import math
    from ecospark.functions import normal

    zs = [-9.0, -3.3, -0.2, 0.0, 0.7, 2.5, 7.5, 12.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", normal.upper_tail(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=1e-6, abs=1e-15)
    ps = spark.createDataFrame([(p,) for p in (1e-6, 0.01, 0.3, 0.5, 0.99, 0.999999)], "p double")
    for r in ps.select("p", normal.quantile(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-7)


def test_projection_origin(spark):
    from ecospark.functions.geo import EPSG_3347, project_lcc

    x, y = project_lcc(F.lit(EPSG_3347.lon_origin), F.lit(EPSG_3347.lat_origin))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).head()
    assert (r.x, r.y) == (pytest.approx(6200000, abs=1e-3), pytest.approx(3000000, abs=1e-3))


def test_unrecorded_trait_is_autotroph_or_left_out(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "t string")
    traits = spark.createDataFrame([("a", "Mixotroph"), ("b", "Autotroph"), (None, "Mixotroph")], "t string, strat string")
    members = clean.trait_set(traits, "t")
    tagged = {r.t: r.strat for r in clean.tag_trait(rows, members, "t").collect()}
    assert tagged == {"a": "Mixotroph", "b": "Autotroph", "c": "Autotroph", None: "Autotroph"}
    kept = {r.t: r.strat for r in clean.attach_trait(rows, traits, "t").collect()}
    assert kept == {"a": "Mixotroph", "b": "Autotroph"}


def test_drop_first_index_and_positions(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "row int, a string, b double")
    assert clean.select_pos(df, [1], drop=True).columns == ["a", "b"]
    assert clean.select_cols(df, drop=["row"], first=["b"]).columns == ["b", "a"]
    assert clean.add_literals(df, ["z"], 0.0).head()["z"] == 0.0


def test_table_level_helpers(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, 10.0), (4, 40.0)], "k int, w double")
    assert {r.k for r in joins.common_keys(a, b, "k").collect()} == {1}
    assert {r.k for r in joins.outer_merge(a, b, "k").collect()} == {1, 2, 3, 4}
    assert joins.bind_by_key(a, b, "k").count() == 1
    loss = clean.row_loss(a, "step").head()
    assert (loss.rows_before, loss.rows_after, loss.rows_lost) == (3, 2, 1)
    assert {(r.variable, r.nulls) for r in clean.null_profile(a).collect()} == {("k", 0), ("v", 1)}
    assert {(r.v, r.n) for r in compose.crosstab(a.withColumn("u", F.lit("q")), "v", "u").select("v", "n").collect()} == {("x", 1), ("y", 1), ("<NA>", 1)}
