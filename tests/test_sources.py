import pytest
from pyspark.sql import types as T

from ecospark.plans import harmonise, survey, taxonomy
from ecospark.schemas import LONG_ABUNDANCE, struct, wide
from ecospark.sources import tables as io
from ecospark.vocabulary import HARMONISED


def test_csv_reads_na_as_missing(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    (tmp_path / "a.csv").write_text("lake_id,Survey,Target_taxon,classic.group,biovol,total.biov\n1,x,NA,g,NA,3.5\n")
    r = io.read_table(spark, path, LONG_ABUNDANCE).head()
    assert r["Target_taxon"] is None and r["biovol"] is None and r["total.biov"] == 3.5
    with pytest.raises(ValueError):
        io.read_table(spark, path)


def test_decimal_comma(spark, tmp_path):
    (tmp_path / "b.csv").write_text("k;a;b\ns1;1,5;x\ns2;NA;2,25\n")
    out = io.read_decimal_comma(spark, str(tmp_path / "b.csv"), wide("k", ["a", "b"])).collect()
    assert [tuple(r) for r in out] == [("s1", 1.5, None), ("s2", None, 2.25)]


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_promote_header_skips_only_the_first_rows(spark, tmp_path, block):
    body = "".join(f"{i};lake{i};{i},5;1\n" for i in range(50))
    # The banner rows equal body rows, so they can only be told apart by position.
    (tmp_path / "c.csv").write_text("1;ALL;Daph.a;Daph.b\n0;lake0;0,5;1\n0;lake0;0,5;1\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        out = io.promote_header(spark, str(tmp_path / "c.csv"), "lake_id")
        assert out.columns == ["lake_id", "Daph", "Daph.1"]
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r.lake_id for r in rows) == sorted(f"lake{i}" for i in range(50))
    assert {r.lake_id: r.Daph for r in rows}["lake7"] == 7.5


def test_partitioned_write_and_index(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "rank string, v int")
    io.write_partitioned(df, str(tmp_path / "p"), ["rank"])
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"rank=a", "rank=b"}
    assert io.drop_index(df).columns == ["v"]


def test_checkpoint_lies_below_the_configured_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = io.scratch_path(spark, "x")
    assert root is None or path.startswith(root)


def test_taxonomy(spark):
    cols = ["Empire", "Kingdom", "Phylum", "Class", "Order", "Family", "Genus", "Final_Nutrition_Strategy"]
    info = spark.createDataFrame([("e", "k", "p", "c", "o", "f", "G1", "Mixotroph"), ("e", "k", "p", "c", "o", "f", "G2", "Autotroph")], cols)
    codes = spark.createDataFrame([("s1", "G1"), ("s2", "G1"), ("s3", "G1")], ["species_code", "genus"])
    trophic = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s3", "m")], ["species_code", "trophic_type"])
    opinions = taxonomy.second_opinion(info, codes, trophic)
    assert [tuple(r) for r in taxonomy.opinion_conflicts(opinions).collect()] == [("G1", "Mixotroph", "Autotroph")]
    assert {tuple(r) for r in taxonomy.opinion_crosstab(opinions).collect()} == {("Mixotroph", "Autotroph", 1), ("Autotroph", "<NA>", 1)}
    assert taxonomy.taxonomy_dimension(info).columns[-1] == "strat"


def test_harmonised_schema(spark):
    wide_df = spark.createDataFrame([("l1", 2.0, 0.5)], "lake_id string, `doc.mgl` double, `tn.mgl` double")
    dated = spark.createDataFrame([("l2", 100.0)], "lake_id string, `mean_DOC_umol.L` double")
    out = harmonise.harmonised_union({"wide": wide_df, "dated": dated}, placeholder=0.0)
    assert set(HARMONISED["wide"]) | set(HARMONISED["dated"]) | {"dataset"} == set(out.columns)
    rows = {r.lake_id: r for r in out.collect()}
    assert rows["l1"]["TN_ug.L"] == 500.0 and rows["l2"]["DOC_mg.L"] == pytest.approx(1.2)
    assert rows["l1"]["sech_m"] is None and rows["l2"]["sech_m"] == 0.0


def test_chemistry_units_and_sodium(spark):
    schema = struct(
        monitoring_location_name=T.StringType(), activity_start_date=T.StringType(), characteristic_name=T.StringType(),
        result_value=T.DoubleType(), result_unit=T.StringType(),
    )
    rows = [("l", "2001-05-01", None, 2.0, "mg/L"), ("l", "2001-05-01", None, 4.0, "mg/L"), ("l", "2001-05-01", "PH", 7.0, None)]
    r = survey.chemistry_means(spark.createDataFrame(rows, schema)).head()
    assert r["mean_SO_mg.L"] == 3.0 and r["mean_pH"] == 7.0 and r["mean_CA_mg.L"] is None
