"""Sorts and aggregates that follow on one key are dealt to as many tasks as their rows call for."""

from pyspark.sql import functions as F

from ecospark.bindings import QUERIES
from ecospark.sources.tables import spread


def tables(spark, folder):
    line = "l_suppkey long, l_partkey long, l_quantity double, l_discount double, l_shipdate timestamp"
    rows = [(s, p, 2.0, 0.1 * (p % 2), None) for s in range(3) for p in range(4)]
    spark.createDataFrame(rows, line).withColumn("l_shipdate", F.to_timestamp(F.lit("1995-02-01"))).write.parquet(f"{folder}/lineitem.parquet")
    part = [(p, "b", "ECONOMY" if p == 1 else "SMALL") for p in range(4)]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string").write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_rows_are_dealt_by_their_number(spark):
    df = spread(spark.range(10), 1_000_000, "id", piece=1000)
    assert df.rdd.getNumPartitions() == 1000 and df.count() == 10
    assert spread(spark.range(10), 10, "id").rdd.getNumPartitions() == 8


def test_recorded_totals_are_dealt(spark, tmp_path, capsys):
    folder = tables(spark, tmp_path)
    for name in ("alpha_recorded_total", "group_summary"):
        df = QUERIES[name](spark, folder)
        df.explain()
        assert "REPARTITION_BY_NUM" in capsys.readouterr().out
        assert {(r.l_suppkey, r.richness, r.total, r.prev) for r in df.collect()} == {(s, 2, 8.0, 25.0) for s in range(3)}


def test_dated_samples_are_dealt(spark, tmp_path, monkeypatch, capsys):
    from ecospark.operators import beta

    seen = []
    build = beta.BetaTable.build.__func__

    def built(cls, df, *args):
        df.explain()
        seen.append(capsys.readouterr().out)
        return build(cls, df, *args)

    monkeypatch.setattr(beta.BetaTable, "build", classmethod(built))
    rows = QUERIES["lcbd_dated"](spark, tables(spark, tmp_path)).collect()
    assert {r["sample"] for r in rows} == {f"{s}_32" for s in range(3)}
    assert seen[0].count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in seen[0]
