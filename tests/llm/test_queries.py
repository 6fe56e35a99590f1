"""Registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import TABLES, compare
from ecospark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, con, name):
    ok, note = compare(spark, con, FOLDER, name)
    assert ok, note


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.count() <= left
        left = docs.count()
        if name != "mixing sources":
            assert docs.columns == names
    assert docs.where(F.col("mix_position").isNull()).count() == 0
    assert docs.select("mix_position").distinct().count() == left > 0
