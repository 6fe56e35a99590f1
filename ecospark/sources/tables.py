"""Reading and writing tables and models."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import decimal_comma
from ..operators.names import normalise_names


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ","
) -> DataFrame:
    """Parquet, or delimited text with a header, an explicit schema and NA as missing."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select(*[F.col(f"`{c}`") for c in schema.names]) if schema else df
    if schema is None:
        raise ValueError("delimited text needs an explicit schema")
    return spark.read.csv(path, schema=schema, sep=sep, header=True, nullValue="NA")


def read_decimal_comma(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ";"
) -> DataFrame:
    """Delimited text whose numbers carry a decimal comma.

    Double columns of the schema are read as text and converted; unreadable text is NULL.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    raw = read_table(spark, path, as_text, sep)
    return raw.select(*[
        (decimal_comma(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.DoubleType)
         else F.col(f"`{f.name}`").cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def promote_header(
    spark: SparkSession, path: str, key: str, banner_rows: int = 3, sep: str = ";"
) -> DataFrame:
    """One headerless text file whose first row names the taxa.

    The first column is an index and goes away, the first name becomes ``key``, the other
    names are normalised, and the ``banner_rows`` leading rows (the name row among them)
    are not data. Only the name row reaches the driver.
    """
    first = spark.read.text(path).head()
    names = first[0].split(sep)[1:]
    names = normalise_names([key, *names[1:]])
    raw = T.StructType(
        [T.StructField("_index", T.StringType()), *(T.StructField(n, T.StringType()) for n in names)]
    )
    body = (
        spark.read.csv(path, schema=raw, sep=sep, header=False, nullValue="NA")
        .select("*", F.col("_metadata.file_block_start").alias("_start"),
                F.monotonically_increasing_id().alias("_id"))
        # The block at offset 0 is the first one of its task, so the low bits count file rows.
        .where(~((F.col("_start") == 0)
                 & (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) < banner_rows)))
    )
    values = [decimal_comma(F.col(f"`{n}`")).alias(n) for n in names[1:]]
    return body.select(F.col(f"`{names[0]}`"), *values)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table, CSV with a header and NA for missing."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    writer.format(fmt).save(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "parquet") -> None:
    """One sub-folder per combination of the ``by`` columns, written in one job."""
    df.write.mode("overwrite").partitionBy(*by).format(fmt).save(path)


def drop_index(df: DataFrame) -> DataFrame:
    """Drop the stored row-name column, which comes first."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[1:]])


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(model_class, path: str):
    return model_class.load(path)


def scratch_root(spark: SparkSession) -> str:
    """This run's folder below the shared checkpoint folder.

    Without ``spark.checkpoint.dir`` a session in one process uses a local folder; on a cluster,
    whose machines do not share one, that is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    return os.path.join(root, f"ecospark-{context.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder of this run."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession) -> None:
    """Remove the materialised tables of this run; results that read them must be written before."""
    drop_path(spark, scratch_root(spark))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove one materialised table; what reads it must be written before."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame, path: str | None = None) -> DataFrame:
    """Materialise as a table in the shared checkpoint folder, cutting the lineage.

    Read back from files, the table survives lost executors, is pruned by column, and has
    a size Spark knows when it chooses a join. ``path`` is a ``scratch_path`` for a table that is dropped early.
    """
    path = path or scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str, piece: int = 250_000) -> DataFrame:
    """Rows dealt by their keys to as many tasks as ``rows`` call for.

    Spark merges shuffle partitions by their compressed bytes; sorts and aggregates that follow one another on the
    same keys then hold millions of rows in one task. A given number of partitions stays as it is.
    """
    return df.repartition(max(-(-rows // piece), 8), *keys)
