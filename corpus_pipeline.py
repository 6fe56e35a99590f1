"""From documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a table
that is written as Parquet in the shared checkpoint folder and read again, so a lost executor
costs the work of one stage at most. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecospark.llm import contamination, lines, mixing, simhash, toxicity
from ecospark.sources.tables import checkpointed

#: Stages 1 to 4 include a trained model, sketches and a graph, which SQL does not express.
ORACLE_SQL = None


def columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of this input's labels does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.labelled(docs, labels))
    return columns(toxicity.scan(docs, model).where("predicted = 0"), docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; lengths follow the new texts."""
    done = columns(lines.line_dedup(docs), docs)
    return columns(done.withColumn("n_chars", F.char_length("text").cast("long")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return columns(simhash.near_dedup(docs, shingle=4, most=4), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not overlap with the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return columns(contamination.contamination(docs, benchmark).where(~F.col("contaminated")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their places in the mixture."""
    return mixing.mix(docs, mixing.tempered_weights(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture made of the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
