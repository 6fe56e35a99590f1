"""Line dedup by distinct-site spread: lines that many sites share are boilerplate.

Each line hash carries a HyperLogLog sketch of its sites. Sketches merge by aggregation, first
within tasks, so a line or a site with a third of all rows costs one sketch per task. Lines
whose estimate lies near the threshold get an exact distinct count. Boilerplate lines leave
every document but the one that holds the first copy (smallest id, then position), so no text
is lost altogether.

Defined cases. A null text stays null and has no lines; an empty text is one empty line. A null
site is no site. Lines are compared without blanks at their ends; empty lines part paragraphs and
are never boilerplate, all others are, however short, by their sites alone. Repeated rows are treated alike: all keep the first
copy or none does. Rows of one id with different texts are told apart by the text. Columns are
kept as they are; new columns replace extra ones of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpointed

BLANKS = " \t\r"


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def row_key(id_col: str, text_col: str) -> Column:
    """Stands for an (id, text) pair in joins that need not carry the text."""
    return F.md5(F.concat_ws("\n", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.col(f"`{text_col}`")))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(row, doc, pos, line hash, site) of every line that is not empty."""
    split = docs.where(F.col(f"`{text_col}`").isNotNull()).select(
        row_key(id_col, text_col).alias("row"), F.col(f"`{id_col}`").alias("doc"), F.col(f"`{site_col}`").alias("site"),
        F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("pos", "line"))
    return (
        split.withColumn("line", bare("line"))
        .where(F.col("line") != "")
        .select("row", "doc", "pos", F.unhex(F.md5("line")).alias("hash"), "site")
    )


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 10, margin: float = 0.25) -> DataFrame:
    """(hash, first): line hashes on ``min_sites`` sites or more, and their first copy.

    The sketch's relative error is 1.04 / sqrt(2 ** lg_k), 3.3 % by default; estimates within
    ``margin`` of the threshold, more than seven of those, are counted exactly.
    """
    spread = lines.groupBy("hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"),
        F.min(F.struct("doc", "pos")).alias("first"),
    ).where(F.col("sites") >= min_sites * (1 - margin))
    spread = checkpointed(spread)
    near = spread.where(F.col("sites") <= min_sites * (1 + margin))
    exact = (
        lines.join(near.select("hash"), "hash", "left_semi").where(F.col("site").isNotNull())
        .select("hash", "site").distinct().groupBy("hash").count().where(F.col("count") >= min_sites)
    )
    sure = spread.where(F.col("sites") > min_sites * (1 + margin))
    return sure.select("hash", "first").unionByName(near.join(exact, "hash", "left_semi").select("hash", "first"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
               min_sites: int = 5) -> DataFrame:
    """The documents with clean texts, and ``n_lines`` and ``n_removed``.

    Only hashes and positions of lines are shuffled; the texts move once, to meet the
    positions that go.
    """
    lines = hashed_lines(docs, id_col, text_col, site_col)
    spread = checkpointed(boilerplate(lines, min_sites))
    gone = (
        lines.drop("site").join(spread, "hash")
        .where(~F.struct("doc", "pos").eqNullSafe(F.col("first")))
        .groupBy("row").agg(F.collect_set("pos").alias("_gone"))
    )
    text = F.col(f"`{text_col}`")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "_row", "_gone", "_all")]
    held = docs.select(*[F.col(f"`{c}`") for c in names], row_key(id_col, text_col).alias("_row"))
    met = held.join(gone.withColumnRenamed("row", "_row"), "_row", "left")
    split = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), text).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    return met.select(
        *[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
