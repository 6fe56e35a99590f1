"""Taxonomic composition: modes, contingency tables, lumping, composition by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import percent, q
from ..sources.tables import checkpointed
from .joins import attach, join_nullsafe

TOP_TAXA = 15
OTHER = "Other"


def mode_by(df: DataFrame, by: str | Sequence[str], col: str) -> DataFrame:
    """Most frequent present value per group, ties to the smaller value: ``*by, mode, n``."""
    by = [by] if isinstance(by, str) else list(by)
    counts = df.dropna(subset=[*by, col]).groupBy(*by, col).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("m"), F.col(col).alias("v")))
    return counts.groupBy(*by).agg(best.alias("_best")).select(
        *by, F.col("_best.v").alias("mode"), (-F.col("_best.m")).alias("n")
    )


def crosstab(df: DataFrame, a: str, b: str, missing: str = "<NA>") -> DataFrame:
    """Counts of value pairs in long form, a missing value being a level: ``a, b, n``."""
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c)
    return df.groupBy(level(a), level(b)).agg(F.count("*").alias("n"))


def kept_levels(counts: DataFrame, level: str, n: str, top: int, by: Sequence[str] = ()) -> DataFrame:
    """Levels that survive lumping, from a table of level counts.

    A level is kept when fewer than ``top`` levels are more frequent. When that would leave
    at most one level to lump, every level is kept. Missing levels take no part. The cut-off
    count is found by a per-group top-n, which each task applies before the shuffle.
    """
    by = list(by)
    present = counts.where(F.col(level).isNotNull())
    ranked = present.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(n).desc()))
    )
    cut = ranked.where(F.col("_r") <= top).groupBy(*by).agg(F.min(n).alias("_cut"))
    marked = join_nullsafe(present, cut, by) if by else present.withColumn(
        "_cut", cut.select("_cut").scalar()
    )
    below = marked.groupBy(*by).agg(F.count_if(F.col(n) < F.col("_cut")).alias("_below"))
    marked = join_nullsafe(marked, below, by) if by else marked.withColumn(
        "_below", below.select("_below").scalar()
    )
    keep = (F.col(n) >= F.col("_cut")) | (F.col("_below") <= 1)
    return marked.where(keep).select(*by, level)


def lump_top_n(
    df: DataFrame, col: str, top: int = TOP_TAXA, other: str = OTHER, name: str = "lumped"
) -> DataFrame:
    """Replace every level outside the most frequent ones by one label; missing stays."""
    counts = df.groupBy(col).agg(F.count("*").alias("_n"))
    # Materialised, so that Spark knows its size when it joins it to the rows.
    kept = checkpointed(kept_levels(counts, col, "_n", top)).withColumn("_kept", F.lit(True))
    lumped = F.when(F.col("_kept") | F.col(col).isNull(), F.col(col).cast("string"))
    return attach(df, kept, col).withColumn(name, lumped.otherwise(F.lit(other))).drop("_kept")


def rank_cells(df: DataFrame, bin_col: Column, ranks: Sequence[str], value: str) -> DataFrame:
    """Rows and summed value per (rank, bin, taxon): the one pass over the data."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rank"), F.col(r).cast("string").alias("taxon")) for r in ranks
    ]))
    return (
        df.select(bin_col.alias("bin"), q(value).cast("double").alias("_x"), cells.alias("_c"))
        .groupBy("_c.rank", "bin", "_c.taxon")
        .agg(F.count("*").alias("freq"), F.coalesce(F.sum("_x"), F.lit(0.0)).alias("abundance"))
    )


def composition_all_ranks(
    df: DataFrame, bin_col: Column, ranks: Sequence[str], value: str, top: int = TOP_TAXA
) -> DataFrame:
    """Composition of every bin for every rank in one job.

    ``rank, bin, taxon, freq, abundance, percent_freq, percent_abundance``; rare taxa are
    lumped per rank over all bins. Rows without a bin form a group of 100 percent rows.
    """
    return composition_of_cells(checkpointed(rank_cells(df, bin_col, ranks, value)), top)


def composition_of_cells(cells: DataFrame, top: int = TOP_TAXA) -> DataFrame:
    """``composition_all_ranks`` of a table made by ``rank_cells``."""
    levels = cells.groupBy("rank", "taxon").agg(F.sum("freq").alias("_n"))
    kept = kept_levels(levels, "taxon", "_n", top, ["rank"]).withColumn("_kept", F.lit(True))
    name = F.when(F.col("_kept") | F.col("taxon").isNull(), F.col("taxon")).otherwise(F.lit(OTHER))
    table = (
        attach(cells, kept, ["rank", "taxon"]).withColumn("taxon", name)
        .groupBy("rank", "bin", "taxon")
        .agg(F.sum("freq").alias("freq"), F.sum("abundance").alias("abundance"))
    )
    totals = table.groupBy("rank", "bin").agg(
        F.sum("freq").alias("_freq"), F.sum("abundance").alias("_abundance")
    )
    whole = F.col("bin").isNull()
    return join_nullsafe(table, totals, ["rank", "bin"]).select(
        "rank", "bin", "taxon", "freq", "abundance",
        F.when(whole, F.lit(100.0)).otherwise(percent(F.col("freq"), F.col("_freq"))).alias("percent_freq"),
        F.when(whole, F.lit(100.0)).otherwise(percent(F.col("abundance"), F.col("_abundance")))
        .alias("percent_abundance"),
    )


def composition(
    df: DataFrame, bin_col: Column, taxon: str, value: str, top: int = TOP_TAXA
) -> DataFrame:
    """Composition of every bin for one rank."""
    return composition_all_ranks(df, bin_col, [taxon], value, top).drop("rank")


def richness_bins(df: DataFrame, bin_col: Column, ranks: Sequence[str], value: str) -> DataFrame:
    """Distinct taxa per rank and bin before lumping, a missing taxon counting as one."""
    return richness_of_cells(rank_cells(df, bin_col, ranks, value))


def richness_of_cells(cells: DataFrame) -> DataFrame:
    """``richness_bins`` of a table made by ``rank_cells``."""
    return cells.groupBy("rank", "bin").agg(F.count("*").alias("richness"))
