"""Site tables of the three kinds of survey, bacteria diversity and composition reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import biovolume, floor_bin, percent, q, row_sum
from ..operators import alpha, beta, clean, compose, joins, reshape
from ..sources.tables import checkpointed
from ..vocabulary import (
    AUTOTROPH, CHEMISTRY_MEANS, COMPOSITION_RANKS, CYANOBACTERIA, DIVERSITY, MIXOTROPH, SODIUM_CODE,
    ZOOPLANKTON_CODE_GROUPS, ZOOPLANKTON_GROUPS,
)

METRIC_NAMES = {"richness": "rich_genus", "evenness": "eveness_piel", "prev": "prev_Mixo"}


def named(df: DataFrame, suffix: str = "") -> DataFrame:
    """Operator column names -> survey column names."""
    return df.withColumnsRenamed({f"{a}{suffix}": f"{b}{suffix}" for a, b in METRIC_NAMES.items()})


def zoo_columns(totals: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Zooplankton biovolume per group and in total, under the survey column names."""
    return totals.select(
        "lake_id", F.col("total").alias("biovol_tot_zoo_um3.mL"), *[F.col(g).alias(f"biovol_{g}_um3.mL") for g in groups]
    )


def wide_survey_table(
    phyto: DataFrame, zoo: DataFrame, env_sheets: Sequence[DataFrame], members: DataFrame,
    groups: Mapping[str, Sequence[str]] = ZOOPLANKTON_CODE_GROUPS, drop: Sequence[str] = (),
) -> DataFrame:
    """Site table of a survey stored as abundance matrices.

    ``phyto`` and ``zoo`` have one row per ``lake_id`` and one column per taxon, repeats
    numbered ``.1``, ``.2``. Everything about a site is in its row, so merging synonyms and
    the metrics need no shuffle; only the joins by site do. Environment sheets are joined
    in order, and keep sites without plankton.
    """
    merged = clean.merge_synonym_columns(phyto, "lake_id")
    taxa = [c for c in merged.columns if c != "lake_id"]
    traits = [c for c in alpha.common_taxa(merged, members) if c != "lake_id"]
    metrics = alpha.alpha_diversity_wide(merged.withColumn("_trait", row_sum(traits) if traits else F.lit(0.0)), "lake_id", taxa, ["_trait"])
    phyto_sites = named(metrics.withColumn("prev", percent(F.col("_trait"), F.col("total"))))
    zoo_sites = alpha.group_totals_wide(clean.merge_synonym_columns(zoo, "lake_id"), groups, "lake_id")
    env = joins.attach_all(env_sheets, "lake_id")
    out = joins.attach(env, phyto_sites.select("lake_id", *DIVERSITY, "prev_Mixo"), "lake_id")
    out = joins.attach(out, zoo_columns(zoo_sites, groups), "lake_id")
    return clean.select_cols(out, drop=drop, first=["lake_id"])


def phyto_cells(phyto: DataFrame, members: DataFrame, groups: bool = False) -> DataFrame:
    """Long phytoplankton aggregated once: site x genus with trait and recorded total.

    With ``groups`` the cells are site x group x genus, as a genus may be recorded in several groups.
    """
    rows = phyto.withColumnsRenamed({"Target_taxon": "Genus", "total.biov": "total", "classic.group": "group"})
    by = ["lake_id", "group"] if groups else ["lake_id"]
    cells = alpha.site_cells(rows, by, "Genus", "biovol", carry=["Survey", "total"])
    return clean.tag_trait(cells, members, "Genus")


def taxon_of(cells: DataFrame) -> str | None:
    """The taxon to count, where one may fill several cells of a site."""
    return "Genus" if "group" in cells.columns else None


def is_trait(label: str) -> Column:
    return F.col("strat") == label


def full_metrics(cells: DataFrame) -> DataFrame:
    return named(alpha.alpha_from_cells(cells, "lake_id", total="total", trait=is_trait(MIXOTROPH), taxon=taxon_of(cells)))


def corrected_metrics(cells: DataFrame, without_cyano: bool = False) -> DataFrame:
    """Metrics of the autotrophs; ``without_cyano`` needs cells by group."""
    where = is_trait(AUTOTROPH)
    if without_cyano:
        where = where & (F.col("group") != CYANOBACTERIA)
    return named(alpha.alpha_from_cells(cells, "lake_id", where=where, suffix="_corr", taxon=taxon_of(cells)), "_corr").drop("total")


def cyano_summary(cells: DataFrame) -> DataFrame:
    """Full metrics with the biovolume and prevalence of cyanobacteria, from cells by group."""
    out = alpha.alpha_from_cells(
        cells, "lake_id", total="total", trait=is_trait(MIXOTROPH), group=F.col("group") == CYANOBACTERIA, firsts=["Survey"],
        taxon=taxon_of(cells),
    )
    return named(out).withColumnsRenamed({"group_total": "biovol_cyano_um3.mL", "group_prev": "prev_Cyano"})


def long_survey_table(
    phyto: DataFrame, zoo: DataFrame, env: DataFrame, members: DataFrame,
    groups: Mapping[str, Sequence[str]] = ZOOPLANKTON_GROUPS,
    drop: Sequence[str] = ("Survey", "secchi_bottom", "Stratification"),
) -> DataFrame:
    """Site table of a survey stored as long abundance rows.

    Full and corrected alpha diversity and LCBD all derive from one site x genus table, so
    the abundance rows are read and shuffled once. ``zoo`` is long: ``lake_id, taxon,
    value``. Sites without full or corrected diversity are left out.
    """
    cells = checkpointed(phyto_cells(phyto, members))
    full, corr = full_metrics(cells), corrected_metrics(cells)
    lcbd = beta.lcbd(cells, "lake_id", "Genus", "_n", unique_cells=True).select("lake_id", F.col("log_lcbd").alias("log_LCBD"))
    lcbd_corr = beta.lcbd(cells, "lake_id", "Genus", "_n", where=is_trait(AUTOTROPH), unique_cells=True).select(
        "lake_id", F.col("log_lcbd").alias("log_LCBD_corr")
    )
    tables = [
        env, full.select("lake_id", *DIVERSITY, "prev_Mixo"), corr, zoo_columns(alpha.group_totals(zoo, groups, "lake_id", "taxon", "value"), groups), lcbd, lcbd_corr
    ]
    out = clean.select_cols(joins.attach_all(tables, "lake_id"), drop=drop)
    return clean.require(out, ["shannon", "eveness_piel", "shannon_corr", "eveness_piel_corr"])


def species_densities(density: DataFrame, codes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Dated densities with genus, taxonomy and biovolume; incomplete rows are left out."""
    rows = density.select(
        F.col("monitoring_location_name").alias("lake_id"), F.to_date("date_collected").alias("date_sampling"),
        "species_code", biovolume(F.col("density"), F.col("volume_cell")).alias("biovol"),
    )
    rows = joins.attach(rows, codes.select("species_code", F.col("genus").alias("Genus")), "species_code")
    return clean.drop_incomplete(joins.attach(rows, taxonomy, "Genus"))


def chemistry_means(
    chemistry: DataFrame, analytes: Mapping[str, str] = CHEMISTRY_MEANS, missing_code: str = SODIUM_CODE
) -> DataFrame:
    """Daily mean of every analyte per site: a mean over sampling times of their means.

    An analyte is named ``code_unit``; a missing code is sodium, whose symbol reads as
    missing. One missing value makes the mean of its sampling time missing.
    """
    rows = clean.fill_null(chemistry, {"characteristic_name": missing_code})
    unit = F.regexp_replace("result_unit", "/", ".")
    rows = rows.withColumn("analyte", F.concat_ws("_", "characteristic_name", F.coalesce(unit, F.lit(""))))
    wide = reshape.pivot_mean(
        rows, ["monitoring_location_name", "activity_start_date"], "analyte", "result_value", list(analytes)
    )
    return wide.groupBy(
        F.to_date("activity_start_date").alias("date_sampling"), F.col("monitoring_location_name").alias("lake_id")
    ).agg(*[F.avg(q(a)).alias(m) for a, m in analytes.items()])


def dated_survey_table(
    density: DataFrame, codes: DataFrame, taxonomy: DataFrame, chemistry: DataFrame, physical: DataFrame,
    analytes: Mapping[str, str] = CHEMISTRY_MEANS,
) -> DataFrame:
    """Sample table (site and date) with chemistry, full and corrected diversity.

    ``physical`` is keyed by ``lake_id``. Samples without chemistry or evenness are left out.
    """
    rows = species_densities(density, codes, taxonomy)
    key = ["lake_id", "date_sampling"]
    cells = checkpointed(alpha.site_cells(rows, key, "Genus", "biovol", carry=["strat"]))
    full = named(alpha.alpha_from_cells(cells, key, trait=is_trait(MIXOTROPH)))
    corr = named(alpha.alpha_from_cells(cells, key, where=is_trait(AUTOTROPH), suffix="_corr"), "_corr").drop("total")
    env = joins.attach(chemistry_means(chemistry, analytes), physical, "lake_id")
    out = joins.attach(env, full.select(*key, *DIVERSITY, "prev_Mixo"), key)
    out = clean.require(joins.attach(out, corr, key), ["shannon", "eveness_piel"])
    out = out.withColumns({"doy": F.dayofyear("date_sampling"), "yr": F.year("date_sampling")})
    return clean.select_cols(out, drop=["date_sampling"], first=["lake_id"])


def rank_site_table(
    counts: DataFrame, sites: DataFrame, keep: DataFrame, taxon_cols: Sequence[str], ranks: Sequence[str]
) -> DataFrame:
    """Site table with the bacterial diversity of each rank.

    ``counts`` has taxon columns and one column per site; ``keep`` lists the sites wanted.
    Rows with a missing rank are left out, as in the survey.
    """
    long = reshape.to_long(counts, list(taxon_cols), "lake_id", "abundance")
    long = clean.drop_incomplete(long)
    per_rank = alpha.rank_diversity(long, "lake_id", list(ranks), "abundance")
    wide = per_rank.groupBy("lake_id").agg(*[
        F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{n}_{r.lower()}_bact")
        for r in ranks
        for c, n in (("richness", "rich"), ("total", "ab_tot"), ("shannon", "H"), ("op_simpson", "one_minus_D"), ("evenness", "J"))
    ])
    return joins.attach(joins.keep_sites(sites, keep, "lake_id"), wide, "lake_id")


def composition_report(
    abundance: DataFrame, prevalence: DataFrame, key: str | Sequence[str], value: str,
    ranks: Sequence[str] = COMPOSITION_RANKS, bins: int = 10, saturated: bool = True,
) -> DataFrame:
    """Composition and taxon richness per prevalence bin for every rank.

    ``prevalence`` holds the key and ``prev_Mixo``; ``saturated=False`` leaves out sites at
    exactly 100 percent. Both results come from one (rank, bin, taxon) table, made in one
    pass over the abundance rows.
    """
    rows = joins.attach(abundance, prevalence, key)
    if not saturated:
        rows = clean.exclude_value(rows, "prev_Mixo", 100.0)
    cells = checkpointed(compose.rank_cells(rows, floor_bin(F.col("prev_Mixo"), 100 // bins), ranks, value))
    table = compose.composition_of_cells(cells)
    return joins.join_nullsafe(table, compose.richness_of_cells(cells), ["rank", "bin"])

