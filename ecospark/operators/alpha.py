"""Alpha diversity.

One kernel serves every variant. Over the positive values x of a site it needs N = sum x,
A = sum x ln x and Q = sum x^2: with a total T, Shannon is -(A - N ln T) / T and Simpson's
complement 1 - Q / T^2. All are sums, so each task reduces its rows before the shuffle.
Richness needs one row per (site, taxon) first; that step also spreads a hot site over as
many tasks as it has taxa.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import percent, positive, q, ratio, row_count_positive, row_sum
from ..vocabulary import MIXOTROPH
from .joins import attach

METRICS = ["richness", "shannon", "op_simpson", "evenness"]
_NO_TAXON = "<NA>"


def alpha_diversity(
    df: DataFrame,
    by: str | Sequence[str],
    taxon: str,
    value: str,
    total: str | None = None,
    trait: Column | None = None,
    group: Column | None = None,
    where: Column | None = None,
    suffix: str = "",
    firsts: Sequence[str] = (),
    unique_cells: bool = False,
) -> DataFrame:
    """Richness, Shannon, Simpson complement, Pielou evenness and trait shares per site.

    ``total`` names a recorded total of the site; without it the total is the sum of the
    positive values. ``trait`` and ``group`` are conditions whose summed value, row count
    and percentage are reported. ``where`` restricts the rows first (corrected diversity)
    and ``suffix`` marks the metrics. ``firsts`` are columns constant per site to carry
    along. With ``unique_cells`` each (site, taxon) is known to be one row and the distinct
    step is skipped. Duplicate rows of a cell count as separate parts of the total.
    """
    by = [by] if isinstance(by, str) else list(by)
    x = q(value).cast("double")
    rows = df.where(positive(q(value)))
    if where is not None:
        rows = rows.where(where)

    def amount(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))

    sums = {
        "_n": F.sum(x),
        "_a": F.sum(x * F.ln(x)),
        "_q": F.sum(x * x),
        **({"trait_total": amount(trait), "trait_rows": F.count_if(trait)} if trait is not None else {}),
        **({"group_total": amount(group)} if group is not None else {}),
    }
    constants = {
        **({"_t": F.max(q(total).cast("double"))} if total else {}),
        **{c: F.min(q(c)) for c in firsts},
    }
    key = F.coalesce(F.col(taxon).cast("string"), F.lit(_NO_TAXON)).alias("_taxon")
    aliased = [e.alias(n) for n, e in {**sums, **constants}.items()]
    if unique_cells:
        site = rows.groupBy(*by).agg(F.count("*").alias("richness"), *aliased)
    else:
        again = [
            *[F.sum(n).alias(n) for n in sums],
            *[F.max(n).alias(n) if n == "_t" else F.min(n).alias(n) for n in constants],
        ]
        cells = rows.groupBy(*[F.col(b) for b in by], key).agg(*aliased)
        site = cells.groupBy(*by).agg(F.count("*").alias("richness"), *again)

    return _metrics(site, by, total is not None, trait is not None, group is not None, suffix, firsts)


def _metrics(
    site: DataFrame, by: list[str], recorded: bool, trait: bool, group: bool, suffix: str, firsts: Sequence[str]
) -> DataFrame:
    """Diversity from the per-site sums ``_n``, ``_a``, ``_q`` and, if recorded, ``_t``."""
    t = F.col("_t") if recorded else F.col("_n")
    shannon = ratio(F.col("_n") * F.ln(F.when(t > 0, t)) - F.col("_a"), t)
    # One taxon holding the whole total has no diversity; clear the rounding noise.
    noise = F.abs(shannon) < 1e-12
    simpson = F.lit(1.0) - ratio(F.col("_q"), t * t)
    out = site.withColumns({
        "total": t,
        "shannon": F.when(noise, F.lit(0.0)).otherwise(shannon),
        "op_simpson": F.when(F.abs(simpson) < 1e-12, F.lit(0.0)).otherwise(simpson),
    }).withColumn("evenness", ratio(F.col("shannon"), F.ln("richness")))
    names = ["total", *METRICS]
    if trait:
        out = out.withColumn("prev", percent(F.col("trait_total"), F.col("total")))
        names = ["total", "trait_total", "trait_rows", *METRICS, "prev"]
    if group:
        out = out.withColumn("group_prev", percent(F.col("group_total"), F.col("total")))
        names += ["group_total", "group_prev"]
    return out.select(
        *by, *[q(c) for c in firsts],
        *[F.col(n).alias(f"{n}{suffix}" if n in METRICS else n) for n in names],
    )


def site_cells(
    df: DataFrame, by: str | Sequence[str], taxon: str, value: str, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per site and taxon with the sums every diversity variant is made of.

    A report that needs several variants aggregates its table once into cells and derives
    alpha and beta diversity, full and corrected, from them. ``carry`` are columns constant
    per cell (a trait) or per site (a recorded total). Cells without a positive value stay,
    with ``_rows`` 0, because their site counts in beta diversity.
    """
    by = [by] if isinstance(by, str) else list(by)
    x = F.when(positive(q(value)), q(value).cast("double"))
    return df.groupBy(*by, taxon).agg(
        F.count(x).alias("_rows"), F.coalesce(F.sum(x), F.lit(0.0)).alias("_n"), F.sum(x * F.ln(x)).alias("_a"),
        F.sum(x * x).alias("_q"), *[F.max(q(c)).alias(c) for c in carry],
    )


def alpha_from_cells(
    cells: DataFrame, by: str | Sequence[str], total: str | None = None, trait: Column | None = None,
    group: Column | None = None, where: Column | None = None, suffix: str = "", firsts: Sequence[str] = (),
    taxon: str | None = None,
) -> DataFrame:
    """``alpha_diversity`` of a table already aggregated by ``site_cells``.

    Cells finer than site x taxon need ``taxon``, so that richness counts each taxon once.
    """
    by = [by] if isinstance(by, str) else list(by)
    rows = cells.where(F.col("_rows") > 0)
    if where is not None:
        rows = rows.where(where)
    zero = F.lit(0)
    site = rows.groupBy(*by).agg(
        (F.count_distinct(F.coalesce(q(taxon).cast("string"), F.lit(_NO_TAXON))) if taxon else F.count("*")).alias("richness"),
        *[F.sum(c).alias(c) for c in ("_n", "_a", "_q")],
        *([F.max(q(total)).alias("_t")] if total else []),
        *([F.coalesce(F.sum(F.when(trait, F.col("_n"))), F.lit(0.0)).alias("trait_total"),
           F.coalesce(F.sum(F.when(trait, F.col("_rows"))), zero).alias("trait_rows")] if trait is not None else []),
        *([F.coalesce(F.sum(F.when(group, F.col("_n"))), F.lit(0.0)).alias("group_total")] if group is not None else []),
        *[F.min(q(c)).alias(c) for c in firsts],
    )
    return _metrics(site, by, total is not None, trait is not None, group is not None, suffix, firsts)


def alpha_diversity_wide(
    df: DataFrame, site: str, taxa: Sequence[str] | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Metrics of the rows of an abundance matrix; every row is reported, without a shuffle.

    A row of zeros has richness 0, Shannon 0 and Simpson complement 1.
    """
    taxa = list(taxa or [c for c in df.columns if c != site])
    values = F.filter(F.array(*[q(c).cast("double") for c in taxa]), positive)
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("n", "a", "q")])
    sums = F.aggregate(values, zero, lambda s, v: F.struct(
        (s["n"] + v).alias("n"), (s["a"] + v * F.ln(v)).alias("a"), (s["q"] + v * v).alias("q")
    ))
    row = df.select(q(site), *[q(c) for c in carry], F.size(values).cast("long").alias("richness"), sums.alias("_s"))
    n = F.col("_s.n")
    shannon = F.ln(F.when(n > 0, n)) - ratio(F.col("_s.a"), n)
    return row.select(
        q(site), *[q(c) for c in carry], n.alias("total"), "richness",
        F.when((n == 0) | (F.abs(shannon) < 1e-12), F.lit(0.0)).otherwise(shannon).alias("shannon"),
        F.when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) - ratio(F.col("_s.q"), n * n)).alias("op_simpson"),
    ).withColumn("evenness", F.when(F.col("richness") > 0, ratio(F.col("shannon"), F.ln("richness"))))


def common_taxa(df: DataFrame, members: DataFrame) -> list[str]:
    """Columns of an abundance matrix that are member taxa: at most the columns reach the driver."""
    name = members.columns[0]
    found = members.where(F.col(name).isin(df.columns)).select(name).distinct().collect()
    present = {r[0] for r in found}
    return [c for c in df.columns if c in present]


def trait_summary_wide(df: DataFrame, members: DataFrame, site: str) -> DataFrame:
    """``trait_summary`` of the rows of an abundance matrix, without a shuffle."""
    taxa = [c for c in common_taxa(df, members) if c != site]
    none = F.lit(0)
    return df.select(
        q(site),
        (row_count_positive(taxa) if taxa else none.cast("long")).alias("trait_richness"),
        (row_sum(taxa) if taxa else none.cast("double")).alias("trait_total"),
    )


def group_totals_wide(df: DataFrame, groups: Mapping[str, Sequence[str]], site: str) -> DataFrame:
    """``group_totals`` of the rows of an abundance matrix, without a shuffle."""
    taxa = [c for c in df.columns if c != site]

    def total(cols: Sequence[str]) -> Column:
        return row_sum(cols) if cols else F.lit(0.0)

    return df.select(
        q(site), *[total([c for c in taxa if c in set(names)]).alias(g) for g, names in groups.items()], total(taxa).alias("total")
    )


def alpha_diversity_all_sites(
    long: DataFrame, site: str, taxon: str, value: str, unique_cells: bool = False
) -> DataFrame:
    """Metrics of every site of a long table, sites without a positive value included."""
    x = F.when(positive(q(value)), q(value).cast("double"))
    sums = {"_n": F.sum(x), "_a": F.sum(x * F.ln(x)), "_q": F.sum(x * x)}
    cells = long
    if not unique_cells:
        key = F.coalesce(F.col(taxon).cast("string"), F.lit(_NO_TAXON)).alias("_taxon")
        cells = long.groupBy(F.col(site), key).agg(F.sum(q(value).cast("double")).alias(value))
    per_site = cells.groupBy(site).agg(
        F.count_if(positive(q(value))).alias("richness"), *[e.alias(n) for n, e in sums.items()]
    )
    n = F.col("_n")
    shannon = F.ln(n) - ratio(F.col("_a"), n)
    out = per_site.select(
        site, F.coalesce(n, F.lit(0.0)).alias("total"), "richness",
        F.when(n.isNull() | (F.abs(shannon) < 1e-12), F.lit(0.0)).otherwise(shannon).alias("shannon"),
        F.when(n.isNull(), F.lit(1.0)).otherwise(F.lit(1.0) - ratio(F.col("_q"), n * n)).alias("op_simpson"),
    )
    return out.withColumn(
        "evenness", F.when(F.col("richness") > 0, ratio(F.col("shannon"), F.ln("richness")))
    )


def richness(df: DataFrame, by: str | Sequence[str], taxon: str) -> DataFrame:
    """Distinct taxa per group; a missing taxon counts as one."""
    by = [by] if isinstance(by, str) else list(by)
    key = F.coalesce(F.col(taxon).cast("string"), F.lit(_NO_TAXON)).alias("_taxon")
    return (
        df.groupBy(*[F.col(b) for b in by], key).agg(F.count("*").alias("_n"))
        .groupBy(*by).agg(F.count("*").alias("richness"))
    )


def trait_summary(df: DataFrame, members: DataFrame, site: str, taxon: str, value: str) -> DataFrame:
    """Positive taxa and summed value of the member taxa, 0 for sites without any."""
    flagged = attach(df, members.select(F.col(members.columns[0]).alias(taxon)).distinct().withColumn("_in", F.lit(True)), taxon)
    cells = flagged.groupBy(site, taxon).agg(F.sum(F.when(F.col("_in"), q(value))).alias("_v"))
    return cells.groupBy(site).agg(
        F.count_if(F.col("_v") > 0).alias("trait_richness"), F.coalesce(F.sum("_v"), F.lit(0.0)).alias("trait_total")
    )


def group_totals(
    df: DataFrame, groups: Mapping[str, Sequence[str]], site: str, taxon: str, value: str
) -> DataFrame:
    """Summed value per functional group and over all taxa; 0 where a group is absent."""
    x = q(value).cast("double")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))
    return df.groupBy(site).agg(
        *[total(F.col(taxon).isin(list(taxa))).alias(name) for name, taxa in groups.items()],
        F.coalesce(F.sum(x), F.lit(0.0)).alias("total"),
    )


def rank_diversity(df: DataFrame, by: str, ranks: Sequence[str], value: str) -> DataFrame:
    """Diversity of the taxa of each rank, their values summed per site first.

    The ranks are unpivoted, so one job serves all of them: ``by, rank, richness, ...``.
    """
    long = (
        df.where(positive(q(value)))
        .select(by, value, F.explode(F.array(*[
            F.struct(F.lit(r).alias("rank"), F.col(r).cast("string").alias("taxon")) for r in ranks
        ])).alias("_c"))
        .select(by, value, "_c.rank", "_c.taxon")
    )
    cells = long.groupBy(by, "rank", "taxon").agg(F.sum(q(value)).alias(value))
    return alpha_diversity(cells, [by, "rank"], "taxon", value, unique_cells=True)
