"""Alpha diversity queries: site = supplier, taxon = part, abundance = quantity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alpha, reshape
from ..sources.tables import spread
from .registry import auto, cyano, mixo, out, query

BRAND_GROUPS = {
    "cladocera": ["STANDARD", "SMALL"],
    "copepoda": ["MEDIUM", "LARGE"],
    "other": ["ECONOMY"],
}
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
METRICS = ["total", "shannon", "op_simpson", "evenness"]
LINES = "select l.*, p.* from lineitem l join part p on l.l_partkey = p.p_partkey"


def textbook(rows: str, total: str, extra: str = "") -> str:
    """Diversity from relative abundances, site by site."""
    return f"""
    with rows as ({rows}),
    site as (select l_suppkey, {total} as t from rows group by l_suppkey),
    p as (select r.*, t, l_quantity / nullif(t, 0) as p from rows r join site using (l_suppkey))
    select l_suppkey, round(any_value(t), 6) as total,
           count(distinct l_partkey) as richness,
           round(-sum(p * ln(p)), 6) + 0.0 as shannon,
           round(1 - sum(p * p), 6) + 0.0 as op_simpson,
           round(-sum(p * ln(p)) / nullif(ln(count(distinct l_partkey)), 0), 6) as evenness{extra}
    from p group by l_suppkey"""


TRAIT_SQL = """,
           cast(sum(case when p_type in ('PROMO','SMALL') then 1 else 0 end) as bigint) as trait_rows,
           round(coalesce(sum(case when p_type in ('PROMO','SMALL') then l_quantity end), 0), 6) as trait_total,
           round(100 * coalesce(sum(case when p_type in ('PROMO','SMALL') then l_quantity end), 0)
                 / nullif(any_value(t), 0), 6) as prev"""
GROUP_SQL = """,
           round(coalesce(sum(case when p_type = 'ECONOMY' then l_quantity end), 0), 6) as group_total,
           round(100 * coalesce(sum(case when p_type = 'ECONOMY' then l_quantity end), 0)
                 / nullif(any_value(t), 0), 6) as group_prev"""
RECORDED = """select * from (select l.* replace (case when l_discount > 0 then l_quantity else 0 end as l_quantity), p.*, r.recorded
    from lineitem l join part p on l.l_partkey = p.p_partkey
    join (select l_suppkey, sum(l_quantity) as recorded from lineitem group by l_suppkey) r using (l_suppkey))
    where l_quantity > 0"""


def recorded_rows(t):
    """Lines with the supplier total over all its lines; undiscounted lines count zero, which the total ignores."""
    totals = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("recorded"))
    counted = F.when(F.col("l_discount") > 0, F.col("l_quantity")).otherwise(0.0)
    # The join and the cells of a supplier follow in one task.
    lines = spread(t.lines.withColumn("l_quantity", counted), t.lineitem.count(), "l_suppkey")
    return lines.join(totals, "l_suppkey")


@query("alpha_long", textbook(LINES, "sum(l_quantity)", TRAIT_SQL))
def alpha_long(t):
    df = alpha.alpha_diversity(t.lines, "l_suppkey", "l_partkey", "l_quantity", trait=mixo())
    return out(df, ["l_suppkey", "richness", "trait_rows"], [*METRICS, "trait_total", "prev"])


@query("alpha_recorded_total", textbook(RECORDED, "any_value(recorded)", TRAIT_SQL))
def alpha_recorded_total(t):
    df = alpha.alpha_diversity(
        recorded_rows(t), "l_suppkey", "l_partkey", "l_quantity", total="recorded", trait=mixo()
    )
    return out(df, ["l_suppkey", "richness", "trait_rows"], [*METRICS, "trait_total", "prev"])


@query("group_summary", textbook(RECORDED, "any_value(recorded)", TRAIT_SQL + GROUP_SQL))
def group_summary(t):
    df = alpha.alpha_diversity(
        recorded_rows(t), "l_suppkey", "l_partkey", "l_quantity", total="recorded", trait=mixo(), group=cyano()
    )
    return out(df, ["l_suppkey", "richness", "trait_rows"],
               [*METRICS, "trait_total", "prev", "group_total", "group_prev"])


def corrected_sql(where: str) -> str:
    return f"""select l_suppkey, total, richness as richness_corr, shannon as shannon_corr,
        op_simpson as op_simpson_corr, evenness as evenness_corr
        from ({textbook(LINES + " where " + where, "sum(l_quantity)")})"""


CORR = ["total", "shannon_corr", "op_simpson_corr", "evenness_corr"]


@query("alpha_corrected", corrected_sql("p_type not in ('PROMO','SMALL')"))
def alpha_corrected(t):
    df = alpha.alpha_diversity(
        t.lines, "l_suppkey", "l_partkey", "l_quantity", where=auto(), suffix="_corr"
    )
    return out(df, ["l_suppkey", "richness_corr"], CORR)


@query("alpha_no_group", f"""
    select c.*, prev from ({corrected_sql("p_type not in ('PROMO','SMALL') and p_type <> 'ECONOMY'")}) c
    left join (select l_suppkey, prev from ({textbook(LINES, "sum(l_quantity)", TRAIT_SQL)})) using (l_suppkey)""")
def alpha_no_group(t):
    corrected = alpha.alpha_diversity(
        t.lines, "l_suppkey", "l_partkey", "l_quantity", where=auto() & ~cyano(), suffix="_corr"
    )
    full = alpha.alpha_diversity(t.lines, "l_suppkey", "l_partkey", "l_quantity", trait=mixo())
    df = corrected.join(full.select("l_suppkey", "prev"), "l_suppkey", "left")
    return out(df, ["l_suppkey", "richness_corr"], [*CORR, "prev"])


@query("taxon_richness", "select l_suppkey, count(distinct l_partkey) as richness from lineitem group by l_suppkey")
def taxon_richness(t):
    return alpha.richness(t.lineitem, "l_suppkey", "l_partkey")


WIDE_SQL = """
    with sites as (select distinct l_orderkey from lineitem), taxa as (select distinct p_type from part),
    y as (select l_orderkey, p_type, sum(case when l_quantity > 25 then l_quantity else 0 end) as v
          from lineitem join part on l_partkey = p_partkey group by all),
    grid as (select l_orderkey, p_type, coalesce(v, 0) as v from sites cross join taxa left join y using (l_orderkey, p_type)),
    s as (select l_orderkey, sum(v) as t, count(*) filter (v > 0) as richness from grid group by 1),
    h as (select l_orderkey, -sum(case when v > 0 then v / t * ln(v / t) end) as sh, 1 - sum(case when v > 0 then v / t * v / t end) as si
          from grid join s using (l_orderkey) group by 1)
    select l_orderkey, cast(richness as bigint) as richness, round(t, 10) as total, round(coalesce(sh, 0), 10) + 0.0 as shannon,
           round(coalesce(si, 1), 10) + 0.0 as op_simpson,
           round(case when richness > 0 then coalesce(sh, 0) / nullif(ln(richness), 0) end, 10) + 0.0 as evenness
    from s join h using (l_orderkey)"""


@query("alpha_wide", WIDE_SQL)
def alpha_wide(t):
    kept = t.lines.withColumn("v", F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0.0))
    wide = reshape.to_wide(kept, "l_orderkey", "p_type", "v", TYPES)
    return out(alpha.alpha_diversity_wide(wide, "l_orderkey", TYPES), ["l_orderkey", "richness"], METRICS, 10)


@query("species_diversity", """
    with y as (select l_suppkey, p_brand, sum(l_quantity) as v from lineitem join part on l_partkey = p_partkey group by all),
    p as (select *, v / sum(v) over (partition by l_suppkey) as p from y)
    select l_suppkey, count(*) as richness, round(sum(v), 6) as total, round(-sum(p * ln(p)), 6) as shannon,
           round(1 - sum(p * p), 6) as op_simpson, round(-sum(p * ln(p)) / nullif(ln(count(*)), 0), 6) as evenness
    from p group by 1""")
def species_diversity(t):
    df = alpha.alpha_diversity_all_sites(t.lines, "l_suppkey", "p_brand", "l_quantity")
    return out(df, ["l_suppkey", "richness"], METRICS)


@query("group_totals", """
    select l_suppkey,
        coalesce(sum(l_quantity) filter (p_type in ('STANDARD','SMALL')), 0) as cladocera,
        coalesce(sum(l_quantity) filter (p_type in ('MEDIUM','LARGE')), 0) as copepoda,
        coalesce(sum(l_quantity) filter (p_type = 'ECONOMY'), 0) as other, sum(l_quantity) as total
    from lineitem join part on l_partkey = p_partkey group by 1""")
def group_totals(t):
    return alpha.group_totals(t.lines, BRAND_GROUPS, "l_suppkey", "p_type", "l_quantity")


@query("trait_summary", """
    with c as (select l_orderkey, l_partkey, sum(l_quantity) as v from lineitem join part on l_partkey = p_partkey
               where p_type in ('PROMO','SMALL') group by all)
    select l_orderkey, count(v) as trait_richness, coalesce(sum(v), 0) as trait_total
    from (select distinct l_orderkey from lineitem) left join c using (l_orderkey) group by 1""")
def trait_summary(t):
    members = t.part.where(mixo()).select("p_partkey")
    return alpha.trait_summary(t.lineitem, members, "l_orderkey", "l_partkey", "l_quantity")


@query("rank_diversity", """
    with long as (select l_suppkey, l_quantity, p_brand, p_type from lineitem join part on l_partkey = p_partkey),
    y as (select l_suppkey, 'p_brand' as rank, p_brand as taxon, sum(l_quantity) as v from long group by all
          union all select l_suppkey, 'p_type', p_type, sum(l_quantity) from long group by all),
    p as (select *, v / sum(v) over (partition by l_suppkey, rank) as p from y)
    select l_suppkey, rank, count(distinct taxon) as richness, round(sum(v), 6) as total, round(-sum(p * ln(p)), 6) as shannon,
        round(1 - sum(p * p), 6) as op_simpson, round(-sum(p * ln(p)) / nullif(ln(count(distinct taxon)), 0), 6) as evenness
    from p group by all""")
def rank_diversity(t):
    df = alpha.rank_diversity(t.lines, "l_suppkey", ["p_brand", "p_type"], "l_quantity")
    return out(df, ["l_suppkey", "rank", "richness"], METRICS)


@query("trait_summary_wide", """
    with c as (select l_orderkey, p_type, sum(l_quantity) as v from lineitem join part on l_partkey = p_partkey where p_type in ('PROMO','SMALL') group by all)
    select l_orderkey, count(v) as trait_richness, coalesce(sum(v), 0) as trait_total
    from (select distinct l_orderkey from lineitem) left join c using (l_orderkey) group by 1""")
def trait_summary_wide(t):
    wide = reshape.to_wide(t.lines, "l_orderkey", "p_type", "l_quantity", TYPES)
    return alpha.trait_summary_wide(wide, t.part.where(mixo()).select("p_type"), "l_orderkey")
