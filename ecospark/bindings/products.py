"""End products: site tables, reports and harmonised tables on the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.columns import percent, rounded
from ..plans import circularity, harmonise, modelling, survey, taxonomy
from ..sources.tables import spread
from .beta import dense
from .composition import COMPOSED, RANKS
from .diversity import BRAND_GROUPS, TYPES
from .registry import mixo, query

METRICS6 = ["shannon", "op_simpson", "eveness_piel"]
# Lines of orders above which they are dealt by their order at once.
DEALT_LINES = 1_000_000


def phyto(t):
    """Long phytoplankton: supplier as lake, part as genus; undiscounted lines count zero.

    The returned lines of an economy part are in another group than its other lines.
    """
    totals = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("total.biov"))
    return t.lines.join(totals, "l_suppkey").select(
        F.col("l_suppkey").cast("string").alias("lake_id"), F.lit("survey").alias("Survey"),
        F.col("l_partkey").cast("string").alias("Target_taxon"),
        F.when((F.col("p_type") == "ECONOMY") & (F.col("l_returnflag") != "R"), "CYANOBACTERIA").otherwise(F.col("p_type")).alias("classic.group"),
        F.when(F.col("l_discount") > 0, F.col("l_quantity")).otherwise(0.0).alias("biovol"), "`total.biov`",
    )


def members(t):
    return t.part.where(mixo()).select(F.col("p_partkey").cast("string").alias("Genus"))


def zoo(t):
    return t.lines.select(
        F.col("l_suppkey").cast("string").alias("lake_id"), F.col("p_type").alias("taxon"), F.col("l_tax").alias("value")
    )


def env(t):
    return t.supplier.select(
        F.col("s_suppkey").cast("string").alias("lake_id"), F.lit("survey").alias("Survey"),
        F.col("s_acctbal").alias("area"), F.col("s_nationkey").cast("double").alias("lake_depth"), F.lit("mixed").alias("Stratification"),
    )


PH = """ph as (select cast(l_suppkey as varchar) as lake_id, l_partkey as taxon, p_type, case when l_discount > 0 then l_quantity else 0 end as v,
        case when p_type = 'ECONOMY' and l_returnflag <> 'R' then 'CYANOBACTERIA' else p_type end as grp,
        sum(l_quantity) over (partition by l_suppkey) as tot from lineitem join part on l_partkey = p_partkey),
    mets as (select lake_id, count(distinct taxon) as rich_genus, -sum(v/tot*ln(v/tot)) as shannon, 1 - sum(v/tot*v/tot) as op_simpson,
        100 * sum(case when p_type in ('PROMO','SMALL') then v else 0 end) / any_value(tot) as prev_Mixo from ph where v > 0 group by 1),
    au as (select *, sum(v) over (partition by lake_id) as t from ph where v > 0 and p_type not in ('PROMO','SMALL')),
    corr as (select lake_id, count(distinct taxon) as rich_genus_corr, -sum(v/t*ln(v/t)) as shannon_corr, 1 - sum(v/t*v/t) as op_simpson_corr from au group by 1),
    an as (select *, sum(v) over (partition by lake_id) as t from ph where v > 0 and p_type not in ('PROMO','SMALL') and grp <> 'CYANOBACTERIA'),
    corr2 as (select lake_id, count(distinct taxon) as rich_genus_corr, -sum(v/t*ln(v/t)) as shannon_corr, 1 - sum(v/t*v/t) as op_simpson_corr from an group by 1)"""
CELLS = """select cast(l_suppkey as varchar) as site, l_partkey, p_type, case when l_discount > 0 then l_quantity else 0 end as v
    from lineitem join part on l_partkey = p_partkey"""
ROUNDED = """rich_genus, round(shannon, 6) as shannon, round(op_simpson, 6) as op_simpson, round(shannon / nullif(ln(rich_genus), 0), 6) as eveness_piel,
    round(prev_Mixo, 6) as "prev_Mixo\""""
ROUNDED_CORR = """rich_genus_corr, round(shannon_corr, 6) as shannon_corr, round(op_simpson_corr, 6) as op_simpson_corr,
    round(shannon_corr / nullif(ln(rich_genus_corr), 0), 6) as eveness_piel_corr"""
SITE_TABLE = f"""
    with {PH},
    l1 as ({dense(CELLS, "l_partkey")} select site as lake_id, ln(sum(s) / (select sum(s) from sq)) as a from sq group by 1),
    l2 as ({dense(CELLS, "l_partkey", "where p_type not in ('PROMO','SMALL')")} select site as lake_id, ln(sum(s) / (select sum(s) from sq)) as b from sq group by 1),
    zoo as (select cast(l_suppkey as varchar) as lake_id, round(sum(l_tax), 4) as tz, round(coalesce(sum(l_tax) filter (p_type in ('STANDARD','SMALL')), 0), 4) as z1,
        round(coalesce(sum(l_tax) filter (p_type in ('MEDIUM','LARGE')), 0), 4) as z2, round(coalesce(sum(l_tax) filter (p_type = 'ECONOMY'), 0), 4) as z3
        from lineitem join part on l_partkey = p_partkey group by 1)
    select cast(s_suppkey as varchar) as lake_id, s_acctbal as area, cast(s_nationkey as double) as lake_depth, {ROUNDED}, {ROUNDED_CORR},
        tz as "biovol_tot_zoo_um3.mL", z1 as "biovol_cladocera_um3.mL", z2 as "biovol_copepoda_um3.mL", z3 as "biovol_other_um3.mL",
        round(a, 6) as "log_LCBD", round(b, 6) as "log_LCBD_corr"
    from supplier join mets on mets.lake_id = cast(s_suppkey as varchar) join corr using (lake_id) left join zoo using (lake_id)
    left join l1 using (lake_id) left join l2 using (lake_id) where rich_genus > 1 and rich_genus_corr > 1"""
ZOO = ["biovol_tot_zoo_um3.mL", "biovol_cladocera_um3.mL", "biovol_copepoda_um3.mL", "biovol_other_um3.mL"]


def tidy(df, digits: dict[str, int]):
    return df.select(*[
        (rounded(F.col(f"`{c}`"), digits[c]) if c in digits else F.col(f"`{c}`")).alias(c) for c in df.columns
    ])


SIX = dict.fromkeys([
    "shannon", "op_simpson", "eveness_piel", "prev_Mixo", "shannon_corr", "op_simpson_corr", "eveness_piel_corr", "log_LCBD",
    "log_LCBD_corr", "prev_Cyano", "slope", "intercept", "r2",
], 6) | dict.fromkeys(ZOO, 4)


@query("site_table", SITE_TABLE)
def site_table(t):
    return tidy(survey.long_survey_table(phyto(t), zoo(t), env(t), members(t), BRAND_GROUPS), SIX)


@query("cyano_summary", f"""with {PH},
    c as (select lake_id, any_value(tot) as total, sum(case when p_type in ('PROMO','SMALL') then v else 0 end) as trait_total,
        count(*) filter (p_type in ('PROMO','SMALL')) as trait_rows, sum(case when grp = 'CYANOBACTERIA' then v else 0 end) as cy from ph where v > 0 group by 1)
    select lake_id, 'survey' as "Survey", total, trait_total, trait_rows, {ROUNDED}, cy as "biovol_cyano_um3.mL", round(100 * cy / total, 6) as "prev_Cyano"
    from mets join c using (lake_id)""")
def cyano_summary(t):
    return tidy(survey.cyano_summary(survey.phyto_cells(phyto(t), members(t), groups=True)), SIX)


@query("corrected_no_cyano", f"""with {PH} select lake_id, {ROUNDED_CORR} from corr2""")
def corrected_no_cyano(t):
    return tidy(survey.corrected_metrics(survey.phyto_cells(phyto(t), members(t), groups=True), without_cyano=True), SIX)


@query("survey_wide_table", """
    with sites as (select distinct l_orderkey from lineitem), taxa as (select distinct p_type from part),
    y as (select l_orderkey, p_type, sum(l_quantity) as v, sum(l_tax) as z from lineitem join part on l_partkey = p_partkey group by all),
    s as (select *, sum(v) over (partition by l_orderkey) as t from y),
    ph as (select l_orderkey, count(*) as rich_genus, -sum(v/t*ln(v/t)) as shannon, 1 - sum(v/t*v/t) as op_simpson,
        100 * sum(case when p_type in ('PROMO','SMALL') then v else 0 end) / any_value(t) as prev_Mixo from s group by 1),
    z as (select l_orderkey, sum(z) as tz, coalesce(sum(z) filter (p_type in ('STANDARD','SMALL')), 0) as z1,
        coalesce(sum(z) filter (p_type in ('MEDIUM','LARGE')), 0) as z2, coalesce(sum(z) filter (p_type = 'ECONOMY'), 0) as z3 from y group by 1)
    select cast(o_orderkey as varchar) as lake_id, o_totalprice as "ctch.m2", o_orderstatus as lake_state, rich_genus, round(shannon, 6) + 0.0 as shannon,
        round(op_simpson, 10) + 0.0 as op_simpson, round(shannon / nullif(ln(rich_genus), 0), 6) as eveness_piel, round(prev_Mixo, 8) as "prev_Mixo",
        round(tz, 4) as "biovol_tot_zoo_um3.mL", round(z1, 4) as "biovol_cladocera_um3.mL", round(z2, 4) as "biovol_copepoda_um3.mL", round(z3, 4) as "biovol_other_um3.mL"
    from orders left join ph on o_orderkey = ph.l_orderkey left join z on o_orderkey = z.l_orderkey""")
def survey_wide_table(t):
    # Each taxon is stored as two columns, so the merge has something to do.
    lines = t.lines.withColumn("lake_id", F.col("l_orderkey").cast("string"))
    late = F.col("l_linestatus") == "F"
    wide = lambda v: lines.groupBy("lake_id").agg(*[
        F.coalesce(F.sum(F.when((F.col("p_type") == p) & cond, F.col(v))), F.lit(0.0)).alias(name)
        for p in TYPES for name, cond in ((p, late), (f"{p}.1", ~late))
    ])
    sheets = [
        t.orders.select(F.col("o_orderkey").cast("string").alias("lake_id"), F.col("o_totalprice").alias("ctch.m2")),
        t.orders.select(F.col("o_orderkey").cast("string").alias("lake_id"), F.col("o_orderstatus").alias("lake_state"), F.lit("r").alias("region")),
    ]
    traits = t.part.where(mixo()).select("p_type").distinct()
    out = survey.wide_survey_table(wide("l_quantity"), wide("l_tax"), sheets, traits, BRAND_GROUPS, drop=["region"])
    return tidy(out, SIX | {"op_simpson": 10, "prev_Mixo": 8})


FLAGS = {"A_mg.L": "mean_A", "N_mg.L": "mean_N", "SO_mg.L": "mean_SO"}


@query("survey_dated_table", """
    with d as (select l_suppkey, cast(l_shipdate as date) as d, p_brand as g, case when p_brand < 'Brand#3' then 'Mixotroph' else 'Autotroph' end as strat,
        l_quantity * l_extendedprice / 1e6 as v from lineitem join part on l_partkey = p_partkey),
    f0 as (select *, sum(v) over (partition by l_suppkey, d) as t, v / sum(v) over (partition by l_suppkey, d) as p,
        v / nullif(sum(case when strat = 'Autotroph' then v end) over (partition by l_suppkey, d), 0) as pc from d),
    f as (select l_suppkey, d, count(distinct g) as rich_genus, -sum(p*ln(p)) as shannon, 1 - sum(p*p) as op_simpson,
        100 * sum(case when strat = 'Mixotroph' then p else 0 end) as prev_Mixo,
        count(distinct g) filter (strat = 'Autotroph') as rc, -sum(pc*ln(pc)) filter (strat = 'Autotroph') as sc, 1 - sum(pc*pc) filter (strat = 'Autotroph') as oc
        from f0 group by all),
    ch0 as (select l_suppkey, l_shipdate, avg(case when l_returnflag = 'A' then l_tax end) as a, avg(case when l_returnflag = 'N' then l_tax end) as n,
        avg(case when l_returnflag = 'R' then l_tax end) as r from lineitem group by all),
    ch as (select l_suppkey, cast(l_shipdate as date) as d, round(avg(a), 8) as mean_A, round(avg(n), 8) as mean_N, round(avg(r), 8) as mean_SO from ch0 group by all)
    select cast(l_suppkey as varchar) as lake_id, mean_A as "mean_A", mean_N as "mean_N", mean_SO as "mean_SO", s_acctbal as area_surface, rich_genus, round(shannon, 6) as shannon, round(op_simpson, 6) as op_simpson,
        round(shannon / nullif(ln(rich_genus), 0), 6) as eveness_piel, round(prev_Mixo, 6) as "prev_Mixo", nullif(rc, 0) as rich_genus_corr,
        round(case when abs(sc) < 1e-12 then 0 else sc end, 6) + 0.0 as shannon_corr, round(case when abs(oc) < 1e-12 then 0 else oc end, 6) + 0.0 as op_simpson_corr,
        round(sc / nullif(ln(rc), 0), 6) as eveness_piel_corr, cast(dayofyear(d) as int) as doy, cast(year(d) as int) as yr
    from f join ch using (l_suppkey, d) left join supplier on l_suppkey = s_suppkey where rich_genus > 1""")
def survey_dated_table(t):
    site = F.col("l_suppkey").cast("string").alias("monitoring_location_name")
    density = t.lineitem.select(
        site, F.col("l_shipdate").alias("date_collected"), F.col("l_partkey").alias("species_code"),
        F.col("l_quantity").alias("density"), F.col("l_extendedprice").alias("volume_cell"),
    )
    codes = t.part.select(F.col("p_partkey").alias("species_code"), F.col("p_brand").alias("genus"))
    strat = F.when(F.col("p_brand") < "Brand#3", "Mixotroph").otherwise("Autotroph")
    traits = t.part.select(F.col("p_brand").alias("Genus"), strat.alias("strat")).distinct()
    chemistry = t.lineitem.select(
        site, F.col("l_shipdate").alias("activity_start_date"), F.nullif("l_returnflag", F.lit("R")).alias("characteristic_name"),
        F.col("l_tax").alias("result_value"), F.lit("mg/L").alias("result_unit"),
    )
    physical = t.supplier.select(F.col("s_suppkey").cast("string").alias("lake_id"), F.col("s_acctbal").alias("area_surface"))
    out = survey.dated_survey_table(density, codes, traits, chemistry, physical, FLAGS)
    return tidy(out, SIX | dict.fromkeys(FLAGS.values(), 8))


EVENTS = {"click_u.L": "mean_click", "purchase_u.L": "mean_purchase", "SO_u.L": "mean_SO"}


@query("chemistry_daily_means", """
    with w as (select user_id, ts, avg(value) filter (event_type = 'click') as c, avg(value) filter (event_type = 'purchase') as p,
        avg(value) filter (event_type = 'view') as s from events group by all)
    select cast(ts as date) as date_sampling, user_id as lake_id, round(avg(c), 6) as mean_click, round(avg(p), 6) as mean_purchase, round(avg(s), 6) as "mean_SO"
    from w group by 1, 2""")
def chemistry_daily_means(t):
    chemistry = t.events.select(
        F.col("user_id").alias("monitoring_location_name"), F.col("ts").alias("activity_start_date"),
        F.nullif("event_type", F.lit("view")).alias("characteristic_name"), F.col("value").alias("result_value"), F.lit("u/L").alias("result_unit"),
    )
    return tidy(survey.chemistry_means(chemistry, EVENTS), dict.fromkeys(EVENTS.values(), 6))


@query("rank_site_table", """
    with long as (select cast(s_nationkey as varchar) as lake_id, p_type, p_brand, l_quantity from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey),
    y as (select lake_id, 't' as rank, p_type as taxon, sum(l_quantity) as v from long group by all union all
          select lake_id, 'b', p_brand, sum(l_quantity) from long group by all),
    p as (select *, v / sum(v) over (partition by lake_id, rank) as p from y),
    m as (select lake_id, rank, count(*) as s, sum(v) as t, -sum(p*ln(p)) as h, 1 - sum(p*p) as d from p group by all)
    select cast(n_nationkey as varchar) as lake_id, n_name, a.s as rich_p_type_bact, a.t as ab_tot_p_type_bact, round(a.h, 6) as "H_p_type_bact",
        round(a.d, 6) as "one_minus_D_p_type_bact", round(a.h / nullif(ln(a.s), 0), 6) as "J_p_type_bact", b.s as rich_p_brand_bact, b.t as ab_tot_p_brand_bact,
        round(b.h, 6) as "H_p_brand_bact", round(b.d, 6) as "one_minus_D_p_brand_bact", round(b.h / nullif(ln(b.s), 0), 6) as "J_p_brand_bact"
    from nation left join m a on a.lake_id = cast(n_nationkey as varchar) and a.rank = 't' left join m b on b.lake_id = cast(n_nationkey as varchar) and b.rank = 'b'
    where n_regionkey < 3""")
def rank_site_table(t):
    # The 25 nation keys.
    nations = [str(i) for i in range(25)]
    rows = t.lines.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("lake", F.col("s_nationkey").cast("string"))
    counts = rows.groupBy("p_type", "p_brand").pivot("lake", nations).agg(F.sum("l_quantity")).fillna(0.0)
    sites = t.nation.select(F.col("n_nationkey").cast("string").alias("lake_id"), "n_name")
    keep = t.nation.where(F.col("n_regionkey") < 3).select(F.col("n_nationkey").cast("string").alias("lake_id"))
    out = survey.rank_site_table(counts, sites, keep, ["p_type", "p_brand"], ["p_type", "p_brand"])
    return tidy(out, {c: 6 for c in out.columns if c[0] in "HJo"})


@query("composition_report", COMPOSED.replace("join prev using (l_orderkey)", "join prev using (l_orderkey) where prev is null or prev <> 100").replace(
    "from tab", "from tab").replace("select rank, bin, taxon, freq, abundance,", """
    select tab.rank, tab.bin, taxon, freq, abundance, (select count(distinct l2.taxon) from long l2 where l2.rank = tab.rank and l2.bin is not distinct from tab.bin) as richness,"""))
def composition_report(t):
    prev = t.lines.groupBy("l_orderkey").agg(
        percent(F.sum(F.when(mixo(), F.col("l_quantity")).otherwise(0.0)), F.sum("l_quantity")).alias("prev_Mixo")
    ).where(F.col("l_orderkey") > 5)
    out = survey.composition_report(t.lines, prev, "l_orderkey", "l_quantity", RANKS, saturated=False)
    return tidy(out, {"percent_freq": 6, "percent_abundance": 6})


def info(t):
    ranks = {r: F.lit(None).cast("string") for r in ("Empire", "Kingdom", "Order", "Family")}
    old = F.when(F.col("p_size") > 40, None).when(F.col("p_size") > 20, "Mixotroph").otherwise("Autotroph")
    return t.part.select(
        *[c.alias(r) for r, c in ranks.items()], F.col("p_type").alias("Phylum"), F.col("p_brand").alias("Class"),
        F.col("p_partkey").cast("string").alias("Genus"), old.alias("Final_Nutrition_Strategy"),
    )


def opinions(t):
    code = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    species = t.lineitem.select(code.alias("species_code"), F.col("l_partkey").cast("string").alias("genus"), "l_returnflag")
    flag = F.when(F.col("l_returnflag") == "A", "a").when(F.col("l_returnflag") == "N", "m").otherwise("h")
    return taxonomy.second_opinion(
        info(t), species.select("species_code", "genus").distinct(), species.select("species_code", flag.alias("trophic_type"))
    )


OPINIONS = """
    op as (select cast(p_partkey as varchar) as "Genus", case when p_size > 40 then null when p_size > 20 then 'Mixotroph' else 'Autotroph' end as strategy_new,
        case mode when 'A' then 'Autotroph' when 'N' then 'Mixotroph' when 'R' then 'Heterotroph' end as strategy_species
        from part left join (select l_partkey, l_returnflag as mode, row_number() over (partition by l_partkey order by count(*) desc,
            case l_returnflag when 'A' then 'a' when 'N' then 'm' else 'h' end) as rn from lineitem group by 1, 2) m on p_partkey = l_partkey and rn = 1)"""


@query("taxonomy_dimension", """
    select cast(null as varchar) as "Empire", cast(null as varchar) as "Kingdom", p_type as "Phylum", p_brand as "Class", cast(null as varchar) as "Order",
        cast(null as varchar) as "Family", cast(p_partkey as varchar) as "Genus", case when p_size > 40 then null when p_size > 20 then 'Mixotroph' else 'Autotroph' end as strat from part""")
def taxonomy_dimension(t):
    return taxonomy.taxonomy_dimension(info(t))


@query("taxonomy_opinions", f"with {OPINIONS} select \"Genus\", strategy_new, strategy_species from op")
def taxonomy_opinions(t):
    return opinions(t).select("Genus", "strategy_new", "strategy_species")


@query("taxonomy_crosstab", f"""with {OPINIONS} select coalesce(strategy_new, '<NA>') as strategy_new, coalesce(strategy_species, '<NA>') as strategy_species,
    count(*) as n from op group by 1, 2""")
def taxonomy_crosstab(t):
    return taxonomy.opinion_crosstab(opinions(t))


@query("taxonomy_conflicts", f"with {OPINIONS} select \"Genus\", strategy_new, strategy_species from op where strategy_new <> strategy_species")
def taxonomy_conflicts(t):
    return taxonomy.opinion_conflicts(opinions(t))


@query("harmonised_union", """
    select 'wide' as dataset, c_name as lake_id, c_acctbal as "DOC_mg.L", c_nationkey * 1000.0::double as "TN_ug.L", null::double as "COND_uS.cm", null::double as temp_mean, null::double as sech_m from customer
    union all select 'long', s_name, s_acctbal, s_nationkey * 1000.0::double, s_nationkey * 1000.0::double,
        (coalesce(nullif(s_nationkey, 0), 0) + coalesce(case when s_acctbal > 0 then s_acctbal end, 0)) / nullif((s_nationkey <> 0)::int + (s_acctbal > 0)::int, 0), s_acctbal from supplier
    union all select 'dated', cast(o_orderkey as varchar), round(o_totalprice * 0.012, 4), cast(o_custkey as double), o_totalprice, null, null from orders""")
def harmonised_union(t):
    nation = F.col("c_nationkey").cast("double")
    wide = t.customer.select(
        F.col("c_name").alias("lake_id"), F.lit(2000).alias("yr"), F.lit(1).alias("doy"),
        F.col("c_acctbal").alias("doc.mgl"), nation.alias("tn.mgl"),
    )
    depth = F.col("s_nationkey").cast("double")
    long = t.supplier.select(
        F.col("s_name").alias("lake_id"), F.col("s_acctbal").alias("DOC"), depth.alias("TN"), depth.alias("Conductivity"),
        F.nullif(depth, F.lit(0.0)).alias("Temperature_up"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("Temperature_bottom"),
        F.col("s_acctbal").alias("secchi_depth"),
    )
    dated = t.orders.select(
        F.col("o_orderkey").cast("string").alias("lake_id"), F.year("o_orderdate").alias("yr"), F.dayofyear("o_orderdate").alias("doy"),
        F.col("o_totalprice").alias("mean_DOC_umol.L"), F.col("o_custkey").cast("double").alias("mean_TDN_ug.L"),
        F.col("o_totalprice").alias("mean_COND_uS.cm"),
    )
    out = harmonise.harmonised_union({"wide": wide, "long": long, "dated": dated})
    doc = F.when(F.col("dataset") == "dated", rounded(F.col("`DOC_mg.L`"), 4)).otherwise(F.col("`DOC_mg.L`"))
    return out.select("dataset", "lake_id", doc.alias("DOC_mg.L"), "`TN_ug.L`", "`COND_uS.cm`", "temp_mean", "sech_m")


@query("circularity_report", f"""with {PH}, tab as (select *, shannon / nullif(ln(rich_genus), 0) as eveness_piel, shannon_corr / nullif(ln(rich_genus_corr), 0) as eveness_piel_corr
    from corr join mets using (lake_id)) """ + " union all ".join(f"""
    select '{m}' as variable, count({m}) as n, round(regr_slope({m}, prev_Mixo), 6) as slope, round(regr_intercept({m}, prev_Mixo), 6) as intercept,
        round(regr_r2({m}, prev_Mixo), 6) as r2, count(*) - count({m}) as nulls from tab"""
    for m in ("rich_genus", "shannon", "op_simpson", "eveness_piel", "rich_genus_corr", "shannon_corr", "op_simpson_corr", "eveness_piel_corr")))
def circularity_report(t):
    return tidy(circularity.circularity_report(circularity.diversity_table(phyto(t), members(t))), SIX)


@query("artefact_test")
def artefact_test(t):
    return circularity.artefact_test(circularity.diversity_table(phyto(t), members(t)), nperm=99)


def order_sites(t):
    """Orders as sites: diversity of their lines and the environment of their customer."""
    lines, rows = t.lines, t.lineitem.count()
    if rows > DEALT_LINES:
        # One exchange serves the distinct brands, the sums and the join.
        lines = spread(lines, rows, "l_orderkey")
    cells = lines.groupBy("l_orderkey").agg(
        F.count_distinct("p_brand").alias("rich_genus"), F.avg("l_quantity").alias("depth"), F.avg("l_discount").alias("color"),
        F.avg("l_tax").alias("pH"),
        percent(F.sum(F.when(mixo(), F.col("l_quantity")).otherwise(0.0)), F.sum("l_quantity")).alias("prev_Mixo"),
    )
    return cells.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("lake_id"), F.col("rich_genus").cast("double").alias("rich_genus"), "depth", "color", "pH", "prev_Mixo",
        F.col("o_totalprice").alias("area_m2"),
    )


@query("model_report")
def model_report(t):
    config = RunConfig(response="rich_genus", corrected=False, n_estimators=100, max_depth=2, learning_rate=0.1, reg_alpha=0.0, reg_lambda=0.0, gamma=0.0)
    run = modelling.run_trees(order_sites(t), "lake_id", config, nperm=2, background=50)
    return modelling.model_report(run)


@query("smooth_report")
def smooth_report(t):
    config = RunConfig(response="rich_genus", corrected=False)
    _, export = modelling.run_smooth(order_sites(t), "lake_id", "long", config)
    return export

