"""Beta diversity queries: the oracle is the dense site x taxon matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import day_of_year, paste_key, rounded
from ..operators import beta, clean
from ..sources.tables import spread
from .registry import auto, query


def dense(cells: str, taxon: str, where: str = "") -> str:
    """Centred squares of the full Hellinger matrix, as CTEs ending in ``sq``."""
    return f"""
    with raw as ({cells}),
    y as (select site, {taxon} as taxon, sum(v) as y from raw {where} group by all),
    s as (select distinct site from y), tx as (select distinct taxon from y),
    tot as (select site, sum(y) as t from y group by 1),
    m as (select s.site, tx.taxon, coalesce(sqrt(y.y / nullif(tot.t, 0)), 0) as h from s cross join tx join tot using (site)
          left join y on y.site = s.site and y.taxon = tx.taxon),
    sq as (select site, taxon, (h - avg(h) over (partition by taxon)) ^ 2 as s from m)"""


SUPPLIER = "select l_suppkey as site, p_brand, p_type, l_quantity as v from lineitem join part on l_partkey = p_partkey"
DATED = "select l_suppkey || '_' || dayofyear(l_shipdate) as site, p_type, l_quantity as v from lineitem join part on l_partkey = p_partkey"


def doy_key():
    return paste_key("l_suppkey", day_of_year("l_shipdate"))


@query("hellinger", f"{dense(SUPPLIER, 'p_brand')} select site as l_suppkey, taxon as p_brand, round(h, 6) as h from m where h > 0")
def hellinger(t):
    h = beta.hellinger(t.lines, "l_suppkey", "p_brand", "l_quantity")
    return h.where(F.col("h") > 0).withColumn("h", rounded(F.col("h")))


@query("beta_total", f"""{dense(SUPPLIER, 'p_brand')} select count(distinct site) as n_sites, round(sum(s), 6) as ss_total,
    round(sum(s) / (count(distinct site) - 1), 6) as bd_total from sq""")
def beta_total(t):
    df = beta.beta_total(t.lines, "l_suppkey", "p_brand", "l_quantity")
    return df.select("n_sites", rounded(F.col("ss_total")).alias("ss_total"), rounded(F.col("bd_total")).alias("bd_total"))


@query("scbd", f"""{dense(SUPPLIER, 'p_brand')} select taxon as p_brand, round(sum(s) / (select sum(s) from sq), 8) as scbd
    from sq group by 1 having sum(s) / (select sum(s) from sq) > 0.01""")
def scbd(t):
    df = clean.above(beta.scbd(t.lines, "l_suppkey", "p_brand", "l_quantity"), "scbd", 0.01)
    return df.withColumn("scbd", rounded(F.col("scbd"), 8))


def lcbd_sql(cells: str, taxon: str, key: str, where: str = "", suffix: str = "") -> str:
    return f"""{dense(cells, taxon, where)} select site as {key}, round(sum(s) / (select sum(s) from sq), 8) as lcbd{suffix},
        round(ln(sum(s) / (select sum(s) from sq)), 6) as log_lcbd{suffix} from sq group by 1"""


@query("lcbd", lcbd_sql(SUPPLIER, "p_brand", "l_suppkey") + " having sum(s) / (select sum(s) from sq) > 8e-4")
def lcbd(t):
    df = clean.above(beta.lcbd(t.lines, "l_suppkey", "p_brand", "l_quantity"), "lcbd", 8e-4)
    return df.select("l_suppkey", rounded(F.col("lcbd"), 8).alias("lcbd"), rounded(F.col("log_lcbd")).alias("log_lcbd"))


@query("lcbd_corrected", lcbd_sql(SUPPLIER, "p_brand", "l_suppkey", "where p_type not in ('PROMO','SMALL')", "_corr"))
def lcbd_corrected(t):
    df = beta.lcbd(t.lines, "l_suppkey", "p_brand", "l_quantity", where=auto(), suffix="_corr")
    return df.select("l_suppkey", rounded(F.col("lcbd_corr"), 8).alias("lcbd_corr"), rounded(F.col("log_lcbd_corr")).alias("log_lcbd_corr"))


@query("sample_sums", """
    select l_suppkey || '_' || dayofyear(l_shipdate) as sample, p_brand, sum(l_quantity) as l_quantity
    from lineitem join part on l_partkey = p_partkey group by all""")
def sample_sums(t):
    return beta.sample_sums(t.lines, doy_key(), "p_brand", "l_quantity")


@query("lcbd_dated", lcbd_sql(DATED, "p_type", "sample").replace(", 8)", ", 10)"))
def lcbd_dated(t):
    # Sums, cells and totals of a sample follow in one task.
    lines = spread(t.lines.withColumn("sample", doy_key()), t.lineitem.count(), "sample")
    sums = beta.sample_sums(lines, F.col("sample"), "p_type", "l_quantity")
    df = beta.lcbd(sums, "sample", "p_type", "l_quantity")
    return df.select("sample", rounded(F.col("lcbd"), 10).alias("lcbd"), rounded(F.col("log_lcbd")).alias("log_lcbd"))


NPERM = 19


def _mix(half: str, r: int) -> str:
    x = f"((({half}) + k{r}) % 2147483647)"
    return f"({x} * {x} % 2147483647 + {x} * 1103515245 % 2147483647)"


def _walk(source: str) -> str:
    """One pass of the keyed bijection over the rows of ``source``."""
    return f"""
    select * exclude (l1, r1, l2, r2), l2 * b + r2 as idx from (
      select *, (r1 + {_mix('l2', 3)}) % b as r2 from (
        select *, (l1 + {_mix('r1', 2)}) % a as l2 from (
          select * exclude (r0), (r0 + {_mix('l1', 1)}) % b as r1 from (
            select * exclude (l0), (l0 + {_mix('r0', 0)}) % a as l1 from (
              select * exclude (idx), cast(floor(idx / b) as bigint) as l0, idx % b as r0 from {source})))))"""


PERMUTED = dense(SUPPLIER, "p_type") + f""",
    total as (select sum(s) as ss from sq),
    obs as (select site, round(sum(s) / (select ss from total), 12) as lcbd from sq group by 1),
    num as (select site, row_number() over (order by md5(cast(site as varchar)), site) - 1 as idx from s),
    size as (select count(*) as n, cast(ceil(sqrt(count(*))) as bigint) as a, cast(ceil(count(*) / ceil(sqrt(count(*)))) as bigint) as b from s),
    start as (select perm, taxon, h, idx, n, a, b, {', '.join(f"('0x' || substr(md5('7:' || perm || ':' || taxon), {1 + 8 * r}, 8))::bigint as k{r}" for r in range(4))}
        from m join num using (site), size, range(1, {NPERM + 1}) p(perm)),
    w1 as ({_walk('start')}),
    w2 as (select perm, taxon, h, idx, n from w1 where idx < n union all
           select perm, taxon, h, idx, n from ({_walk('(select * from w1 where idx >= n)')}) where idx < n union all
           select perm, taxon, h, idx, n from ({_walk('(select * from (' + _walk('(select * from w1 where idx >= n)') + ') where idx >= n)')})),
    shuffled as (select perm, idx, sum((h - mu) ^ 2) / (select ss from total) as l
                 from w2 join (select taxon, avg(h) as mu from m group by 1) using (taxon) group by all)
    select site as l_suppkey, round(any_value(lcbd), 8) as lcbd, round((count(*) filter (round(l, 12) >= lcbd) + 1) / {NPERM + 1}.0::double, 6) as pval
    from shuffled join num using (idx) join obs using (site) group by site"""


@query("lcbd_permutation", PERMUTED)
def lcbd_permutation(t):
    df = beta.lcbd_permutation(t.lines, "l_suppkey", "p_type", "l_quantity", nperm=NPERM, seed=7)
    return df.select("l_suppkey", rounded(F.col("lcbd"), 8).alias("lcbd"), rounded(F.col("pval")).alias("pval"))


@query("varpart")
def varpart(t):
    h = beta.hellinger(t.lines, "l_suppkey", "p_brand", "l_quantity")
    means = t.lineitem.groupBy("l_suppkey").agg(
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_extendedprice").alias("price")
    )
    sites = t.supplier.select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("double").alias("nation"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"),
    )
    env = clean.impute_median(sites.join(means, "l_suppkey"), ["balance", "discount", "tax", "price"])
    df = beta.varpart(h, env, "l_suppkey", "p_brand", ["nation", "balance"], ["discount", "tax", "price"])
    return df.withColumn("adj_r2", rounded(F.col("adj_r2")))


@query("varpart_pair", dense(SUPPLIER, "p_brand") + """,
    e as (select l_suppkey as site, s_nationkey::double as x1, avg(l_discount) as x2 from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
    z as (select site, x1 - avg(x1) over () as x1, x2 - avg(x2) over () as x2 from e),
    g as (select count(*) as n, sum(x1 * x1) as g11, sum(x1 * x2) as g12, sum(x2 * x2) as g22 from z),
    c as (select taxon, sum(h * x1) as c1, sum(h * x2) as c2 from m join z using (site) group by 1),
    r as (select sum(c1 * c1 / g11) as s1, sum(c2 * c2 / g22) as s2,
        sum((c1 * c1 * g22 - 2 * c1 * c2 * g12 + c2 * c2 * g11) / (g11 * g22 - g12 * g12)) as s12 from c, g),
    a as (select 1 - (1 - s1 / t) * (n - 1) / (n - 2) as x1, 1 - (1 - s2 / t) * (n - 1) / (n - 2) as x2,
        1 - (1 - s12 / t) * (n - 1) / (n - 3) as x12 from r, g, (select sum(s) as t from sq))
    select fraction, round(adj_r2, 6) + 0.0 as adj_r2 from (
        select 'a' as fraction, x12 - x2 as adj_r2 from a union all select 'b', x1 + x2 - x12 from a
        union all select 'c', x12 - x1 from a union all select 'd', 1 - x12 from a)""")
def varpart_pair(t):
    h = beta.hellinger(t.lines, "l_suppkey", "p_brand", "l_quantity")
    means = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_discount").alias("discount"))
    env = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("double").alias("nation")).join(means, "l_suppkey")
    df = beta.varpart(h, env, "l_suppkey", "p_brand", ["nation"], ["discount"])
    return df.withColumn("adj_r2", rounded(F.col("adj_r2")))
