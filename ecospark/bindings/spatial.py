"""Spatial queries: points are the first two embedding coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.geo import project_lcc
from ..operators import spatial, stats
from .registry import query


def points(t):
    e = F.col("embedding")
    return t.embeddings.select(
        F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), F.col("label").cast("double").alias("v")
    )


PTS = """pts as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, label::double as v from embeddings)"""
HART = """case when a > 37 then 0 when a < 7.07106781186547 then exp(-a*a/2)
    * ((((((0.0352624965998911*a + 0.700383064443688)*a + 6.37396220353165)*a + 33.912866078383)*a + 112.079291497871)*a + 221.213596169931)*a + 220.206867912376)
    / (((((((0.0883883476483184*a + 1.75566716318264)*a + 16.064177579207)*a + 86.7807322029461)*a + 296.564248779674)*a + 637.333633378831)*a + 793.826512519948)*a + 440.413735824752)
    else exp(-a*a/2) / (a + 1/(a + 2/(a + 3/(a + 4/(a + 0.65))))) / 2.506628274631 end"""


@query("project_lcc", """
    with k as (select sqrt(2/298.257222101 - 1/(298.257222101*298.257222101)) as e),
    m as (select e, cos(radians(49)) / sqrt(1 - (e*sin(radians(49)))^2) as m1, cos(radians(77)) / sqrt(1 - (e*sin(radians(77)))^2) as m2,
        tan(pi()/4 - radians(49)/2) / ((1 - e*sin(radians(49)))/(1 + e*sin(radians(49))))^(e/2) as t1,
        tan(pi()/4 - radians(77)/2) / ((1 - e*sin(radians(77)))/(1 + e*sin(radians(77))))^(e/2) as t2,
        tan(pi()/4 - radians(63.390675)/2) / ((1 - e*sin(radians(63.390675)))/(1 + e*sin(radians(63.390675))))^(e/2) as t0 from k),
    n as (select *, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) as n from m),
    f as (select *, 6378137.0 * m1 / (n * t1^n) as af from n),
    p as (select vec_id, -100 + 40*embedding[1]::double as lon, 50 + 20*embedding[2]::double as lat from embeddings),
    r as (select vec_id, lon, n, af * t0^n as r0, af * (tan(pi()/4 - radians(lat)/2) / ((1 - e*sin(radians(lat)))/(1 + e*sin(radians(lat))))^(e/2))^n as r from p, f)
    select vec_id, round(6200000 + r * sin(n * radians(lon + 91.8666666666667)), 3) as x,
        round(3000000 + r0 - r * cos(n * radians(lon + 91.8666666666667)), 3) as y from r""")
def project(t):
    e = F.col("embedding")
    x, y = project_lcc(F.lit(-100.0) + F.lit(40.0) * e[0].cast("double"), F.lit(50.0) + F.lit(20.0) * e[1].cast("double"))
    return t.embeddings.select("vec_id", rounded(x, 3).alias("x"), rounded(y, 3).alias("y"))


@query("site_points", "select vec_id as site, embedding[1]::double as x, embedding[2]::double as y, label from embeddings")
def site_points(t):
    e = F.col("embedding")
    return stats.site_points(t.embeddings, "vec_id", e[0].cast("double"), e[1].cast("double"), ["label"])


GABRIEL = f"""with {PTS},
    pr as (select a.id as src, b.id as dst, a.x as x1, a.y as y1, b.x as x2, b.y as y2, (a.x-b.x)^2 + (a.y-b.y)^2 as d2 from pts a join pts b on a.id < b.id),
    gab as (select src, dst, sqrt(d2) as d from pr where not exists (
        select 1 from pts k where k.id <> src and k.id <> dst and (k.x-x1)^2 + (k.y-y1)^2 + (k.x-x2)^2 + (k.y-y2)^2 < d2))"""


@query("gabriel_edges", GABRIEL + " select src, dst, round(d, 6) as d from gab")
def gabriel_edges(t):
    return spatial.gabriel_edges(points(t)).withColumn("d", rounded(F.col("d")))


@query("knn_edges", f"""with {PTS} select src, dst, round(d, 6) as d from (
    select a.id as src, b.id as dst, sqrt((a.x-b.x)^2 + (a.y-b.y)^2) as d,
        row_number() over (partition by a.id order by (a.x-b.x)^2 + (a.y-b.y)^2, b.id) as r from pts a join pts b on a.id <> b.id) where r <= 5""")
def knn_edges(t):
    return spatial.knn_edges(points(t), 5).withColumn("d", rounded(F.col("d")))


@query("band_edges", f"""with {PTS} select a.id as src, b.id as dst, round(sqrt((a.x-b.x)^2 + (a.y-b.y)^2), 6) as d
    from pts a join pts b on a.id < b.id where sqrt((a.x-b.x)^2 + (a.y-b.y)^2) <= 0.02""")
def band_edges(t):
    return spatial.band_edges(points(t), 0.02).withColumn("d", rounded(F.col("d")))


@query("spatial_weights", f"""with {PTS}, knn as (select src, dst from (
    select a.id as src, b.id as dst, row_number() over (partition by a.id order by (a.x-b.x)^2 + (a.y-b.y)^2, b.id) as r
    from pts a join pts b on a.id <> b.id) where r <= 3)
    select src, dst, 1.0::double as w from knn union select dst, src, 1.0::double from knn""")
def spatial_weights(t):
    return spatial.weights(spatial.knn_edges(points(t), 3))


MORAN = """
    v as (select i, s0, n, -1.0::double / (n - 1) as e,
        (n*((n*n - 3*n + 3)*s1 - n*s2 + 3*s0*s0) - kk*((n*n - n)*s1 - 2*n*s2 + 6*s0*s0)) / nullif((n-1)*(n-2)*(n-3)*s0*s0, 0) - 1.0::double/((n-1)*(n-1)) as var{extra} from st),
    zt as (select *, (i - e) / sqrt(var) as z, abs((i - e) / sqrt(var)) as a from v)"""


@query("moran", GABRIEL + f""",
    w as (select src, dst from gab union all select dst, src from gab),
    z as (select id, v - avg(v) over () as z from pts),
    mm as (select count(*)::double as np, sum(z*z) as m2, sum(z*z*z*z) as m4 from z),
    dg as (select src, count(*)::double as k from w group by 1),
    st as (select (select count(*) from dg)::double as n, (select sum(k) from dg) as s0, 2*(select sum(k) from dg) as s1,
        (select sum(4*k*k) from dg) as s2, np * m4 / (m2*m2) as kk,
        (select count(*) from dg) * (select sum(a.z*b.z) from w join z a on a.id = src join z b on b.id = dst) / ((select sum(k) from dg) * m2) as i from mm),
    {MORAN.format(extra='')}
    select n::bigint as n, s0, round(i, 8) as i, round(e, 8) as expected, round(var, 10) as variance, round(z, 6) as z,
        round(case when z >= 0 then {HART} else 1 - ({HART}) end, 6) as p from zt""")
def moran(t):
    pts = points(t)
    df = spatial.moran(pts, spatial.gabriel_edges(pts), "v")
    digits = {"i": 8, "expected": 8, "variance": 10, "z": 6, "p": 6}
    return df.select("n", "s0", *[rounded(F.col(c), d).alias(c) for c, d in digits.items()])


@query("correlogram", f"""with {PTS},
    pr as (select a.id as i, b.id as j, sqrt((a.x-b.x)^2 + (a.y-b.y)^2) as d from pts a join pts b on a.id <> b.id),
    rg as (select min(d) as lo, max(d) as hi, ceil(log2(count(*) / 2) + 1) as k from pr),
    c as (select i, j, cast(least(greatest(ceil((d - lo) / ((hi - lo) / k)), 1), k) as int) as class from pr, rg),
    kd as (select class, i, count(*)::double as k from c group by all),
    zz as (select class, i, k, v - avg(v) over (partition by class) as z from kd join pts on i = id),
    pw as (select c.class, c.i, a.k as ki, a.z as zi, b.k as kj, b.z as zj from c join zz a on a.class = c.class and a.i = c.i join zz b on b.class = c.class and b.i = c.j),
    pt as (select class, i, any_value(ki) as k, any_value(zi) as z, sum(zj) / any_value(ki) as lag, sum(1/kj) as cc from pw group by all),
    st as (select class, count(*)::double as n, count(*)::double as s0, sum(1/k + cc/k) as s1, sum((1+cc)^2) as s2, sum(k) / 2 as pairs,
        count(*) * sum(z*z*z*z) / (sum(z*z)^2) as kk, sum(z*lag) / sum(z*z) as i from pt group by 1),
    {MORAN.format(extra=', class, pairs')}
    select class, round(lo + (hi-lo)/k * (class-1), 6) as lo, round(lo + (hi-lo)/k * class, 6) as hi, pairs::bigint as pairs, round(i, 6) as i,
        round(case when z >= 0 then {HART} else 1 - ({HART}) end, 6) as p from zt, rg""")
def correlogram(t):
    df = spatial.correlogram(points(t), "v")
    return df.select("class", "pairs", *[rounded(F.col(c)).alias(c) for c in ("lo", "hi", "i", "p")])
