"""Images, column functions and spectra."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import physics as phys
from ..operators import grids as ops
from ..operators import spectra as spec
from ..operators.selection import quantiles
from .registry import query
from .scores import tidy
from .tables import CELLS, FIELDS, IMAGE, cells, fields, image, table

NEAR = IMAGE + """, n AS (SELECT y, x, v, lag(v) OVER r AS l, lead(v) OVER r AS rr, lag(v) OVER c AS u, lead(v) OVER c AS d FROM image WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))"""


@query("j02_centred_differences", f"WITH {NEAR} SELECT y, x, round(CASE WHEN v IS NOT NULL THEN (rr - l)/(2*cos(radians(20 + y*0.1))) END, 6) AS dx, round(CASE WHEN v IS NOT NULL THEN (d - u)/2 END, 6) AS dy FROM n")
def centred(spark, sf):
    v, s = F.col("v"), 2 * F.cos(F.radians(20 + F.col("y") * 0.1))
    return tidy(image(spark, sf).select("y", "x", ops.centred(v, [], "x", "y", s).alias("dx"), ops.centred(v, [], "y", "x", F.lit(2.0)).alias("dy")), 6)


@query("j03_laplacian", f"WITH {NEAR} SELECT count(l + rr + u + d + v) AS n, round(sqrt(avg(pow(l + rr + u + d - 4*v, 2))), 6) AS rms FROM n")
def laplacian(spark, sf):
    rows = image(spark, sf).select(ops.laplacian("v", []).alias("l"))
    return tidy(rows.agg(F.count("l").alias("n"), F.sqrt(F.avg(F.col("l") * F.col("l"))).alias("rms")), 6)


@query("j04_gradient", f"WITH {NEAR} SELECT y, round(avg(CASE WHEN v IS NOT NULL THEN sqrt(pow((rr-l)/2, 2) + pow((d-u)/2, 2)) END), 6) AS gradient FROM n GROUP BY y")
def gradient(spark, sf):
    v = F.col("v")
    rows = image(spark, sf).select("y", ops.centred(v, [], "x", "y", F.lit(2.0)).alias("dx"), ops.centred(v, [], "y", "x", F.lit(2.0)).alias("dy"))
    return tidy(rows.groupBy("y").agg(F.avg(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)).alias("gradient")), 6)


@query("n02_gradient_error", f"WITH {NEAR}, e AS (SELECT abs(rr - v) AS e FROM n UNION ALL SELECT abs(d - v) FROM n) SELECT count(e) AS n, round(avg(e), 6) AS error FROM e")
def gradient_error(spark, sf):
    """The mean absolute difference of neighbours, both axes pooled."""
    v = F.col("v")
    rows = image(spark, sf).select(F.array(F.abs(ops.beside(v, [], "x", "y", 1) - v), F.abs(ops.beside(v, [], "y", "x", 1) - v)).alias("e")).select(F.explode("e").alias("e"))
    return tidy(rows.agg(F.count("e").alias("n"), F.avg("e").alias("error")), 6)


def taps(sigma: float, truncate: float = 3.0) -> str:
    return ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in ops.kernel(sigma, truncate).items())


SMOOTH = """{n}x AS (SELECT y, x + o AS x, sum(coalesce(v, 0)*k) AS num, sum(CASE WHEN v IS NULL THEN 0 ELSE k END) AS den FROM {src}, (VALUES {taps}) t(o, k) GROUP BY ALL),
    {n}y AS (SELECT y + o AS y, x, sum(num*k) AS num, sum(den*k) AS den FROM {n}x, (VALUES {taps}) t(o, k) GROUP BY ALL),
    {n} AS (SELECT s.y, s.x, CASE WHEN s.v IS NOT NULL AND den >= 0.5 THEN num/den END AS v FROM {src} s JOIN {n}y g ON s.y = g.y AND s.x = g.x)"""


@query("j01_smoothed", f"WITH {IMAGE}, {SMOOTH.format(n='sm', src='image', taps=taps(1.2))} SELECT y, x, round(v, 6) AS v FROM sm")
def smoothed(spark, sf):
    return tidy(ops.smoothed(image(spark, sf), [], "v", 1.2), 6)


#: Fields go on mirrored at their edges, again and again where a kernel reaches beyond the mirror image.
REFLECT = """{n}x AS (SELECT y, t.x, sum(coalesce(v, 0)*k) AS num, sum(CASE WHEN v IS NULL THEN 0 ELSE k END) AS den FROM range(0, 40) t(x), (VALUES {taps}) w(o, k), image i WHERE i.x = least(((t.x + o) % 80 + 80) % 80, 79 - ((t.x + o) % 80 + 80) % 80) GROUP BY ALL),
    {n}y AS (SELECT t.y, g.x, sum(num*k) AS num, sum(den*k) AS den FROM (SELECT DISTINCT y FROM image) t, (VALUES {taps}) w(o, k), {n}x g, (SELECT max(y) + 1 AS n FROM image) m WHERE g.y = least(((t.y + o) % (2*m.n) + 2*m.n) % (2*m.n), 2*m.n - 1 - ((t.y + o) % (2*m.n) + 2*m.n) % (2*m.n)) GROUP BY ALL),
    {n} AS (SELECT s.y, s.x, CASE WHEN s.v IS NOT NULL THEN num/den END AS v FROM image s JOIN {n}y g ON s.y = g.y AND s.x = g.x)"""


@query("j05_band_pass", f"WITH {IMAGE}, {REFLECT.format(n='sa', taps=taps(0.5, 4.0))}, {REFLECT.format(n='sb', taps=taps(1.5, 4.0))} SELECT y, x, round(sa.v - sb.v, 6) AS v FROM sa JOIN sb USING (y, x)")
def band_pass(spark, sf):
    """The difference of two smooths, reflected at the edges and cut at four sigmas."""
    rows = image(spark, sf)
    size = ((rows.agg(F.max("y")).first()[0] or 0) + 1, 40)
    both = ops.smoothed_by(rows.withColumn("valid", F.col("v").isNotNull()), [], {"v": "valid"}, {"a": 0.5, "b": 1.5}, 4.0, 0.0, size)
    return tidy(both.select("y", "x", (F.col("v_a") - F.col("v_b")).alias("v")), 6)


FLOW = "flow AS (SELECT p_partkey // 40 AS y, p_partkey % 40 AS x, p_retailprice/1000 AS u, p_size/10.0 AS v, 20 + (p_partkey // 40)*0.1 AS lat FROM part)"


def flow(spark, sf):
    part = table(spark, sf, "part").select(F.expr("p_partkey div 40").alias("y"), (F.col("p_partkey") % 40).alias("x"), (F.col("p_retailprice") / 1000).alias("u"), (F.col("p_size") / 10.0).alias("v"))
    return part.withColumn("lat", 20 + F.col("y") * 0.1)


#: Distance of the two neighbours in m, along x at a latitude and along y.
SX, SY = f"({2 * math.radians(0.1) * ops.RADIUS!r}*cos(radians(lat)))", repr(2 * math.radians(0.1) * ops.RADIUS)
TURN = FLOW + f""", n AS (SELECT y, x, (lead(v) OVER r - lag(v) OVER r)/{SX} AS vx, (lead(u) OVER r - lag(u) OVER r)/{SX} AS ux, (lead(v) OVER c - lag(v) OVER c)/{SY} AS vy, (lead(u) OVER c - lag(u) OVER c)/{SY} AS uy, u, v, lat
    FROM flow WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))"""


def derivatives(spark, sf):
    rows = flow(spark, sf)
    sx, sy = 2 * math.radians(0.1) * ops.RADIUS * F.cos(F.radians("lat")), F.lit(2 * math.radians(0.1) * ops.RADIUS)
    return rows.select("y", "x", "u", "v", "lat", *(ops.centred(F.col(c), [], a, o, s).alias(c + a) for c in ("u", "v") for a, o, s in (("x", "y", sx), ("y", "x", sy))))


@query("j06_vorticity_divergence", f"WITH {TURN} SELECT y, x, round(1e6*(vx - uy + u*tan(radians(lat))/{ops.RADIUS}), 6) AS vorticity, round(1e6*(ux + vy - v*tan(radians(lat))/{ops.RADIUS}), 6) AS divergence FROM n")
def vorticity(spark, sf):
    r = F.tan(F.radians("lat")) / ops.RADIUS
    return tidy(derivatives(spark, sf).select("y", "x", (1e6 * (F.col("vx") - F.col("uy") + F.col("u") * r)).alias("vorticity"), (1e6 * (F.col("ux") + F.col("vy") - F.col("v") * r)).alias("divergence")), 6)


@query("j07_geostrophic_residual", f"WITH {TURN}, t AS (SELECT {2 * ops.OMEGA}*sin(radians(lat)) AS f, * FROM n), g AS (SELECT f*u AS left_x, -{ops.GRAVITY}*vy/1e4 AS right_x, f*v AS left_y, {ops.GRAVITY}*vx/1e4 AS right_y FROM t WHERE vx IS NOT NULL AND vy IS NOT NULL) SELECT count(*) AS n, round(1e6*sqrt(avg(pow(left_x - right_x, 2) + pow(left_y - right_y, 2))), 6) AS residual, round(1e6*sqrt(avg(left_x*left_x + left_y*left_y)), 6) AS lhs FROM g")
def geostrophic(spark, sf):
    """Both sides of a balance, their residual and its rms over the region."""
    f = 2 * ops.OMEGA * F.sin(F.radians("lat"))
    rows = derivatives(spark, sf).where("vx IS NOT NULL AND vy IS NOT NULL").select((f * F.col("u")).alias("lx"), (-ops.GRAVITY * F.col("vy") / 1e4).alias("rx"), (f * F.col("v")).alias("ly"), (ops.GRAVITY * F.col("vx") / 1e4).alias("ry"))
    res = (F.col("lx") - F.col("rx")) ** 2 + (F.col("ly") - F.col("ry")) ** 2
    return tidy(rows.agg(F.count("*").alias("n"), (1e6 * F.sqrt(F.avg(res))).alias("residual"), (1e6 * F.sqrt(F.avg(F.col("lx") ** 2 + F.col("ly") ** 2))).alias("lhs")), 6)


DENSITY = "rho AS (SELECT l_orderkey AS col, l_linenumber AS k, avg(l_quantity/2) AS t, 30 + avg(l_discount)*60 AS s FROM lineitem GROUP BY ALL)"
C1, C2, C3, C4, C5, C6, C7 = phys.SIGMA2
SIGMA = f"({C1} + {C3}*s + t*({C2} + {C5}*s + t*({C4} + {C7}*s + {C6}*t)))"


def density(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("col"), F.col("l_linenumber").alias("k")).agg(F.avg(F.col("l_quantity") / 2).alias("t"), (30 + F.avg("l_discount") * 60).alias("s"))
    return rows.withColumn("sigma", phys.sigma2(F.col("t"), F.col("s")))


@query("i01_sigma2", f"WITH {DENSITY} SELECT col, k, round({SIGMA}, 6) AS sigma FROM rho")
def sigma2(spark, sf):
    return tidy(density(spark, sf).select("col", "k", "sigma"), 6)


@query("j08_inversion_fraction", f"WITH {DENSITY}, d AS (SELECT {SIGMA} - lead({SIGMA}) OVER (PARTITION BY col ORDER BY k) AS drop FROM rho) SELECT count(drop) AS pairs, round(avg(CASE WHEN drop > 0.01 THEN 1.0 WHEN drop IS NOT NULL THEN 0 END), 8) AS share, round(avg(pow(greatest(drop, 0)/0.01, 2)), 2) AS penalty FROM d WHERE drop IS NOT NULL")
def inversions(spark, sf):
    """The share of adjacent levels whose density falls downward, and the penalty on it."""
    drop = F.col("sigma") - F.lead("sigma").over(Window.partitionBy("col").orderBy("k"))
    rows = density(spark, sf).select(drop.alias("drop")).where("drop IS NOT NULL")
    return tidy(rows.agg(F.count("*").alias("pairs"), F.avg((F.col("drop") > 0.01).cast("double")).alias("share"), F.avg((F.greatest("drop", F.lit(0.0)) / 0.01) ** 2).alias("penalty")), 8, penalty=2)


EDGE = FLOW + """, f AS (SELECT y, x, coalesce({c} >= {t}, false) AS fast, lat FROM flow),
    nb AS (SELECT *, coalesce(lag(fast) OVER r AND lead(fast) OVER r AND lag(fast) OVER c AND lead(fast) OVER c, false) AS inner_ FROM f WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)),
    edges AS (SELECT y, x, lat, fast AND NOT inner_ AND x < 38 AS edge FROM nb)"""


def edges(spark, sf, speed, threshold):
    rows = flow(spark, sf).withColumn("speed", speed).withColumn("region", F.col("x") < 38)
    return ops.front_edges(rows, [], "speed", "region", threshold)


@query("j09_front_edges", f"WITH {EDGE.format(c='v', t=3.0)} SELECT y, count_if(edge) AS edges FROM edges GROUP BY y")
def front_edges(spark, sf):
    return edges(spark, sf, F.col("v"), 3.0).groupBy("y").agg(F.count_if("edge").alias("edges"))


@query("j10_distance_to_front", f"WITH {EDGE.format(c='v', t=4.9)}, e AS (SELECT y AS ey, x AS ex FROM edges WHERE edge) SELECT y, x, round(coalesce(min(sqrt((x-ex)*(x-ex) + (y-ey)*(y-ey))), 0)*any_value({phys.RADIUS_KM}*radians(0.04)*cos(radians(lat))), 6) AS km FROM edges LEFT JOIN e ON true GROUP BY y, x")
def distance(spark, sf):
    """Km to the nearest edge of the front; 0 everywhere if there is none."""
    rows = ops.distance_to(edges(spark, sf, F.col("v"), 4.9), [], "edge", 0.0)
    return tidy(rows.select("y", "x", (F.col("distance") * phys.cell_km(F.col("lat"))).alias("km")), 6)


@query("j11_front_distance", f"""WITH {EDGE.format(c='v', t=4.7)}, p AS (SELECT y, x, edge AS a, lag(edge, 3) OVER (PARTITION BY y ORDER BY x) AS b, {phys.RADIUS_KM}*radians(0.04)*cos(radians(lat)) AS km FROM edges),
    d AS (SELECT min(sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y)))*any_value(p.km) AS d FROM p, p q WHERE p.a AND q.b GROUP BY p.y, p.x UNION ALL SELECT min(sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y)))*any_value(p.km) FROM p, p q WHERE p.b AND q.a GROUP BY p.y, p.x)
    SELECT 'ok' AS status, round(avg(d), 6) AS mean_km, round(max(d), 6) AS hausdorff_km, round(quantile_cont(d, 0.95), 6) AS p95_km FROM d""")
def front_distance(spark, sf):
    """A front against itself three cells on."""
    rows = edges(spark, sf, F.col("v"), 4.7).select("y", "x", F.col("edge").alias("a"), F.coalesce(ops.beside(F.col("edge"), [], "x", "y", -3), F.lit(False)).alias("b"), phys.cell_km(F.col("lat")).alias("km"), F.lit(1).alias("field"))
    return tidy(ops.front_distance(rows, ["field"], "a", "b", "km").drop("field"), 6)


#: The predicted speed of the front's loss, beside the true one, v.
GUESS = "(v*0.9 + u*0.3)"
EDGES_OF_BOTH = EDGE.format(c="v", t=4.5) + EDGE.format(c=GUESS, t=4.5).removeprefix(FLOW).replace(", f AS", ", f2 AS").replace("nb AS", "nb2 AS").replace("FROM f WINDOW", "FROM f2 WINDOW").replace("edges AS", "edges2 AS").replace("FROM nb)", "FROM nb2)")


@query("n05_front_loss", f"""WITH {EDGES_OF_BOTH}, d AS (SELECT a.y, a.x, coalesce(min(sqrt((a.x-e.x)*(a.x-e.x) + (a.y-e.y)*(a.y-e.y))), 0) AS d FROM edges a LEFT JOIN edges e ON e.edge GROUP BY ALL), d2 AS (SELECT a.y, a.x, coalesce(min(sqrt((a.x-e.x)*(a.x-e.x) + (a.y-e.y)*(a.y-e.y))), 0) AS d FROM edges a LEFT JOIN edges2 e ON e.edge GROUP BY ALL)
    SELECT round(avg(pow(1/(1+exp(-({GUESS} - 4.5)/0.5)) - CASE WHEN v >= 4.5 THEN 1 ELSE 0 END, 2)*(d.d*d.d + d2.d*d2.d)*pow({phys.RADIUS_KM}*radians(0.04)*cos(radians(lat)), 2)), 6) AS loss FROM flow s JOIN d ON d.y = s.y AND d.x = s.x JOIN d2 ON d2.y = s.y AND d2.x = s.x WHERE s.x < 38""")
def front_loss(spark, sf):
    """Squared difference of soft masks times the squared distances to both fronts, over the region."""
    rows = flow(spark, sf).select("y", "x", "v", (F.col("v") * 0.9 + F.col("u") * 0.3).alias("guess"), (F.col("x") < 38).alias("region"), phys.cell_km(F.col("lat")).alias("km"))
    return tidy(ops.front_loss(rows.withColumn("one", F.lit(1)), ["one"], "guess", "v", "region", "km", 4.5, 0.5).drop("one"), 6)


@query("j12_boundary_mask", f"WITH {IMAGE}, m AS (SELECT max(y) AS h FROM image), e AS (SELECT y AS ey, x AS ex FROM image, m WHERE v IS NOT NULL AND (x < 2 OR y < 2 OR x > 37 OR y > h - 2)), d AS (SELECT y, x, v, min(sqrt((x-ex)*(x-ex) + (y-ey)*(y-ey))) AS d FROM image, e GROUP BY ALL) SELECT y, count_if(v IS NULL OR d <= 4) AS boundary FROM d GROUP BY y")
def boundary_mask(spark, sf):
    """Land, and ocean within a band of the open edge's ocean (the outer two rows and columns)."""
    rows = image(spark, sf)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("y").alias("height"))))  # one row
    outer = (F.col("x") < 2) | (F.col("y") < 2) | (F.col("x") > 37) | (F.col("y") > F.col("height") - 2)
    rows = ops.distance_to(rows.withColumn("open", F.col("v").isNotNull() & outer), [], "open")
    return rows.groupBy("y").agg(F.count_if(F.col("v").isNull() | (F.col("distance") <= 4)).alias("boundary"))


@query("j14_bilinear", """WITH g AS (SELECT n_nationkey % 5 AS i, n_nationkey // 5 AS j, n_regionkey + 1.0 AS v FROM nation), p AS (SELECT c_custkey AS key, (c_custkey % 40)*0.1*72 AS lat, (c_custkey % 97)*11.0 - 360 AS lon FROM customer),
    f AS (SELECT key, lat/72 AS fy, (((lon % 360) + 360) % 360)/72 AS fx FROM p), c AS (SELECT key, CAST(floor(fy) AS INT) + dy AS i, (CAST(floor(fx) AS INT) + dx) % 5 AS j, (CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END)*(CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) AS k FROM f, range(0, 2) a(dy), range(0, 2) b(dx))
    SELECT key, CASE WHEN count_if(v IS NULL) = 0 THEN round(sum(k*v), 6) END AS value FROM c LEFT JOIN g USING (i, j) WHERE k > 0 GROUP BY key""")
def bilinear(spark, sf):
    """Points on a coarse global grid; longitude wraps, a point outside raises."""
    grid = table(spark, sf, "nation").select((F.col("n_nationkey") % 5).cast("long").alias("i"), F.expr("n_nationkey div 5").alias("j"), (F.col("n_regionkey") + 1.0).alias("v"))
    points = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), ((F.col("c_custkey") % 40) * 0.1 * 72).alias("lat"), ((F.col("c_custkey") % 97) * 11.0 - 360).alias("lon"))
    return tidy(ops.bilinear(points, grid, 72.0).select("key", F.col("got").alias("value")), 6)


@query("j15_consistency_checks", f"""WITH {DENSITY}, a AS (SELECT col, count(*) AS n, count_if(t < 3) AS thin, stddev_pop({SIGMA}) AS spread, sum(t) AS total FROM rho GROUP BY col), {NEAR}
    SELECT count(*) AS columns, sum(thin)::BIGINT AS thin, round(avg(spread), 6) AS spread, round(max(total), 6) AS largest, (SELECT round(sqrt(avg(pow(l + rr + u + d - 4*v, 2))), 6) FROM n) AS laplacian FROM a""")
def consistency(spark, sf):
    """Several consistency numbers of one state in a row."""
    a = density(spark, sf).groupBy("col").agg(F.count_if(F.col("t") < 3).alias("thin"), F.stddev_pop("sigma").alias("spread"), F.sum("t").alias("total"))
    a = a.agg(F.lit(1).alias("one"), F.count("*").alias("columns"), F.sum("thin").alias("thin"), F.avg("spread").alias("spread"), F.max("total").alias("largest"))
    b = image(spark, sf).select(ops.laplacian("v", []).alias("l")).agg(F.lit(1).alias("one"), F.sqrt(F.avg(F.col("l") * F.col("l"))).alias("laplacian"))
    return tidy(a.join(b, "one").drop("one"), 6)


@query("j16_tiles_with_halo", f"WITH {IMAGE}, {SMOOTH.format(n='sm', src='image', taps=taps(0.6))} SELECT y//16 AS ty, x//16 AS tx, count(v) AS n, round(sum(v), 5) AS total FROM sm GROUP BY ALL")
def tiles(spark, sf):
    """Smoothing tile by tile, each with a halo that is cropped again: the same as smoothing the whole."""
    rows = ops.tiled(image(spark, sf), 16, 4)
    inner = rows.select("ty", "tx", "y", "x", "inner")
    out = ops.smoothed(rows, ["ty", "tx"], "v", 0.6).join(inner.where("inner"), ["ty", "tx", "y", "x"])
    return tidy(out.groupBy("ty", "tx").agg(F.count("v").alias("n"), F.sum("v").alias("total")), 5)


# Column functions


@query("i02_calendar", f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), p AS (SELECT day, n_nationkey*3.0 - 36 AS lat, dayofyear(day) AS n, CASE WHEN (year(day) % 4 = 0 AND year(day) % 100 <> 0) OR year(day) % 400 = 0 THEN 366 ELSE 365 END AS days FROM d JOIN nation ON n_nationkey = dayofyear(day) % 25),
    q AS (SELECT *, radians(23.44)*sin(2*pi()*(284 + n)/365) AS tilt, radians(lat) AS phi FROM p), h AS (SELECT *, acos(greatest(-1, least(1, -tan(phi)*tan(tilt)))) AS half FROM q)
    SELECT day, round(sin(2*pi()*(n - 0.5)/days), 8) AS sin_doy, round(cos(2*pi()*(n - 0.5)/days), 8) AS cos_doy, round(1361/pi()*(1 + 0.033*cos(2*pi()*n/365))*(half*sin(phi)*sin(tilt) + cos(phi)*cos(tilt)*sin(half)), 5) AS insolation FROM h""")
def calendar(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    lat = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 3.0 - 36).alias("lat"))
    rows = days.withColumn("n_nationkey", F.dayofyear("day") % 25).join(lat, "n_nationkey")
    day = F.col("day")
    return tidy(rows.select("day", F.sin(phys.phase(day)).alias("sin_doy"), F.cos(phys.phase(day)).alias("cos_doy"), phys.insolation(day, F.col("lat")).alias("insolation")), 8, insolation=5)


@query("q03_sql_functions", f"WITH {DENSITY} SELECT col, k, round({SIGMA}, 6) AS sigma, round(CASE WHEN t > 10 THEN t ELSE 1 END, 6) AS std, round({phys.RADIUS_KM}*radians(0.08)*cos(radians(k*10)), 6) AS km FROM rho")
def sql_functions(spark, sf):
    """Functions registered by name, used in SQL."""
    from ..functions.registry import register

    register(spark)
    rows = density(spark, sf).select("col", "k", F.expr("sigma2(t, s)").alias("sigma"), F.expr("safe_std(CASE WHEN t > 10 THEN t ELSE 0D END)").alias("std"), F.expr("cell_km(CAST(k * 10 AS DOUBLE), 0.08D)").alias("km"))
    return tidy(rows, 6)


@query("i03_cell_size", f"SELECT n_nationkey AS key, round({phys.RADIUS_KM}*radians(0.04)*cos(radians(n_nationkey*3.0 - 36)), 8) AS km FROM nation")
def cell_size(spark, sf):
    return tidy(table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), phys.cell_km(F.col("n_nationkey") * 3.0 - 36).alias("km")), 8)


@query("i04_surface_speed", f"WITH {FLOW}, c AS (SELECT y, x, (u + coalesce(lead(u) OVER r, u))/2 AS uc, (v + coalesce(lead(v) OVER c, v))/2 AS vc FROM flow WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)) SELECT y, x, round(sqrt(uc*uc + vc*vc + 1e-12), 8) AS speed FROM c")
def surface_speed(spark, sf):
    """Velocities on cell faces averaged to centres, the last repeated, and their speed."""
    u, v = F.col("u"), F.col("v")
    rows = flow(spark, sf).select("y", "x", ((u + F.coalesce(ops.beside(u, [], "x", "y", 1), u)) / 2).alias("uc"), ((v + F.coalesce(ops.beside(v, [], "y", "x", 1), v)) / 2).alias("vc"))
    return tidy(rows.select("y", "x", F.sqrt(F.col("uc") ** 2 + F.col("vc") ** 2 + 1e-12).alias("speed")), 8)


PLACES = "places AS (SELECT p_partkey AS key, -98 + (p_partkey % 40)*0.5 AS lon, 18 + (p_partkey // 40)*0.25 AS lat, p_retailprice - 800 AS depth FROM part)"


@query("i05_regions", f"WITH {PLACES} SELECT key, depth > 500 AND lon <= -81 AND lat >= 21.5 AS deep, NOT ((lat < 21.5 AND lon > -87.5) OR (lat < 22.75 AND lon > -84) OR lon > -81) AS basin, lat > 24 OR lon < -87 AS eddy FROM places")
def regions(spark, sf):
    """Two different predicates for the basin, and the region of eddies."""
    part = table(spark, sf, "part")
    lon, lat = -98 + (F.col("p_partkey") % 40) * 0.5, 18 + F.expr("p_partkey div 40") * 0.25
    return part.select(F.col("p_partkey").alias("key"), ((F.col("p_retailprice") - 800 > 500) & phys.in_region("west of the straits", lon, lat)).alias("deep"), phys.in_region("basin", lon, lat).alias("basin"), phys.in_region("eddies", lon, lat).alias("eddy"))


@query("i07_safe_std", "SELECT p_size AS size, round(CASE WHEN stddev_pop(p_size) > 0 THEN stddev_pop(p_size) ELSE 1 END, 6) AS std FROM part GROUP BY p_size")
def safe_std(spark, sf):
    from ..operators.moments import safe, std_pop

    return tidy(table(spark, sf, "part").groupBy(F.col("p_size").alias("size")).agg(safe(std_pop("p_size")).alias("std")), 6)


@query("i08_grid_spacing", "WITH s AS (SELECT c_nationkey AS line, c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS d FROM customer) SELECT line, round(quantile_cont(abs(d), 0.5), 6) AS spacing FROM s WHERE d IS NOT NULL GROUP BY line")
def grid_spacing(spark, sf):
    """The median distance of neighbouring coordinates."""
    d = F.abs(F.col("c_acctbal") - F.lag("c_acctbal").over(Window.partitionBy("c_nationkey").orderBy("c_acctbal")))
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("line"), d.alias("d")).where("d IS NOT NULL")
    return tidy(quantiles(rows, ["line"], {"spacing": (F.col("d"), 0.5)}), 6)


@query("i09_metric_grid", f"WITH {PLACES} SELECT key, round(radians(0.5)*6371000*cos(radians(lat)), 4) AS dx, round(2*7.2921e-5*sin(radians(lat))*1e5, 8) AS f, round(tan(radians(lat))/6371000*1e8, 8) AS tan_r FROM places")
def metric_grid(spark, sf):
    """Spacing, rotation and curvature at each latitude."""
    lat = F.radians(18 + F.expr("p_partkey div 40") * 0.25)
    return tidy(table(spark, sf, "part").select(F.col("p_partkey").alias("key"), (math.radians(0.5) * ops.RADIUS * F.cos(lat)).alias("dx"), (2 * ops.OMEGA * F.sin(lat) * 1e5).alias("f"), (F.tan(lat) / ops.RADIUS * 1e8).alias("tan_r")), 8, dx=4)


@query("i10_group_weights", "WITH g AS (SELECT split_part(p_name, ' ', 1) AS grp, p_name AS name, count(*) AS n FROM part GROUP BY ALL) SELECT name, round(1.0/((SELECT count(DISTINCT grp) FROM g)*count(*) OVER (PARTITION BY grp)), 8) AS weight FROM g")
def group_weights(spark, sf):
    """Each group weighs alike, split over its channels."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("grp")).distinct()
    groups = names.select("grp").distinct().agg(F.count("*").alias("groups"), F.lit(1).alias("one"))
    rows = names.withColumn("n", F.count("*").over(Window.partitionBy("grp"))).withColumn("one", F.lit(1)).join(F.broadcast(groups), "one")  # one row
    return tidy(rows.select("name", (1.0 / (F.col("groups") * F.col("n"))).alias("weight")), 8)


# Spectra


DX = 30.0
#: The corner of each field that is land.
LAND = (4, 3)
OCEAN = np.ones((8, 8), bool)
OCEAN[: LAND[0], : LAND[1]] = False
WET = f"(CASE WHEN y < {LAND[0]} AND x < {LAND[1]} THEN 0.0::DOUBLE ELSE 1.0 END)"
HANN = [0.5 - 0.5 * math.cos(2 * math.pi * n / 7) for n in range(8)]
HANNS = "[" + ", ".join(map(repr, HANN)) + "]"
W2 = float(np.square(spec.hann((8, 8), OCEAN)).sum())
BAND = " ".join(f"WHEN 1/sqrt(k2) >= {lo} AND 1/sqrt(k2) < {hi if hi < 1e9 else 1e9} THEN {k}" for k, (lo, hi) in enumerate(spec.BANDS.values()))
DFT = CELLS + f""", w AS (SELECT *, {HANNS}[y + 1]*{HANNS}[x + 1]*{WET} AS w FROM cells), m AS (SELECT id, sum(h*w)/sum(w) AS m FROM w GROUP BY id), a AS (SELECT w.id, label, y, x, (h - m)*w AS a FROM w JOIN m USING (id)),
    f AS (SELECT id, label, ky, kx, sum(a*cos(2*pi()*(ky*y + kx*x)/8)) AS re, sum(a*sin(2*pi()*(ky*y + kx*x)/8)) AS im FROM a, range(0, 8) p(ky), range(0, 8) q(kx) GROUP BY ALL),
    p AS (SELECT id, label, (re*re + im*im)/(64*{W2!r}) AS p, (pow(CASE WHEN ky > 3 THEN ky - 8 ELSE ky END, 2) + pow(CASE WHEN kx > 3 THEN kx - 8 ELSE kx END, 2))/(64*{DX}*{DX}) AS k2 FROM f),
    b AS (SELECT id, label, p, CASE {BAND} END AS band FROM p WHERE k2 > 0)"""


@query("k01_band_variance", f"WITH {DFT} SELECT id, band, round(sum(p)*1e3, 6) AS power FROM b GROUP BY ALL")
def band_variance(spark, sf):
    rows = spec.band_variances(fields(spark, sf), "id long, label int", (8, 8), DX, mask=OCEAN)
    out = rows.unpivot("id", ["b0", "b1", "b2", "b3"], "name", "power").select("id", F.substring("name", 2, 1).cast("int").alias("band"), (F.col("power") * 1e3).alias("power"))
    return tidy(out, 6)


@query("k05_spectral_ratio", f"WITH {DFT}, s AS (SELECT label, band, sum(p) AS p FROM b GROUP BY ALL) SELECT label, round(max(CASE WHEN band = 0 THEN p END)/sum(p), 6) AS small, round(max(CASE WHEN band = 2 THEN p END)/sum(p), 6) AS large FROM s GROUP BY label")
def spectral_ratio(spark, sf):
    rows = spec.band_variances(fields(spark, sf), "id long, label int", (8, 8), DX, mask=OCEAN).groupBy("label").agg(*(F.sum(f"b{k}").alias(f"b{k}") for k in range(4)))
    total = F.col("b0") + F.col("b1") + F.col("b2") + F.col("b3")
    return tidy(rows.select("label", (F.col("b0") / total).alias("small"), (F.col("b2") / total).alias("large")), 6)


@query("k02_cross_spectrum", DFT.replace("fields AS (SELECT vec_id", "WITH fields AS (SELECT vec_id", 1) + " SELECT label, round(1e3*sum(p), 6) AS covariance FROM b GROUP BY label")
def cross_spectrum(spark, sf):
    """Cross power of a field and itself, over all bands."""
    rows = fields(spark, sf).withColumn("u", F.col("v"))
    out = spec.band_variances(rows, "id long, label int", (8, 8), DX, "v", "u", OCEAN)
    return tidy(out.groupBy("label").agg((1e3 * F.sum(F.col("b0") + F.col("b1") + F.col("b2") + F.col("b3"))).alias("covariance")), 6)


HANN4 = "[" + ", ".join(repr(0.5 - 0.5 * math.cos(2 * math.pi * n / 3)) for n in range(4)) + "]"
W4 = float(np.square(spec.hann((4, 4), OCEAN[::2, ::2])).sum())
ALIAS = CELLS + f""", w AS (SELECT *, {HANNS}[y + 1]*{HANNS}[x + 1]*{WET} AS w, CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN {HANN4}[y // 2 + 1]*{HANN4}[x // 2 + 1]*{WET} ELSE 0 END AS ws FROM cells),
    m AS (SELECT id, sum(h*w)/sum(w) AS m, sum(h*ws)/sum(ws) AS ms FROM w GROUP BY id), a AS (SELECT w.id, y, x, (h - m)*w AS a, (h - ms)*ws AS s FROM w JOIN m USING (id)),
    f AS (SELECT id, ky, kx, sum(a*cos(2*pi()*(ky*y + kx*x)/8)) AS re, sum(a*sin(2*pi()*(ky*y + kx*x)/8)) AS im, sum(s*cos(2*pi()*(ky*y + kx*x)/8)) AS sr, sum(s*sin(2*pi()*(ky*y + kx*x)/8)) AS si FROM a, range(-4, 4) p(ky), range(-4, 4) q(kx) GROUP BY ALL),
    p AS (SELECT id, ky, kx, (re*re + im*im)/(64*{W2!r}) AS pf, (sr*sr + si*si)/(16*{W4!r}) AS ps FROM f WHERE ky*ky + kx*kx > 0 AND 8*{DX}/sqrt(ky*ky + kx*kx) >= 100),
    t AS (SELECT id, sum(ps) FILTER (ky BETWEEN -2 AND 1 AND kx BETWEEN -2 AND 1) AS sub, sum(pf) FILTER (ky BETWEEN -2 AND 2 AND kx BETWEEN -2 AND 2) AS whole FROM p GROUP BY id)"""


@query("k03_alias_share", f"WITH {ALIAS} SELECT id, round((sub - whole)/sub, 5) AS share FROM t")
def alias_share(spark, sf):
    """The share of power at long wavelengths that taking every second cell folds there."""
    return tidy(spec.alias_share(fields(spark, sf), "id long", (8, 8), 2, DX, ("100to200km", "gt200km"), OCEAN), 5)


EXCESS = CELLS + f""", s AS (SELECT id, y, x, h/0.1*{WET} AS t, 0.7*v[64 - y*8 - x]/0.1*{WET} AS p FROM cells JOIN fields USING (id)),
    f AS (SELECT id, ky, kx, sum(p*cos(2*pi()*(ky*y + kx*x)/8)) AS pr, sum(p*sin(2*pi()*(ky*y + kx*x)/8)) AS pi_, sum(t*cos(2*pi()*(ky*y + kx*x)/8)) AS tr, sum(t*sin(2*pi()*(ky*y + kx*x)/8)) AS ti FROM s, range(0, 8) a(ky), range(0, 8) b(kx) GROUP BY ALL),
    r AS (SELECT id, round_even(sqrt(pow(CASE WHEN ky > 3 THEN ky - 8 ELSE ky END, 2) + pow(CASE WHEN kx > 4 THEN kx - 8 ELSE kx END, 2)), 0) AS ring, sum(pr*pr + pi_*pi_)/64 AS px, sum(tr*tr + ti*ti)/64 AS py, sum(pr*tr + pi_*ti)/64 AS c FROM f GROUP BY ALL)"""


@query("k04_adjusted_excess", f"WITH {EXCESS} SELECT id, round(sum(2*(greatest(px, py) - sqrt(px*py + 1e-12))*(1 - c/sqrt(px*py + 1e-12)))/{int(OCEAN.sum())}, 6) AS excess FROM r GROUP BY id")
def adjusted_excess(spark, sf):
    """The excess of each field's forecast by its own mirror image."""
    rows = fields(spark, sf).withColumn("p", F.transform("v", lambda x: 0.7 * x)).withColumn("p", F.reverse("p"))
    return tidy(spec.adjusted_excess(rows.select("id", "p", "v"), "id long", (8, 8), "p", "v", 0.1, mask=OCEAN), 6)


@query("k06_correlated_noise")
def noise(spark, sf):
    """Seeded fields of correlated noise: their mean square and their neighbours' correlation."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [spec.correlated_noise((16, 16), (8.0, 8.0), 24.0, int(i)) for i in p["id"]]
            yield p.assign(mean_square=[float(np.square(f).mean()) for f in out], beside=[float((f[:, 1:] * f[:, :-1]).mean()) for f in out])

    return fields(spark, sf).select("id").mapInPandas(run, "id long, mean_square double, beside double")


@query("c03_pivoted_fields", f"WITH {FIELDS} SELECT id, round(sum(CASE WHEN i % 8 = 1 THEN v[i] END), 6) AS x0, round(sum(CASE WHEN i % 8 = 0 THEN v[i] END), 6) AS x7 FROM fields, range(1, 65) t(i) GROUP BY id")
def pivoted(spark, sf):
    """Fields from rows of cells to columns."""
    rows = cells(spark, sf).where("x IN (0, 7)").withColumn("name", F.concat(F.lit("x"), F.col("x").cast("string")))
    return tidy(rows.groupBy("id").pivot("name", ["x0", "x7"]).agg(F.sum("h")), 6)
