"""Statistics of forecast steps, by families, and the scorecard made from them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import physics as phys
from ..operators import consistency, grids, losses, spectra
from ..operators import scorecard as card
from ..operators import statistics as ops
from ..operators import topology as top
from ..shared import cut, parts_of
from .registry import query
from .scores import tidy
from .tables import FIELDS, table

LEVELS, SPACING, MOST_LEADS = (0, 100, 200, 500), 0.25, 10
#: Channels with their value at a field of zeros and per unit of the field; a day has one field for each.
CHANNELS = [(f"{v}_{z}m", *of(z)) for v, of in {"temp": lambda z: (25 - z / 40, 6.0), "salin": lambda z: (35.5 + z / 1000, 1.0), "u": lambda z: (0.0, 4 - z / 250), "v": lambda z: (0.0, 4 - z / 250)}.items() for z in LEVELS]
CHANNELS += [("ssh", 0.0, 1.5), ("ubaro", 0.0, 0.5), ("vbaro", 0.0, 0.5)]
N = len(CHANNELS)
#: Bytes of the files whose runs a task makes.
RUN_BYTES = 1 << 20
#: The model: 0.7 of a day and 0.2 of the day before make the next; by lead, what it takes of the last two true days.
LAST, BEFORE = [1.0, 0.7], [0.0, 0.2]
for _ in range(MOST_LEADS):
    LAST.append(0.7 * LAST[-1] + 0.2 * LAST[-2])
    BEFORE.append(0.7 * BEFORE[-1] + 0.2 * BEFORE[-2])


def grid(spark):
    """An 8 by 8 grid with a shelf in the west and a corner of land; its last column is the boundary, where the model is given the truth."""
    rows = spark.range(64).select(F.expr("id div 8").alias("y"), (F.col("id") % 8).alias("x"))
    rows = rows.withColumns({"lon": -87.5 + F.col("x") * SPACING, "lat": 22 + F.col("y") * SPACING, "depth": F.when((F.col("y") >= 6) & (F.col("x") < 2), 0.0).otherwise(60.0 + 130 * F.col("x") + 20 * F.col("y"))})
    deep, lon, lat = F.col("depth") > ops.PIECE_DEPTH, F.col("lon"), F.col("lat")
    return rows.withColumns(
        {f"sea_{z}m": F.col("depth") > z for z in LEVELS}
        | {"area": F.cos(F.radians(lat)) ** 2, "region": (F.col("depth") > 0) & (F.col("x") < 7), "deep": deep, "front": deep & phys.in_region("west of the straits", lon, lat), "strip": deep & lat.between(21.9, 22.4) & lon.between(-87.0, -84.8)}
    )


def forecast(spark, sf):
    """Runs of the model from every day that has one before it, up to ten days or the end of the record but one.

    Whole days are stored. In a plan each start is sent those that its run takes, once, and its leads and cells are made of
    them where they lie, so whatever is grouped by start needs no other shuffle. A state's channels are columns of their own,
    as a plan makes all of a struct for each cell or none.
    """
    rows = table(spark, sf, "embeddings").select(F.expr(f"int(vec_id div {N})").alias("day"), (F.col("vec_id") % N).alias("c"), F.col("embedding").alias("v"))
    parts, names = parts_of(rows, RUN_BYTES), [name for name, *_ in CHANNELS]
    days = rows.groupBy("day").agg(F.count("*").alias("n"), *(F.first(F.when(F.col("c") == k, F.col("v")), True).alias(name) for k, name in enumerate(names))).where(F.col("n") == N)
    days = cut(days.select("day", F.size(F.arrays_zip(*names)).alias("cells"), *names).where("cells > 0"))  # not of a day that lacks a field
    t = (days.agg(F.max("day")).first()[0] or 0) + 1
    sent = days.select(F.struct("cells", *names).alias("s"), "day", F.explode(F.sequence(F.lit(-1), F.lit(MOST_LEADS))).alias("ahead"))
    sent = sent.select((F.col("day") - F.col("ahead")).cast("long").alias("start"), "ahead", "s").where(f"start BETWEEN 1 AND {t - 3}")
    runs = sent.repartition(parts, "start").groupBy("start").agg(F.map_from_entries(F.collect_list(F.struct("ahead", "s"))).alias("days"))

    of = {"x0": F.lit(0), "x1": F.lit(-1), "t": F.col("lead"), "tp": F.col("lead") - 1}
    leads = F.sequence(F.lit(1), F.least(F.lit(MOST_LEADS), (t - 2 - F.col("start")).cast("int")))
    steps = runs.select("start", "days", F.explode(leads).alias("lead")).select("start", "lead", *(F.try_element_at("days", at).alias(k) for k, at in of.items()))
    steps = steps.select("start", "lead", F.least(*(F.coalesce(f"{k}.cells", F.lit(0)) for k in of)).alias("cells"), *(F.col(f"{k}.{name}").alias(f"{k}_{name}") for k in of for name in names))
    cells = steps.where("cells > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    factor = lambda of, ahead: F.element_at(F.array(*(F.lit(k) for k in of)), F.col("lead") + ahead)
    field, x = (lambda day, name: F.get(f"{day}_{name}", F.col("at")).cast("double")), (F.col("at") % 8).cast("long")

    def channels(who, raw):
        return [(a + b * raw(name)).alias(f"{who}_{name}") for name, a, b in CHANNELS]

    def predicted(who, truth, ahead):
        return channels(who, lambda name: F.when(x == 7, field(truth, name)).otherwise(factor(LAST, ahead) * field("x0", name) + factor(BEFORE, ahead) * field("x1", name)))

    plain = lambda who, day: channels(who, lambda name: field(day, name))
    return cells.select("start", "lead", F.expr("bigint(at div 8)").alias("y"), x.alias("x"), *predicted("pred", "t", 1), *plain("truth", "t"), *plain("x0", "x0"), *predicted("pred_prev", "tp", 0), *plain("truth_prev", "tp"))


def steps(spark, sf):
    return ops.Steps(forecast(spark, sf), grid(spark), LEVELS, SPACING, kept=True)


# The same in SQL: channels one below the other

PLACE = f"""place AS MATERIALIZED (SELECT *, 2*{grids.OMEGA}*sin(radians(lat)) AS f, tan(radians(lat))/{grids.RADIUS} AS tr, pow(cos(radians(lat)), 2) AS area, depth > 0 AND x < 7 AS region, depth > 500 AS deep, depth > 500 AND lat BETWEEN 21.9 AND 22.4 AND lon BETWEEN -87.0 AND -84.8 AS strip,
    pow({SPACING}*{phys.KM_A_DEGREE}*cos(radians(lat)), 2) AS km2, {phys.RADIUS_KM}*radians({SPACING})*cos(radians(lat)) AS km FROM (SELECT i // 8 AS y, i % 8 AS x, -87.5::DOUBLE + (i % 8)*{SPACING} AS lon, 22::DOUBLE + (i // 8)*{SPACING} AS lat, CASE WHEN i // 8 >= 6 AND i % 8 < 2 THEN 0.0::DOUBLE ELSE 60 + 130*(i % 8) + 20*(i // 8) END AS depth FROM range(0, 64) r(i)))"""
CHANNEL = "channel AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', '{n.split('_')[0]}', {int(n.split('_')[1][:-1]) if '_' in n else 'NULL'}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (n, a, b) in enumerate(CHANNELS)) + ") c(c, name, var, z, a, b))"
FACTOR = "factor AS (SELECT * FROM (VALUES " + ", ".join(f"({lead}, {LAST[lead]!r}::DOUBLE, {BEFORE[lead]!r}::DOUBLE)" for lead in range(MOST_LEADS + 1)) + ") k(k, p, q))"
LONG = f"""{FIELDS}, {PLACE}, {CHANNEL}, {FACTOR},
    whole AS (SELECT id // {N} AS day FROM fields GROUP BY ALL HAVING count(*) = {N}),
    raw AS MATERIALIZED (SELECT day, (i - 1) // 8 AS y, (i - 1) % 8 AS x, id % {N} AS c, v[i] AS r FROM fields JOIN whole ON day = id // {N}, range(1, 65) t(i)),
    runs AS (SELECT s.day AS start, lead FROM whole s, range(1, {MOST_LEADS + 1}) l(lead) WHERE s.day >= 1 AND lead <= (SELECT max(day) + 1 FROM whole) - 2 - s.day),
    long AS MATERIALIZED (SELECT start, CAST(lead AS INTEGER) AS lead, t.y, t.x, name, var, z, a + b*t.r AS truth, a + b*o.r AS x0, a + b*tp.r AS truth_prev, a + b*(CASE WHEN t.x = 7 THEN t.r ELSE k.p*o.r + k.q*o1.r END) AS pred, a + b*(CASE WHEN t.x = 7 THEN tp.r ELSE k0.p*o.r + k0.q*o1.r END) AS pred_prev
        FROM runs JOIN raw t ON t.day = start + lead JOIN raw o ON o.day = start AND o.y = t.y AND o.x = t.x AND o.c = t.c JOIN raw o1 ON o1.day = start - 1 AND o1.y = t.y AND o1.x = t.x AND o1.c = t.c
        JOIN raw tp ON tp.day = start + lead - 1 AND tp.y = t.y AND tp.x = t.x AND tp.c = t.c JOIN channel ch ON ch.c = t.c JOIN factor k ON k.k = lead JOIN factor k0 ON k0.k = lead - 1)"""
#: The states of model and truth one below the other.
STATES = "states AS MATERIALIZED (SELECT start, lead, 'model' AS who, y, x, name, z, pred AS v, pred_prev AS before FROM long UNION ALL SELECT start, lead, 'truth', y, x, name, z, truth, truth_prev FROM long)"


def pick(when: dict[str, str], value: str, name: str) -> str:
    """The one value of a group for which conditions hold."""
    return f"max(CASE WHEN {' AND '.join(f'{k} = {v!r}' for k, v in when.items())} THEN {value} END) AS {name}"


DZ = "CASE z WHEN 0 THEN 50 WHEN 100 THEN 100 WHEN 200 THEN 200 WHEN 500 THEN 1650 ELSE 1 END"
FIELD_SQL = f"""weighted AS (SELECT *, CASE WHEN region AND depth > coalesce(z, 0) THEN area*{DZ} ELSE 0 END AS w, pred - truth AS e, x0 - truth AS p, pred - pred_prev AS da, truth - truth_prev AS db FROM long JOIN place USING (y, x)),
    sums AS (SELECT start, lead, var, sum(w) AS w, sum(w*e) AS e, sum(w*e*e) AS ee, sum(w*p) AS p, sum(w*p*p) AS pp, sum(w*da)/sum(w) AS ma, sum(w*db)/sum(w) AS mb FROM weighted WHERE name NOT LIKE '%baro' GROUP BY ALL),
    change AS (SELECT start, lead, var, sum(s.w) AS n, sum(s.w*(da - ma)*(db - mb)) AS ab, sum(s.w*pow(da - ma, 2)) AS aa, sum(s.w*pow(db - mb, 2)) AS bb FROM weighted s JOIN sums USING (start, lead, var) GROUP BY ALL),
    by_field AS (SELECT start, lead, {', '.join(pick({'var': f}, v, f'{n}_{f}') for f in ops.FIELDS for n, v in (('rmse', 'sqrt(ee/w)'), ('rmse_pers', 'sqrt(pp/w)'), ('bias', 'e/w'), ('bias_pers', 'p/w')))} FROM sums GROUP BY ALL),
    by_change AS (SELECT start, lead, {', '.join(pick({'var': f}, 'ab/nullif(sqrt(aa*bb), 0)', f'corr_change_{f}') for f in ops.FIELDS)} FROM change GROUP BY ALL),
    whole_area AS (SELECT sum(area) AS area FROM place WHERE region),
    means AS (SELECT start, lead, {', '.join(f"sum(w*{x}) FILTER (name = '{c}')/sum(w) FILTER (name = '{c}') AS mean_{c}_{who}" for c in ops.MEANS for who, x in ops.WHO.items())}, {', '.join(f"sum(w*{x}*{x}/2) FILTER (var IN ('u', 'v'))/any_value(whole_area.area) AS ke_{who}" for who, x in ops.WHO.items())} FROM weighted, whole_area GROUP BY ALL),
    surface AS MATERIALIZED (SELECT start, lead, y, x, {', '.join(f"sqrt(sum({s}*{s})) AS {s}" for s in ('pred', 'truth', 'x0'))} FROM long WHERE name IN ('u_0m', 'v_0m') GROUP BY ALL),
    fastest AS (SELECT start, lead, {', '.join(f'max({x}) AS maxspeed_{who}' for who, x in ops.WHO.items())} FROM surface JOIN place USING (y, x) WHERE region GROUP BY ALL)"""

HANN = lambda n: "CAST([" + ", ".join(repr(float(w)) for w in np.hanning(n)) + "] AS DOUBLE[])"
BANDS = " ".join(f"WHEN k2 <= {1 / max(lo, 1e-9) ** 2!r} AND k2 > {1 / hi**2 if math.isfinite(hi) else 0.0!r} THEN '{name}'" for name, (lo, hi) in spectra.BANDS.items())
SPECTRUM_SQL = f"""side AS (SELECT avg(sqrt(km2)) AS dx FROM place WHERE region),
    taper AS MATERIALIZED (SELECT start, lead, who, name, y, x, v, CASE WHEN region AND depth > coalesce(z, 0) THEN {HANN(8)}[y + 1]*{HANN(7)}[x + 1] ELSE 0 END AS w FROM states JOIN place USING (y, x) WHERE name IN ('ssh', 'temp_100m') AND x < 7),
    middle AS (SELECT start, lead, who, name, sum(v*w)/sum(w) AS m, sum(w*w) AS w2 FROM taper GROUP BY ALL),
    bins AS (SELECT start, lead, who, name, ky, kx, any_value(w2) AS w2, sum((v - m)*w*cos(2*pi()*(ky*y/8.0 + kx*x/7.0))) AS re, sum((v - m)*w*sin(2*pi()*(ky*y/8.0 + kx*x/7.0))) AS im FROM taper JOIN middle USING (start, lead, who, name), range(-4, 4) a(ky), range(-3, 4) b(kx) GROUP BY ALL),
    power AS (SELECT start, lead, who, name, (re*re + im*im)/(56*w2) AS p, (pow(ky/8.0, 2) + pow(kx/7.0, 2))/(dx*dx) AS k2 FROM bins, side WHERE ky <> 0 OR kx <> 0),
    bands AS (SELECT start, lead, who, name, CASE {BANDS} END AS band, sum(p) AS p FROM power GROUP BY ALL),
    spectra AS (SELECT start, lead, {', '.join(pick({'name': c, 'band': b, 'who': who}, 'p', f'spec_{c}_{b}_{who}') for c in ops.SPECTRA for b in spectra.BANDS for who in ops.WHO)} FROM bands GROUP BY ALL)"""

PIECE_SQL = """level AS (SELECT start, lead, who, sum(v*km2)/sum(km2) AS m FROM states JOIN place USING (y, x) WHERE name = 'ssh' AND deep GROUP BY ALL),
    high AS MATERIALIZED (SELECT start, lead, who, y, x FROM states JOIN place USING (y, x) JOIN level USING (start, lead, who) WHERE name = 'ssh' AND deep AND v - m >= 0.17),
    flood AS (SELECT start, lead, who, y, x, y*8 + x AS root FROM high UNION SELECT h.start, h.lead, h.who, h.y, h.x, f.root FROM flood f JOIN high h ON h.start = f.start AND h.lead = f.lead AND h.who = f.who AND abs(h.y - f.y) + abs(h.x - f.x) = 1),
    cell_of AS MATERIALIZED (SELECT start, lead, who, y, x, min(root) AS root FROM flood GROUP BY ALL),
    piece AS (SELECT start, lead, who, root, sum(km2) AS km2, max(lat) AS north, count_if(strip) AS seeds FROM cell_of JOIN place USING (y, x) GROUP BY ALL),
    main AS (SELECT start, lead, who, arg_min(root, struct_pack(a := -seeds, b := root)) AS main FROM piece WHERE seeds > 0 GROUP BY ALL),
    piece_of AS (SELECT s.start, s.lead, s.who, max(CASE WHEN root = main THEN north END) AS north, coalesce(sum(CASE WHEN root IS DISTINCT FROM main AND km2 >= 1000 THEN 1 ELSE 0 END), 0)::DOUBLE AS lce, coalesce(max(CASE WHEN root = main THEN km2 END), 0) AS area
        FROM level s LEFT JOIN piece USING (start, lead, who) LEFT JOIN main USING (start, lead, who) GROUP BY ALL),
    pieces AS (SELECT start, lead, """ + ", ".join(pick({"who": who}, k, f"lc_{k}_{who}") for k in ("north", "lce", "area") for who in ops.WHO) + " FROM piece_of GROUP BY ALL)"

FRONT_SQL = f"""fast AS MATERIALIZED (SELECT start, lead, 'pred' AS who, y, x FROM surface WHERE pred >= {ops.FRONT_MS} UNION ALL SELECT start, lead, 'x0', y, x FROM surface WHERE x0 >= {ops.FRONT_MS} UNION ALL SELECT start, lead, 'truth', y, x FROM surface WHERE truth >= {ops.FRONT_MS}),
    edge AS MATERIALIZED (SELECT f.start, f.lead, f.who, f.y, f.x, any_value(km) AS km FROM fast f JOIN place p ON p.y = f.y AND p.x = f.x AND p.deep LEFT JOIN fast n ON n.start = f.start AND n.lead = f.lead AND n.who = f.who AND abs(n.y - f.y) + abs(n.x - f.x) = 1 GROUP BY ALL HAVING count(n.y) < 4),
    apart AS (SELECT a.start, a.lead, CASE WHEN a.who = 'truth' THEN b.who ELSE a.who END AS who, a.who AS of_, a.y, a.x, min(sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)))*any_value(a.km) AS km FROM edge a JOIN edge b ON b.start = a.start AND b.lead = a.lead AND a.who <> b.who AND 'truth' IN (a.who, b.who) GROUP BY a.start, a.lead, a.who, b.who, a.y, a.x),
    fronts AS (SELECT start, lead, {', '.join(f"{f}(km) FILTER (who = '{x}') AS front_{k}_km_{n}" for k, f in (('mean', 'avg'), ('hausdorff', 'max')) for n, x in (('model', 'pred'), ('pers', 'x0')))} FROM apart GROUP BY ALL)"""

SIDE = float(np.mean(np.sqrt(np.cos(np.radians(22 + np.arange(1, 7) * SPACING))))) * math.radians(SPACING) * grids.RADIUS
TAPS = ", ".join(f"('{s}', {o}, {w!r}::DOUBLE)" for s, km in ops.SCALES_KM.items() for o, w in grids.kernel(km * 1000 / SIDE).items())
SX, SY = f"({2 * math.radians(SPACING) * grids.RADIUS!r}*cos(radians(lat)))", repr(2 * math.radians(SPACING) * grids.RADIUS)
C1, C2, C3, C4, C5, C6, C7 = phys.SIGMA2
SIGMA = lambda t, s: f"({C1} + {C3}*{s} + {t}*({C2} + {C5}*{s} + {t}*({C4} + {C7}*{s} + {C6}*{t})))"


def of_cell(name: str, value: str = "v") -> str:
    return f"max({value}) FILTER (name = '{name}')"


#: Names of the values that are smoothed, their expressions of a cell's channels, and the depth at which they are real.
VALUES = {f"{v}{z}": (of_cell(f"{v}_{z}m"), z) for v in "uv" for z in ops.VORTICITY} | {"ssh": (of_cell("ssh"), 0), "rise": (f"({of_cell('ssh')} - {of_cell('ssh', 'before')})/86400", 0)}
VALUES |= {f"h{v}": (f"any_value(depth)*({of_cell(f'{v}baro')} + {of_cell(f'{v}baro', 'before')})/2", 0) for v in "uv"}
for a, b in ops.SHEAR:
    VALUES |= {f"{v}z{a}": (f"({of_cell(f'{v}_{a}m')} - {of_cell(f'{v}_{b}m')})/{b - a}", b) for v in "uv"}
    VALUES[f"rho{a}"] = (f"({SIGMA(of_cell(f'temp_{a}m'), of_cell(f'salin_{a}m'))} + {SIGMA(of_cell(f'temp_{b}m'), of_cell(f'salin_{b}m'))})/2", b)
TIE_SIDES = {"geo": (["u0", "v0"], ["-9.81/f*ssh_y", "9.81/f*ssh_x"]), "cont": (["rise"], ["-(hu_x + hv_y - hv*tr)"])}
TIE_SIDES |= {f"tw_{a}m_{b}m": ([f"uz{a}", f"vz{a}"], [f"9.81/(f*1025.0)*rho{a}_y", f"-9.81/(f*1025.0)*rho{a}_x"]) for a, b in ops.SHEAR}
SINGLE = {f"zeta_{z}m": f"(v{z}_x - u{z}_y + u{z}*tr)/f" for z in ops.VORTICITY} | {"div_0m": "(u0_x + v0_y - v0*tr)/f"}


def tie_columns() -> str:
    out = []
    for t, (left, right) in TIE_SIDES.items():
        whole = " AND ".join(f"{side} IS NOT NULL" for side in (*left, *right))
        for k in range(2):
            x, y = (left[k], right[k]) if k < len(left) else ("0", "0")
            out += [f"CASE WHEN {whole} THEN {x} END AS {t}_l{k}", f"CASE WHEN {whole} THEN {x} - ({y}) END AS {t}_r{k}"]
    return ", ".join(out)


def rms(*parts: str) -> str:
    return f"sqrt(coalesce(avg({' + '.join(f'pow({p}, 2)' for p in parts)}), 0))"


OPERATOR_SQL = f"""wide AS (SELECT start, lead, who, y, x, {', '.join(f'CASE WHEN any_value(depth) > {z} THEN {e} END AS {n}' for n, (e, z) in VALUES.items())} FROM states JOIN place USING (y, x) GROUP BY ALL),
    tall AS MATERIALIZED (UNPIVOT wide ON {', '.join(VALUES)} INTO NAME name VALUE v),
    taps AS (SELECT * FROM (VALUES {TAPS}) t(s, o, k)),
    along_x AS MATERIALIZED (SELECT start, lead, who, name, s, y, x + o AS x, sum(v*k) AS num, sum(k) AS den FROM tall, taps GROUP BY ALL),
    along_y AS (SELECT start, lead, who, name, a.s, y + o AS y, x, sum(num*k) AS num, sum(den*k) AS den FROM along_x a JOIN taps t ON t.s = a.s GROUP BY ALL),
    smooth AS MATERIALIZED (SELECT start, lead, who, name, s, y, x, CASE WHEN den >= 0.5 THEN num/den END AS v FROM tall JOIN along_y USING (start, lead, who, name, y, x)),
    sloped AS (SELECT g.start, g.lead, g.who, g.name, g.s, g.y, g.x, g.v, CASE WHEN g.v IS NOT NULL THEN (e.v - w.v)/{SX} END AS dx, CASE WHEN g.v IS NOT NULL THEN (n.v - u.v)/{SY} END AS dy FROM smooth g JOIN place p ON p.y = g.y AND p.x = g.x
        {' '.join(f'LEFT JOIN smooth {j} ON {j}.start = g.start AND {j}.lead = g.lead AND {j}.who = g.who AND {j}.name = g.name AND {j}.s = g.s AND {j}.y = g.y{dy} AND {j}.x = g.x{dx}' for j, dy, dx in (('e', '', ' + 1'), ('w', '', ' - 1'), ('n', ' + 1', ''), ('u', ' - 1', '')))}),
    level_of AS (SELECT start, lead, who, s, y, x, {', '.join(f"max(v) FILTER (name = '{n}') AS {n}, max(dx) FILTER (name = '{n}') AS {n}_x, max(dy) FILTER (name = '{n}') AS {n}_y" for n in VALUES)} FROM sloped GROUP BY ALL),
    sided AS MATERIALIZED (SELECT start, lead, who, s, y, x, {', '.join(f'{e} AS {n}' for n, e in SINGLE.items())}, {tie_columns()} FROM level_of JOIN place USING (y, x) WHERE region),
    rooted AS (SELECT start, lead, who, s, {', '.join(f'{rms(n)} AS {n}' for n in SINGLE)}, {', '.join(f'{rms(f"{t}_l0", f"{t}_l1")} AS {t}_lhs, {rms(f"{t}_r0", f"{t}_r1")} AS {t}_residual' for t in ops.TIES)} FROM sided GROUP BY ALL),
    missed AS (SELECT start, lead, s, {', '.join(f'{rms(f"a.{t}_r0 - b.{t}_r0", f"a.{t}_r1 - b.{t}_r1")} AS {t}' for t in ops.TIES)} FROM sided a JOIN sided b USING (start, lead, s, y, x) WHERE a.who = 'model' AND b.who = 'truth' GROUP BY ALL),
    operators AS (SELECT start, lead, {', '.join(pick({'s': s, 'who': who}, n, f'op_{n}_{s}_{who}') for s in ops.SCALES_KM for who in ops.WHO for n in SINGLE)},
        {', '.join(pick({'s': s, 'who': who}, f'{t}_{part}', f'op_{t}_{s}_{part}_{who}') for s in ops.SCALES_KM for who in ops.WHO for t in ops.TIES for part in ('residual', 'lhs'))} FROM rooted GROUP BY ALL),
    errors AS (SELECT start, lead, {', '.join(pick({'s': s}, t, f'op_{t}_{s}_error') for s in ops.SCALES_KM for t in ops.TIES)} FROM missed GROUP BY ALL),
    density AS (SELECT start, lead, who, y, x, z, depth, {SIGMA("max(v) FILTER (name LIKE 'temp%')", "max(v) FILTER (name LIKE 'salin%')")} AS rho FROM states JOIN place USING (y, x) WHERE region AND z IS NOT NULL GROUP BY ALL),
    falls AS (SELECT start, lead, who, avg(CASE WHEN rho - below > 0.01 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM (SELECT *, lead(rho) OVER w AS below, lead(z) OVER w AS under FROM density WINDOW w AS (PARTITION BY start, lead, who, y, x ORDER BY z)) WHERE depth > under GROUP BY ALL),
    inversions AS (SELECT start, lead, {', '.join(pick({'who': who}, 'share', f'op_inversions_{who}') for who in ops.WHO)} FROM falls GROUP BY ALL)"""

NAMES = list(ops.registry())
OTHERS = {f"spec_{c}_{b}_ratio": f"spec_{c}_{b}_model/nullif(spec_{c}_{b}_truth, 0)" for c in ops.SPECTRA for b in spectra.BANDS} | {"lc_north_error": "lc_north_model - lc_north_truth"}
#: All statistics, as the table ``stats``.
STATS = f"""RECURSIVE {LONG}, {STATES}, {FIELD_SQL}, {SPECTRUM_SQL}, {PIECE_SQL}, {FRONT_SQL}, {OPERATOR_SQL},
    stats AS MATERIALIZED (SELECT CAST(start AS BIGINT) AS start, CAST(lead AS INTEGER) AS lead, {', '.join(f'{OTHERS.get(n, n)} AS {n}' for n in NAMES)} FROM by_field JOIN by_change USING (start, lead) JOIN means USING (start, lead) JOIN fastest USING (start, lead) JOIN spectra USING (start, lead)
        JOIN pieces USING (start, lead) LEFT JOIN fronts USING (start, lead) JOIN operators USING (start, lead) JOIN errors USING (start, lead) JOIN inversions USING (start, lead))"""


def places(name: str) -> int:
    """Decimals that a statistic is rounded to."""
    return 12 if name.startswith("op_tw") else 4 if name.startswith(("ke", "lc_area", "op_cont")) and "cont" not in name else 8


@query("m04_statistics", f"WITH {STATS} SELECT start, lead, {', '.join(f'round({n}, {places(n)}) AS {n}' for n in NAMES)} FROM stats")
def statistics(spark, sf):
    """All 126 statistics of every start and lead."""
    return tidy(ops.statistics(steps(spark, sf)), **{n: places(n) for n in NAMES})


# The scorecard


#: Test runs start on or after a day, runs in the sample before another.
TEST, IN_SAMPLE = 15, 12
LEADS = tuple(k for k in card.REPORTED if k <= MOST_LEADS)


def sql_diagnostics() -> str:
    """(name, family, value, low, high, how) of each diagnostic as rows of a VALUES list over ``stats`` and ``own``."""
    def row(name, family, a, b, low=0.9, high=1.1, how="median"):
        return f"('{name}', '{family}', CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 'inf'::DOUBLE WHEN {a} < 0 THEN '-inf'::DOUBLE END ELSE {a}/{b} END, {low}::DOUBLE, {high}::DOUBLE, '{how}')"

    pair = lambda name, family, key, *rest: row(name, family, f"{key}_model", f"{key}_truth", *rest)
    out = [pair("ke", "blur", "ke"), pair("maxspeed", "blur", "maxspeed")]
    out += [f"('spec_{c}_{b}', 'blur', spec_{c}_{b}_ratio, 0.9::DOUBLE, 1.1::DOUBLE, 'median')" for c in ops.SPECTRA for b in spectra.BANDS]
    out += [f"('mean_{c}', 'drift', mean_{c}_model - mean_{c}_truth, -own.s_{c}, own.s_{c}, 'median')" for c in ops.MEANS]
    out += [row("front_vs_persistence", "eddies", "front_mean_km_model", "front_mean_km_pers", 0.0, 1.0), pair("lc_area", "eddies", "lc_area"), pair("lc_lce", "eddies", "lc_lce", 0.67, 1.5, "mean"), pair("inversions", "structure", "op_inversions", 0.5, 2.0)]
    for s in ops.SCALES_KM:
        out += [pair(f"{k}_{s}", "blur", f"op_{k}_{s}") for k in SINGLE] + [pair(f"{t}_{s}", "ties", f"op_{t}_{s}_residual") for t in ops.TIES]
    return ", ".join(out)


FINITE = "CASE WHEN isfinite({v}) THEN {v} END"
CURVES = f"""own AS (SELECT {', '.join(f'coalesce(stddev_pop(mean_{c}_truth - before_{c}), 0) AS s_{c}' for c in ops.MEANS)} FROM (SELECT *, {', '.join(f'lag(mean_{c}_truth, 7) OVER w AS before_{c}' for c in ops.MEANS)} FROM stats WINDOW w AS (PARTITION BY start ORDER BY lead))),
    each AS MATERIALIZED (SELECT start, lead, d.* FROM stats, own, LATERAL (VALUES {sql_diagnostics()}) d(name, family, v, low, high, how)),
    curve AS MATERIALIZED (SELECT name, lead, which, any_value(low) AS low, any_value(high) AS high, CASE WHEN any_value(how) = 'mean' THEN CASE WHEN count_if(isinf(v)) = 0 THEN avg(CASE WHEN isfinite(v) THEN v END) END ELSE quantile_cont(v, 0.5) END AS m FROM each, (VALUES ('test'), ('in_sample')) w(which) WHERE (which = 'test' AND start >= {TEST} OR which = 'in_sample' AND start < {IN_SAMPLE}) GROUP BY ALL)"""
CARD = f"""{CURVES},
    outside AS (SELECT name, which, lead, sum(CASE WHEN isfinite(m) AND (m < low OR m > high) THEN 1 ELSE 0 END) OVER (PARTITION BY name, which ORDER BY lead ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM curve),
    departs AS (SELECT name, {', '.join(f"min(lead) FILTER (which = '{w}' AND n = 3) AS departs_{w}" for w in ('test', 'in_sample'))} FROM outside GROUP BY name),
    reported AS (SELECT name, {', '.join(f"max({FINITE.format(v='m')}) FILTER (lead = {k}) AS d{k}" for k in LEADS)} FROM curve WHERE which = 'test' GROUP BY name),
    share AS (SELECT name, quantile_cont(v, 0.5) AS share FROM stats, LATERAL (VALUES {', '.join(f"('{t}_{s}', CASE WHEN op_{t}_{s}_lhs_truth > 0 THEN op_{t}_{s}_residual_truth/op_{t}_{s}_lhs_truth END)" for s in ops.SCALES_KM for t in ops.TIES)}) d(name, v) WHERE start < {IN_SAMPLE} GROUP BY name)
    SELECT e.name AS diagnostic, e.family, round(e.low, 8) AS low, round(e.high, 8) AS high, departs_test, departs_in_sample, {', '.join(f'round(d{k}, 8) AS d{k}' for k in LEADS)}, (SELECT count(DISTINCT start) FROM stats WHERE start >= {TEST}) AS n_test, round(share, 8) AS truth_residual_share, share <= 0.5 AS usable_as_loss
    FROM (SELECT DISTINCT name, family, low, high FROM each) e LEFT JOIN departs USING (name) LEFT JOIN reported USING (name) LEFT JOIN share USING (name)"""


def of_test():
    return F.col("start") >= TEST


@query("e22_scorecard", f"WITH {STATS}, {CARD}")
def scorecard(spark, sf):
    """The 32 diagnostics: the lead at which each leaves its band, over test starts and over those in the sample, and its values at some leads."""
    stats = cut(ops.statistics(steps(spark, sf)))
    return tidy(card.full_scorecard(stats, of_test(), F.col("start") < IN_SAMPLE, LEADS), 8)


#: Diagnostics that are asked for by name, so that only their statistics are planned.
CHOSEN = ("ke", "maxspeed", "lc_area", "front_vs_persistence")


@query("q02_diagnostic_series", f"WITH {STATS}, {CURVES} SELECT name, lead, round({FINITE.format(v='m')}, 8) AS value FROM curve WHERE which = 'test' AND name IN {CHOSEN}")
def diagnostic_series(spark, sf):
    """Curves of diagnostics chosen by name: only the families behind them are computed."""
    needed = ["ke_model", "ke_truth", "maxspeed_model", "maxspeed_truth", "lc_area_model", "lc_area_truth", "front_mean_km_model", "front_mean_km_pers"]
    stats = cut(ops.statistics(steps(spark, sf), needed))
    rows = [card.Diagnostic("ke", "blur", card.over("ke_model", "ke_truth")), card.Diagnostic("maxspeed", "blur", card.over("maxspeed_model", "maxspeed_truth")), card.Diagnostic("lc_area", "eddies", card.over("lc_area_model", "lc_area_truth")), card.Diagnostic("front_vs_persistence", "eddies", card.over("front_mean_km_model", "front_mean_km_pers"), card.FRONTS)]
    return tidy(card.curves(stats, rows, of_test()), 8)


# Losses


#: Weights of the terms that are added to the square error.
TERMS = {"means": 0.1, "excess": 0.5, "stability": 0.2}
ALL_CHANNELS = [name for name, *_ in CHANNELS]
FULL_LOSS = f"""{LONG}, {STATES}, scale AS (SELECT name, stddev_pop(truth) AS s FROM long GROUP BY name), inside AS (SELECT count(*) AS n FROM place WHERE region),
    wmse AS (SELECT start, lead, sum(pow((pred - truth)/s, 2))/any_value(inside.n) AS wmse FROM long JOIN scale USING (name) JOIN place USING (y, x), inside WHERE region GROUP BY ALL),
    mean AS (SELECT start, lead, name, sum(area*pred)/sum(area) AS p, sum(area*truth)/sum(area) AS t, sum(area*truth_prev)/sum(area) AS b FROM long JOIN place USING (y, x) WHERE region AND depth > coalesce(z, 0) AND name IN {ops.MEANS} GROUP BY ALL),
    own_change AS (SELECT name, stddev_pop(d) AS s FROM (SELECT DISTINCT ON (name, start + lead) name, t - b AS d FROM mean WHERE start < {IN_SAMPLE}) GROUP BY name),
    means AS (SELECT start, lead, sum(pow((p - t)/s, 2)) AS means FROM mean JOIN own_change USING (name) GROUP BY ALL),
    scaled AS MATERIALIZED (SELECT start, lead, name, y, x, CASE WHEN region THEN pred/s ELSE 0 END AS p, CASE WHEN region THEN truth/s ELSE 0 END AS t FROM long JOIN scale USING (name) JOIN place USING (y, x)),
    wave AS (SELECT start, lead, name, ky, kx, sum(p*cos(2*pi()*(ky*y + kx*x)/8)) AS pr, sum(p*sin(2*pi()*(ky*y + kx*x)/8)) AS pj, sum(t*cos(2*pi()*(ky*y + kx*x)/8)) AS tr, sum(t*sin(2*pi()*(ky*y + kx*x)/8)) AS tj FROM scaled, range(-4, 4) a(ky), range(-4, 4) b(kx) GROUP BY ALL),
    ring AS (SELECT start, lead, name, round_even(sqrt(ky*ky + kx*kx), 0) AS ring, sum(pr*pr + pj*pj)/64 AS px, sum(tr*tr + tj*tj)/64 AS py, sum(pr*tr + pj*tj)/64 AS c FROM wave GROUP BY ALL),
    excess AS (SELECT start, lead, sum(2*(greatest(px, py) - sqrt(px*py + 1e-12))*(1 - c/sqrt(px*py + 1e-12)))/any_value(inside.n) AS excess FROM ring, inside GROUP BY ALL),
    column_of AS (SELECT start, lead, y, x, z, depth, {SIGMA("max(v) FILTER (name LIKE 'temp%')", "max(v) FILTER (name LIKE 'salin%')")} AS rho FROM states JOIN place USING (y, x) WHERE region AND z IS NOT NULL AND who = 'model' GROUP BY ALL),
    stability AS (SELECT start, lead, avg(pow(greatest(rho - below, 0)/{losses.INVERSION_SCALE}, 2)) AS stability FROM (SELECT *, lead(rho) OVER w AS below, lead(z) OVER w AS under FROM column_of WINDOW w AS (PARTITION BY start, lead, y, x ORDER BY z)) WHERE depth > under GROUP BY ALL)
    SELECT CAST(start AS BIGINT) AS start, lead, round(wmse, 6) AS wmse, round(means, 6) AS means, round(excess, 6) AS excess, round(stability, 5) AS stability, round(wmse + {TERMS['means']}*means + {TERMS['excess']}*excess + {TERMS['stability']}*stability, 5) AS loss
    FROM wmse JOIN means USING (start, lead) JOIN excess USING (start, lead) JOIN stability USING (start, lead)"""


@query("n03_step_loss", f"WITH {FULL_LOSS}")
def step_loss(spark, sf):
    """The square error of every step with the penalty of means, the adjusted spectral error and the stability of levels."""
    of = steps(spark, sf)
    ops.stored_cells(of, {(who, c) for who in ("pred", "truth", "truth_prev") for c in ALL_CHANNELS})
    return tidy(losses.step_loss(of, ALL_CHANNELS, TERMS, F.col("start") < IN_SAMPLE), 6, stability=5, loss=5)


LAYER_STATES = """one AS (SELECT l_orderkey AS col, l_linenumber AS k, avg(l_quantity) - 8 AS dp, avg(l_quantity)/2 AS temp_truth, avg(l_quantity*(1 - l_discount/9))/2 AS temp_pred, 30 + avg(l_discount)*60 AS salin_truth, 30 + avg(l_tax)*60 AS salin_pred FROM lineitem GROUP BY ALL)"""
WEIGHTS = {"density": 1e-6, "stability": 1e-5}


@query("n01_layer_loss", f"""WITH {LAYER_STATES}, scale AS (SELECT stddev_pop(temp_truth) AS st, stddev_pop(salin_truth) AS ss FROM one),
    r AS (SELECT *, greatest(dp, 0)/greatest(avg(greatest(dp, 0)) OVER w, 1e-6) AS rel, {SIGMA('temp_pred', 'salin_pred')} AS p, {SIGMA('temp_truth', 'salin_truth')} AS t FROM one WINDOW w AS (PARTITION BY col)),
    b AS (SELECT *, lead(p) OVER d AS below, least(rel, lead(rel) OVER d) AS both_ FROM r WINDOW d AS (PARTITION BY col ORDER BY k)),
    c AS (SELECT col, sum(rel*(pow((temp_pred - temp_truth)/st, 2) + pow((salin_pred - salin_truth)/ss, 2))) AS wmse, avg(rel*pow((p - t)/{losses.RHO_REF}, 2)) AS density, coalesce(avg(CASE WHEN below IS NOT NULL THEN both_*pow(greatest(p - below, 0)/{losses.RHO_REF}, 2) END), 0) AS stability FROM b, scale GROUP BY col)
    SELECT CAST(col % 64 AS BIGINT) AS part, count(*) AS columns, round(avg(wmse), 6) AS wmse, round(avg(density), 2) AS density, round(avg(stability), 2) AS stability, round(avg(wmse + {WEIGHTS['density']!r}::DOUBLE*density + {WEIGHTS['stability']!r}::DOUBLE*stability), 5) AS loss FROM c GROUP BY ALL""")
def layer_loss(spark, sf):
    """Errors of layers weighted by their thickness, with the terms of density and of stability, of every column, by part of the domain."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    one = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("col"), F.col("l_linenumber").alias("k")).agg(
        (F.avg(q) - 8).alias("dp"), (F.avg(q) / 2).alias("temp_truth"), (F.avg(q * (1 - d / 9)) / 2).alias("temp_pred"), (30 + F.avg(d) * 60).alias("salin_truth"), (30 + F.avg("l_tax") * 60).alias("salin_pred"))
    scale = one.agg(F.stddev_pop("temp_truth").alias("temp"), F.stddev_pop("salin_truth").alias("salin")).first().asDict()
    columns = losses.layer_loss(one, "col", "k", scale, WEIGHTS)
    out = columns.groupBy((F.col("col") % 64).alias("part")).agg(F.count("*").alias("columns"), *(F.avg(c).alias(c) for c in ("wmse", "density", "stability", "loss")))
    return tidy(out, 6, density=2, stability=2, loss=5)


# Consistency of states


def thickness(who, z):
    """A layer's thickness in m, from the level's velocity."""
    return 6 + 8 * F.col(f"{who}_v_{z}m")


#: Fields of a state: sea surface, temperature, salinity and velocity of the first layer, thickness of the third, surface speed.
CHECKED = {
    "ssh": lambda x: F.col(f"{x}_ssh"), "t01": lambda x: F.col(f"{x}_temp_0m"), "s01": lambda x: F.col(f"{x}_salin_0m"), "u01": lambda x: F.col(f"{x}_u_0m") + F.col(f"{x}_ubaro"), "thk20": lambda x: thickness(x, 200),
    "spd": lambda x: F.hypot(F.col(f"{x}_u_0m") + F.col(f"{x}_ubaro"), F.col(f"{x}_v_0m") + F.col(f"{x}_vbaro")),
}
LAPLACIANS, SLOPES, BANDED, LEAST_CELLS = ["ssh", "t01", "u01", "thk20"], ["t01", "s01"], ["t01", "spd"], 10
#: The same in SQL, of the columns p_<channel> of a state.
CHECKED_SQL = {"ssh": "ssh", "t01": "temp_0m", "s01": "salin_0m", "u01": "(u_0m + ubaro)", "thk20": "(6 + 8*v_200m)", "spd": "sqrt(pow(u_0m + ubaro, 2) + pow(v_0m + vbaro, 2))"}


def mirrored(sigma: float) -> dict[tuple[int, int], float]:
    """The weight of each cell for each in smoothing eight cells in a row that go on mirrored at their edges, as often as it takes."""
    out: dict[tuple[int, int], float] = {}
    for cell in range(8):
        for o, w in grids.kernel(sigma, 4.0).items():
            k = (cell + o) % 16
            at = (cell, k if k < 8 else 15 - k)
            out[at] = out.get(at, 0.0) + w
    return out


MIRRORS = ", ".join(f"('{s}', {c}, {k}, {w!r}::DOUBLE)" for s, sigma in (("fine", 0.5), ("coarse", 2.5)) for (c, k), w in mirrored(sigma).items())
DP = {z: f"(6 + 8*v_{z}m)" for z in LEVELS}
NEXT = list(zip(LEVELS, LEVELS[1:], strict=False))
RHO = {z: SIGMA(f"temp_{z}m", f"salin_{z}m") for z in LEVELS}
CHECKS = f"""{LONG}, wide AS (SELECT start, lead, y, x, who, {', '.join(f"max(v) FILTER (name = '{n}') AS {n}" for n in ALL_CHANNELS)} FROM (SELECT start, lead, y, x, name, 'model' AS who, pred AS v FROM long UNION ALL SELECT start, lead, y, x, name, 'truth', truth FROM long UNION ALL SELECT start, lead, y, x, name, 'x0', x0 FROM long) GROUP BY ALL),
    state AS MATERIALIZED (SELECT * FROM wide JOIN (SELECT y, x, region FROM place) USING (y, x)),
    columns AS (SELECT start, lead, y, x, who, {' + '.join(DP.values())} AS total FROM state WHERE region),
    column_error AS (SELECT a.start, a.lead, a.who, sqrt(avg(pow(a.total - b.total, 2))) AS col_err_m FROM columns a JOIN columns b USING (start, lead, y, x) WHERE b.who = 'truth' AND a.who <> 'x0' GROUP BY a.start, a.lead, a.who),
    layer AS (SELECT start, lead, who, avg(({' + '.join(f'CASE WHEN {d} < -0.01 THEN 1.0::DOUBLE ELSE 0 END' for d in DP.values())})/4) AS neg_thk_frac, min(least({', '.join(DP.values())})) AS neg_thk_min,
        sum({' + '.join(f'CASE WHEN {DP[a]} > 1 AND {DP[b]} > 1 AND {RHO[b]} < {RHO[a]} - 0.02 THEN 1 ELSE 0 END' for a, b in NEXT)})/greatest(sum({' + '.join(f'CASE WHEN {DP[a]} > 1 AND {DP[b]} > 1 THEN 1 ELSE 0 END' for a, b in NEXT)}), 1)::DOUBLE AS inversion_frac,
        sqrt(avg({' + '.join(f"pow(({' + '.join(f'{v}_{z}m*greatest({DP[z]}, 0)' for z in LEVELS)})/greatest({' + '.join(f'greatest({d}, 0)' for d in DP.values())}, 1e-6), 2)" for v in 'uv')})) AS baro_resid, avg(pow(u_0m + ubaro, 2) + pow(v_0m + vbaro, 2)) AS ke FROM state WHERE region AND who <> 'x0' GROUP BY start, lead, who),
    spread AS (SELECT start, lead, who, quantile_cont(d, 0.5) AS iso_spread FROM (SELECT start, lead, who, z, quantile_cont(rho, 0.75) - quantile_cont(rho, 0.25) AS d FROM ({' UNION ALL '.join(f'SELECT start, lead, who, {z} AS z, {RHO[z]} AS rho FROM state WHERE region AND {DP[z]} > 5' for z in LEVELS)}) GROUP BY start, lead, who, z HAVING count(*) > {LEAST_CELLS}) GROUP BY ALL),
    of_field AS (SELECT start, lead, y, x, who, region, {', '.join(f'{e} AS {f}' for f, e in CHECKED_SQL.items())} FROM state),
    moved AS MATERIALIZED (SELECT a.start, a.lead, a.y, a.x, a.who, a.t01, a.s01, {', '.join(f'a.{f} - b.{f} AS d_{f}' for f in dict.fromkeys((*LAPLACIANS, *BANDED)))} FROM of_field a JOIN of_field b USING (start, lead, y, x) WHERE a.region AND a.who <> 'x0' AND b.who = 'x0'),
    mirror AS (SELECT * FROM (VALUES {MIRRORS}) m(s, c, k, w)),
    blur_x AS MATERIALIZED (SELECT start, lead, who, s, y, c AS x, {', '.join(f'sum(w*d_{f}) AS n_{f}' for f in BANDED)}, sum(w) AS den FROM moved JOIN mirror ON k = x GROUP BY ALL),
    blur AS (SELECT start, lead, who, b.s, c AS y, x, {', '.join(f'sum(w*n_{f})/sum(w*den) AS b_{f}' for f in BANDED)} FROM blur_x b JOIN mirror m ON m.s = b.s AND k = y GROUP BY ALL),
    band AS (SELECT a.start, a.lead, a.who, a.y, a.x, {', '.join(f'a.b_{f} - c.b_{f} AS band_{f}' for f in BANDED)} FROM blur a JOIN blur c USING (start, lead, who, y, x) WHERE a.s = 'fine' AND c.s = 'coarse'),
    field AS (SELECT m.start, m.lead, m.who, {', '.join(f'sqrt(avg(pow(e.d_{f} + w.d_{f} + n.d_{f} + s.d_{f} - 4*m.d_{f}, 2))) AS lap_{f}' for f in LAPLACIANS)}, {', '.join(f'avg(sqrt(pow(e.{f} - w.{f}, 2) + pow(n.{f} - s.{f}, 2))/2) AS grad_{f}' for f in SLOPES)}, {', '.join(f'sqrt(avg(pow(band_{f}, 2))) AS band_{f}' for f in BANDED)}
        FROM moved m {' '.join(f'JOIN moved {j} ON {j}.start = m.start AND {j}.lead = m.lead AND {j}.who = m.who AND {j}.y = m.y{dy} AND {j}.x = m.x{dx}' for j, dy, dx in (('e', '', ' + 1'), ('w', '', ' - 1'), ('n', ' + 1', ''), ('s', ' - 1', '')))} JOIN band g ON g.start = m.start AND g.lead = m.lead AND g.who = m.who AND g.y = m.y AND g.x = m.x GROUP BY m.start, m.lead, m.who)"""
NUMBERS = ["neg_thk_frac", "neg_thk_min", "col_err_m", "inversion_frac", "iso_spread", "baro_resid", "ke", *(f"lap_{f}" for f in LAPLACIANS), *(f"grad_{f}" for f in SLOPES), *(f"band_{f}" for f in BANDED)]


@query("j15_step_checks", f"WITH {CHECKS} SELECT CAST(start AS BIGINT) AS start, lead, who, {', '.join(f'round({n}, 8) AS {n}' for n in NUMBERS)} FROM layer JOIN column_error USING (start, lead, who) JOIN field USING (start, lead, who) LEFT JOIN spread USING (start, lead, who)")
def step_checks(spark, sf):
    """Fifteen numbers that say whether a state is consistent, of the model's and of the true state of every step."""
    of = steps(spark, sf)
    ops.stored_cells(of, {(who, c) for who in ("pred", "truth", "x0") for c in ALL_CHANNELS})
    layers = consistency.layer_numbers(of, thickness, LEAST_CELLS)
    fields_ = consistency.field_numbers(of, CHECKED, LAPLACIANS, SLOPES, BANDED)
    return tidy(layers.join(fields_, [*ops.KEYS, "who"]).select(*ops.KEYS, "who", *NUMBERS), 8)


# Structure of steps


@query("l11_step_pairs")
def step_pairs(spark, sf):
    """Each step's sea surface: maxima and minima of model and truth, and how far the model's diagram and the start's lie from the true one."""
    of = steps(spark, sf)
    ops.stored_cells(of, {(who, "ssh") for who in ("pred", "truth", "x0")})
    inside = of.image(of.place.region)
    held = F.array_sort(F.collect_list(F.struct("y", "x", "pred_ssh", "truth_ssh", "x0_ssh")))
    images = of.cells.groupBy(*ops.KEYS).agg(held.alias("v")).select(*ops.KEYS, *(F.col(f"v.{who}_ssh").alias(who) for who in ("pred", "truth", "x0")))

    def run(parts):
        for p in parts:
            rows = []
            for start, lead, *states in zip(p["start"], p["lead"], p["pred"], p["truth"], p["x0"], strict=True):
                model, truth, first = (np.where(inside, np.asarray(x, float).reshape(inside.shape), np.nan) for x in states)
                rows += [(start, lead, *r) for r in top.pair_scores(*(x - np.nanmean(x) for x in (model, truth, first)), 0.05)]
            yield pd.DataFrame(rows, columns=["start", "lead", "kind", *top.PAIR_SCORES])

    numbers = ", ".join(f"{n} {'long' if n.startswith('count') else 'double'}" for n in top.PAIR_SCORES)
    out = images.mapInPandas(run, f"start long, lead int, kind string, {numbers}")
    return tidy(out.select("start", "lead", "kind", *(F.when(~F.isnan(n), F.col(n)).alias(n) if not n.startswith("count") else F.col(n) for n in top.PAIR_SCORES)), 8)
