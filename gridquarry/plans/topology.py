"""Components, persistence, events, tracks and matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import topology as top
from .registry import query
from .scores import tidy
from .tables import CELLS, DAILY, cells, daily, fields, table

FLOOD = "RECURSIVE " + CELLS + """, on_ AS (SELECT id, y*8 + x AS c, y, x, h FROM cells WHERE h >= {t}), r AS (SELECT id, c, y, x, c AS root FROM on_ UNION SELECT o.id, o.c, o.y, o.x, r.root FROM r JOIN on_ o ON o.id = r.id AND abs(o.y - r.y) + abs(o.x - r.x) = 1),
    comp AS (SELECT id, c, any_value(y) AS y, any_value(x) AS x, min(root) AS root FROM r GROUP BY id, c)"""


def mapped(df, run, schema):
    """Each Arrow batch of fields through ``run`` (id, 8 by 8 array) -> rows."""
    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(",")]
        for p in parts:
            rows = [r for i, v in zip(p["id"], p["v"], strict=True) for r in run(int(i), np.asarray(v, float).reshape(8, 8))]
            yield pd.DataFrame(rows, columns=names)

    return df.select("id", "v").mapInPandas(go, schema)


@query("l03_components", f"WITH {FLOOD.format(t=0.05)} SELECT id, root AS first_cell, count(*) AS cells FROM comp GROUP BY id, root")
def components(spark, sf):
    def run(i, f):
        found = top.labels(f >= 0.05).ravel()
        for k in range(1, found.max() + 1):
            at = np.flatnonzero(found == k)
            yield i, int(at[0]), len(at)

    return mapped(fields(spark, sf), run, "id long, first_cell long, cells long")


@query("l04_main_component", f"""WITH {FLOOD.format(t=0.0)}, seed AS (SELECT id, root, count(*) AS n FROM comp WHERE y < 2 GROUP BY ALL), main AS (SELECT id, arg_min(root, struct_pack(a := -n, b := root)) AS root FROM seed GROUP BY id),
    s AS (SELECT c.id, c.root, count(*) AS area, max(y) AS north, any_value(m.root) AS main FROM comp c JOIN main m USING (id) GROUP BY c.id, c.root) SELECT id, max(CASE WHEN root = main THEN north END) AS north, max(CASE WHEN root = main THEN area END) AS area, count_if(root <> main AND area >= 4) AS eddies FROM s GROUP BY id""")
def main_component(spark, sf):
    """The component most frequent on the seed strip: how far it reaches, its area, and the large others."""
    def run(i, f):
        found = top.labels(f >= 0.0)
        strip = found[:2][found[:2] > 0]
        if strip.size:
            main = int(np.bincount(strip).argmax())
            sizes = np.bincount(found.ravel())
            yield i, int(np.flatnonzero((found == main).any(1)).max()), int(sizes[main]), int(sum(s >= 4 for k, s in enumerate(sizes) if k not in (0, main)))

    return mapped(fields(spark, sf), run, "id long, north long, area long, eddies long")


@query("l02_open_boundary", f"WITH {CELLS}, n AS (SELECT id, y, x, h >= 0 AS ok, coalesce(lag(h) OVER r >= 0, false) AND coalesce(lead(h) OVER r >= 0, false) AND coalesce(lag(h) OVER c >= 0, false) AND coalesce(lead(h) OVER c >= 0, false) AS whole FROM cells WINDOW r AS (PARTITION BY id, y ORDER BY x), c AS (PARTITION BY id, x ORDER BY y)) SELECT id, count_if(ok AND NOT whole) AS rim FROM n GROUP BY id")
def open_boundary(spark, sf):
    """Valid cells beside invalid ones or the edge, by windows alone."""
    from ..operators.grids import beside

    ok = F.col("h") >= 0
    near = [F.coalesce(beside(ok, ["id"], a, o, s), F.lit(False)) for a, o in (("x", "y"), ("y", "x")) for s in (1, -1)]
    rows = cells(spark, sf).select("id", (ok & ~(near[0] & near[1] & near[2] & near[3])).alias("rim"))
    return rows.groupBy("id").agg(F.count_if("rim").alias("rim"))


#: The number of maxima of a field is that of cells without a higher neighbour (ties by index).
PEAKS = CELLS + """, p AS (SELECT id, label, h, NOT coalesce(lag(h) OVER r >= h, false) AND NOT coalesce(lead(h) OVER r > h, false) AND NOT coalesce(lag(h) OVER c >= h, false) AND NOT coalesce(lead(h) OVER c > h, false) AS peak FROM cells WINDOW r AS (PARTITION BY id, y ORDER BY x), c AS (PARTITION BY id, x ORDER BY y))"""


@query("l01_maxima", f"WITH {PEAKS} SELECT id, count_if(peak) AS maxima, round(max(h), 8) AS highest FROM p GROUP BY id")
def maxima(spark, sf):
    """Components of positive persistence, by field: as many as there are maxima."""
    def run(i, f):
        found = top.persistence(f)
        yield i, len(found), max(b for b, _, _ in found)

    return tidy(mapped(fields(spark, sf), run, "id long, maxima long, highest double"), 8)


#: From each maximum of either sign (s, m) the best level w to every cell, until one is higher, or earlier and as high, or on the rim.
PAIRS = "RECURSIVE " + CELLS + """, g AS (SELECT id, s, y, x, y*8 + x AS c, s*h AS h FROM cells, (VALUES (1), (-1)) t(s)),
    k AS (SELECT *, NOT coalesce(lag(h) OVER r >= h, false) AND NOT coalesce(lead(h) OVER r > h, false) AND NOT coalesce(lag(h) OVER d >= h, false) AND NOT coalesce(lead(h) OVER d > h, false) AS peak FROM g WINDOW r AS (PARTITION BY id, s, y ORDER BY x), d AS (PARTITION BY id, s, x ORDER BY y)),
    w AS (SELECT id, s, c AS m, h AS hm, c, y, x, h AS w, y IN (0, 7) OR x IN (0, 7) AS ends FROM k WHERE peak
      UNION SELECT g.id, g.s, w.m, w.hm, g.c, g.y, g.x, least(w.w, g.h), g.y IN (0, 7) OR g.x IN (0, 7) OR g.h > w.hm OR (g.h = w.hm AND g.c < w.m) FROM w JOIN g ON g.id = w.id AND g.s = w.s AND abs(g.y - w.y) + abs(g.x - w.x) = 1 WHERE NOT w.ends),
    p AS (SELECT id, s, m, any_value(hm) AS birth, max(w) FILTER (ends) AS death FROM w GROUP BY id, s, m)"""


@query("l01_persistence_pairs", f"WITH {PAIRS} SELECT id, CASE s WHEN 1 THEN 'max' ELSE 'min' END AS kind, m AS cell, round(s*birth, 8) AS birth, round(s*death, 8) AS death FROM p WHERE birth > death")
def pairs(spark, sf):
    def run(i, f):
        for kind, b, d, c in top.both_signs(f, open_edge=True):
            yield i, kind, c, b, d

    return tidy(mapped(fields(spark, sf), run, "id long, kind string, cell long, birth double, death double"), 8)


@query("l05_connection_levels", f"""WITH RECURSIVE {CELLS}, g AS (SELECT id, y*8 + x AS c, y, x, h FROM cells), w AS (SELECT id, c, y, x, h AS w FROM g WHERE c = 0 UNION SELECT g.id, g.c, g.y, g.x, least(w.w, g.h) FROM w JOIN g ON g.id = w.id AND abs(g.y - w.y) + abs(g.x - w.x) = 1) SELECT id, round(max(w), 8) AS level FROM w WHERE c = 63 GROUP BY id""")
def connection_levels(spark, sf):
    """The level at which two corners connect, of every field."""
    def run(i, f):
        yield i, top.connection_level(f, 0, 63)

    return tidy(mapped(fields(spark, sf), run, "id long, level double"), 8)


#: The best level w at which each cell connects to the seed strip's highest cell.
NECKS = "RECURSIVE " + CELLS + """, g AS (SELECT id, y, x, y*8 + x AS c, h FROM cells), seed AS (SELECT id, arg_max(c, struct_pack(h := h, c := -c)) AS c FROM g WHERE y < 2 AND x BETWEEN 3 AND 5 GROUP BY id),
    w AS (SELECT id, c, y, x, h AS w FROM g SEMI JOIN seed USING (id, c) UNION SELECT g.id, g.c, g.y, g.x, least(w.w, g.h) FROM w JOIN g ON g.id = w.id AND abs(g.y - w.y) + abs(g.x - w.x) = 1),
    b AS (SELECT id, c, max(w) AS saddle FROM w GROUP BY id, c), k AS (SELECT *, NOT coalesce(lag(h) OVER r >= h, false) AND NOT coalesce(lead(h) OVER r > h, false) AND NOT coalesce(lag(h) OVER d >= h, false) AND NOT coalesce(lead(h) OVER d > h, false) AS peak FROM g WINDOW r AS (PARTITION BY id, y ORDER BY x), d AS (PARTITION BY id, x ORDER BY y)),
    m AS (SELECT id, c, h, saddle FROM k JOIN b USING (id, c) WHERE peak), s AS (SELECT m.id, m.c, max(g.h) AS peak FROM m JOIN b o ON o.id = m.id AND o.saddle > m.saddle JOIN g ON g.id = o.id AND g.c = o.c GROUP BY ALL)"""


@query("l06_neck_saddles", f"WITH {NECKS} SELECT m.id, m.c AS cell, round(m.h, 8) AS height, round(m.saddle, 8) AS saddle, round(greatest(0, least(m.h, coalesce(s.peak, m.saddle)) - m.saddle), 8) AS depth FROM m LEFT JOIN s ON s.id = m.id AND s.c = m.c")
def necks(spark, sf):
    """Every maximum with its connection level to the seed, and the neck's depth."""
    seed = np.zeros((8, 8), bool)
    seed[:2, 3:6] = True

    def run(i, f):
        for cell, height, saddle, depth in top.necks(f, seed):
            yield i, cell, height, saddle, depth

    return tidy(mapped(fields(spark, sf), run, "id long, cell long, height double, saddle double, depth double"), 8)


RULE = top.Rule(level=0.02, least_depth=0.01, days=1, window=5)
SERIES = "CAST(label * 1000 + id div 100 AS INT) AS series"

#: Pieces over the level and lobes of main pieces as parts with their cells (pc); the part of the next day that each
#: part overlaps (nx); the path of each detachment (path), the start of its first long run of deep touches (fate); and,
#: day by day, which detachments are none because they overlap a touch that did not count (taken).
DETACHED = f"""RECURSIVE {CELLS}, g AS (SELECT id, y, x, y*8 + x AS c, h FROM cells),
    s AS (SELECT id, CAST(label*1000 + id // 100 AS INT) AS series, row_number() OVER (PARTITION BY label*1000 + id // 100 ORDER BY id) - 1 AS day, count(*) OVER (PARTITION BY label*1000 + id // 100) AS days FROM fields),
    seed AS (SELECT id, arg_max(c, struct_pack(h := h, c := -c)) AS c FROM g WHERE y < 2 AND x BETWEEN 3 AND 5 GROUP BY id),
    fl AS (SELECT id, c, y, x, c AS root FROM g WHERE h >= {RULE.level} UNION SELECT g.id, g.c, g.y, g.x, fl.root FROM fl JOIN g ON g.id = fl.id AND g.h >= {RULE.level} AND abs(g.y - fl.y) + abs(g.x - fl.x) = 1),
    piece AS (SELECT id, c, min(root) AS root FROM fl GROUP BY id, c), main AS (SELECT id, root FROM piece SEMI JOIN seed USING (id, c)),
    w AS (SELECT id, c, y, x, h AS w FROM g SEMI JOIN seed USING (id, c) UNION SELECT g.id, g.c, g.y, g.x, least(w.w, g.h) FROM w JOIN g ON g.id = w.id AND abs(g.y - w.y) + abs(g.x - w.x) = 1),
    lv AS (SELECT w.id, w.c, max(w) AS level FROM w JOIN piece p ON p.id = w.id AND p.c = w.c JOIN main m ON m.id = p.id AND m.root = p.root GROUP BY w.id, w.c),
    lobe AS (SELECT g.id, g.c AS top, g.c, g.y, g.x, level, h > level AS open_ FROM g JOIN lv USING (id, c) UNION SELECT g.id, l.top, g.c, g.y, g.x, l.level, true FROM lobe l JOIN g ON l.open_ AND g.id = l.id AND g.h > l.level AND abs(g.y - l.y) + abs(g.x - l.x) = 1),
    pc AS (SELECT id, 'piece' AS kind, root AS part, c FROM piece UNION ALL SELECT id, 'lobe', top, c FROM lobe),
    sh AS (SELECT pc.id, kind, part, n.id AS nid, p.root, count(*) AS cells, arg_max(p.c, struct_pack(h := g.h, c := -p.c)) AS top FROM pc JOIN s ON s.id = pc.id JOIN s n ON n.series = s.series AND n.day = s.day + 1 JOIN piece p ON p.id = n.id AND p.c = pc.c JOIN g ON g.id = p.id AND g.c = p.c GROUP BY ALL),
    nx AS (SELECT sh.id, kind, part, nid, max(top) FILTER (sh.root = m.root) AS top, arg_max(sh.root, struct_pack(n := cells, r := -sh.root)) AS most FROM sh LEFT JOIN main m ON m.id = nid GROUP BY ALL),
    born AS (SELECT DISTINCT s.series, n.day, n.days, n.id, p.root FROM s JOIN s n ON n.series = s.series AND n.day = s.day + 1 JOIN main m ON m.id = s.id JOIN piece b ON b.id = s.id AND b.root = m.root JOIN piece p ON p.id = n.id AND p.c = b.c LEFT JOIN main o ON o.id = n.id WHERE p.root IS DISTINCT FROM o.root),
    path AS (SELECT series, day AS born, root, 0 AS k, id, 'piece' AS kind, root AS part, NULL::DOUBLE AS level FROM born
      UNION ALL SELECT path.series, path.born, path.root, k + 1, nx.nid, CASE WHEN nx.top IS NULL THEN 'piece' ELSE 'lobe' END, coalesce(nx.top, nx.most), lv.level FROM path JOIN nx ON nx.id = path.id AND nx.kind = path.kind AND nx.part = path.part LEFT JOIN lv ON lv.id = nx.nid AND lv.c = nx.top),
    deep AS (SELECT *, k - row_number() OVER (PARTITION BY series, born, root ORDER BY k) AS run FROM path WHERE level - {RULE.level} >= {RULE.least_depth}),
    long_ AS (SELECT series, born, root, min(k) AS back FROM deep GROUP BY series, born, root, run HAVING count(*) > {RULE.days}),
    fate AS (SELECT b.*, last, back, CASE WHEN back IS NOT NULL THEN 'reattached' WHEN b.day + last + 1 = days THEN 'record_end' ELSE 'dissipated' END AS fate FROM born b JOIN (SELECT series, born, root, max(k) AS last FROM path GROUP BY ALL) p ON p.series = b.series AND p.born = b.day AND p.root = b.root LEFT JOIN (SELECT series, born, root, min(back) AS back FROM long_ GROUP BY ALL) l ON l.series = b.series AND l.born = b.day AND l.root = b.root),
    touch AS (SELECT path.series, path.born, path.root, path.born + k AS day, path.id, path.part, path.level FROM path JOIN fate f ON f.series = path.series AND f.day = path.born AND f.root = path.root WHERE path.kind = 'lobe' AND k < coalesce(back, last + 1)),
    bars AS (SELECT DISTINCT b.series, b.day, b.root, t.born AS by_day, t.root AS by_root FROM born b JOIN touch t ON t.series = b.series AND t.day = b.day - 1 JOIN lobe l ON l.id = t.id AND l.top = t.part JOIN piece p ON p.id = b.id AND p.root = b.root AND p.c = l.c),
    taken AS (SELECT series, 0::BIGINT AS day, CAST([] AS BIGINT[]) AS keys FROM s WHERE day = 0
      UNION ALL SELECT t.series, t.day + 1, list_concat(t.keys, coalesce(n.more, [])) FROM taken t JOIN s ON s.series = t.series AND s.day = t.day + 1,
        LATERAL (SELECT (SELECT list(b.day*64 + b.root) FROM born b WHERE b.series = t.series AND b.day = t.day + 1 AND NOT EXISTS (SELECT 1 FROM bars x WHERE x.series = b.series AND x.day = b.day AND x.root = b.root AND list_contains(t.keys, x.by_day*64 + x.by_root))) AS more) n),
    found AS (SELECT f.series, f.day, f.id, f.root AS first_cell, fate, f.day + CASE WHEN back IS NOT NULL THEN back WHEN fate = 'record_end' THEN last ELSE last + 1 END AS fate_day FROM fate f JOIN taken t ON t.series = f.series AND t.day = f.day AND list_contains(t.keys, f.day*64 + f.root)),
    detached AS (SELECT series, day, first_cell, fate, fate_day, CASE WHEN fate_day - day > {RULE.window} THEN 'separated' WHEN fate = 'record_end' THEN 'censored' ELSE fate END AS outcome, outcome = 'separated' AND fate <> 'reattached' AS final,
      (SELECT arg_max(g.c, struct_pack(h := g.h, c := -g.c)) FROM piece p JOIN g ON g.id = p.id AND g.c = p.c WHERE p.id = found.id AND p.root = first_cell) AS cell, (SELECT count(*) FROM piece p WHERE p.id = found.id AND p.root = first_cell) AS pixels,
      (SELECT count(*) FROM touch t WHERE t.series = found.series AND t.born = found.day AND t.root = first_cell) AS touches, (SELECT round(max(level) - {RULE.level}, 8) FROM touch t WHERE t.series = found.series AND t.born = found.day AND t.root = first_cell) AS deepest_touch FROM found)"""


@query("l07_detachments", f"WITH {DETACHED} SELECT * FROM detached")
def detachments(spark, sf):
    """Fields of a label as a series of days; one group is one series."""
    seed = np.zeros((8, 8), bool)
    seed[:2, 3:6] = True
    names = "series day cell first_cell pixels fate fate_day outcome final touches deepest_touch".split()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        found = top.detachments([np.asarray(v, float).reshape(8, 8) for v in p["v"]], seed, RULE)
        return pd.DataFrame([d | {"series": int(p["series"].iloc[0])} for d in found], columns=names)

    series = fields(spark, sf).selectExpr(SERIES, "id", "v")
    rows = series.groupBy("series").applyInPandas(run, "series int, day long, cell long, first_cell long, pixels long, fate string, fate_day long, outcome string, final boolean, touches long, deepest_touch double")
    return tidy(rows, 8)


@query("l08_separation_events", f"""WITH {DETACHED}, o AS (SELECT *, fate <> 'reattached' AND outcome IN ('separated', 'censored') AS closes FROM detached WHERE cell >= 16),
    n AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY series ORDER BY day, first_cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM o WHERE closes OR fate = 'reattached')
    SELECT series, max(day) FILTER (closes) AS day, max(first_cell) FILTER (closes) AS first_cell, NOT bool_or(final) AS censored, max(pixels) FILTER (closes) AS pixels, max(cell) FILTER (closes) AS cell, any_value(fate) FILTER (closes) AS fate, max(fate_day) FILTER (closes) AS fate_day, min(day) AS first_day, count_if(NOT closes) AS reattachments, count_if(NOT closes AND outcome = 'separated') AS late_reattachments FROM n GROUP BY series, span HAVING bool_or(closes)""")
def separations(spark, sf):
    """Final or censored separations in the region, with the reattachments before them."""
    found = top.separation_events(detachments(spark, sf), ["series"], F.col("cell") >= 16, ["day", "first_cell"])
    return found.select("series", "day", "first_cell", "censored", "pixels", "cell", "fate", "fate_day", "first_day", "reattachments", "late_reattachments")


@query("l09_event_report", f"""WITH {DETACHED}, b AS (SELECT id, c, max(w) AS saddle FROM w GROUP BY id, c), k AS (SELECT *, NOT coalesce(lag(h) OVER r >= h, false) AND NOT coalesce(lead(h) OVER r > h, false) AND NOT coalesce(lag(h) OVER d >= h, false) AND NOT coalesce(lead(h) OVER d > h, false) AS peak FROM g WINDOW r AS (PARTITION BY id, y ORDER BY x), d AS (PARTITION BY id, x ORDER BY y)),
    m AS (SELECT id, c, h, saddle FROM k JOIN b USING (id, c) WHERE peak), sp AS (SELECT m.id, m.c, max(g.h) AS peak FROM m JOIN b o ON o.id = m.id AND o.saddle > m.saddle JOIN g ON g.id = o.id AND g.c = o.c GROUP BY ALL),
    neck AS (SELECT series, max(round(greatest(0, least(m.h, coalesce(sp.peak, m.saddle)) - m.saddle), 8)) AS deepest_neck FROM m JOIN s USING (id) LEFT JOIN sp ON sp.id = m.id AND sp.c = m.c GROUP BY series)
    SELECT series, count(*) AS detachments, count_if(final) AS final, max(pixels) AS largest, any_value(deepest_neck) AS deepest_neck FROM detached JOIN neck USING (series) GROUP BY series""")
def event_report(spark, sf):
    """Detachments of a series beside its events and the deepest neck of each day."""
    found = detachments(spark, sf).groupBy("series").agg(F.count("*").alias("detachments"), F.count_if("final").alias("final"), F.max("pixels").alias("largest"))
    neck = necks(spark, sf).join(fields(spark, sf).selectExpr("id", SERIES), "id").groupBy("series").agg(F.max("depth").alias("deepest_neck"))
    return found.join(neck, "series")


@query("l10_diagram_distances")
def diagram_distances(spark, sf):
    """Wasserstein and bottleneck distances of each field's diagram to its transpose's, and to a damped copy's."""
    def run(i, f):
        a, b = top.diagram(top.persistence(f), 0.02), top.diagram(top.persistence(0.8 * f), 0.02)
        yield i, top.wasserstein(a, b), top.bottleneck(a, b), top.wasserstein(a, top.diagram(top.persistence(f.T.copy()), 0.02))

    return tidy(mapped(fields(spark, sf), run, "id long, w1 double, bottleneck double, transposed double"), 8)


@query("l11_score_pairs")
def score_pairs(spark, sf):
    """Per field and polarity: counts and amplitudes of a damped model and of the truth, and the distance of their diagrams."""
    def run(i, f):
        truth, model = f - f.mean(), 0.8 * (f - f.mean())
        for kind, sign in (("max", 1), ("min", -1)):
            t, m = (top.diagram(top.persistence(sign * x, open_edge=True), 0.02) for x in (truth, model))
            yield i, kind, len(m), len(t), float((m[:, 0] - m[:, 1]).sum()), float((t[:, 0] - t[:, 1]).sum()), top.wasserstein(m, t)

    return tidy(mapped(fields(spark, sf), run, "id long, kind string, n_model long, n_truth long, amp_model double, amp_truth double, w1 double"), 8)


#: A grid in degrees, the seed and the sections that close the basin off: from shore to shore, at any slant.
LON, LAT, SEED = [-90.0 + 0.25 * x for x in range(8)], [22.0 + 0.2 * y for y in range(8)], (-89.3, 22.62)
SECTIONS = [((-90.1, 23.03), (-88.61, 23.42)), ((-88.45, 21.93), (-88.72, 23.11))]
RASTER = "near AS (" + " UNION ALL ".join(
    f"SELECT t, ceil(({y0}::DOUBLE + ({y1} - {y0})*t/n - 22.0)/0.2 - 0.5) AS y, ceil(({x0}::DOUBLE + ({x1} - {x0})*t/n + 90.0)/0.25 - 0.5) AS x FROM (SELECT t, greatest(2, ceil(4*sqrt(pow({x1} - {x0}, 2) + pow({y1} - {y0}, 2))/0.2)::INT + 1) - 1 AS n FROM range(0, 200) r(t)) WHERE t <= n" for (x0, y0), (x1, y1) in SECTIONS
) + "), drawn AS (SELECT DISTINCT least(greatest(y, 0), 7) AS y, least(greatest(x, 0), 7) AS x FROM near), wide AS (SELECT DISTINCT d.y + a.dy AS y, d.x + a.dx AS x FROM drawn d, (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) a(dy, dx))"


@query("j13_basin_mask", f"WITH RECURSIVE {CELLS}, {RASTER}, on_ AS (SELECT id, y*8 + x AS c, y, x FROM cells LEFT JOIN wide USING (y, x) WHERE h >= -0.05 AND wide.y IS NULL), r AS (SELECT id, c, y, x FROM on_ WHERE y = 3 AND x = 3 UNION SELECT o.id, o.c, o.y, o.x FROM r JOIN on_ o ON o.id = r.id AND abs(o.y - r.y) + abs(o.x - r.x) = 1) SELECT id, count(*) AS cells, sum(c)::BIGINT AS places FROM r GROUP BY id")
def basin_mask(spark, sf):
    """The ocean around a seed that two slanted sections close off; nothing where the seed isn't open ocean."""
    def run(i, f):
        found = top.basin(f >= -0.05, LON, LAT, SECTIONS, SEED)
        if found is not None:
            yield i, int(found.sum()), int(np.flatnonzero(found).sum())

    return mapped(fields(spark, sf), run, "id long, cells long, places long")


def tracks(spark, sf):
    """From each day's start: the nearest cell with a large value within a radius of the day before's, until there is none."""
    rows = daily(spark, sf).where("feature = 'view' AND value > 5").select(F.expr("cell div 50").alias("region"), F.datediff("day", F.lit("2024-01-01")).alias("d"), "cell")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        by_day = {d: np.sort(g["cell"].to_numpy()) for d, g in p.groupby("d")}
        out = []
        if 15 in by_day:
            for step in (-1, 1):
                at, d = int(by_day[15][0]), 15
                while d in by_day:
                    near = by_day[d][np.argmin(np.abs(by_day[d] - at))]
                    if abs(int(near) - at) > 6:
                        break
                    at = int(near)
                    if step == -1 or d != 15:
                        out.append((int(p["region"].iloc[0]), d, at))
                    d += step
        return pd.DataFrame(out, columns=["region", "day", "cell"])

    return rows.groupBy("region").applyInPandas(run, "region long, day long, cell long")


@query("d11_matched_events", f"""WITH RECURSIVE {DAILY}, t AS (SELECT cell, datediff('day', DATE '2024-01-01', day) AS d, row_number() OVER (PARTITION BY cell ORDER BY day) AS i FROM daily WHERE feature = 'view'), m AS (SELECT cell, datediff('day', DATE '2024-01-01', day) AS d FROM daily WHERE feature = 'signup'),
    g AS (SELECT cell, 0::BIGINT AS i, CAST([] AS BIGINT[]) AS used, NULL::BIGINT AS got FROM (SELECT DISTINCT cell FROM t) UNION ALL
      SELECT g.cell, t.i, CASE WHEN n.d IS NULL THEN used ELSE list_append(used, n.d) END, n.d FROM g JOIN t ON t.cell = g.cell AND t.i = g.i + 1, LATERAL (SELECT (SELECT arg_min(m.d, struct_pack(a := abs(m.d - t.d), b := m.d)) FROM m WHERE m.cell = t.cell AND abs(m.d - t.d) <= 2 AND NOT list_contains(g.used, m.d)) AS d) n)
    SELECT t.cell, t.d AS truth, g.got AS model FROM t JOIN g ON g.cell = t.cell AND g.i = t.i UNION ALL SELECT m.cell, NULL, m.d FROM m WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.cell = m.cell AND g.got = m.d)""")
def matched(spark, sf):
    """Each true event, in order, takes the nearest unused model event within two days; the rest of both stay."""
    from ..operators.joins import greedy_matches

    rows = daily(spark, sf).where("feature IN ('view', 'signup')").select("cell", F.datediff("day", F.lit("2024-01-01")).cast("long").alias("d"), (F.col("feature") == "view").alias("true"))
    return greedy_matches(rows, ["cell"], "d", "true", 2)


#: Grid points, and as a mesh the distinct coordinates of all customers.
POINTS = """p AS (SELECT p_partkey AS a, (p_partkey % 40) + p_size/100.0 AS x, p_partkey // 40 + p_retailprice/10000 AS y FROM part), m AS (SELECT min(c_custkey) AS b, (c_custkey % 13)*3.0 AS x, (c_custkey // 13 % 17)*3.0 AS y FROM customer GROUP BY ALL),
    d AS (SELECT a, b, sqrt(pow(p.x - m.x, 2) + pow(p.y - m.y, 2)) AS d, p.x - m.x AS dx, p.y - m.y AS dy FROM p, m)"""


def points(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") % 40) + F.col("p_size") / 100.0).alias("x"), (F.expr("p_partkey div 40") + F.col("p_retailprice") / 10000).alias("y"))
    m = table(spark, sf, "customer").groupBy(((F.col("c_custkey") % 13) * 3.0).alias("x"), (F.expr("c_custkey div 13") % 17 * 3.0).alias("y")).agg(F.min("c_custkey").alias("b"))
    return p, m


@query("d08_radius_and_knn_edges", f"WITH {POINTS} SELECT b AS mesh, count(*) AS edges, round(max(d), 6) AS longest, round(sum(dx), 6) AS dx, round(sum(dy), 6) AS dy FROM d WHERE d <= 2.01 GROUP BY b")
def radius_edges(spark, sf):
    """Mesh points with the grid points within two thirds of their spacing: edges with their length and offset."""
    from ..operators.joins import within_radius

    edges = within_radius(*points(spark, sf), 2.01)
    return tidy(edges.groupBy(F.col("b").alias("mesh")).agg(F.count("*").alias("edges"), F.max("distance").alias("longest"), F.sum("dx").alias("dx"), F.sum("dy").alias("dy")), 6)


@query("d08_nearest_neighbours", f"WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM d) SELECT a AS cell, count(*) AS n, sum(b)::BIGINT AS neighbours, round(max(d), 6) AS farthest, round(sum(-dx), 6) AS dx, round(sum(-dy), 6) AS dy FROM r WHERE k <= 4 GROUP BY a")
def nearest_neighbours(spark, sf):
    """The four nearest mesh points of every grid point, however far they lie, with the offsets to them."""
    from ..operators.joins import nearest

    edges = nearest(*points(spark, sf), 4, 6.0)
    return tidy(edges.groupBy(F.col("a").alias("cell")).agg(F.count("*").alias("n"), F.sum("b").alias("neighbours"), F.max("distance").alias("farthest"), F.sum(-F.col("dx")).alias("dx"), F.sum(-F.col("dy")).alias("dy")), 6)
