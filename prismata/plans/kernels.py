"""Queries over pixels and lenses: scopes, curves, tables, masks, composition, automatic adjustments and lens matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismata.functions import parse
from prismata.operators import grouping, raster, similarity
from prismata.plans.registry import PIXELS, _pixels, query
from prismata.sources import files

P = f", p AS ({PIXELS})"
_LINEAR = "CASE WHEN {x} / 255.0 <= 0.04045 THEN {x} / 255.0 / 12.92 ELSE pow(({x} / 255.0 + 0.055) / 1.055, 2.4) END"


@query("a12_rgb_waveform", ("lineitem",), f"{P}, v AS (SELECT id, x, unnest(['r', 'g', 'b']) AS channel, unnest([r, g, b]) AS level FROM p) SELECT id, channel, least(CAST(floor(x * 256 / 8) AS INT), 255) AS \"column\", level, count(*) AS n FROM v GROUP BY ALL")
def _(lineitem):
    return raster.waveform_rgb(_pixels(lineitem), 8)


@query("a12_parade", ("lineitem",), f"{P}, v AS (SELECT id, x, unnest([0, 87, 174]) AS base, unnest([r, g, b]) AS level FROM p) SELECT id, CAST(base + floor(x * 82.0 / 8) % 82 AS INT) AS \"column\", level, count(*) AS n FROM v GROUP BY ALL")
def _(lineitem):
    return raster.parade(_pixels(lineitem), 8)


@query("a12_vectorscope", ("lineitem",), f"""{P}, c AS (SELECT id, CAST((-0.1146 * r - 0.3854 * g + 0.5 * b) * 0.836 AS DOUBLE) AS cb, CAST((0.5 * r - 0.4542 * g - 0.0458 * b) * 0.836 AS DOUBLE) AS cr FROM p), s AS (SELECT id, cb, cr, CASE WHEN cb * cb + cr * cr > 16129 THEN 127 / sqrt(cb * cb + cr * cr) ELSE 1 END AS k FROM c)
SELECT id, CAST(floor(least(255, greatest(0, round(cb * k, 9) + 128))) AS INT) AS vx, CAST(floor(least(255, greatest(0, 128 - round(cr * k, 9)))) AS INT) AS vy, count(*) AS n FROM s GROUP BY ALL""")
def _(lineitem):
    return raster.vectorscope(_pixels(lineitem))


@query("x10_auto_adjustments", ("lineitem",), f"""{P}, y AS (SELECT id, x, y, 0.2126 * r + 0.7152 * g + 0.0722 * b AS l, CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) ELSE 0 END AS s FROM p),
size AS (SELECT id, count(*) AS n, avg(s) AS sat, max(x) + 1 AS w, max(y) + 1 AS h FROM y GROUP BY 1),
ce AS (SELECT y.id, avg(l / 255) FILTER (x >= floor(w * 0.25) AND x < floor(w * 0.75) AND y >= floor(h * 0.25) AND y < floor(h * 0.75)) AS c, avg(l / 255) FILTER (NOT (x >= floor(w * 0.25) AND x < floor(w * 0.75) AND y >= floor(h * 0.25) AND y < floor(h * 0.75))) AS e FROM y JOIN size USING (id) GROUP BY 1),
hist AS (SELECT id, least(255, CAST(round(l) AS INT)) AS bin, count(*) AS k FROM y GROUP BY ALL), run AS (SELECT hist.id, bin, k, sum(k) OVER (PARTITION BY hist.id ORDER BY bin) AS c, n FROM hist JOIN size USING (id)),
q AS (SELECT id, coalesce(min(bin) FILTER (c >= floor(n * 0.01)), 255) AS p1, coalesce(min(bin) FILTER (c >= floor(n * 0.5)), 255) AS p50, coalesce(min(bin) FILTER (c >= floor(n * 0.99)), 255) AS p99, sum(k) FILTER (bin >= 240) / max(n) AS hi, sum(k) FILTER (bin >= 250) / max(n) AS clip, sum(k) FILTER (bin < 32) / max(n) AS lo FROM run GROUP BY 1),
z AS (SELECT q.id, p1, p50, p99, coalesce(hi, 0) AS hi, coalesce(clip, 0) AS clip, coalesce(lo, 0) AS lo, sat, greatest(p99 - p1, 1) AS rng, c, e FROM q JOIN size USING (id) JOIN ce USING (id)),
e1 AS (SELECT *, CASE WHEN p99 > 245 OR hi > 0.02 OR clip > 0.005 THEN least((128 - p50) * 0.125, 0) ELSE (128 - p50) * 0.125 END AS x0 FROM z), e2 AS (SELECT *, CASE WHEN p99 + x0 > 250 THEN 250 - p99 ELSE x0 END AS exposure, CASE WHEN rng < 220 THEN (220.0 / rng - 1) * 10 ELSE 0 END * CASE WHEN hi > 0.02 THEN 0.5 ELSE 1 END AS contrast FROM e1),
h2 AS (SELECT y.id, CAST(round(least(255, greatest(0, (l + exposure - 128) * (1 + contrast / 100) + 128))) AS INT) AS bin, count(*) AS k FROM y JOIN e2 USING (id) GROUP BY ALL), r2 AS (SELECT h2.id, bin, sum(k) OVER (PARTITION BY h2.id ORDER BY bin) AS c, n FROM h2 JOIN size USING (id)),
q2 AS (SELECT id, coalesce(min(bin) FILTER (c >= floor(n * 0.01)), 255) AS a1, coalesce(min(bin) FILTER (c >= floor(n * 0.5)), 255) AS a50, coalesce(min(bin) FILTER (c >= floor(n * 0.99)), 255) AS a99 FROM r2 GROUP BY 1)
SELECT e2.id, round(least(5, greatest(-5, exposure / 20)), 6) AS exposure, round((128 - a50) * 0.007, 6) AS brightness, round(least(100, contrast), 6) AS contrast, round(CASE WHEN hi > 0.02 THEN -least(hi * 120, 70) ELSE 0 END, 6) AS highlights, round(CASE WHEN lo > 0.05 THEN least(lo * 40, 50) ELSE 0 END, 6) AS shadows,
round(CASE WHEN sat < 0.2 THEN (0.2 - sat) * 120 ELSE 0 END, 6) AS vibrance, round(CASE WHEN e < c THEN greatest(-100, (e - c) * 100) ELSE 0 END, 6) AS vignette, round(CASE WHEN rng < 120 AND sat < 0.15 THEN (1 - rng / 120.0) * 35 ELSE 0 END, 6) AS dehaze, round(CASE WHEN rng < 180 THEN (1 - rng / 180.0) * 50 ELSE 0 END, 6) AS clarity,
round(CASE WHEN c - e > 0.05 THEN least((c - e) * 100, 60) ELSE 0 END, 6) AS centre, round((a99 - 255) * 0.2, 6) AS whites, round(-a1 * 0.5, 6) AS blacks FROM e2 JOIN q2 USING (id)""")
def _(lineitem):
    rows = raster.auto_adjustments(_pixels(lineitem))
    return rows.select("id", *[F.round(c, 6).alias(c) for c in rows.columns if c != "id"])


@query("k2_color_transforms", ("lineitem",), f"""{P}, q AS (SELECT id, x, y, r, g, b, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM p)
SELECT id, x, y, round(CASE WHEN d = 0 THEN 0 WHEN hi = r THEN (CASE WHEN g < b THEN 360 ELSE 0 END) + 60.0 * (g - b) / d WHEN hi = g THEN 120 + 60.0 * (b - r) / d ELSE 240 + 60.0 * (r - g) / d END, 6) AS hue, round(CASE WHEN hi = 0 THEN 0 ELSE CAST(d AS DOUBLE) / hi END, 6) AS sat, round(hi / 255.0, 6) AS val, round({_LINEAR.format(x='g')}, 6) AS linear FROM q""")
def _(lineitem):
    p = _pixels(lineitem)
    hsv = raster.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    return p.select("id", "x", "y", hsv.alias("c"), F.round(raster.srgb_to_linear(F.col("g") / 255.0), 6).alias("linear")).select("id", "x", "y", F.round("c.h", 6).alias("hue"), F.round("c.s", 6).alias("sat"), F.round("c.v", 6).alias("val"), "linear")


KNOTS = ((0.0, 10.0), (64.0, 40.0), (128.0, 160.0), (192.0, 160.0), (255.0, 250.0))


@query("k3_tone_curve", ("lineitem",), f"""{P}, k AS (SELECT * FROM (VALUES (0, 0.0, 10.0, 64.0, 40.0, 0.46875, 1.171875), (1, 64.0, 40.0, 128.0, 160.0, 1.171875, 0.0), (2, 128.0, 160.0, 192.0, 160.0, 0.0, 0.0), (3, 192.0, 160.0, 255.0, 250.0, 0.0, 1.4285714285714286)) v(i, x1, y1, x2, y2, m1, m2)),
t AS (SELECT id, x, y, r, (r - x1) / (x2 - x1) AS t, x2 - x1 AS dx, y1, y2, m1, m2 FROM p JOIN k ON r > x1 AND r <= x2 WHERE r > 0 AND r < 255)
SELECT id, x, y, round(least(1, greatest(0, ((2 * t * t * t - 3 * t * t + 1) * y1 + (t * t * t - 2 * t * t + t) * m1 * dx + (3 * t * t - 2 * t * t * t) * y2 + (t * t * t - t * t) * m2 * dx) / 255)), 6) AS v FROM t UNION ALL SELECT id, x, y, round(10 / 255.0, 6) FROM p WHERE r = 0 UNION ALL SELECT id, x, y, round(250 / 255.0, 6) FROM p WHERE r >= 255""")
def _(lineitem):
    return _pixels(lineitem).select("id", "x", "y", F.round(raster.tone_curve(F.col("r") / 255.0, KNOTS), 6).alias("v"))


@query("k3_tone_maps", ("lineitem",), f"""{P}, c AS (SELECT id, x, y, r / 64.0 AS v FROM p), m AS (SELECT *, least(1, greatest(0, (log2(greatest(v / 0.18, 1e-6)) + 15.2) / 20.2)) AS e FROM c), s AS (SELECT *, 2.3843 * (e - 0.6060606) / CASE WHEN e < 0.6060606 THEN -1.0359 ELSE 1.3475 END AS u, CASE WHEN e < 0.6060606 THEN -1.0359 ELSE 1.3475 END AS k FROM m)
SELECT id, x, y, round(least(1, greatest(0, v * (2.51 * v + 0.03) / (v * (2.43 * v + 0.59) + 0.14))), 6) AS filmic, round(pow(least(1, greatest(0, CASE WHEN e = 0.6060606 THEN 2.3843 * e - 1.0112 ELSE k * u / pow(1 + pow(u, 1.5), 1 / 1.5) + 0.43446 END)), 2.4), 6) AS agx FROM s""")
def _(lineitem):
    v = F.col("r") / 64.0
    return _pixels(lineitem).select("id", "x", "y", F.round(raster.filmic(v), 6).alias("filmic"), F.round(raster.agx_curve(v), 6).alias("agx"))


@query("k4_lut", ("lineitem",), f"""{P}, s AS (SELECT id, x, y, least(1, r / 255.0) * 2 AS r, least(1, g / 255.0) * 2 AS g, least(1, b / 255.0) * 2 AS b FROM p), i AS (SELECT *, floor(r) AS r0, floor(g) AS g0, floor(b) AS b0, r - floor(r) AS fr, g - floor(g) AS fg, b - floor(b) AS fb FROM s),
w AS (SELECT id, x, y, r0, g0, b0, fr, fg, fb, least(r0 + 1, 2) AS r1, least(g0 + 1, 2) AS g1, least(b0 + 1, 2) AS b1 FROM i),
o AS (SELECT *, CASE WHEN fr > fg THEN CASE WHEN fg > fb THEN [fr, fg, fb] WHEN fr > fb THEN [fr, fb, fg] ELSE [fb, fr, fg] END ELSE CASE WHEN fb > fg THEN [fb, fg, fr] WHEN fb > fr THEN [fg, fb, fr] ELSE [fg, fr, fb] END END AS f, CASE WHEN fr > fg THEN CASE WHEN fg > fb THEN 'rgb' WHEN fr > fb THEN 'rbg' ELSE 'brg' END ELSE CASE WHEN fb > fg THEN 'bgr' WHEN fb > fr THEN 'gbr' ELSE 'grb' END END AS k FROM w),
a AS (SELECT *, CASE WHEN k[1] = 'r' THEN r1 ELSE r0 END AS ra, CASE WHEN k[1] = 'g' THEN g1 ELSE g0 END AS ga, CASE WHEN k[1] = 'b' THEN b1 ELSE b0 END AS ba, CASE WHEN k[3] <> 'r' THEN r1 ELSE r0 END AS rb, CASE WHEN k[3] <> 'g' THEN g1 ELSE g0 END AS gb, CASE WHEN k[3] <> 'b' THEN b1 ELSE b0 END AS bb FROM o)
SELECT id, x, y, round((1 - f[1]) * r0 * r0 / 4 + (f[1] - f[2]) * ra * ra / 4 + (f[2] - f[3]) * rb * rb / 4 + f[3] * r1 * r1 / 4, 6) AS lr, round((1 - f[1]) * (g0 + b0) / 4 + (f[1] - f[2]) * (ga + ba) / 4 + (f[2] - f[3]) * (gb + bb) / 4 + f[3] * (g1 + b1) / 4, 6) AS lg FROM a""")
def _(lineitem):
    grid = lineitem.sparkSession.range(27).select(F.lit("lut").alias("path"), F.lit(3).alias("size"), F.col("id").cast("int").alias("i"), F.pow(F.col("id") % 3, 2).alias("q"), (F.floor(F.col("id") / 3) % 3).alias("g"), F.floor(F.col("id") / 9).alias("b"))
    lut = grid.select("path", "size", "i", (F.col("q") / 4).alias("r"), ((F.col("g") + F.col("b")) / 4).alias("g"), (F.col("b") / 2).alias("b"))
    out = raster.apply_lut(_pixels(lineitem).select("id", "x", "y", F.least(F.lit(1.0), F.col("r") / 255.0).alias("r"), F.least(F.lit(1.0), F.col("g") / 255.0).alias("g"), F.least(F.lit(1.0), F.col("b") / 255.0).alias("b")), lut)
    return out.select("id", "x", "y", F.round("lut.r", 6).alias("lr"), F.round("lut.g", 6).alias("lg"))


@query("k6_masks", ("lineitem",), f"""{P}, d AS (SELECT id, x, y, r, g, b, sqrt(pow(((x - 4) * cos(radians(30)) + (y - 900) * sin(radians(30))) / 3.0, 2) + pow((-(x - 4) * sin(radians(30)) + (y - 900) * cos(radians(30))) / 500.0, 2)) AS e, ((x - 1) * -(1000.0 - 10) + (y - 10) * (7.0 - 1)) / sqrt(pow(7.0 - 1, 2) + pow(1000.0 - 10, 2)) AS w, 0.299 * r + 0.587 * g + 0.114 * b AS l, pow(r - 100, 2) + pow(g - 60, 2) + pow(b - 90, 2) AS q FROM p)
SELECT id, x, y, CAST(floor(round(255 * least(1, greatest(0, 1 - (e - 0.4) / 0.6)), 6)) AS INT) AS radial, CAST(floor(round(255 * least(1, greatest(0, 0.5 - 0.5 * w / 5)), 6)) AS INT) AS linear, CAST(floor(round(CASE WHEN abs(l - 80) <= 51 THEN 255 * (1 - abs(l - 80) / 51) ELSE 0 END, 6)) AS INT) AS luminance, CAST(floor(round(CASE WHEN q <= pow(76.5, 2) * 3 THEN 255 * (1 - sqrt(q) / sqrt(pow(76.5, 2) * 3)) ELSE 0 END, 6)) AS INT) AS color FROM d""")
def _(lineitem):
    x, y, rgb = F.col("x"), F.col("y"), (F.col("r"), F.col("g"), F.col("b"))
    return _pixels(lineitem).select("id", "x", "y", raster.radial_mask(x, y, 4, 900, 3.0, 500.0, 0.6, 30.0).alias("radial"), raster.linear_mask(x, y, (1.0, 10.0), (7.0, 1000.0), 5.0).alias("linear"), raster.luminance_mask(*rgb, 80.0, 20.0).alias("luminance"), raster.color_mask(*rgb, (100, 60, 90), 30.0).alias("color"))


@query("k13_negative", ("lineitem",), f"""{P}, l AS (SELECT id, x, y, -log10(least(1, greatest(1e-6, r / 255.0))) AS r, -log10(least(1, greatest(1e-6, g / 255.0))) AS g, -log10(least(1, greatest(1e-6, b / 255.0))) AS b FROM p), size AS (SELECT id, max(x) + 1 AS w, max(y) + 1 AS h FROM p GROUP BY 1),
i AS (SELECT l.*, floor(w * 0.12) AS mx, floor(h * 0.12) AS my, w, h FROM l JOIN size USING (id)), v AS (SELECT id, unnest(['r', 'g', 'b']) AS c, unnest([r, g, b]) AS v FROM i WHERE x >= mx AND x < w - mx AND y >= my AND y < h - my AND (y - my) % 3 = 0),
k AS (SELECT id, c, v, row_number() OVER (PARTITION BY id, c ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY id, c) AS n FROM v), m AS (SELECT id, c, max(v) FILTER (rn = floor(n * 0.001)) AS lo, max(v) FILTER (rn = least(n - 1, floor(n * 0.999))) AS hi FROM k GROUP BY 1, 2),
f AS (SELECT id, c, lo, CASE WHEN hi <= lo + 0.0001 THEN lo + 1 ELSE hi END AS hi FROM m), s AS (SELECT 1 / (1 + exp(4 * 0.6)) AS y0, 1 / (1 + exp(-4 * 0.4)) AS y1),
t AS (SELECT l.id, l.x, l.y, least(1, greatest(0, (1 / (1 + exp(-4 * (greatest(0, (l.r - fr.lo) / (fr.hi - fr.lo)) - 0.6))) - y0) / (y1 - y0))) AS r, least(1, greatest(0, (1 / (1 + exp(-4 * (greatest(0, (l.g - fg.lo) / (fg.hi - fg.lo)) - 0.6))) - y0) / (y1 - y0))) AS g, least(1, greatest(0, (1 / (1 + exp(-4 * (greatest(0, (l.b - fb.lo) / (fb.hi - fb.lo)) - 0.6))) - y0) / (y1 - y0))) AS b
FROM l JOIN f fr ON fr.id = l.id AND fr.c = 'r' JOIN f fg ON fg.id = l.id AND fg.c = 'g' JOIN f fb ON fb.id = l.id AND fb.c = 'b', s), u AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS luma, greatest(r, g, b) AS top FROM t), z AS (SELECT *, CASE WHEN top > 0.9 THEN pow(least(1, greatest(0, (top - 0.9) * 10)), 2) ELSE 0 END AS o FROM u)
SELECT id, x, y, round(pow(least(1, greatest(0, r + (luma - r) * o)), 1 / 2.2), 5) AS r, round(pow(least(1, greatest(0, g + (luma - g) * o)), 1 / 2.2), 5) AS g, round(pow(least(1, greatest(0, b + (luma - b) * o)), 1 / 2.2), 5) AS b FROM z""")
def _(lineitem):
    unit = lambda c: (F.col(c) / 255.0).alias(c)
    return raster.negative(_pixels(lineitem).select("id", "x", "y", unit("r"), unit("g"), unit("b"))).select("id", "x", "y", *[F.round(c, 5).alias(c) for c in "rgb"])


@query("g17_composition", ("lineitem",), f"""{P}, m AS (SELECT id, x, y, max(x) OVER w + 1 AS wd, max(y) OVER w + 1 AS ht, (218 * r + 732 * g + 74 * b) >> 10 AS v FROM p WINDOW w AS (PARTITION BY id)), s AS (SELECT id, count(*) AS n, avg(x) / max(wd) AS cx, avg(y) / max(ht) AS cy, count(*) FILTER (x < greatest(1, round(wd * 0.04)) OR x >= wd - greatest(1, round(wd * 0.04)) OR y < greatest(1, round(ht * 0.04)) OR y >= ht - greatest(1, round(ht * 0.04))) / count(*) AS edge FROM m WHERE v >= 128 GROUP BY 1)
SELECT id, round(least(1, greatest(0, 0.7 * least(1, greatest(0, 1 - sqrt(least(pow(cx - 1 / 3.0, 2), pow(cx - 2 / 3.0, 2)) + least(pow(cy - 1 / 3.0, 2), pow(cy - 2 / 3.0, 2))) / 0.5)) + 0.3 * (1 - edge))), 6) AS composition, round(edge, 6) AS edge FROM s WHERE n >= 64""")
def _(lineitem):
    p = _pixels(lineitem)
    masks = p.select("id", "x", "y", raster.luma(F.col("r"), F.col("g"), F.col("b")).alias("mask"))
    return raster.composition(masks).select("id", F.round("composition", 6).alias("composition"), F.round("edge", 6).alias("edge"))


GRAY = "SELECT l_suppkey % 9 AS id, l_partkey % 40 AS x, l_orderkey % 40 AS y, CAST(max(l_quantity * 5) AS INT) AS v FROM lineitem GROUP BY ALL"


def _gray(lineitem):
    return lineitem.groupBy((F.col("l_suppkey") % 9).alias("id"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_orderkey") % 40).alias("y")).agg(F.max(F.col("l_quantity") * 5).cast("int").alias("v"))


@query("a15_sharpness", ("lineitem",), f", g AS ({GRAY}), s AS (SELECT a.id, a.x, a.y, sum(b.v * CASE WHEN a.x = b.x AND a.y = b.y THEN -4 ELSE 1 END) AS w, count(*) AS n FROM g a JOIN g b ON a.id = b.id AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3) SELECT id, round(var_pop(w), 6) AS sharpness FROM s WHERE n = 5 GROUP BY 1")
def _(lineitem):
    g = _gray(lineitem)
    return raster.laplacian_variance(g.select("id", "x", "y", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"))).select("id", F.round("sharpness", 6).alias("sharpness"))


@query("g18_softest_cell", ("lineitem",), f""", g AS ({GRAY}), m AS (SELECT id, max(x) + 1 AS w, max(y) + 1 AS h FROM g GROUP BY 1), c AS (SELECT g.*, CAST(w / 4 AS INT) AS cw, CAST(h / 4 AS INT) AS ch, least(3, CAST(floor(x / floor(w / 4)) AS INT)) AS col, least(3, CAST(floor(y / floor(h / 4)) AS INT)) AS "row", w, h FROM g JOIN m USING (id) WHERE w >= 16 AND h >= 16),
t AS (SELECT id, col, "row", max(w) AS w, max(h) AS h FROM c GROUP BY 1, 2, 3 HAVING sqrt(var_pop(v)) >= 4), s AS (SELECT a.id, a.col, a."row", sum(b.v * CASE WHEN a.x = b.x AND a.y = b.y THEN -4 ELSE 1 END) AS l, count(*) AS n FROM c a JOIN c b ON a.id = b.id AND a.col = b.col AND a."row" = b."row" AND abs(a.x - b.x) + abs(a.y - b.y) <= 1 GROUP BY a.id, a.col, a."row", a.x, a.y),
k AS (SELECT t.id, t.col, t."row", coalesce((SELECT var_pop(l) FROM s WHERE s.id = t.id AND s.col = t.col AND s."row" = t."row" AND n = 5), 0) AS sharp FROM t) SELECT id, col, "row" FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sharp, 6), "row", col) AS rn FROM k) WHERE rn = 1""")
def _(lineitem):
    return raster.softest_cell(_gray(lineitem)).select("id", "col", "row")


@query("x5_lens_specification", ("part",), "SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE (CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 50 AS VARCHAR) END) || ' mm' || CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 2 = 0 THEN ', f/2.5' ELSE ', f/2.5-5' END END AS spec FROM part")
def _(part):
    n = F.col("p_size").cast("bigint")
    one = F.lit(1).cast("bigint")
    ratio = lambda a, b: F.struct(a.alias("n"), b.alias("d"))
    ten, five = F.lit(25).cast("bigint"), F.lit(5).cast("bigint")
    values = F.array(ratio(n, one), ratio(F.when(n % 3 == 0, n).otherwise(n + 50), one), ratio(ten, F.lit(10).cast("bigint")), ratio(F.when(n % 2 == 0, ten).otherwise(five * 10), F.when(n % 5 == 0, F.lit(0).cast("bigint")).otherwise(F.lit(10).cast("bigint"))))
    return part.select(F.col("p_partkey").alias("id"), parse.lens_specification(F.when(n % 7 == 0, F.slice(values, 1, 3)).otherwise(values)).alias("spec"))


@query("x9_typed_adjustments", ("events",), "SELECT event_id AS id, round(CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END / 20, 6) AS exposure, round(CASE WHEN event_id % 3 = 1 THEN value ELSE 50 END / 100, 6) AS luma, event_id % 3 <> 2 AND value <> 0 AND NOT (event_id % 3 = 1 AND value = 50) AS edited FROM events")
def _(events):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"exposure": '), F.col("value").cast("string"), F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"grain": {"size": '), F.col("value").cast("string"), F.lit("}}"))).otherwise(F.lit("{}"))
    v = events.select("event_id", F.parse_json(text).alias("v"))
    edited = files.is_edited("v", {"exposure": 0.0, "grain.size": 50.0})
    return v.select(F.col("event_id").alias("id"), F.round(files.adjustment("v", "exposure", scale=20.0), 6).alias("exposure"), F.round(files.adjustment("v", "grain.size", default=50.0, scale=100.0), 6).alias("luma"), edited.alias("edited"))


@query("j13_lens_match", ("part",), """, lens AS (SELECT DISTINCT p_brand AS maker, p_type AS model FROM part), asked AS (SELECT p_partkey AS id, p_brand, p_type FROM part WHERE p_partkey % 11 = 0 AND p_partkey % 7 > 0)
SELECT id, maker, model FROM asked JOIN lens ON p_type = model AND maker = CASE WHEN id % 4 = 3 THEN (SELECT max(l.maker) FROM lens l WHERE l.model = p_type) ELSE p_brand END""")
def _(part):
    """Types as lenses of their brands; asked for by their names in lower case, some in quotes, a quarter without a known maker, a seventh by a name that none has."""
    i = F.col("p_partkey")
    lenses = part.select(F.col("p_brand").alias("maker"), F.col("p_type").alias("model")).distinct()
    model = F.when(i % 7 == 0, "###").when(i % 2 == 0, F.concat(F.lit('"'), "p_type", F.lit('"'))).otherwise(F.lower("p_type"))
    wanted = part.filter(i % 11 == 0).select(i.alias("id"), F.when(i % 4 == 3, "nobody").otherwise(F.lower("p_brand")).alias("maker"), model.alias("model"))
    return files.match_lenses(wanted, lenses)


@query("x12_lens_interpolation", ("part",), """, e AS (SELECT * FROM (VALUES (24.0, 0.1, -0.2, 0.3), (50.0, 0.2, -0.1, 0.1), (70.0, 0.4, 0.0, 0.0)) v(focal, a, b, c)), w AS (SELECT p_partkey AS id, CAST(p_size * 2 AS DOUBLE) AS f FROM part),
n AS (SELECT id, f, least(70.0, greatest(24.0, f)) AS g FROM w) SELECT id, round(lo.a + (hi.a - lo.a) * CASE WHEN hi.focal > lo.focal THEN (g - lo.focal) / (hi.focal - lo.focal) ELSE 0 END, 6) AS a, round(lo.b + (hi.b - lo.b) * CASE WHEN hi.focal > lo.focal THEN (g - lo.focal) / (hi.focal - lo.focal) ELSE 0 END, 6) AS b
FROM n JOIN e lo ON lo.focal = (SELECT max(focal) FROM e WHERE focal <= g) JOIN e hi ON hi.focal = (SELECT min(focal) FROM e WHERE focal >= g)""")
def _(part):
    entries = part.sparkSession.createDataFrame([("m", 24.0, 0.1, -0.2, 0.3), ("m", 50.0, 0.2, -0.1, 0.1), ("m", 70.0, 0.4, 0.0, 0.0)], "model string, focal double, a double, b double, c double")
    wanted = part.select(F.col("p_partkey").alias("id"), F.lit("m").alias("model"), (F.col("p_size") * 2).cast("double").alias("focal"))
    return files.interpolate_lens(wanted, entries).select("id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("j9_hamming_pairs", ("embeddings",), ", s AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS h FROM embeddings) SELECT a.id AS src, b.id AS dst, CAST(64 - list_dot_product(list_transform(a.h, lambda x: (2 * x - 1)::DOUBLE), list_transform(b.h, lambda x: (2 * x - 1)::DOUBLE)) AS BIGINT) // 2 AS bits FROM s a JOIN s b ON a.label = b.label AND a.id < b.id WHERE CAST(64 - list_dot_product(list_transform(a.h, lambda x: (2 * x - 1)::DOUBLE), list_transform(b.h, lambda x: (2 * x - 1)::DOUBLE)) AS BIGINT) // 2 <= 24")
def _(embeddings):
    rows = embeddings.select(F.col("label").cast("string").alias("scope"), F.col("vec_id").alias("id"), F.array(similarity.sign_hash(F.col("embedding"))).alias("words"))
    return similarity.hamming_pairs(rows, 24).select("src", "dst", "bits")
