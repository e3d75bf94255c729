"""Queries over dense images made of orders: denoising, sensor corrections, demosaicing."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismata.operators import components, grouping, matching, similarity, tiles
from prismata.plans.registry import query

#: Four images of rows of WIDE pixels; a last row that is not full is left out. Tiles are small, so that images have many.
WIDE, TILE = 37, 16
IMAGE = f""", place AS (SELECT o_orderkey % 4 AS id, o_orderkey // 4 % {WIDE} AS x, o_orderkey // 4 // {WIDE} AS y, o_totalprice % 256 / 255 AS r, o_custkey * 7 % 256 / 255.0 AS g, o_orderkey * 31 % 256 / 255.0 AS b, CASE WHEN o_orderkey % 61 = 0 THEN 4000 ELSE o_totalprice % 900 END AS v FROM orders WHERE o_orderkey // 4 // {WIDE} < (SELECT count(*) // 4 // {WIDE} FROM orders)), size AS (SELECT id, max(y) AS my FROM place GROUP BY 1)"""


def _image(orders):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = orders.agg(F.floor(F.floor(F.count("*") / 4) / WIDE).alias("rows"))
    p = orders.select((k % 4).alias("id"), (F.floor(k / 4) % WIDE).alias("x"), F.floor(F.floor(k / 4) / WIDE).alias("y"), (F.col("o_totalprice") % 256 / 255).alias("r"), (c * 7 % 256 / 255.0).alias("g"), (k * 31 % 256 / 255.0).alias("b"), F.when(k % 61 == 0, F.lit(4000.0)).otherwise(F.col("o_totalprice") % 900).alias("v"))
    return p.join(F.broadcast(rows)).filter("y < rows").drop("rows")  # one row


_TAPS = "(SELECT unnest([-2, -1, 0, 1, 2]) AS k, unnest([0.0625, 0.25, 0.375, 0.25, 0.0625]) AS t)"


def _level(before: str, level: int) -> str:
    """SQL of one smoothing: along rows, then columns, edges repeated."""
    gap = 1 << level
    return f""", h{level} AS (SELECT a.id, a.x, a.y, {", ".join(f"sum(t * b.{c}) AS {c}" for c in ("l", "cb", "cr"))} FROM {before} a CROSS JOIN {_TAPS} k JOIN {before} b ON b.id = a.id AND b.y = a.y AND b.x = greatest(0, least({WIDE - 1}, a.x + k.k * {gap})) GROUP BY 1, 2, 3),
s{level} AS (SELECT a.id, a.x, a.y, {", ".join(f"sum(t * b.{c}) AS {c}" for c in ("l", "cb", "cr"))} FROM h{level} a JOIN size USING (id) CROSS JOIN {_TAPS} k JOIN h{level} b ON b.id = a.id AND b.x = a.x AND b.y = greatest(0, least(my, a.y + k.k * {gap})) GROUP BY 1, 2, 3)"""


def _denoised(strength: float) -> str:
    weights = [(0.25, 1.0), (0.45, 0.9), (0.35, 0.6), (0.15, 0.3)]
    text = ", y0 AS (SELECT id, x, y, 0.299 * r + 0.587 * g + 0.114 * b AS l, -0.168736 * r - 0.331264 * g + 0.5 * b AS cb, 0.5 * r - 0.418688 * g - 0.081312 * b AS cr FROM place)"
    names = ["y0", "s0", "s1", "s2", "s3"]
    for level in range(4):
        text += _level(names[level], level)
    part = lambda c, k: " + ".join(f"({names[j]}.{c} - {names[j + 1]}.{c}) * {1 - min(1, strength * weights[j][k])}" for j in range(4)) + f" + s3.{c}"
    joined = "y0 " + " ".join(f"JOIN s{j} USING (id, x, y)" for j in range(4))
    return text + f""", z AS (SELECT id, x, y, {part("l", 0)} AS l, {part("cb", 1)} AS cb, {part("cr", 1)} AS cr FROM {joined})
SELECT id, x, y, round(greatest(0, l + 1.402 * cr), 6) + 0 AS r, round(greatest(0, l - 0.344136 * cb - 0.714136 * cr), 6) + 0 AS g, round(greatest(0, l + 1.772 * cb), 6) + 0 AS b FROM z"""


@query("k9_wavelet_denoise", ("orders",), IMAGE + _denoised(0.7))
def _(orders):
    out = tiles.wavelet_denoise(tiles.to_tiles(_image(orders), "r", "g", "b", size=TILE), 0.7, TILE)
    return tiles.to_pixels(out, "r", "g", "b", size=TILE).select("id", "x", "y", *[F.round(c, 6).alias(c) for c in "rgb"])


_AT = "v.x = greatest(0, least({wide}, p.x + d.dx)) AND v.y = greatest(0, least(my, p.y + d.dy))".format(wide=WIDE - 1)


@query("k14_mended_pixels", ("orders",), f"""{IMAGE}, d AS (SELECT unnest([0, 0, -2, 2]) AS dx, unnest([-2, 2, 0, 0]) AS dy), n AS (SELECT p.id, p.x, p.y, list(v.v ORDER BY v.v) AS a FROM place p JOIN size USING (id) CROSS JOIN d JOIN place v ON v.id = p.id AND {_AT} GROUP BY 1, 2, 3)
SELECT id, x, y, round(CASE WHEN my >= 4 AND abs(v - (a[2] + a[3]) * 0.5) > 0.15 * 4000 THEN (a[2] + a[3]) * 0.5 ELSE v END, 6) AS v FROM place JOIN n USING (id, x, y) JOIN size USING (id)""")
def _(orders):
    out = tiles.mend_pixels(tiles.to_tiles(_image(orders), "v", size=TILE), 0.15, 4000.0, TILE)
    return tiles.to_pixels(out, "v", size=TILE).select("id", "x", "y", F.round("v", 6).alias("v"))


@query("k14_row_banding", ("orders",), f"""{IMAGE}, m AS (SELECT id, y, avg(v) AS m FROM place GROUP BY 1, 2), o AS (SELECT a.id, a.y, CASE WHEN my >= 8 THEN (any_value(a.m) - avg(b.m)) * 0.8 ELSE 0 END AS o FROM m a JOIN size USING (id) LEFT JOIN m b ON b.id = a.id AND b.y <> a.y AND abs(b.y - a.y) <= 16 AND (b.y - a.y) % 2 = 0 GROUP BY 1, 2, my)
SELECT id, x, y, round(CASE WHEN abs(coalesce(o, 0)) < 0.000001 THEN v ELSE greatest(0, v - o) END, 6) AS v FROM place JOIN o USING (id, y)""")
def _(orders):
    return tiles.unband(_image(orders).select("id", "x", "y", "v"), 0.8).select("id", "x", "y", F.round("v", 6).alias("v"))


@query("k8_demosaic", ("orders",), f"""{IMAGE}, c AS (SELECT *, CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN 'r' WHEN x % 2 = 1 AND y % 2 = 1 THEN 'b' ELSE 'g' END AS k FROM place), d AS (SELECT unnest([0, 0, -1, 1, -1, -1, 1, 1]) AS dx, unnest([-1, 1, 0, 0, -1, 1, -1, 1]) AS dy),
n AS (SELECT p.id, p.x, p.y, avg(v.v) FILTER (dx = 0 OR dy = 0) AS crossing, avg(v.v) FILTER (dx <> 0 AND dy <> 0) AS diagonal, avg(v.v) FILTER (dx <> 0 AND dy <> 0 AND v.k = 'r') AS red, avg(v.v) FILTER (dx <> 0 AND dy <> 0 AND v.k = 'b') AS blue FROM c p JOIN size USING (id) CROSS JOIN d JOIN c v ON v.id = p.id AND {_AT} GROUP BY 1, 2, 3)
SELECT id, x, y, round(CASE k WHEN 'r' THEN v WHEN 'b' THEN diagonal ELSE coalesce(red, v) END, 6) AS r, round(CASE k WHEN 'g' THEN v ELSE crossing END, 6) AS g, round(CASE k WHEN 'b' THEN v WHEN 'r' THEN diagonal ELSE coalesce(blue, v) END, 6) AS b FROM c JOIN n USING (id, x, y)""")
def _(orders):
    out = tiles.demosaic(tiles.to_tiles(_image(orders), "v", size=TILE), size=TILE)
    return tiles.to_pixels(out, "r", "g", "b", size=TILE).select("id", "x", "y", *[F.round(c, 6).alias(c) for c in "rgb"])


#: Two images of each of five sets of vectors: the second is the first moved by (30, -12), a third of its features drawn a bit differently, and every seventh somewhere else.
STEPS = (-0.125, -0.0625, 0.0625, 0.125)
FEATURES = f""", f AS (SELECT vec_id AS i, vec_id % 5 AS s, vec_id * 37 % 1000 AS x, vec_id * 91 % 700 AS y, [{" + ".join(f"(e > {t})::INT" for t in STEPS)} FOR e IN embedding] AS c FROM embeddings),
g AS (SELECT i, s, CASE WHEN i % 7 = 0 THEN x + 700 + 13 * (i % 11) ELSE x + 30 END AS x, CASE WHEN i % 7 = 0 THEN y + 300 - 17 * (i % 13) ELSE y - 12 END AS y, [CASE WHEN i % 3 = 0 AND k <= 4 THEN 4 - c[k] ELSE c[k] END FOR k IN range(1, 65)] AS c FROM f),
d AS (SELECT f.s, f.i, g.i AS j, f.x AS x1, f.y AS y1, g.x AS x2, g.y AS y2, list_sum([abs(f.c[k] - g.c[k]) FOR k IN range(1, 65)]) AS apart FROM f JOIN g ON f.s = g.s),
r AS (SELECT *, row_number() OVER w AS rn, lead(apart) OVER w AS runner FROM d WINDOW w AS (PARTITION BY s, i ORDER BY apart, j)), m AS (SELECT 2 * s AS a, 2 * s + 1 AS b, i, j, x1, y1, x2, y2 FROM r WHERE rn = 1 AND runner > 0 AND CAST(apart AS FLOAT) / CAST(runner AS FLOAT) < CAST(0.8 AS FLOAT))"""


def _features(embeddings):
    i = F.col("vec_id")
    seventh, third = i % 7 == 0, i % 3 == 0
    over = lambda v, t: F.transform(v, lambda e: e - F.lit(t).cast("float"))
    words = lambda v: F.array(*[similarity.sign_hash(over(v, t)) for t in STEPS])
    turned = F.transform("embedding", lambda e, k: F.when(third & (k < 4), -e).otherwise(e))
    x, y = i * 37 % 1000, i * 91 % 700
    first = embeddings.select((i % 5 * 2).alias("image"), i.alias("i"), x.alias("x"), y.alias("y"), words(F.col("embedding")).alias("words"))
    second = embeddings.select((i % 5 * 2 + 1).alias("image"), i.alias("i"), F.when(seventh, x + 700 + 13 * (i % 11)).otherwise(x + 30).alias("x"), F.when(seventh, y + 300 - 17 * (i % 13)).otherwise(y - 12).alias("y"), words(turned).alias("words"))
    pairs = embeddings.select((i % 5 * 2).alias("a"), (i % 5 * 2 + 1).alias("b")).distinct()
    return first.unionByName(second), pairs


@query("g25_feature_matches", ("embeddings",), f"{FEATURES} SELECT a, b, i, j FROM m")
def _(embeddings):
    return matching.match_features(*_features(embeddings)).select("a", "b", "i", "j")


@query("g25_consensus", ("embeddings",), f"{FEATURES} SELECT a, b, count(*) AS matches, count(*) FILTER ((x2 - x1 - 30) ** 2 + (y2 - y1 + 12) ** 2 < 25) AS inliers, 30.0::DOUBLE AS dx, -12.0::DOUBLE AS dy FROM m GROUP BY 1, 2 HAVING inliers >= 15")
def _(embeddings):
    found = matching.consensus(matching.match_features(*_features(embeddings)))
    return found.select("a", "b", F.col("matches").cast("bigint").alias("matches"), F.col("inliers").cast("bigint").alias("inliers"), F.round(F.col("map")[2], 3).alias("dx"), F.round(F.col("map")[5], 3).alias("dy"))


@query("g24_stitching_order", ("embeddings",))
def _(embeddings):
    """Five vectors' nearest relatives as a set of images: links are as strong as vectors are alike."""
    links = similarity.strongest_links(embeddings, "vec_id", "embedding", 0.3, F.col("vec_id") % 5, 1000)
    kept = components.spanning_forest(links).select(F.col("scope").alias("set"), "src", "dst", F.col("weight").alias("inliers"))
    return grouping.stitching_order(kept)


_TURN = "radians(17.0)"


@query("k7_warped", ("orders",), f"""{IMAGE}, c AS (SELECT id, x, y, my, {WIDE} / 2.0 AS cx, (my + 1) / 2.0 AS cy, x - {WIDE} / 2.0 - 0.04 * {WIDE} AS u, y - (my + 1) / 2.0 + 0.03 * (my + 1) AS v FROM place JOIN size USING (id)),
s AS (SELECT id, x, y, my, cx + (cos({_TURN}) * u + sin({_TURN}) * v) / 1.2 / 1.1 AS sx, cy + (-sin({_TURN}) * u + cos({_TURN}) * v) / 1.2 AS sy FROM c),
n AS (SELECT s.id, s.x, s.y, sum(p.v * (1 - abs(s.sx - p.x)) * (1 - abs(s.sy - p.y))) AS v FROM s JOIN place p ON p.id = s.id AND p.x BETWEEN floor(s.sx) AND floor(s.sx) + 1 AND p.y BETWEEN floor(s.sy) AND floor(s.sy) + 1 WHERE sx >= 0 AND sy >= 0 AND sx < {WIDE - 1} AND sy < my GROUP BY 1, 2, 3)
SELECT id, x, y, round(coalesce(n.v, 0), 5) AS v FROM (SELECT id, x, y FROM place) LEFT JOIN n USING (id, x, y)""")
def _(orders):
    out = tiles.warp(tiles.to_tiles(_image(orders), "v", size=TILE), 1, TILE, rotate=17.0, scale=120.0, aspect=10.0, x_offset=4.0, y_offset=-3.0)
    return tiles.to_pixels(out, "v", size=TILE).select("id", "x", "y", F.round("v", 5).alias("v"))


@query("k7_turned_flipped_cropped", ("orders",), f"""{IMAGE}, t AS (SELECT id, my - y AS x, x AS y, v, my + 1 AS w, {WIDE} AS h FROM place JOIN size USING (id)), f AS (SELECT id, w - 1 - x AS x, y, v, w FROM t)
SELECT id, x - 3 AS x, y - 6 AS y, round(v, 6) AS v FROM f WHERE x >= 3 AND x < 53 AND y >= 6 AND y < 26""")
def _(orders):
    """In the order of an edit: turned by a quarter, mirrored, cropped."""
    image = _image(orders).select("id", "x", "y", "v")
    return tiles.cropped(tiles.flipped(tiles.turned(image, 1), True, False), 3.2, 5.5, 50.0, 20.4).select("id", "x", "y", F.round("v", 6).alias("v"))


@query("k6_grown_feathered_mask", ("orders",), f"""{IMAGE}, m AS (SELECT id, x, y, CASE WHEN v > 700 THEN v % 256 ELSE 0 END AS v FROM place), d AS (SELECT unnest(range(-2, 3)) AS k), g AS (SELECT a.id, a.x, a.y, max(b.v) AS v FROM m a CROSS JOIN d JOIN m b ON b.id = a.id AND b.y = a.y AND b.x = a.x + k GROUP BY 1, 2, 3),
h AS (SELECT a.id, a.x, a.y, max(b.v) AS v FROM g a CROSS JOIN d JOIN g b ON b.id = a.id AND b.x = a.x AND b.y = a.y + k GROUP BY 1, 2, 3), e AS (SELECT k, exp(-k * k / 4.5) / sum(exp(-k * k / 4.5)) OVER () AS w FROM (SELECT unnest(range(-3, 4)) AS k)),
r AS (SELECT a.id, a.x, a.y, sum(w * b.v) AS v FROM h a CROSS JOIN e JOIN h b ON b.id = a.id AND b.y = a.y AND b.x = greatest(0, least({WIDE - 1}, a.x + k)) GROUP BY 1, 2, 3)
SELECT a.id, a.x, a.y, round(sum(w * b.v), 5) AS v FROM r a JOIN size USING (id) CROSS JOIN e JOIN r b ON b.id = a.id AND b.x = a.x AND b.y = greatest(0, least(my, a.y + k)) GROUP BY 1, 2, 3""")
def _(orders):
    mask = _image(orders).select("id", "x", "y", F.when(F.col("v") > 700, F.col("v") % 256).otherwise(0.0).alias("v"))
    out = tiles.feathered(tiles.grown(tiles.to_tiles(mask, "v", size=TILE), 2, TILE), 1.5, TILE)
    return tiles.to_pixels(out, "v", size=TILE).select("id", "x", "y", F.round("v", 5).alias("v"))
