"""Raster reductions over pixel rows (id, x, y, r, g, b): histograms, waveforms, percentiles, colours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.session import small_side


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer luma."""
    return F.shiftright(218 * r.cast("int") + 732 * g.cast("int") + 74 * b.cast("int"), 10)


def histogram(pixels: DataFrame, width: int | str, step: int = 2) -> DataFrame:
    """(id, channel, bin, n): 256 bins of each channel and luma, from every step-th pixel of the image read row by row; empty bins included.

    width: pixels of a row (a number, or a column's name); x and y begin at 0.
    """
    place = F.col("y") * (F.col(width) if isinstance(width, str) else F.lit(width)) + F.col("x")
    v = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), x.cast("int").alias("bin")) for c, x in (("r", F.col("r")), ("g", F.col("g")), ("b", F.col("b")), ("luma", luma(F.col("r"), F.col("g"), F.col("b"))))]))
    counts = pixels.filter(place % step == 0).select("id", v.alias("v")).groupBy("id", "v.channel", "v.bin").agg(F.count("*").alias("n"))
    grid = pixels.select("id").distinct().select("id", F.explode(F.array(*map(F.lit, ("r", "g", "b", "luma")))).alias("channel")).select("id", "channel", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("bin"))
    return grid.join(counts, ["id", "channel", "bin"], "left").fillna(0, ["n"])


def smoothed(hist: DataFrame, sigma: float = 2.0) -> DataFrame:
    """hist with s: Gaussian smoothing over the bins, the ends clamped."""
    reach = int(3 * sigma)
    taps = [2.718281828459045 ** (-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total = sum(taps)
    by = hist.groupBy("id", "channel").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"].cast("double")).alias("h"))
    own = lambda i: sum((F.lit(t / total) * F.element_at("h", F.greatest(F.lit(1), F.least(F.lit(256), i + k + 1))) for t, k in zip(taps, range(-reach, reach + 1))), F.lit(0.0))
    each = by.select("id", "channel", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(255)), own)).alias("bin", "s"))
    return hist.join(each, ["id", "channel", "bin"])


def scaled(smooth: DataFrame, share: float = 0.99) -> DataFrame:
    """smoothed() with v, the height at which a bin is drawn: s over the value that this share of the channel's bins does not exceed, 1 at most; 0 if that value is none."""
    top = smooth.groupBy("id", "channel").agg(F.element_at(F.sort_array(F.collect_list("s")), int(255 * share + 0.5) + 1).alias("top"))
    return smooth.join(top, ["id", "channel"]).withColumn("v", F.when(F.col("top") > 1e-6, F.least(F.lit(1.0), F.col("s") / F.col("top"))).otherwise(0.0)).drop("top")


def percentile_bins(hist: DataFrame, *shares: float) -> DataFrame:
    """(id, channel, p...): the first bin at which the cumulative count reaches each share."""
    w = Window.partitionBy("id", "channel").orderBy("bin")
    run = hist.withColumn("c", F.sum("n").over(w)).withColumn("t", F.sum("n").over(Window.partitionBy("id", "channel")))
    return run.groupBy("id", "channel").agg(*[F.min(F.when(F.col("c") >= s * F.col("t"), F.col("bin"))).alias(f"p{round(100 * s)}") for s in shares])


def waveform(pixels: DataFrame, width: int, bins: int = 256) -> DataFrame:
    """(id, column, level, n): how often each level of luma occurs in each of bins columns."""
    return pixels.select("id", F.floor(F.col("x") * bins / width).cast("int").alias("column"), luma(F.col("r"), F.col("g"), F.col("b")).alias("level")).groupBy("id", "column", "level").agg(F.count("*").alias("n"))


def waveform_rgb(pixels: DataFrame, width: int, bins: int = 256) -> DataFrame:
    """(id, channel, column, level, n): the waveform of each colour channel."""
    v = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("int").alias("level")) for c in "rgb"]))
    at = F.least(F.floor(F.col("x") * bins / width), F.lit(bins - 1)).cast("int")
    return pixels.select("id", at.alias("column"), v.alias("v")).groupBy("id", "v.channel", "column", "v.level").agg(F.count("*").alias("n"))


#: Columns of one channel of the parade, and where each channel begins.
PARADE, PARADE_AT = 82, {"r": 0, "g": 87, "b": 174}


def parade(pixels: DataFrame, width: int) -> DataFrame:
    """(id, column, level, n): the three channels side by side in 256 columns."""
    v = F.explode(F.array(*[F.struct(F.lit(at).alias("at"), F.col(c).cast("int").alias("level")) for c, at in PARADE_AT.items()]))
    step = F.floor(F.col("x") * float(PARADE) / width) % PARADE
    return pixels.select("id", step.alias("step"), v.alias("v")).select("id", (F.col("v.at") + F.col("step")).cast("int").alias("column"), "v.level").groupBy("id", "column", "level").agg(F.count("*").alias("n"))


def vectorscope(pixels: DataFrame) -> DataFrame:
    """(id, vx, vy, n): colour differences on a grid of 256 by 256, scaled to 0.836 and held within a circle of 127."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    cb, cr = (-0.1146 * r - 0.3854 * g + 0.5 * b) * 0.836, (0.5 * r - 0.4542 * g - 0.0458 * b) * 0.836
    far = F.sqrt(cb * cb + cr * cr)
    inside = F.when(far > 127, 127 / far).otherwise(1.0)
    within = lambda c: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c))).cast("int")
    spots = pixels.select("id", within(F.round(cb * inside, 9) + 128).alias("vx"), within(128 - F.round(cr * inside, 9)).alias("vy"))
    return spots.groupBy("id", "vx", "vy").agg(F.count("*").alias("n"))


def clipping(hist: DataFrame) -> DataFrame:
    """(id, dark, bright): shares of luma below 5 and from 250."""
    own = hist.filter("channel = 'luma'").groupBy("id").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("bin") < 5, F.col("n")).otherwise(0)).alias("d"), F.sum(F.when(F.col("bin") >= 250, F.col("n")).otherwise(0)).alias("b"))
    return own.select("id", F.try_divide("d", "t").alias("dark"), F.try_divide("b", "t").alias("bright"))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """(h, s, v) of channels from 0 to 255: degrees, and two shares."""
    top, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    d = top - low
    h = F.pmod(F.when(d == 0, 0.0).when(top == r, 60 * (g - b) / d).when(top == g, 60 * (b - r) / d + 120).otherwise(60 * (r - g) / d + 240), F.lit(360.0))
    return F.struct(h.alias("h"), F.when(top == 0, 0.0).otherwise(d / top).alias("s"), (top / 255).alias("v"))


def hue_name(r: Column, g: Column, b: Column) -> Column:
    """Name of a pixel's colour by its hue, saturation and value."""
    c = rgb_to_hsv(r, g, b)
    h, s, v = c["h"], c["s"], c["v"]
    out = F.when(v < 0.2, "black").when((s < 0.1) & (v > 0.8), "white").when(s < 0.1, "gray")
    warm = (h < 45) | (h >= 340)
    out = out.when(warm & (v < 0.6) & (s < 0.7), "brown").when((h < 20) | (h >= 340), "red")
    for name, until in (("orange", 45), ("yellow", 70), ("green", 160), ("blue", 260), ("purple", 340)):
        out = out.when(h < until, name)
    return out


def dominant_colors(pixels: DataFrame, top: int = 2) -> DataFrame:
    """(id, color, n): the most frequent chromatic colours, or the most frequent one if none is chromatic."""
    counts = pixels.select("id", hue_name(F.col("r"), F.col("g"), F.col("b")).alias("color")).groupBy("id", "color").agg(F.count("*").alias("n"))
    gray = F.col("color").isin("black", "white", "gray")
    ranked = counts.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(gray, F.desc("n"), "color"))).withColumn("any", F.max(~gray).over(Window.partitionBy("id")))
    return ranked.filter((F.col("any") & ~gray & (F.col("rn") <= top)) | (~F.col("any") & (F.col("rn") == 1))).select("id", "color", "n")


def laplacian_variance(pixels: DataFrame) -> DataFrame:
    """(id, sharpness): variance of the 4-neighbour Laplacian of luma over inner pixels; neighbours meet in one aggregation, not a self-join."""
    at = pixels.select("id", "x", "y", luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    near = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), (F.col("v") * k).alias("w"), F.lit(1 if k == 1 else 16).alias("c")) for dx, dy, k in ((0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1))]))
    sums = at.select("id", near.alias("p")).groupBy("id", "p.x", "p.y").agg(F.sum("p.w").alias("w"), F.sum("p.c").alias("c")).filter("c = 20")
    return sums.groupBy("id").agg(F.var_pop("w").alias("sharpness"))


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, 1 / 2.4) - 0.055)


def combine_masks(base: Column, mask: Column, mode: str) -> Column:
    """Mask algebra on 0..255 values."""
    return {"add": F.greatest(base, mask), "subtract": F.greatest(base - mask, F.lit(0)), "intersect": F.least(base, mask), "invert": 255 - base}[mode]


def _mask(share: Column) -> Column:
    """0 to 255 of a share, cut to whole numbers."""
    return F.floor(F.round(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 6)).cast("int")


def radial_mask(x: Column, y: Column, cx: int, cy: int, rx: float, ry: float, feather: float, degrees: float = 0.0) -> Column:
    """255 inside a turned ellipse, falling evenly to 0 at its edge over the feather."""
    turn = math.radians(degrees)
    dx, dy = x - cx, y - cy
    u, v = dx * math.cos(turn) + dy * math.sin(turn), -dx * math.sin(turn) + dy * math.cos(turn)
    far = F.sqrt(F.pow(u / max(rx, 0.01), 2) + F.pow(v / max(ry, 0.01), 2))
    soft = min(max(feather, 0.0), 1.0)
    return _mask(1 - (far - (1 - soft)) / max(soft, 0.01))


def linear_mask(x: Column, y: Column, start: tuple[float, float], end: tuple[float, float], reach: float) -> Column:
    """A gradient across a line: 255 on one side, 0 on the other, even between them over reach on each side; 0 everywhere if the line is a point."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    length = math.hypot(dx, dy)
    if length * length < 0.01:
        return F.lit(0)
    across = ((x - start[0]) * -dy + (y - start[1]) * dx) / length
    return _mask(0.5 - 0.5 * across / max(reach, 0.01))


def luminance_mask(r: Column, g: Column, b: Column, target: float, tolerance: float) -> Column:
    """255 where a pixel is as bright as the target, falling to 0 at the tolerance (in hundredths)."""
    reach = max(tolerance * 2.55, 1.0)
    apart = F.abs(0.299 * r + 0.587 * g + 0.114 * b - target)
    return F.when(apart <= reach, _mask(1 - apart / reach)).otherwise(0)


def color_mask(r: Column, g: Column, b: Column, target: tuple[float, float, float], tolerance: float) -> Column:
    """255 where a pixel has the target's colour, falling to 0 at the tolerance (in hundredths of each channel)."""
    reach = max(tolerance * 2.55, 1.0) * math.sqrt(3)
    apart = F.sqrt(F.pow(r - target[0], 2) + F.pow(g - target[1], 2) + F.pow(b - target[2], 2))
    return F.when(apart <= reach, _mask(1 - apart / reach)).otherwise(0)


def tone_curve(value: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """A curve through knots (0 to 255 each) of a value from 0 to 1: cubic Hermite pieces whose slopes never overshoot (Fritsch and Carlson), held at the ends."""
    if len(knots) < 2:
        return value
    (x, y), n = zip(*knots), len(knots)
    rise = [(y[i + 1] - y[i]) / max(0.001, x[i + 1] - x[i]) for i in range(n - 1)]
    inner = [0.0 if rise[i - 1] * rise[i] <= 0 else (rise[i - 1] + rise[i]) / 2 for i in range(1, n - 1)]
    slopes = [rise[0], *inner, rise[-1]]
    v = value * 255.0
    out = F.when(v <= x[0], y[0] / 255.0)
    for i in range(n - 1):
        m1, m2 = slopes[i], slopes[i + 1]
        steep = math.hypot(m1, m2) / abs(rise[i]) if rise[i] else 0.0
        if steep > 3:
            m1, m2 = m1 * 3 / steep, m2 * 3 / steep
        w = x[i + 1] - x[i]
        t = (v - x[i]) / w
        piece = (2 * t * t * t - 3 * t * t + 1) * y[i] + (t * t * t - 2 * t * t + t) * (m1 * w) + (3 * t * t - 2 * t * t * t) * y[i + 1] + (t * t * t - t * t) * (m2 * w)
        out = out.when((v <= x[i + 1]) & (v < x[-1]), F.greatest(F.lit(0.0), F.least(F.lit(1.0), piece / 255.0)))
    return out.otherwise(y[-1] / 255.0)


def filmic(c: Column) -> Column:
    """The basic tone map of linear light, 0 to 1."""
    x = F.greatest(c, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x * (2.51 * x + 0.03) / (x * (2.43 * x + 0.59) + 0.14)))


# Fixed values of the AgX curve: exposures from middle grey, slope, powers, the joint of toe and shoulder, their scales.
AGX = {"low": -15.2, "range": 20.2, "slope": 2.3843, "power": 1.5, "x": 0.6060606, "y": 0.43446, "cut": -1.0112, "toe": -1.0359, "shoulder": 1.3475, "gamma": 2.4}


def agx_curve(c: Column) -> Column:
    """The AgX curve of one channel of the rendering space: exposure on a log scale, toe, shoulder, gamma."""
    k = AGX
    e = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log2(F.greatest(c / 0.18, F.lit(1e-6))) - k["low"]) / k["range"]))

    def bend(scale: float) -> Column:
        u = k["slope"] * (e - k["x"]) / scale
        return scale * u / F.pow(1 + F.pow(u, k["power"]), 1 / k["power"]) + k["y"]

    curved = F.when(e < k["x"], bend(k["toe"])).when(e == k["x"], k["slope"] * e + k["cut"]).otherwise(bend(k["shoulder"]))
    return F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), curved)), k["gamma"])


def apply_lut(pixels: DataFrame, lut: DataFrame) -> DataFrame:
    """pixels (r, g, b from 0 to 1) with lut: the colour that a 3-D table gives, by tetrahedra. lut: size, i (red fastest), r, g, b.

    A pixel's cell is cut along the order of its fractions: from the near corner one step along
    each axis in turn to the far one. The four corners are looked up by number in the table,
    which is broadcast if its counted rows are few.
    """
    size = lut.agg(F.max("size")).first()[0]
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * (size - 1)
    step = {"r": 1, "g": size, "b": size * size}
    axes = [F.struct((unit(c) - F.floor(unit(c))).alias("f"), F.lit(-k).alias("order"), F.when(F.floor(unit(c)) < size - 1, step[c]).otherwise(0).alias("step")) for k, c in enumerate("rgb")]
    near = sum((F.floor(unit(c)) * step[c] for c in "rgb"), F.lit(0)).cast("int")
    own = pixels.withColumns({"axes": F.sort_array(F.array(*axes), asc=False), "near": near, "row": F.monotonically_increasing_id()})
    at = lambda k: F.col("axes")[k]
    one, two, three = (at(k)["step"] for k in range(3))
    corners = [(F.col("near"), 1 - at(0)["f"]), (F.col("near") + one, at(0)["f"] - at(1)["f"]), (F.col("near") + one + two, at(1)["f"] - at(2)["f"]), (F.col("near") + one + two + three, at(2)["f"])]
    out = own
    for k, (number, weight) in enumerate(corners):
        table = small_side(lut.select(F.col("i").alias(f"i{k}"), F.struct("r", "g", "b").alias(f"c{k}")))
        out = out.withColumns({f"i{k}": number.cast("int"), f"w{k}": weight}).join(table, f"i{k}", "left")
    mixed = F.struct(*[sum((F.col(f"w{k}") * F.col(f"c{k}.{c}") for k in range(4)), F.lit(0.0)).alias(c) for c in "rgb"])
    return out.select(*pixels.columns, mixed.alias("lut"))


def negative(pixels: DataFrame, exposure: float = 0.0, contrast: float = 1.0, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(id, x, y, r, g, b) of photographed negatives (channels 0 to 1): densities between the bounds of each channel, through a normalised sigmoid, highlights drawn to their luma.

    Bounds are the values at 0.1 and 99.9 % of the densities inside a margin of 12 %, of every third row.
    """
    density = lambda c: -F.log10(F.greatest(F.lit(1e-6), F.least(F.lit(1.0), F.col(c))))
    logs = pixels.select("id", "x", "y", *[density(c).alias(c) for c in "rgb"])
    size = logs.groupBy("id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    inner = logs.join(small_side(size), "id").withColumns({"mx": F.floor(F.col("w") * 0.12), "my": F.floor(F.col("h") * 0.12)})
    inner = inner.filter((F.col("x") >= F.col("mx")) & (F.col("x") < F.col("w") - F.col("mx")) & (F.col("y") >= F.col("my")) & (F.col("y") < F.col("h") - F.col("my")) & ((F.col("y") - F.col("my")) % 3 == 0))
    long = inner.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in "rgb"])).alias("p")).groupBy("id", "p.c", "p.v").agg(F.count("*").alias("k"))
    w = Window.partitionBy("id", "c")
    ranked = long.withColumns({"upto": F.sum("k").over(w.orderBy("v")), "n": F.sum("k").over(w)})
    at = lambda share: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * share), F.col("n") - 1), F.col("v")))
    bounds = ranked.groupBy("id", "c").agg(at(0.001).alias("lo"), at(0.999).alias("hi"))
    safe = bounds.withColumn("hi", F.when(F.col("hi") <= F.col("lo") + 0.0001, F.col("lo") + 1).otherwise(F.col("hi")))
    wide = safe.groupBy("id").agg(*[F.max(F.when(F.col("c") == c, F.col(v))).alias(f"{c}_{v}") for c in "rgb" for v in ("lo", "hi")])
    k, x0 = 4.0 * max(contrast, 0.1), 0.6 - 0.25 * exposure
    y0, y1 = 1 / (1 + math.exp(k * x0)), 1 / (1 + math.exp(-k * (1 - x0)))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    curve = lambda c, weight: unit((1 / (1 + F.exp(-k * (F.greatest(F.lit(0.0), (F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo"))) * weight - x0))) - y0) / (y1 - y0))
    bent = logs.join(small_side(wide), "id").select("id", "x", "y", *[curve(c, v).alias(c) for c, v in zip("rgb", weights)])
    top = F.greatest("r", "g", "b")
    grey = bent.withColumns({"luma": 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b"), "drawn": F.when(top > 0.9, F.pow(unit((top - 0.9) * 10), 2)).otherwise(0.0)})
    return grey.select("id", "x", "y", *[F.pow(unit(F.col(c) + (F.col("luma") - F.col(c)) * F.col("drawn")), 1 / 2.2).alias(c) for c in "rgb"])


def auto_adjustments(pixels: DataFrame) -> DataFrame:
    """One row of suggested adjustments an image, from its luma percentiles, saturation, and the light of its centre and edge.

    Two passes: a histogram with the means, and a second histogram after exposure and contrast.
    """
    y = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    hi = F.greatest("r", "g", "b")
    each = pixels.select("id", "x", "y", y.alias("luma"), F.when(hi > 0, (hi - F.least("r", "g", "b")) / hi).otherwise(0.0).alias("sat"))
    size = each.groupBy("id").agg(F.count("*").alias("n"), F.avg("sat").alias("sat"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    sized = each.drop("sat").join(small_side(size), "id")
    half = lambda c, d: (F.col(c) >= F.floor(F.col(d) * 0.25)) & (F.col(c) < F.floor(F.col(d) * 0.75))
    middle = half("x", "w") & half("y", "h")
    light = sized.groupBy("id").agg(F.avg(F.when(middle, F.col("luma") / 255)).alias("centre"), F.avg(F.when(~middle, F.col("luma") / 255)).alias("edge"))

    def marks(bins: DataFrame, prefix: str) -> DataFrame:
        counts = bins.groupBy("id", "bin").agg(F.count("*").alias("k"), F.max("n").alias("n"))
        run = counts.withColumn("c", F.sum("k").over(Window.partitionBy("id").orderBy("bin")))
        at = lambda p: F.when(F.floor(F.max("n") * p) < 1, 0).otherwise(F.coalesce(F.min(F.when(F.col("c") >= F.floor(F.col("n") * p), F.col("bin"))), F.lit(255)))
        part = lambda low, high: F.sum(F.when((F.col("bin") >= low) & (F.col("bin") < high), F.col("k")).otherwise(0)) / F.max("n")
        return run.groupBy("id").agg(at(0.01).alias(f"{prefix}1"), at(0.5).alias(f"{prefix}50"), at(0.99).alias(f"{prefix}99"), part(240, 256).alias(f"{prefix}high"), part(250, 256).alias(f"{prefix}clipped"), part(0, 32).alias(f"{prefix}dark"))

    c, zero = F.col, F.lit(0.0)
    first = marks(sized.select("id", "n", F.least(F.round("luma"), F.lit(255.0)).cast("int").alias("bin")), "p").join(size.select("id", "sat"), "id").join(light, "id")
    span = F.greatest(c("p99") - c("p1"), F.lit(1)).cast("double")
    lift = (128 - c("p50")) * 0.125
    lift = F.when((c("p99") > 245) | (c("phigh") > 0.02) | (c("pclipped") > 0.005), F.least(lift, zero)).otherwise(lift)
    one = first.withColumn("span", span).withColumn("exposure", F.when(c("p99") + lift > 250, 250.0 - c("p99")).otherwise(lift)).withColumn("contrast", F.when(c("span") < 220, (220 / c("span") - 1) * 10).otherwise(0.0) * F.when(c("phigh") > 0.02, 0.5).otherwise(1.0))
    after = sized.join(small_side(one.select("id", "exposure", "contrast")), "id")
    bent = (c("luma") + c("exposure") - 128) * (1 + c("contrast") / 100) + 128
    second = marks(after.select("id", "n", F.round(F.least(F.lit(255.0), F.greatest(zero, bent))).cast("int").alias("bin")), "a")
    darker = F.when(c("edge") < c("centre"), c("centre") - c("edge")).otherwise(0.0)
    held = lambda x, low, high: F.least(F.lit(high), F.greatest(F.lit(low), x))
    return one.join(second, "id").select(
        "id",
        held(c("exposure") / 20, -5.0, 5.0).alias("exposure"),
        ((128 - c("a50")) * 0.007).alias("brightness"),
        F.least(c("contrast"), F.lit(100.0)).alias("contrast"),
        F.when(c("phigh") > 0.02, -F.least(c("phigh") * 120, F.lit(70.0))).otherwise(0.0).alias("highlights"),
        F.when(c("pdark") > 0.05, F.least(c("pdark") * 40, F.lit(50.0))).otherwise(0.0).alias("shadows"),
        F.when(c("sat") < 0.2, (0.2 - c("sat")) * 120).otherwise(0.0).alias("vibrance"),
        F.greatest(F.lit(-100.0), -100 * darker).alias("vignette"),
        F.when((c("span") < 120) & (c("sat") < 0.15), (1 - c("span") / 120) * 35).otherwise(0.0).alias("dehaze"),
        F.when(c("span") < 180, (1 - c("span") / 180) * 50).otherwise(0.0).alias("clarity"),
        F.when(darker > 0.05, F.least(darker * 100, F.lit(60.0))).otherwise(0.0).alias("centre"),
        ((c("a99") - 255) * 0.2).alias("whites"),
        (-0.5 * c("a1")).alias("blacks"),
    )


#: Mask values that count as the subject, and the fewest such pixels that make one.
SUBJECT, LEAST_SUBJECT = 128, 64


def composition(masks: DataFrame) -> DataFrame:
    """(id, composition, edge) of subject masks (id, x, y, mask): nearness of the subject's centre to a crossing of thirds, and the part of it at the image's edge. Images without a subject have no row."""
    size = masks.groupBy("id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    own = masks.filter(F.col("mask") >= SUBJECT).join(small_side(size), "id")
    rim = lambda c, d: (F.col(c) < F.greatest(F.lit(1.0), F.round(F.col(d) * 0.04))) | (F.col(c) >= F.col(d) - F.greatest(F.lit(1.0), F.round(F.col(d) * 0.04)))
    known = own.groupBy("id").agg(F.count("*").alias("n"), (F.avg("x") / F.max("w")).alias("cx"), (F.avg("y") / F.max("h")).alias("cy"), F.count_if(rim("x", "w") | rim("y", "h")).alias("k")).filter(F.col("n") >= LEAST_SUBJECT)
    off = lambda c: F.least(F.pow(F.col(c) - 1 / 3, 2), F.pow(F.col(c) - 2 / 3, 2))
    thirds = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sqrt(off("cx") + off("cy")) / 0.5))
    edge = F.col("k") / F.col("n")
    return known.select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.7 * thirds + 0.3 * (1 - edge))).alias("composition"), edge.alias("edge"))


def softest_cell(gray: DataFrame, grid: int = 4, texture: float = 4.0) -> DataFrame:
    """(id, col, row, x, y, width, height): of grid by grid cells with some texture the one of the least sharpness, as shares of the image. gray: id, x, y, v.

    Images under four pixels a cell, and those without texture anywhere, have no row. Ties go to the first row, then column.
    """
    size = gray.groupBy("id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).filter((F.col("w") >= 4 * grid) & (F.col("h") >= 4 * grid))
    step = lambda c, d: F.least(F.lit(grid - 1), F.floor(F.col(c) / F.floor(F.col(d) / grid))).cast("int")
    cells = gray.join(small_side(size), "id").withColumns({"col": step("x", "w"), "row": step("y", "h")})
    rough = cells.groupBy("id", "col", "row").agg(F.stddev_pop("v").alias("sd"), F.max("w").alias("w"), F.max("h").alias("h")).filter(F.col("sd") >= texture)
    named = cells.withColumn("id", F.struct("id", "col", "row"))
    sharp = laplacian_variance(named.select("id", "x", "y", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"))).select("id.*", "sharpness")
    scored = rough.join(sharp, ["id", "col", "row"], "left").select("id", F.struct(F.round(F.coalesce("sharpness", F.lit(0.0)), 6).alias("s"), "row", "col", "w", "h").alias("k"))
    best = scored.groupBy("id").agg(F.min("k").alias("k")).select("id", "k.*")
    cw, ch = F.floor(F.col("w") / grid), F.floor(F.col("h") / grid)
    return best.select("id", "col", "row", (F.col("col") * cw / F.col("w")).alias("x"), (F.col("row") * ch / F.col("h")).alias("y"), (cw / F.col("w")).alias("width"), (ch / F.col("h")).alias("height"))
