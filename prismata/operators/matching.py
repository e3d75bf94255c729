"""Feature matching between images, and the geometry that most matches agree on.

Matching compares each feature of one image with all of another by differing bits; the best must
be clearly better than the second. A task holds a slice of the one image's features and those of
the other. Consensus tries a fixed number of hypotheses for each pair of images: four matches
picked by a hash of the pair and the hypothesis' number give a projective map, and each hypothesis
is scored against all matches of its pair by one expression. So results depend on nothing but the
rows, however they are dealt out, and a pair's hypotheses are dealt out like any rows.

A pair's matches are as many as an image's features at most; detectors bound those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismata.session import materialize

#: A match must be this much better than the second best.
RATIO = 0.8
#: Pixels within which a match agrees with a map, matches that must agree, and hypotheses tried.
NEAR, AGREE, HYPOTHESES = 5.0, 15, 2500
#: Features of the first image that a task compares at once, and matches that it scores; hypotheses times matches that are held at once.
SLICE, SCORED = 2048, 1 << 18
#: Slices of an image at most: each takes a copy of the other image's features, which a task holds anyway.
SLICES = 16
NONE = (1 << 32) - 1


def match_features(features: DataFrame, pairs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(a, b, i, j, x1, y1, x2, y2): for each feature i of image a its match j in b.

    features: image, i, x, y, words (array of 64-bit words). pairs: a, b. Of equally near
    features the first is the best and another the second, so neither matches; if b has
    one feature only, it matches all. Pairs with an image without features have no match.
    """
    side = lambda c: features.select(F.col("image").alias(c), "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "words")
    each = pairs.select("a", "b").distinct()
    first = each.join(side("a"), "a").withColumn("part", F.floor(F.pmod(F.xxhash64("i"), F.lit(1 << 20))))
    sizes = first.groupBy("a", "b").agg(F.least(F.ceil(F.count("*") / SLICE), F.lit(SLICES)).cast("int").alias("parts"))
    first = first.join(sizes, ["a", "b"]).withColumn("part", (F.col("part") % F.col("parts")).cast("int")).withColumn("second", F.lit(False)).drop("parts")
    second = each.join(side("b"), "b").join(sizes, ["a", "b"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("second", F.lit(True)).drop("parts")
    names = ["a", "b", "i", "j", "x1", "y1", "x2", "y2"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        flag = table.column("second").to_numpy()
        one, two = table.filter(pa.array(~flag)), table.filter(pa.array(flag))
        picked: tuple = ((), ())
        if one.num_rows and two.num_rows:
            words = [np.array(t.column("words").to_pylist(), np.int64).view(np.uint64) for t in (one, two)]
            best, at, runner = [], [], []
            kind = np.uint16 if words[1].shape[1] < 1000 else np.uint32
            columns = np.ascontiguousarray(words[1].T)
            for row in words[0]:
                apart = np.zeros(two.num_rows, kind)
                for column, word in zip(columns, row):
                    apart += np.bitwise_count(column ^ word)
                at.append(int(apart.argmin()))
                best.append(int(apart[at[-1]]))
                apart[at[-1]] = np.iinfo(kind).max
                runner.append(int(apart.min()) if len(apart) > 1 else NONE)
            best, runner = np.array(best, np.float32), np.array(runner, np.float32)
            ok = (runner > 0) & (np.divide(best, runner, out=np.ones_like(best), where=runner > 0) < np.float32(ratio))
            picked = (np.flatnonzero(ok), np.array(at)[ok])
        one, two = one.take(pa.array(picked[0], pa.int64())), two.take(pa.array(picked[1], pa.int64()))
        columns = [one.column("a"), one.column("b"), one.column("i"), two.column("i"), one.column("x"), one.column("y"), two.column("x"), two.column("y")]
        return pa.table(dict(zip(names, columns)))

    kinds = dict(first.dtypes)
    schema = f"a {kinds['a']}, b {kinds['b']}, i {kinds['i']}, j {kinds['i']}, x1 double, y1 double, x2 double, y2 double"
    return first.unionByName(second).groupBy("a", "b", "part").applyInArrow(run, schema)


def maps_of(points: np.ndarray) -> np.ndarray:
    """Projective maps (n x 3 x 3) through four matches each (n x 4 x (x1, y1, x2, y2)); not a number where three of the first points lie on a line."""
    x, y, u, v = (points[:, :, k] for k in range(4))
    zero, one = np.zeros_like(x), np.ones_like(x)
    rows = np.stack([np.stack([-x, -y, -one, zero, zero, zero, x * u, y * u, u], -1), np.stack([zero, zero, zero, -x, -y, -one, x * v, y * v, v], -1)], 2)
    out = np.linalg.svd(rows.reshape(len(points), 8, 9))[2][:, -1].reshape(-1, 3, 3)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = out / out[:, 2:, 2:]
    for a, b, c in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)):
        area = x[:, a] * (y[:, b] - y[:, c]) + x[:, b] * (y[:, c] - y[:, a]) + x[:, c] * (y[:, a] - y[:, b])
        out[np.abs(area) < 1e-6] = np.nan
    return out


def inliers_of(maps: np.ndarray, points: np.ndarray, near: float) -> np.ndarray:
    """How many of the matches (m x (x1, y1, x2, y2)) each map (n x 9) takes within near."""
    x, y, u, v = points.T
    step = max(1, SCORED // max(len(points), 1))
    out = np.zeros(len(maps), np.int64)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for k in range(0, len(maps), step):
            h = maps[k : k + step].T[:, :, None]
            z = h[6] * x + h[7] * y + h[8]
            dx, dy = u - (h[0] * x + h[1] * y + h[2]) / z, v - (h[3] * x + h[4] * y + h[5]) / z
            out[k : k + step] = ((np.abs(z) >= 1e-8) & (dx * dx + dy * dy < near * near)).sum(1)
    return out


def consensus(matches: DataFrame, hypotheses: int = HYPOTHESES, near: float = NEAR, agree: int = AGREE) -> DataFrame:
    """(a, b, matches, inliers, map): for each pair of images the projective map (nine numbers, by rows) that most of its matches agree with, if at least `agree` do. Of equally good hypotheses the first counts.

    A hypothesis is four rows that are looked up by their places; it is scored on slices of the matches, whose counts add up.
    """
    point = ["x1", "y1", "x2", "y2"]
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("i", "j", *point)) - 1
    placed = materialize(matches.select("a", "b", place.cast("bigint").alias("place"), *point), "matches")
    sizes = placed.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n >= 4")
    tried = sizes.select("a", "b", "n", F.explode(F.sequence(F.lit(0), F.lit(hypotheses - 1))).alias("k"))
    pick = [F.pmod(F.xxhash64("a", "b", "k", F.lit(s)), F.col("n")).alias(f"p{s}") for s in range(4)]
    chosen = tried.select("a", "b", "k", *pick).filter("p0 != p1 AND p0 != p2 AND p0 != p3 AND p1 != p2 AND p1 != p3 AND p2 != p3")
    asked = chosen.select("a", "b", "k", F.posexplode(F.array("p0", "p1", "p2", "p3")).alias("s", "place"))
    four = asked.join(placed, ["a", "b", "place"]).groupBy("a", "b", "k").agg(F.array_sort(F.collect_list(F.struct("s", F.array(*point).alias("q")))).alias("f")).select("a", "b", "k", F.flatten(F.transform("f", lambda x: x["q"])).alias("four"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array(batch.column(3).flatten()).reshape(batch.num_rows, 4, 4)
            found = maps_of(points).reshape(-1, 9) if len(points) else np.zeros((0, 9))
            ok = np.isfinite(found).all(1)
            lists = pa.ListArray.from_arrays(np.arange(0, 9 * int(ok.sum()) + 1, 9, dtype=np.int32), pa.array(found[ok].reshape(-1)))
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(3)), lists], names=["a", "b", "k", "map"])

    kinds = dict(four.dtypes)
    keys = f"a {kinds['a']}, b {kinds['b']}"
    solved = materialize(four.mapInArrow(solve, f"{keys}, k int, map array<double>"), "maps")
    maps = solved.groupBy("a", "b").agg(F.collect_list(F.struct("k", "map")).alias("m")).join(sizes, ["a", "b"])
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / SLICE))).alias("part")
    maps = maps.select("a", "b", parts, F.col("m.k").alias("ks"), F.flatten("m.map").alias("maps"))
    slices = placed.groupBy("a", "b", F.floor(F.col("place") / SLICE).alias("part")).agg(F.flatten(F.collect_list(F.array(*point))).alias("points"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ks, h, points = (batch.column(c)[row].values for c in (2, 3, 4))
                counts = inliers_of(h.to_numpy().reshape(-1, 9), points.to_numpy().reshape(-1, 4), near)
                one = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([*(one.column(c).take(pa.array(np.zeros(len(ks), np.int64))) for c in (0, 1)), ks, pa.array(counts)], names=["a", "b", "k", "inliers"])

    scored = maps.join(slices, ["a", "b", "part"]).select("a", "b", "ks", "maps", "points").mapInArrow(score, f"{keys}, k int, inliers bigint")
    best = scored.groupBy("a", "b", "k").agg(F.sum("inliers").alias("inliers")).groupBy("a", "b").agg(F.max(F.struct("inliers", (-F.col("k")).alias("k"))).alias("s")).filter(F.col("s.inliers") >= agree)
    named = best.select("a", "b", (-F.col("s.k")).alias("k"), F.col("s.inliers").cast("int").alias("inliers"))
    return named.join(solved, ["a", "b", "k"]).join(sizes, ["a", "b"]).select("a", "b", F.col("n").cast("int").alias("matches"), "inliers", "map")
