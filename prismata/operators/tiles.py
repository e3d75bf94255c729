"""Stencils over images as tiles (K7-K10, K14): pixel rows become square array blocks, neighbours meet by halo exchange.

A tile is a row (id, ty, tx, height, width of its image, data): its planes as one block of
bytes. A stencil of reach r needs r more pixels around a tile. Each tile sends every
tile that needs some of its pixels just those, once; grouping by the receiving tile puts them
together. So what moves for one step is the images and their seams, whatever the image's
size, and a task holds one padded tile. Beyond the image's edge the nearest pixel is
repeated. Iterated stencils write their tiles between the steps.

Pixels are numbered from 0 in each image; an image has height and width by its largest
numbers, and pixels that are missing count as 0. Of repeated pixels the largest values count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismata.session import materialize

SIZE = 256
TILE = "id bigint, ty int, tx int, height int, width int, data binary"
NAMES = [c.split()[0] for c in TILE.split(", ")]
TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

#: One tile's planes (channels x rows x columns), the place of its first pixel, and its image's height and width.
Step = Callable[[np.ndarray, int, int, int, int], np.ndarray]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(NAMES, TYPES))})


def _span(at: int, size: int, end: int) -> int:
    """Pixels of a tile in one direction."""
    return min(size, end - at * size)


def to_tiles(pixels: DataFrame, *planes: str, size: int = SIZE) -> DataFrame:
    """Tiles of pixel rows (id, x, y and the planes)."""
    sizes = pixels.groupBy("id").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))
    placed = pixels.select(F.col("id").cast("bigint").alias("id"), F.floor(F.col("y") / size).cast("int").alias("ty"), F.floor(F.col("x") / size).cast("int").alias("tx"), (F.col("y") % size).cast("int").alias("y"), (F.col("x") % size).cast("int").alias("x"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"v{k}") for k, c in enumerate(planes)])

    def build(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in NAMES[:5]}
        block = np.full((len(planes), _span(first["ty"], size, first["height"]), _span(first["tx"], size, first["width"])), -np.inf)
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        for k in range(len(planes)):
            np.maximum.at(block[k], (y, x), table.column(f"v{k}").to_numpy())
        block[np.isneginf(block)] = 0
        return _table([(*first.values(), block.tobytes())])

    # a tile has size x size pixels at most
    return placed.join(sizes, "id").groupBy("id", "ty", "tx").applyInArrow(build, TILE)


def _planes(data: bytes, channels: int, height: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(channels, height, width)


def _pieces(channels: int, reach: int, size: int):
    """A tile -> for each tile that needs some of its pixels: the receiver, where the piece stands in the image, and the piece."""

    def targets(at: int, n: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(receiver, from, to) along one direction, as places in the image."""
        first, last = at * size, at * size + n
        for t in range(max(0, (first - reach) // size), min((end - 1) // size, (last - 1 + reach) // size) + 1):
            lo, hi = max(first, t * size - reach), min(last, t * size + _span(t, size, end) + reach)
            if lo < hi:
                yield t, lo, hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ty, tx, height, width, data in zip(*(c.to_pylist() for c in batch.columns)):
                h, w = _span(ty, size, height), _span(tx, size, width)
                block = _planes(data, channels, h, w)
                rows = []
                for ry, y0, y1 in targets(ty, h, height):
                    for rx, x0, x1 in targets(tx, w, width):
                        own = block[:, y0 - ty * size : y1 - ty * size, x0 - tx * size : x1 - tx * size]
                        rows.append((i, ry, rx, height, width, np.ascontiguousarray(own).tobytes(), y0, x0, y1 - y0, x1 - x0))
                kinds = (*TYPES, *[pa.int32()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[*NAMES, "y0", "x0", "h", "w"])

    return run


def stencil(tiles: DataFrame, channels: int, reach: int, step: Step, size: int = SIZE) -> DataFrame:
    """Tiles of what step makes of each tile padded by reach on all sides. step gets the padded planes and returns planes of the tile's own size."""
    pieces = tiles.select(*NAMES).mapInArrow(_pieces(channels, reach, size), f"{TILE}, y0 int, x0 int, h int, w int")

    def put_together(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        first = rows[0]
        height, width = first["height"], first["width"]
        top, left = first["ty"] * size, first["tx"] * size
        h, w = _span(first["ty"], size, height), _span(first["tx"], size, width)
        y0, x0, y1, x1 = max(0, top - reach), max(0, left - reach), min(height, top + h + reach), min(width, left + w + reach)
        whole = np.zeros((channels, y1 - y0, x1 - x0))
        for r in rows:
            whole[:, r["y0"] - y0 : r["y0"] - y0 + r["h"], r["x0"] - x0 : r["x0"] - x0 + r["w"]] = _planes(r["data"], channels, r["h"], r["w"])
        padded = np.pad(whole, ((0, 0), (reach - (top - y0), reach - (y1 - top - h)), (reach - (left - x0), reach - (x1 - left - w))), mode="edge")
        out = step(padded, top, left, height, width)
        return _table([(first["id"], first["ty"], first["tx"], height, width, np.ascontiguousarray(out, np.float64).tobytes())])

    # a group is one padded tile
    return pieces.groupBy("id", "ty", "tx").applyInArrow(put_together, TILE)


def each_tile(tiles: DataFrame, channels: int, step: Step, size: int = SIZE) -> DataFrame:
    """Tiles of what step makes of each tile by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for ty, tx, height, width, raw in zip(*(batch.column(k).to_pylist() for k in range(1, 6))):
                block = _planes(raw, channels, _span(ty, size, height), _span(tx, size, width))
                data.append(np.ascontiguousarray(step(block, ty * size, tx * size, height, width), np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(data, pa.binary())], names=NAMES)

    return tiles.select(*NAMES).mapInArrow(run, TILE)


def to_pixels(tiles: DataFrame, *planes: str, size: int = SIZE) -> DataFrame:
    """(id, x, y and the planes) of every pixel."""
    names = ["id", "x", "y", *planes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ty, tx, height, width, data in zip(*(c.to_pylist() for c in batch.columns)):
                h, w = _span(ty, size, height), _span(tx, size, width)
                block = _planes(data, len(planes), h, w)
                y, x = np.divmod(np.arange(h * w, dtype=np.int64), w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, i)), pa.array(x + tx * size), pa.array(y + ty * size), *(pa.array(p.reshape(-1)) for p in block)], names=names)

    return tiles.select(*NAMES).mapInArrow(run, "id bigint, x bigint, y bigint, " + ", ".join(f"{p} double" for p in planes))


# Denoising by wavelets (K9)

# The smoothing kernel, and how much of each level's detail goes at full strength, finest first.
TAPS = np.array([1, 4, 6, 4, 1]) / 16
LUMA = (0.25, 0.45, 0.35, 0.15)
CHROMA = (1.0, 0.9, 0.6, 0.3)
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
FROM_YCC = np.array([[1.0, 0.0, 1.402], [1.0, -0.344136, -0.714136], [1.0, 1.772, 0.0]])


def _dilated(padded: np.ndarray, gap: int) -> np.ndarray:
    """The kernel with holes, along rows, then columns; padded has 2 * gap more pixels on each side."""
    w, h = padded.shape[2] - 4 * gap, padded.shape[1] - 4 * gap
    rows = sum(t * padded[:, :, k * gap : k * gap + w] for k, t in enumerate(TAPS))
    return sum(t * rows[:, k * gap : k * gap + h] for k, t in enumerate(TAPS))


def wavelet_denoise(tiles: DataFrame, strength: float, size: int = SIZE) -> DataFrame:
    """Tiles of denoised red, green and blue: brightness and colour are split into four levels of detail each, and of each level a share goes, more of colour than of brightness.

    A level is the difference between an image and its smoothed form, and the smoothed
    form is the next level's image: one halo exchange a level, with holes that double.
    """
    if strength <= 0:
        return tiles
    kept = [1 - np.clip(strength * np.array([a, b, b]), 0, 1)[:, None, None] for a, b in zip(LUMA, CHROMA)]
    now = each_tile(tiles, 3, lambda rgb, *_: np.concatenate([np.tensordot(TO_YCC, rgb, 1), np.zeros_like(rgb)]), size)  # the image, and what is kept of it so far
    for level, share in enumerate(kept):
        gap = 1 << level

        def split(padded: np.ndarray, *_, gap: int = gap, share: np.ndarray = share) -> np.ndarray:
            own = padded[:, 2 * gap : -2 * gap, 2 * gap : -2 * gap]
            smooth = _dilated(padded[:3], gap)
            return np.concatenate([smooth, own[3:] + (own[:3] - smooth) * share])

        now = materialize(stencil(now, 6, 2 * gap, split, size), "wavelet")
    return each_tile(now, 6, lambda p, *_: np.maximum(np.tensordot(FROM_YCC, p[:3] + p[3:], 1), 0), size)


# Sensor corrections (K14) and demosaicing (K8)


def mend_pixels(tiles: DataFrame, threshold: float, white: float, size: int = SIZE) -> DataFrame:
    """Tiles of one sensor plane without hot and dead pixels: a value further from the median of its four neighbours of the same colour than this share of white becomes that median. Images under five pixels in a direction stay."""

    def mend(padded: np.ndarray, top: int, left: int, height: int, width: int) -> np.ndarray:
        own = padded[:, 2:-2, 2:-2]
        if height < 5 or width < 5:
            return own
        around = np.sort(np.stack([padded[:, :-4, 2:-2], padded[:, 4:, 2:-2], padded[:, 2:-2, :-4], padded[:, 2:-2, 4:]]), axis=0)
        median = (around[1] + around[2]) * 0.5
        return np.where(np.abs(own - median) > threshold * white, median, own)

    return stencil(tiles, 1, 2, mend, size)


def unband(pixels: DataFrame, strength: float, value: str = "v", reach: int = 8) -> DataFrame:
    """Pixel rows (id, x, y, value) of a sensor without row banding: of each row's mean, what differs from the mean of the rows of its kind (every second one, up to reach on each side, itself not) is subtracted by strength, down to 0. Images under nine rows stay."""
    means = pixels.groupBy("id", "y").agg(F.avg(value).alias("m"))
    height = means.groupBy("id").agg((F.max("y") + 1).alias("height"))
    # each row's mean goes to the rows that look at it: 2 * reach rows of one number
    steps = F.array(*[F.lit(2 * d) for d in range(-reach, reach + 1) if d])
    seen = means.select("id", F.explode(F.transform(steps, lambda d: F.col("y") + d)).alias("y"), F.col("m").alias("other")).groupBy("id", "y").agg(F.avg("other").alias("around"))
    off = means.join(height, "id").join(seen, ["id", "y"], "left").select("id", "y", F.when(F.col("height") >= 9, F.coalesce((F.col("m") - F.col("around")) * strength, F.lit(0.0))).otherwise(0.0).alias("off"))
    return pixels.join(off, ["id", "y"]).withColumn(value, F.when(F.abs("off") < 1e-6, F.col(value)).otherwise(F.greatest(F.col(value) - F.col("off"), F.lit(0.0)))).drop("off")


#: Colour numbers of the four places of a sensor's pattern: red 0, green 1, blue 2.
RGGB = (0, 1, 1, 2)


def demosaic(tiles: DataFrame, pattern: tuple[int, int, int, int] = RGGB, size: int = SIZE) -> DataFrame:
    """Tiles of red, green and blue from one sensor plane, bilinear.

    At red and blue, green is the mean of the four pixels beside, and the other colour that of
    the four at the corners. At green, red and blue are the means of those corners that are
    red or blue, which only happens at the image's edge, where places beyond it stand for the
    nearest inside; elsewhere they are the pixel's own value.
    """
    cfa = np.array(pattern).reshape(2, 2)

    def fill(padded: np.ndarray, top: int, left: int, height: int, width: int) -> np.ndarray:
        v = padded[0]
        h, w = v.shape[0] - 2, v.shape[1] - 2
        rows, cols = (np.clip(np.arange(at - 1, at + n + 1), 0, end - 1) % 2 for at, n, end in ((top, h, height), (left, w, width)))
        colour = cfa[rows][:, cols]
        cut = lambda a, dy, dx: a[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        own, kind = cut(v, 0, 0), cut(colour, 0, 0)
        cross = sum(cut(v, *d) for d in ((-1, 0), (1, 0), (0, -1), (0, 1))) / 4
        corners = [(cut(v, a, b), cut(colour, a, b)) for a in (-1, 1) for b in (-1, 1)]
        diagonal = sum(c for c, _ in corners) / 4

        def of(k: int) -> np.ndarray:
            n = sum((kinds == k).astype(float) for _, kinds in corners)
            total = sum(np.where(kinds == k, c, 0) for c, kinds in corners)
            return np.where(n > 0, total / np.maximum(n, 1), own)

        red = np.where(kind == 0, own, np.where(kind == 2, diagonal, of(0)))
        green = np.where(kind == 1, own, cross)
        blue = np.where(kind == 2, own, np.where(kind == 0, diagonal, of(2)))
        return np.stack([red, green, blue])

    return stencil(tiles, 1, 1, fill, size)


# Geometry (K7)

#: Places of an image -> the places that they are drawn from: (x, y, height, width) to (x, y), all as arrays of doubles.
Inverse = Callable[[np.ndarray, np.ndarray, int, int], tuple[np.ndarray, np.ndarray]]
ASKED = "id bigint, ty int, tx int, to_y int, to_x int, asked binary"


def gather(tiles: DataFrame, channels: int, inverse: Inverse, size: int = SIZE) -> DataFrame:
    """Tiles of images of the same sizes whose pixels are drawn from elsewhere, mixed of the four pixels around; 0 where those are not all inside.

    Each tile asks the tiles that its pixels are drawn from for weighted shares of theirs, and adds
    up what comes back: at most four shares a pixel, however far an image is scaled down or turned.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ty, tx, height, width in zip(*(c.to_pylist() for c in batch.columns)):
                h, w = _span(ty, size, height), _span(tx, size, width)
                y, x = np.mgrid[ty * size : ty * size + h, tx * size : tx * size + w].reshape(2, -1).astype(float)
                sx, sy = inverse(x, y, height, width)
                at = np.flatnonzero((sx >= 0) & (sy >= 0) & (sx < width - 1) & (sy < height - 1))
                x0, y0 = np.floor(sx[at]).astype(np.int64), np.floor(sy[at]).astype(np.int64)
                fx, fy = sx[at] - x0, sy[at] - y0
                to, px, py, share = (np.concatenate(p) for p in zip(*[(at, x0 + dx, y0 + dy, (fx if dx else 1 - fx) * (fy if dy else 1 - fy)) for dy in (0, 1) for dx in (0, 1)]))
                tile = (py // size) * (-(-width // size)) + px // size
                spot = (py % size) * np.minimum(size, width - px // size * size) + px % size
                order = np.argsort(tile, kind="stable")
                rows = []
                for own in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
                    if len(own):
                        packed = to[own].astype("<i4").tobytes() + spot[own].astype("<i4").tobytes() + share[own].tobytes()
                        rows.append((i, int(py[own[0]]) // size, int(px[own[0]]) // size, ty, tx, packed))
                kinds = (pa.int64(), *[pa.int32()] * 4, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "ty", "tx", "to_y", "to_x", "asked"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ty, tx, height, width, data, asked in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4, 5, 8))):
                n = len(asked) // 16
                to, spot, share = np.frombuffer(asked, "<i4", n), np.frombuffer(asked, "<i4", n, 4 * n), np.frombuffer(asked, np.float64, n, 8 * n)
                block = _planes(data, channels, _span(ty, size, height), _span(tx, size, width)).reshape(channels, -1)
                places, at = np.unique(to, return_inverse=True)
                sums = np.stack([np.bincount(at, block[k][spot] * share, len(places)) for k in range(channels)])
                out.append(places.astype("<i4").tobytes() + sums.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(6), batch.column(7), batch.column(3), batch.column(4), pa.array(out, pa.binary())], names=NAMES)

    def add_up(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in NAMES[:5]}
        h, w = _span(first["ty"], size, first["height"]), _span(first["tx"], size, first["width"])
        whole = np.zeros((channels, h * w))
        for raw in table.column("data").to_pylist():
            n = len(raw) // (4 + 8 * channels)
            whole[:, np.frombuffer(raw, "<i4", n)] += np.frombuffer(raw, np.float64, n * channels, 4 * n).reshape(channels, n)
        return _table([(*first.values(), whole.tobytes())])

    asked = tiles.select(*NAMES[:5]).mapInArrow(ask, ASKED)
    met = tiles.select(*NAMES).join(asked, ["id", "ty", "tx"]).select(*NAMES, "to_y", "to_x", "asked")
    nothing = tiles.select(*NAMES[:5], F.unhex(F.lit("")).alias("data"))
    # a tile gets four shares a pixel at most
    return met.mapInArrow(answer, TILE).unionByName(nothing).groupBy("id", "ty", "tx").applyInArrow(add_up, TILE)


def warp_matrix(height: int, width: int, rotate: float = 0.0, scale: float = 100.0, aspect: float = 0.0, x_offset: float = 0.0, y_offset: float = 0.0, vertical: float = 0.0, horizontal: float = 0.0) -> np.ndarray:
    """Where a place of the image goes, in homogeneous coordinates about its centre: scaled and stretched, turned (degrees), put into perspective, moved (per cent of the image)."""
    cx, cy = width / 2, height / 2
    wide = 1 + aspect / 100 if aspect >= 0 else 1 / (1 - aspect / 100)
    turn, s = np.radians(rotate), scale / 100
    centre = np.array([[1, 0, cx], [0, 1, cy], [0, 0, 1.0]])
    moved = np.array([[1, 0, x_offset / 100 * width], [0, 1, y_offset / 100 * height], [0, 0, 1.0]])
    view = np.array([[1, 0, 0], [0, 1, 0], [-horizontal / 100_000 * 2000 / width, vertical / 100_000 * 2000 / height, 1.0]])
    turned = np.array([[np.cos(turn), -np.sin(turn), 0], [np.sin(turn), np.cos(turn), 0], [0, 0, 1.0]])
    back = np.array([[1, 0, -cx], [0, 1, -cy], [0, 0, 1.0]])
    return centre @ moved @ view @ turned @ np.diag([s * wide, s, 1.0]) @ back


def warp(tiles: DataFrame, channels: int, size: int = SIZE, **params: float) -> DataFrame:
    """Tiles of warped images; params are those of warp_matrix(). A map that cannot be undone leaves the image as it is."""

    def inverse(x: np.ndarray, y: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        matrix = warp_matrix(height, width, **params)
        back = np.linalg.inv(matrix) if abs(np.linalg.det(matrix)) > 1e-12 else np.eye(3)
        u, v, z = back @ np.stack([x, y, np.ones_like(x)])
        far = np.abs(z) <= 1e-6
        z = np.where(far, 1.0, z)
        return np.where(far, -1.0, u / z), np.where(far, -1.0, v / z)

    return gather(tiles, channels, inverse, size)


def _sizes(pixels: DataFrame) -> DataFrame:
    return pixels.join(pixels.groupBy("id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h")), "id")


def turned(pixels: DataFrame, steps: int) -> DataFrame:
    """Pixel rows turned clockwise by quarters."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "_w", "_h"))
    to = {0: (x, y), 1: (h - 1 - y, x), 2: (w - 1 - x, h - 1 - y), 3: (y, w - 1 - x)}[steps % 4]
    return _sizes(pixels).withColumns({"x": to[0], "y": to[1]}).drop("_w", "_h")


def flipped(pixels: DataFrame, horizontal: bool, vertical: bool) -> DataFrame:
    """Pixel rows mirrored left to right, then top to bottom."""
    to = {"x": F.col("_w") - 1 - F.col("x") if horizontal else F.col("x"), "y": F.col("_h") - 1 - F.col("y") if vertical else F.col("y")}
    return _sizes(pixels).withColumns(to).drop("_w", "_h")


def cropped(pixels: DataFrame, x: float, y: float, width: float, height: float) -> DataFrame:
    """Pixel rows of a part, numbered from 0, as far as it lies inside; an image that has none of it, or a part without an area, is left whole."""
    left, top, wide, high = (int(np.floor(v + 0.5)) for v in (x, y, width, height))
    if wide <= 0 or high <= 0:
        return pixels
    sized = _sizes(pixels).withColumn("_in", (F.lit(left) < F.col("_w")) & (F.lit(top) < F.col("_h")))
    part = (F.col("x") >= left) & (F.col("x") < left + wide) & (F.col("y") >= top) & (F.col("y") < top + high)
    kept = sized.filter(~F.col("_in") | part)
    return kept.withColumns({"x": F.when(F.col("_in"), F.col("x") - left).otherwise(F.col("x")), "y": F.when(F.col("_in"), F.col("y") - top).otherwise(F.col("y"))}).drop("_w", "_h", "_in")


# Masks (K6)


def grow_pixels(width: int, height: int, grow: float) -> int:
    """Pixels by which a strength of -100 to 100 grows a mask (shrinks it, if negative): a hundredth of the shorter side at full strength."""
    return int(np.copysign(np.floor(abs(grow) / 100 * min(width, height) * 0.01 + 0.5), grow))


def feather_sigma(width: int, height: int, feather: float) -> float:
    """The width of the blur for a strength of 0 to 100: half a hundredth of the shorter side at full strength."""
    return max(0.0, feather / 100 * min(width, height) * 0.005)


def grown(tiles: DataFrame, pixels: int, size: int = SIZE) -> DataFrame:
    """Tiles of masks grown by so many pixels: the largest value in the square around each pixel, rows first, then columns; shrunk by a negative number, to the smallest."""
    if not pixels:
        return tiles
    reach, pick = abs(pixels), np.maximum if pixels > 0 else np.minimum

    def step(padded: np.ndarray, *_) -> np.ndarray:
        h, w = padded.shape[1] - 2 * reach, padded.shape[2] - 2 * reach
        rows = pick.reduce([padded[:, :, k : k + w] for k in range(2 * reach + 1)])
        return pick.reduce([rows[:, k : k + h] for k in range(2 * reach + 1)])

    return stencil(tiles, 1, reach, step, size)


def feathered(tiles: DataFrame, sigma: float, size: int = SIZE) -> DataFrame:
    """Tiles of masks blurred by a Gaussian of reach 2 * sigma, edges repeated; a sigma of a hundredth or less changes nothing."""
    if sigma <= 0.01:
        return tiles
    reach = int(np.ceil(2 * sigma))
    taps = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    taps /= taps.sum()

    def step(padded: np.ndarray, *_) -> np.ndarray:
        h, w = padded.shape[1] - 2 * reach, padded.shape[2] - 2 * reach
        rows = sum(t * padded[:, :, k : k + w] for k, t in enumerate(taps))
        return sum(t * rows[:, k : k + h] for k, t in enumerate(taps))

    return stencil(tiles, 1, reach, step, size)
