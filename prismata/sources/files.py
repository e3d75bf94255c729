"""File listings, sidecars, XMP, LUT, lens and preset sources, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismata.functions.parse import extension, resize_target
from prismata.session import small_side

# File name extensions of camera raw and raster formats.
RAW_FORMATS = ("dng", "pro", "ari", "crw", "cr2", "cr3", "bay", "raw", "erf", "raf", "3fr", "fff", "iiq", "kdc", "k25", "dcs", "dcr", "mos", "rwl", "mef", "mrw", "nef", "nrw", "orf", "rw2", "pef", "ptx", "srw", "x3f", "arw", "srf", "sr2")
RASTER_FORMATS = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp", "jxl", "exr", "hdr", "tga", "ico", "dds", "qoi", "ff", "pnm", "pbm", "pgm", "ppm", "pam")


def is_raw(path: Column) -> Column:
    return extension(path).isin(*RAW_FORMATS)


def is_supported(path: Column) -> Column:
    return extension(path).isin(*RAW_FORMATS, *RASTER_FORMATS)


def scan_directory(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, file_name, modified_at, size, is_raw) of supported files below root, without dot files; the content column is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select("path", name.alias("file_name"), F.unix_timestamp("modificationTime").alias("modified_at"), F.col("length").alias("size"), is_raw(F.col("path")).alias("is_raw"))
    return rows.filter(is_supported(F.col("path")) & ~F.col("file_name").startswith("."))


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """old with the rows of new put in their place by key; fields that new lacks (null) keep their value."""
    rest = [c for c in old.columns if c not in key]
    o, n = old.select(*key, F.struct(*rest).alias("o")), new.select(*key, F.struct(*rest).alias("n"))
    return o.join(n, list(key), "full").select(*key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in rest])


def mark_missing(old: DataFrame, seen: DataFrame, scope: Column, *key: str) -> DataFrame:
    """old with status 'missing' for rows of the scanned scope that were not seen, 'present' for those that were."""
    marked = old.join(seen.select(*key).distinct().withColumn("seen", F.lit(True)), list(key), "left")
    return marked.withColumn("status", F.when(F.col("seen"), "present").when(scope, "missing").otherwise(F.col("status"))).drop("seen")


SIDECAR = "version INT, rating INT, adjustments VARIANT, tags ARRAY<STRING>, exif MAP<STRING, STRING>"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """One row a sidecar file; a broken file keeps its row with nulls and its text."""
    text = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_sidecars(text)


def parse_sidecars(text: DataFrame) -> DataFrame:
    """(path, version, rating, adjustments, tags, exif, broken) of rows (path, text); absent files have the defaults."""
    fixed = text.withColumn("s", F.from_json("text", "version INT, rating INT, tags ARRAY<STRING>, exif MAP<STRING, STRING>", {"mode": "PERMISSIVE"})).withColumn("v", F.try_parse_json("text"))
    return fixed.select("path", "s.version", F.coalesce("s.rating", F.lit(0)).alias("rating"), F.try_variant_get("v", "$.adjustments", "variant").alias("adjustments"), F.coalesce("s.tags", F.array().cast("array<string>")).alias("tags"), "s.exif", (F.col("text").isNotNull() & F.col("v").isNull()).alias("broken"))


def adjustment(column: str, path: str, kind: str = "double", default: float = 0.0, scale: float = 1.0) -> Column:
    """A typed adjustment with its default and scale."""
    return F.coalesce(F.try_variant_get(column, f"$.{path}", kind), F.lit(default)) / scale


# Geometry with its defaults; lens corrections with their switch, strength (per cent) and parameters with defaults.
GEOMETRY = {"transformDistortion": 0.0, "transformVertical": 0.0, "transformHorizontal": 0.0, "transformRotate": 0.0, "transformAspect": 0.0, "transformScale": 100.0, "transformXOffset": 0.0, "transformYOffset": 0.0}
LENS = {
    "Distortion": {"k1": 0.0, "k2": 0.0, "k3": 0.0},
    "Tca": {"tca_vr": 1.0, "tca_vb": 1.0},
    "Vignette": {"vig_k1": 0.0, "vig_k2": 0.0, "vig_k3": 0.0},
}


def is_edited(column: str, defaults: dict[str, float]) -> Column:
    """Whether an image's adjustments (a variant) show (F14): masks or patches, a crop that is moved, a turn or a mirror, geometry or lens corrections in effect, or any of the plain adjustments off its default.

    What is null or no object is not edited. Adjustments of another type than expected count as absent.
    """
    get = lambda path, kind: F.try_variant_get(column, f"$.{path}", kind)
    number = lambda path, default=0.0: F.coalesce(get(path, "double"), F.lit(default))
    flag = lambda path, default: F.coalesce(get(path, "boolean"), F.lit(default))
    some = lambda path: F.coalesce(F.size(get(path, "array<variant>")) > 0, F.lit(False))
    out = some("aiPatches") | some("masks")
    sides = [get(f"crop.{c}", "double") for c in ("x", "y", "width", "height")]
    out = out | (sum((c.isNotNull().cast("int") for c in sides), F.lit(0)) == 4) & F.coalesce((F.abs(sides[0]) > 0.1) | (F.abs(sides[1]) > 0.1), F.lit(False))
    steps = get("orientationSteps", "bigint")
    out = out | F.coalesce(steps > 0, F.lit(False)) | (F.abs(number("rotation")) > 0.001) | flag("flipHorizontal", False) | flag("flipVertical", False)
    for name, value in GEOMETRY.items():
        out = out | (number(name, value) != value)
    for name, values in LENS.items():
        moved = F.abs(number(f"lens{name}Amount", 100.0) / 100 - 1) >= 1e-4
        for k, value in values.items():
            moved = moved | (F.abs(number(f"lensDistortionParams.{k}", value) - value) >= 1e-6)
        out = out | flag(f"lens{name}Enabled", True) & moved
    for name, value in defaults.items():
        out = out | (adjustment(column, name, default=value) != value)
    return F.coalesce(F.schema_of_variant(column).startswith("OBJECT"), F.lit(False)) & out


def parse_xmp(text: Column) -> Column:
    """(rating, label, tags) of an XMP packet."""
    rating = F.coalesce(F.regexp_extract(text, r'xmp:Rating\s*=\s*"(-?\d+)', 1).try_cast("int"), F.regexp_extract(text, r"<xmp:Rating>\s*(-?\d+)", 1).try_cast("int"))
    label = F.nullif(F.coalesce(F.nullif(F.regexp_extract(text, r'xmp:Label\s*=\s*"([^"]*)"', 1), F.lit("")), F.regexp_extract(text, r"<xmp:Label>([^<]*)<", 1)), F.lit(""))
    bag = F.regexp_extract(text, r"(?s)<dc:subject>(.*?)</dc:subject>", 1)
    return F.struct(rating.alias("rating"), label.alias("label"), F.regexp_extract_all(bag, F.lit(r"<rdf:li[^>]*>([^<]*)</rdf:li>"), F.lit(1)).alias("tags"))


def merge_xmp(rating: Column, tags: Column, xmp: Column) -> Column:
    """(rating, tags): the packet's rating only where there is none yet; the union of the tags."""
    return F.struct(F.when(rating == 0, F.coalesce(xmp["rating"], F.lit(0))).otherwise(rating).alias("rating"), F.array_union(tags, F.coalesce(xmp["tags"], F.array().cast("array<string>"))).alias("tags"))


def xmp_packet(rating: Column, label: Column, tags: Column) -> Column:
    """The text of an XMP packet; a sink writes it."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    items = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("<rdf:li>"), safe(t), F.lit("</rdf:li>"))), "")
    head = F.concat(F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmp:Rating="'), rating.cast("string"), F.lit('" xmp:Label="'), safe(F.coalesce(label, F.lit(""))), F.lit('">'))
    return F.concat(head, F.lit("<dc:subject><rdf:Bag>"), items, F.lit("</rdf:Bag></dc:subject></rdf:Description></rdf:RDF></x:xmpmeta>"))


def parse_cube(lines: DataFrame) -> DataFrame:
    """(path, size, i, r, g, b) of .cube text rows (path, line_number, value): comments and settings are skipped, entries numbered in order."""
    from pyspark.sql import Window

    size = F.max(F.regexp_extract("value", r"^\s*LUT_3D_SIZE\s+(\d+)", 1).try_cast("int")).over(Window.partitionBy("path"))
    nums = F.split(F.trim("value"), r"\s+")
    entries = lines.withColumn("size", size).filter(F.col("value").rlike(r"^\s*-?[\d.]")).filter(F.size(nums) >= 3)
    at = F.row_number().over(Window.partitionBy("path").orderBy("line_number")) - 1
    return entries.select("path", "size", at.alias("i"), *[F.get(nums, k).try_cast("double").alias(c) for k, c in enumerate("rgb")])


def read_lenses(spark: SparkSession, path: str) -> DataFrame:
    """(maker, model, mount, cropfactor, focal, a, b, c): one row for each distortion entry of a lens database."""
    entry = T.StructType([T.StructField(f"_{c}", T.DoubleType()) for c in ("focal", "a", "b", "c", "k1")])
    schema = T.StructType([T.StructField("maker", T.StringType()), T.StructField("model", T.StringType()), T.StructField("mount", T.StringType()), T.StructField("cropfactor", T.DoubleType()), T.StructField("calibration", T.StructType([T.StructField("distortion", T.ArrayType(entry))]))])
    lenses = spark.read.format("xml").option("rowTag", "lens").schema(schema).load(path)
    return lenses.select("maker", "model", "mount", "cropfactor", F.explode_outer("calibration.distortion").alias("d")).select("maker", "model", "mount", "cropfactor", *[F.col(f"d._{c}").alias(c) for c in ("focal", "a", "b", "c")])


def interpolate_lens(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, a, b, c): linear in the focal length between the entries around it, held at the ends (X12). wanted: id, model, focal."""
    j = wanted.select("id", "model", F.col("focal").alias("f")).join(entries, "model")
    point = F.struct("focal", "a", "b", "c")
    near = j.groupBy("id", F.col("f")).agg(F.max_by(point, F.when(F.col("focal") <= F.col("f"), F.col("focal"))).alias("lo"), F.min_by(point, F.when(F.col("focal") >= F.col("f"), F.col("focal"))).alias("hi"), F.min_by(point, "focal").alias("first"), F.max_by(point, "focal").alias("last"))
    low = F.when(F.col("f") <= F.col("first.focal"), F.col("first")).otherwise(F.col("lo"))
    high = F.when(F.col("f") >= F.col("last.focal"), F.col("last")).otherwise(F.col("hi"))
    both = near.select("id", "f", low.alias("lo"), high.alias("hi"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("f") - F.col("lo.focal"), F.col("hi.focal") - F.col("lo.focal")), F.lit(0.0))))
    return both.select("id", *[(F.col(f"lo.{c}") + t * (F.col(f"hi.{c}") - F.col(f"lo.{c}"))).alias(c) for c in "abc"])


# Fixed values of the subsequence score: a matching letter, opening and widening a gap, a letter at the start, after a break, at a change of case, right after another; the first letter counts this many times its bonus.
FUZZY = {"match": 16, "open": -3, "widen": -1, "head": 8, "break": 7, "camel": 6, "next": 4, "first": 3}


def fuzzy_score(text: str, pattern: str) -> int:
    """How well the letters of pattern, in order and without case, are found in text; 0 if they are not."""
    low, want, k = text.lower(), pattern.lower(), FUZZY
    if not want or len(low) != len(text):
        return 0

    def bonus(i: int) -> int:
        if i == 0:
            return k["head"]
        before, here = text[i - 1], text[i]
        return k["break"] if not before.isalnum() else k["camel"] if before.islower() and here.isupper() else 0

    none = -(10**9)
    ends = [none] * len(low)  # the best score with the last letter of pattern at each place
    for j, c in enumerate(want):
        now, gap = [none] * len(low), none
        for i, here in enumerate(low):
            if j and i:
                gap = max(gap + k["widen"], ends[i - 2] + k["open"] if i > 1 else none)
            if here != c:
                continue
            if j == 0:
                now[i] = k["match"] + k["first"] * bonus(i)
            else:
                straight = ends[i - 1] + k["match"] + max(k["next"], bonus(i)) if i else none
                now[i] = max(straight, gap + k["match"] + bonus(i))
        ends = now
    return max(0, *ends)


def match_lenses(wanted: DataFrame, lenses: DataFrame) -> DataFrame:
    """(id, maker, model): the lens whose name fits best: among those of the maker, half the surplus length against it, or else of all. wanted: id, maker, model; no row if none fits.

    The lens table is small; it is joined by maker, and whole only for what is left.
    """

    @F.pandas_udf("int")
    def score(names, models):
        import pandas as pd

        return pd.Series([fuzzy_score(a, b.strip().strip('"')) for a, b in zip(names, models)])

    asked = wanted.select("id", F.lower(F.trim(F.regexp_replace("maker", '"', ""))).alias("key"), F.col("model").alias("asked"))
    known = small_side(lenses.select("maker", "model", F.lower("maker").alias("key")))
    same = asked.join(known, "key").withColumn("score", score("model", "asked"))
    near = same.withColumn("fit", F.col("score") - F.floor(F.greatest(F.length("model") - F.length(F.trim(F.regexp_replace("asked", '"', ""))), F.lit(0)) / 2))
    pick = lambda rows, fit: rows.filter("score > 0").groupBy("id").agg(F.max_by(F.struct("maker", "model"), F.struct(fit, F.col("model"), F.col("maker"))).alias("b")).select("id", "b.*")
    first = pick(near, F.col("fit"))
    letters = lambda c: F.array_distinct(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")), ""))
    left = asked.join(first.select("id"), "id", "left_anti").withColumn("letter", F.get(F.array_sort(F.filter(letters("asked"), lambda x: x != "")), 0))
    by_letter = small_side(lenses.select("maker", "model", F.explode(letters("model")).alias("letter")))  # a lens that fits has every letter of the text
    rest = left.join(by_letter, "letter").withColumn("score", score("model", "asked"))
    return first.unionByName(pick(rest, F.col("score")))


def read_presets(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(presets, failures): files that parse, and the paths and texts of those that do not."""
    text = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = text.withColumn("ok", F.try_parse_json("value").isNotNull())
    return parsed.filter("ok").select("path", F.from_json("value", schema).alias("p")).select("path", "p.*"), parsed.filter("NOT ok").select("path", "value")


def export_plan(rows: DataFrame, base: str, longest: int, format_: str = "jpg") -> DataFrame:
    """(id, target, w, h): output paths that keep folders below base and never leave it, and sizes. rows: id, path, width, height."""
    inside = F.when(F.col("path").startswith(base.rstrip("/") + "/"), F.substring("path", len(base.rstrip("/")) + 2, 1 << 20)).otherwise(F.regexp_extract("path", r"([^/]+)$", 1))
    safe = F.array_join(F.filter(F.split(inside, "/"), lambda p: ~p.isin("", ".", "..")), "/")
    return rows.select("id", F.concat(F.regexp_replace(safe, r"\.[^./]*$", ""), F.lit("." + format_)).alias("target"), resize_target(F.col("width"), F.col("height"), longest).alias("s")).select("id", "target", "s.w", "s.h")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
