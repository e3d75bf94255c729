"""Conversion of foreign presets (S15): attributes and curves of XMP texts, joined with a table of targets and scales.

A preset's attributes become rows, the table says what each is here (target, factor, bounds);
it is data, so a new attribute is a new row. Attributes that the table knows but that hold no
number are listed by unread(), and convert nothing. Of an attribute that a text gives twice the
last counts. Null texts have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names in the foreign format and here.
PLAIN = {
    "Exposure2012": "exposure",
    "Contrast2012": "contrast",
    "Highlights2012": "highlights",
    "Whites2012": "whites",
    "Blacks2012": "blacks",
    "Clarity2012": "clarity",
    "Dehaze": "dehaze",
    "Vibrance": "vibrance",
    "Saturation": "saturation",
    "Texture": "structure",
    "SharpenRadius": "sharpenRadius",
    "SharpenDetail": "sharpenDetail",
    "SharpenEdgeMasking": "sharpenMasking",
    "LuminanceSmoothing": "lumaNoiseReduction",
    "ColorNoiseReduction": "colorNoiseReduction",
    "ColorNoiseReductionDetail": "colorNoiseDetail",
    "ColorNoiseReductionSmoothness": "colorNoiseSmoothness",
    "ChromaticAberrationRedCyan": "chromaticAberrationRedCyan",
    "ChromaticAberrationBlueYellow": "chromaticAberrationBlueYellow",
    "PostCropVignetteAmount": "vignetteAmount",
    "PostCropVignetteMidpoint": "vignetteMidpoint",
    "PostCropVignetteFeather": "vignetteFeather",
    "PostCropVignetteRoundness": "vignetteRoundness",
    "GrainAmount": "grainAmount",
    "GrainSize": "grainSize",
    "GrainFrequency": "grainRoughness",
    "ColorGradeBlending": "colorGrading.blending",
    "SplitToningBalance": "colorGrading.balance",
    "SplitToningShadowHue": "colorGrading.shadows.hue",
    "SplitToningShadowSaturation": "colorGrading.shadows.saturation",
    "ColorGradeShadowLum": "colorGrading.shadows.luminance",
    "ColorGradeMidtoneHue": "colorGrading.midtones.hue",
    "ColorGradeMidtoneSat": "colorGrading.midtones.saturation",
    "ColorGradeMidtoneLum": "colorGrading.midtones.luminance",
    "SplitToningHighlightHue": "colorGrading.highlights.hue",
    "SplitToningHighlightSaturation": "colorGrading.highlights.saturation",
    "ColorGradeHighlightLum": "colorGrading.highlights.luminance",
    "ColorGradeGlobalHue": "colorGrading.global.hue",
    "ColorGradeGlobalSat": "colorGrading.global.saturation",
    "ColorGradeGlobalLum": "colorGrading.global.luminance",
}
COLOURS = {"Red": "reds", "Orange": "oranges", "Yellow": "yellows", "Green": "greens", "Aqua": "aquas", "Blue": "blues", "Purple": "purples", "Magenta": "magentas"}
CURVES = {"ToneCurvePV2012": "luma", "ToneCurvePV2012Red": "red", "ToneCurvePV2012Green": "green", "ToneCurvePV2012Blue": "blue"}
#: Attribute -> target, factor, lower and upper bound.
SCALED = {"Shadows2012": ("shadows", 1.5, None, 100.0), "Sharpness": ("sharpness", 100 / 150, 0.0, 100.0), "Tint": ("tint", 100 / 150, -100.0, 100.0)}
#: A colour temperature is a shift against that of the shot, in millionths of its inverse, of which MIRED are all.
WARMTH, SHOT, AS_SHOT, MIRED = "Temperature", "AsShotTemperature", 5500.0, 150.0
UNNAMED = "Imported Preset"


def targets() -> list[tuple[str, str, float, float | None, float | None]]:
    """The table: attribute, target, factor, low, high."""
    rows = [(a, t, 1.0, None, None) for a, t in PLAIN.items()] + [(a, *v) for a, v in SCALED.items()]
    for theirs, ours in COLOURS.items():
        rows += [(f"HueAdjustment{theirs}", f"hsl.{ours}.hue", 0.75, None, None), (f"SaturationAdjustment{theirs}", f"hsl.{ours}.saturation", 1.0, None, None), (f"LuminanceAdjustment{theirs}", f"hsl.{ours}.luminance", 1.0, None, None)]
    return rows


def attributes(texts: DataFrame) -> DataFrame:
    """(path, attribute, raw) of texts (path, value)."""
    found = F.regexp_extract_all("value", F.lit(r'crs:([A-Za-z0-9]+="[^"]*")'), 1)
    each = texts.select("path", F.posexplode(found).alias("k", "a")).select("path", "k", F.substring_index("a", '="', 1).alias("attribute"), F.regexp_extract("a", r'="([^"]*)"$', 1).alias("raw"))
    return each.groupBy("path", "attribute").agg(F.max_by("raw", "k").alias("raw"))


def number_of(raw: Column) -> Column:
    """A number with or without signs before it; null for anything else."""
    plain = F.regexp_replace(raw, r"^\++", "")
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))


def _known(texts: DataFrame) -> DataFrame:
    table = texts.sparkSession.createDataFrame(targets(), "attribute string, target string, factor double, low double, high double")
    return attributes(texts).join(F.broadcast(table), "attribute").withColumn("number", number_of(F.col("raw")))  # about seventy rows


def unread(texts: DataFrame) -> DataFrame:
    """(path, attribute, raw): known attributes without a number."""
    return _known(texts).filter("number IS NULL").select("path", "attribute", "raw")


def adjustments(texts: DataFrame) -> DataFrame:
    """(path, target, value): what the presets' numbers are here."""
    scaled = F.col("number") * F.col("factor")
    bounded = F.greatest(F.least(scaled, F.coalesce("high", scaled)), F.coalesce("low", F.least(scaled, F.coalesce("high", scaled))))
    plain = _known(texts).filter("number IS NOT NULL").select("path", "target", bounded.alias("value"))
    heat = attributes(texts).filter(F.col("attribute").isin(WARMTH, SHOT)).groupBy("path").agg(*[F.max(F.when(F.col("attribute") == a, number_of(F.col("raw")))).alias(n) for a, n in ((WARMTH, "to"), (SHOT, "shot"))])
    shift = (1_000_000 / F.coalesce("shot", F.lit(AS_SHOT)) - 1_000_000 / F.col("to")) / MIRED * 100
    warm = heat.filter("to != 0 AND (shot IS NULL OR shot != 0)").select("path", F.lit("temperature").alias("target"), F.greatest(F.lit(-100.0), F.least(F.lit(100.0), shift)).alias("value"))
    return plain.unionByName(warm)


def curves(texts: DataFrame) -> DataFrame:
    """(path, curve, place, x, y): points of the tone curves, places from 0. Of the brightness curve, what lifts the shadows is damped: by a fifth at black, not at all from 64 on."""
    parts = []
    for theirs, ours in CURVES.items():
        body = F.regexp_extract("value", rf"(?s)<crs:{theirs}>\s*<rdf:Seq>(.*?)</rdf:Seq>\s*</crs:{theirs}>", 1)
        points = F.regexp_extract_all(body, F.lit(r"<rdf:li>(\d{1,9},\s*\d{1,9})</rdf:li>"), 1)
        parts.append(F.struct(F.lit(ours).alias("curve"), points.alias("points")))
    each = texts.select("path", F.explode(F.array(*parts)).alias("c")).select("path", "c.curve", F.posexplode("c.points").alias("place", "p"))
    pair = F.split("p", r",\s*")
    rows = each.select("path", "curve", "place", pair[0].cast("int").alias("x"), pair[1].cast("int").alias("y"))
    lifted = F.col("x") + (F.col("y") - F.col("x")) * (0.8 + 0.2 * F.col("x") / 64)
    damped = F.greatest(F.lit(0), F.least(F.lit(255), F.round(lifted).cast("int")))
    return rows.withColumn("y", F.when((F.col("curve") == "luma") & (F.col("y") > F.col("x")) & (F.col("x") < 64), damped).otherwise(F.col("y")))


def names(texts: DataFrame) -> DataFrame:
    """(path, name) of the presets."""
    own = F.trim(F.regexp_extract("value", r"(?s)<crs:Name>.*?<rdf:Alt>.*?<rdf:li[^>]*>([^<]+)</rdf:li>.*?</crs:Name>", 1))
    return texts.select("path", F.when(own != "", own).otherwise(UNNAMED).alias("name"))
