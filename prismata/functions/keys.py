"""Keys of cached renderings (X7): digests of what each kind of rendering depends on, from the adjustments of an image (a variant).

Two images share a key exactly if the parts named by it are equal, as canonical JSON (objects by
their keys, numbers as written). What a key does not name may change without a new rendering.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Adjustments that move pixels, those of the lens blur, and those that only place the picture.
GEOMETRY = ("transformDistortion", "transformVertical", "transformHorizontal", "transformRotate", "transformAspect", "transformScale", "transformXOffset", "transformYOffset", "lensDistortionAmount", "lensVignetteAmount", "lensTcaAmount", "lensDistortionParams", "lensMaker", "lensModel", "lensDistortionEnabled", "lensTcaEnabled", "lensVignetteEnabled")
BLUR = ("lensBlurAmount", "lensBlurDiffusion", "lensBlurShape", "lensBlurMinDepth", "lensBlurMaxDepth", "lensBlurMinFade", "lensBlurMaxFade", "lensBlurDepthMap")
PLACING = ("crop", "rotation", "orientationSteps", "flipHorizontal", "flipVertical")


def _get(v: Column | str, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _named(v: Column | str, names: tuple[str, ...]) -> list[Column]:
    """'name=JSON' of those that are there."""
    return [F.concat(F.lit(f"{n}="), F.to_json(_get(v, n))) for n in names]


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)  # absent parts are left out


def _blur(v: Column | str) -> list[Column]:
    on = F.coalesce(_get(v, "sectionVisibility.effects", "boolean"), F.lit(True)) & F.coalesce(_get(v, "lensBlurEnabled", "boolean"), F.lit(False))
    return [F.when(on, "blur").otherwise("sharp"), *[F.when(on, c) for c in _named(v, BLUR)]]


def geometry_key(v: Column | str) -> Column:
    """What moves pixels: patches, quarter turns, geometry and lens."""
    steps = F.concat(F.lit("steps="), _get(v, "orientationSteps", "bigint").cast("string"))
    return _digest(*_named(v, ("aiPatches",)), steps, *_named(v, GEOMETRY))


def thumbnail_key(v: Column | str) -> Column:
    """What a thumbnail's base depends on: geometry, and the lens blur if it is on and shown."""
    return _digest(geometry_key(v), *_blur(v))


def visual_key(path: Column, v: Column | str) -> Column:
    """All but geometry and what places the picture."""
    every = F.try_variant_get(v, "$", "map<string, variant>")
    kept = F.map_filter(every, lambda k, _: ~k.isin(*GEOMETRY, *PLACING))
    parts = F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(k, F.lit("="), F.to_json(kept[k])))
    return _digest(F.concat(F.lit("path="), path), F.array_join(parts, "|"))


def transform_key(v: Column | str) -> Column:
    """What the transformed picture depends on: how it is placed, the blur, geometry, and of patches who they are, whether they show, and how large they are."""
    text = lambda x, name: F.coalesce(F.try_variant_get(x, f"$.{name}", "string"), F.lit(""))
    flag = lambda x, name, default: F.coalesce(F.try_variant_get(x, f"$.{name}", "boolean"), F.lit(default)).cast("string")

    def patch(x: Column) -> Column:
        whole = F.try_variant_get(x, "$.patchData", "variant").isNotNull()
        sizes = F.when(whole, F.concat_ws("x", F.octet_length(text(x, "patchData.color")), F.octet_length(text(x, "patchData.mask")))).otherwise(F.octet_length(text(x, "patchDataBase64")).cast("string"))
        return F.concat_ws(":", F.try_variant_get(x, "$.id", "string"), flag(x, "visible", True), sizes, F.to_json(F.try_variant_get(x, "$.subMasks", "variant")), flag(x, "invert", False))

    patches = F.array_join(F.transform(F.try_variant_get(v, "$.aiPatches", "array<variant>"), patch), ",")
    crop = F.to_json(_get(v, "crop"))
    placed = [F.coalesce(_get(v, "orientationSteps", "bigint"), F.lit(0)).cast("string"), F.coalesce(_get(v, "rotation", "double"), F.lit(0.0)).cast("string"), flag(v, "flipHorizontal", False), flag(v, "flipVertical", False)]
    return _digest(*placed, *_blur(v), F.when(crop != "null", F.concat(F.lit("crop="), crop)), *_named(v, GEOMETRY), F.concat(F.lit("patches="), patches))


def job_key(path: Column, v: Column | str) -> Column:
    """Everything."""
    return _digest(F.concat(F.lit("path="), path), F.to_json(v))
