"""Column functions over metadata text: numbers, dates, paths, tags and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(text: Column) -> Column:
    """'f/2.8', '50mm', '1/250 s', '3/0' (null), else the first token as a number."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"^f/|mm\b|\s*s$", ""))
    first = F.element_at(F.split(plain, r"\s+"), 1)
    top, bottom = F.element_at(F.split(first, "/"), 1), F.try_element_at(F.split(first, "/"), F.lit(2))
    ratio = F.try_divide(top.try_cast("double"), bottom.try_cast("double"))
    return F.when(first.contains("/"), ratio).otherwise(first.try_cast("double"))


def parse_date(text: Column) -> Column:
    """Seconds of 'Y:m:d H:M:S[.f]' or 'Y-m-d H:M:S[.f]' (T allowed), read as UTC; null otherwise."""
    plain = F.regexp_replace(F.trim(text), "T", " ")
    whole = F.regexp_extract(plain, r"^(\d{4}[:-]\d\d[:-]\d\d \d\d:\d\d:\d\d)(\.\d+)?$", 1)
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(whole, F.lit("yyyy:MM:dd HH:mm:ss"))), F.unix_timestamp(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ss"))))


def first_of(values: Column, *keys: str) -> Column:
    """The first of some keys of a map that is there."""
    return F.coalesce(*[F.try_element_at(values, F.lit(k)) for k in keys])


def tag_kind(tag: Column) -> Column:
    """(name, kind) of a prefixed tag; without a prefix it is a machine tag."""
    kinds = ("user", "color", "person")
    kind, name = F.lit("ai"), tag
    for k in kinds:
        kind = F.when(tag.startswith(k + ":"), k).otherwise(kind)
        name = F.when(tag.startswith(k + ":"), F.substring(tag, len(k) + 2, 1 << 20)).otherwise(name)
    return F.struct(F.trim(name).alias("name"), kind.alias("kind"))


def virtual_path(path: Column) -> Column:
    """(source, copy_id) of '<path>?vc=<copy>'."""
    return F.struct(F.regexp_extract(path, r"^(.*?)(\?vc=(.*))?$", 1).alias("source"), F.regexp_extract(path, r"\?vc=(.*)$", 1).alias("copy_id"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem_before_last_dot(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def file_name_from_template(template: str, name: Column, sequence: Column, total: Column, taken: Column) -> Column:
    """{original_filename} {sequence} {YYYY} {MM} {DD} {hh} {mm}; the sequence is padded to the width of the total. taken: timestamp."""
    out = F.lit(template)
    parts = {"{original_filename}": stem_before_last_dot(name), "{sequence}": F.lpad(sequence.cast("string"), F.length(total.cast("string")), F.lit("0"))}
    parts |= {"{YYYY}": F.date_format(taken, "yyyy"), "{MM}": F.date_format(taken, "MM"), "{DD}": F.date_format(taken, "dd"), "{hh}": F.date_format(taken, "HH"), "{mm}": F.date_format(taken, "mm")}
    for key, value in parts.items():
        out = F.replace(out, F.lit(key), value)
    return out


def resize_target(width: Column, height: Column, longest: int) -> Column:
    """(w, h) scaled so that the longer side is at most longest; never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct(F.greatest(F.round(width * scale), F.lit(1)).cast("int").alias("w"), F.greatest(F.round(height * scale), F.lit(1)).cast("int").alias("h"))


def demosaic_for_iso(iso: Column) -> Column:
    """The demosaicing method for a sensitivity; the last two suit noise."""
    return F.when(iso >= 1600, "lmmse").when(iso >= 800, "igv").when(iso.isNotNull(), "amaze")


def denoise_for_iso(iso: Column) -> Column:
    """Strength of denoising, 0 to 1; null if the sensitivity is unknown."""
    return F.when(iso.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (iso - 100.0) / 6300.0)))


def lens_specification(values: Column) -> Column:
    """'24-70 mm, f/2.8' from (numerator, denominator) structs n, d: shortest and longest focal length, and the widest aperture at each.

    Null with fewer than four values or without both focal lengths; the aperture is left out if it is unknown.
    """
    at = lambda i: F.try_divide(F.get(values, F.lit(i))["n"].cast("float"), F.get(values, F.lit(i))["d"].cast("float")).cast("float")
    plain = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    span = lambda a, b: F.when(F.abs(a - b) < 0.01, plain(a)).otherwise(F.concat(plain(a), F.lit("-"), plain(b)))
    focal, aperture = span(at(0), at(1)), span(at(2), at(3))
    return F.when((F.size(values) >= 4) & focal.isNotNull(), F.concat(focal, F.lit(" mm"), F.coalesce(F.concat(F.lit(", f/"), aperture), F.lit(""))))


def normalized(vector: Column) -> Column:
    """Unit vector; null for zero or non-finite vectors."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(vector, lambda x: x.cast("double") / norm))


def dot(a: Column, b: Column) -> Column:
    """Inner product; -1 for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(-1.0))
