"""Camera metadata from the bytes of files (S7): directories of entries, followed in one projection.

A TIFF structure is a header with a byte order, and directories of 12-byte entries; small values
stand in their entry, larger ones at an offset, and further directories (camera, position) are
named by entries. Everything is read by column functions on the file's bytes: a directory
becomes an array of entries, entries point into the same column, and the bytes are dropped before any
entry becomes a row. So nothing moves, and no row is copied with its file.

A file without the structure, an offset beyond the end, a count that cannot be, or a text that
is none give nulls. JPEG files are read from their Exif segment on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF and Exif formats: bytes of a value of each type, and tags.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
TAGS = {0x010F: "Make", 0x0110: "Model", 0x0132: "DateTime", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "PhotographicSensitivity", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9204: "ExposureBiasValue", 0x920A: "FocalLength", 0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel"}
CAMERA, POSITION = 0x8769, 0x8825
#: Entries of a directory, and bytes of a value, beyond which a file is taken for broken.
ENTRIES, VALUE = 1000, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number(data: Column, at: Column, size: int, little: Column) -> Column:
    """The unsigned number of 2 or 4 bytes at an offset; null beyond the end."""
    digits = F.hex(F.substring(data, F.least(at + 1, F.lit(_FAR)).cast("int"), F.lit(size)))
    return let(digits, lambda h: F.when(F.length(h) == 2 * size, F.conv(F.when(little, swapped(h)).otherwise(h), 16, 10).cast("bigint")))


_FAR = (1 << 31) - 1


def swapped(digits: Column) -> Column:
    """Hexadecimal digits with their bytes in reverse order."""
    return F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")


def entries(data: Column, at: Column, little: Column, part: str) -> Column:
    """The directory at an offset: an array of (part, tag, type, count, value), value being its bytes; null if there is no directory."""
    size_of = F.create_map(*[F.lit(x) for pair in SIZES.items() for x in pair])
    head = lambda k: F.struct((at + 2 + 12 * k).alias("start"), number(data, at + 2 + 12 * k, 2, little).cast("int").alias("tag"), number(data, at + 4 + 12 * k, 2, little).cast("int").alias("type"), number(data, at + 6 + 12 * k, 4, little).alias("count"))

    def value(e: Column) -> Column:
        spot = F.struct((F.try_element_at(size_of, e["type"]) * e["count"]).alias("size"), (e["start"] + 8).alias("inline"), number(data, e["start"] + 8, 4, little).alias("far"))
        bytes_ = let(spot, lambda q: F.when(q["size"] <= VALUE, let(F.substring(data, F.least(F.when(q["size"] <= 4, q["inline"]).otherwise(q["far"]) + 1, F.lit(_FAR)).cast("int"), q["size"].cast("int")), lambda v: F.when(F.octet_length(v) == q["size"], v))))
        return F.struct(F.lit(part).alias("part"), e["tag"].alias("tag"), e["type"].alias("type"), e["count"].alias("count"), bytes_.alias("value"))

    spots = let(number(data, at, 2, little), lambda n: F.when((n > 0) & (n <= ENTRIES) & (at + 2 + 12 * n <= F.octet_length(data)), F.sequence(F.lit(0), (n - 1).cast("int"))))
    return F.transform(F.transform(spots, head), value)


def _pointer(directory: Column, tag: int, little: Column) -> Column:
    return number(F.get(F.filter(directory, lambda e: e["tag"] == tag), F.lit(0))["value"], F.lit(0), 4, little)


def read_directories(files: DataFrame, content: str = "content") -> DataFrame:
    """files without their content, with little (byte order; null: no structure) and entries: those of the main, the camera's and the position's directory (part, tag, type, count, value)."""
    raw, data, little = F.col(content), F.col("tiff"), F.col("little")
    segment = F.locate("457869660000", F.hex(F.substring(raw, 1, 65536)))  # 'Exif' and two zeros
    is_jpeg = F.hex(F.substring(raw, 1, 2)) == "FFD8"
    body = F.when(is_jpeg, let(segment, lambda at: F.when(at % 2 == 1, F.substring(raw, F.floor(at / 2 + 7).cast("int"), F.octet_length(raw))))).otherwise(raw)
    rows = files.withColumn("tiff", body)
    head = F.hex(F.substring(data, 1, 4))
    rows = rows.withColumn("little", let(head, lambda h: F.when(h == "49492A00", True).when(h == "4D4D002A", False)))
    rows = rows.withColumn("main", entries(data, F.when(little.isNotNull(), number(data, F.lit(4), 4, little)), little, "main"))
    for name, tag in (("camera", CAMERA), ("position", POSITION)):
        rows = rows.withColumn(f"{name}_at", _pointer(F.col("main"), tag, little)).withColumn(name, entries(data, F.col(f"{name}_at"), little, name))
    nothing = F.array().cast(rows.schema["main"].dataType)
    found = F.concat(*[F.coalesce(c, nothing) for c in ("main", "camera", "position")])
    return rows.withColumn("entries", found).drop("tiff", "main", "camera", "position", "camera_at", "position_at", content)


def text_of(entry: Column) -> Column:
    """The text of an entry, up to its first zero byte, without white space around it; null if it is none."""
    plain = F.when(entry["type"] == 2, F.trim(F.regexp_replace(F.decode(entry["value"], "ISO-8859-1"), "\\x00[\\s\\S]*$", "")))
    return let(plain, lambda t: F.when(t != "", t))


def values_of(entry: Column, little: Column) -> Column:
    """The numbers of an entry as (top, bottom), bottom being 1 but for rationals; null for texts and other types."""
    v, kind = entry["value"], entry["type"]
    signed = lambda x: let(x, lambda y: F.when(y >= 1 << 31, y - (1 << 32)).otherwise(y))
    of = lambda top, bottom=F.lit(1).cast("bigint"): F.struct(top.alias("top"), bottom.alias("bottom"))
    places = F.when((entry["count"] > 0) & v.isNotNull(), F.sequence(F.lit(0), (entry["count"] - 1).cast("int")))
    at = lambda k, width, more=0: number(v, k * width + more, min(width, 4), little)
    forms = {3: lambda k: of(at(k, 2)), 4: lambda k: of(at(k, 4)), 9: lambda k: of(signed(at(k, 4))), 5: lambda k: of(at(k, 8), at(k, 8, 4)), 10: lambda k: of(signed(at(k, 8)), signed(at(k, 8, 4)))}
    out = F
    for t, form in forms.items():
        out = out.when(kind == t, F.transform(places, form))
    return out


def quotient(pair: Column) -> Column:
    """A number in single precision; null over 0."""
    single = lambda x: x.cast("float").cast("double")
    return F.try_divide(single(pair["top"]), single(pair["bottom"])).cast("float").cast("double")


def shown(x: Column) -> Column:
    """A number as it is shown: the shortest decimals of its single-precision value, none for a whole number."""
    plain = F.when((F.abs(x) >= 0.001) & (F.abs(x) < 1e7), x.cast("float").cast("string")).otherwise(x.cast("decimal(30,12)").cast("string"))
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def metadata(files: DataFrame, content: str = "content") -> DataFrame:
    """files without their content, with the fields that the list view shows: texts, null where the file has none."""
    rows = read_directories(files, content)
    asked = F.array(*map(F.lit, TAGS))
    told = F.transform(F.filter("entries", lambda e: (e["part"] != "position") & F.array_contains(asked, e["tag"])), lambda e: F.struct(e["tag"].alias("tag"), e["type"].alias("type"), text_of(e).alias("text"), values_of(e, F.col("little")).alias("pairs")))
    rows = rows.withColumn("told", told)
    first = lambda tag: F.get(F.filter("told", lambda e: e["tag"] == tag), F.lit(0))
    for tag, name in TAGS.items():
        rows = rows.withColumn(f"_{name}", first(tag))
    text = lambda name: F.col(f"_{name}")["text"]
    kinds = {"ShutterSpeedValue": (10,), "PhotographicSensitivity": (3, 4)}  # other fields are unsigned ratios, or they are not read
    pair = lambda name, k=0: F.when(F.col(f"_{name}")["type"].isin(*kinds.get(name, (5,))), F.get(F.col(f"_{name}")["pairs"], F.lit(k)))
    one = lambda name, form: let(quotient(pair(name)), form)
    # a time of one over a whole number is shown as it is stored
    time = let(pair("ExposureTime"), lambda p: F.when((p["top"] == 1) & (p["bottom"] > 1), F.concat(F.lit("1/"), p["bottom"].cast("string"), F.lit(" s"))).otherwise(let(quotient(p), lambda t: F.when((t > 0) & (t < 1), F.concat(F.lit("1/"), F.round(1 / t).cast("bigint").cast("string"), F.lit(" s"))).otherwise(F.concat(shown(t), F.lit(" s"))))))
    date = lambda name: F.regexp_replace(text(name), r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")
    lens = F.array(*[quotient(pair("LensSpecification", k)) for k in range(4)])
    span = lambda a, b: F.when(F.abs(a - b) < 0.01, shown(a)).otherwise(F.concat(shown(a), F.lit("-"), shown(b)))
    fields = {
        "Make": text("Make"),
        "Model": text("Model"),
        "LensMake": text("LensMake"),
        "LensModel": text("LensModel"),
        "ExposureTime": time,
        "FNumber": one("FNumber", lambda x: F.concat(F.lit("f/"), shown(x))),
        "ApertureValue": one("ApertureValue", lambda x: F.concat(F.lit("f/"), shown(x))),
        "ShutterSpeedValue": one("ShutterSpeedValue", shown),
        "FocalLength": one("FocalLength", shown),
        "FocalLengthIn35mmFilm": one("FocalLength", shown),
        "PhotographicSensitivity": pair("PhotographicSensitivity")["top"].cast("string"),
        "ISOSpeed": pair("PhotographicSensitivity")["top"].cast("string"),
        "DateTimeOriginal": date("DateTimeOriginal"),
        "CreateDate": date("DateTime"),
        "ModifyDate": date("DateTimeDigitized"),
        "LensSpecification": let(lens, lambda v: F.when((v[2] > 0) | (v[3] > 0), F.concat(span(v[0], v[1]), F.lit(" mm, f/"), span(v[2], v[3]))).otherwise(F.concat(span(v[0], v[1]), F.lit(" mm")))),
    }
    return rows.select(*[c for c in rows.columns if c not in ("entries", "little", "told") and c[0] != "_"], *[c.alias(name) for name, c in fields.items()])


# Writing, for sidecars and tests: the same structure from columns, as hexadecimal digits.


def packed(value: Column | int, size: int, little: Column) -> Column:
    """A number as the digits of its bytes."""
    if isinstance(value, int):
        return F.when(little, value.to_bytes(size, "little").hex().upper()).otherwise(value.to_bytes(size, "big").hex().upper())
    return let(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"), lambda h: F.when(little, swapped(h)).otherwise(h))


def directory(items: list[tuple[int, int, int, int, Column]], at: int, little: Column) -> tuple[Column, int]:
    """The digits of a directory that will stand at an offset, and where it ends. items: tag, type, count, size and digits of the value, in rising order of tags; a value of up to four bytes is filled up."""
    rest, parts, tail = at + 2 + 12 * len(items) + 4, [packed(len(items), 2, little)], []
    for tag, kind, count, size, value in items:
        parts += [packed(tag, 2, little), packed(kind, 2, little), packed(count, 4, little), F.rpad(value, 8, "0") if size <= 4 else packed(rest, 4, little)]
        if size > 4:
            tail.append(value)
            rest += size
    return F.concat(*parts, packed(0, 4, little), *tail), rest
