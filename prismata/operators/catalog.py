"""Catalog base view, structured search, scopes and lookups.

Text comparison folds case by Unicode; user text is matched literally (no LIKE wildcards).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismata.functions import parse

#: Names of people, and of exclusions, that a query honours.
MAX_NAMES = 12
MAX_ROWS = 20_000
#: The last second (of the year 2099) that a date of a query may name.
LAST_DATE = 4_102_444_800


def base_view(images: DataFrame, roots: DataFrame, versions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Present images with their root, original version and, if any, metadata."""
    own = versions.filter("copy_id = ''").drop("copy_id")
    root = roots.select(F.col("id").alias("root_id"), "absolute_path")
    return images.filter("status = 'present'").join(root, "root_id").join(own, images["id"] == own["image_id"]).drop("image_id").join(metadata.withColumnRenamed("image_id", "id"), "id", "left")


@dataclass
class CatalogQuery:
    """Every field is optional; those given are joined by AND."""

    root_id: int | None = None
    folder: str | None = None
    recursive: bool = True
    rating: int | None = None
    min_rating: int | None = None
    year: int | None = None
    date_from: int | None = None
    date_to: int | None = None
    is_raw: bool | None = None
    is_edited: bool | None = None
    color: str | None = None
    lens: str | None = None
    camera: str | None = None
    text: str | None = None
    tags: list[str] = field(default_factory=list)
    ai_tags: list[str] = field(default_factory=list)
    tag_mode: str = "AND"
    people: list[str] = field(default_factory=list)
    exclude_tags: list[str] = field(default_factory=list)
    exclude_ai_tags: list[str] = field(default_factory=list)
    exclude_people: list[str] = field(default_factory=list)
    limit: int | None = None

    @classmethod
    def of_json(cls, text: str) -> CatalogQuery:
        """A stored query: camelCase names; fields that it does not know are ignored, anything but an object is an error."""
        stored = json.loads(text)
        if not isinstance(stored, dict):
            raise ValueError("a stored query is a JSON object")
        own = {"rootId": "root_id", "minRating": "min_rating", "tagMode": "tag_mode", "aiTags": "ai_tags", "excludedPeople": "exclude_people", "excludedTags": "exclude_tags", "excludedAiTags": "exclude_ai_tags", "dateFrom": "date_from", "dateTo": "date_to", "isRaw": "is_raw", "isEdited": "is_edited"}
        known = {own.get(k, k): v for k, v in stored.items() if v is not None}
        if known.get("person") and not known.get("people"):
            known["people"] = [known["person"]]
        return cls(**{k: v for k, v in known.items() if k in cls.__dataclass_fields__})

    def sanitized(self) -> CatalogQuery:
        """What a generated query may ask: known ranges, trimmed and bounded texts, dates in order; never a scope of its own."""
        within = lambda v, low, high: v if v is not None and low <= v <= high else None
        short = lambda v, n: (v or "").strip()[:n] or None
        names = lambda vs, n: [t for t in ((v or "").strip()[:n] for v in vs) if t][:MAX_NAMES]
        people = self.people
        if len(people) == 1:  # "A and B" names two
            people = [p for p in re.split(r",| and | & ", people[0]) if p.strip()]
        dates = sorted(d for d in (within(self.date_from, 0, LAST_DATE), within(self.date_to, 0, LAST_DATE)) if d is not None)
        first, last = dates if len(dates) == 2 else (within(self.date_from, 0, LAST_DATE), within(self.date_to, 0, LAST_DATE))
        return CatalogQuery(
            rating=within(self.rating, 0, 5), min_rating=within(self.min_rating, 0, 5), year=within(self.year, 1900, 2100), date_from=first, date_to=last, is_raw=self.is_raw, is_edited=self.is_edited,
            color=short(self.color, 32), lens=short(self.lens, 120), camera=short(self.camera, 120), text=short(self.text, 200), tags=names(self.tags, 80), ai_tags=names(self.ai_tags, 80), tag_mode=self.tag_mode if self.tag_mode in ("AND", "OR") else "AND",
            people=names(people, 120), exclude_tags=names(self.exclude_tags, 120), exclude_ai_tags=names(self.exclude_ai_tags, 120), exclude_people=names(self.exclude_people, 120), limit=MAX_ROWS,
        )


def has(column: Column, text: str) -> Column:
    return F.lower(F.coalesce(column, F.lit(""))).contains(text.lower())


def folder_scope(path: Column, folder: str, recursive: bool = True) -> Column:
    """Paths below a folder, or directly in it; '' is the root."""
    inside = path.startswith(folder.rstrip("/") + "/") if folder else F.lit(True)
    return inside if recursive else F.regexp_replace(path, r"/?[^/]*$", "") == folder.rstrip("/")


def _conjuncts(q: CatalogQuery) -> Column:
    date = F.coalesce("date_taken", "modified_at")
    rules = [
        (q.root_id, lambda v: F.col("root_id") == v),
        (q.rating, lambda v: F.col("rating") == v),
        (q.min_rating, lambda v: F.col("rating") >= v),
        (q.year, lambda v: F.col("year") == v),
        (q.date_from, lambda v: date >= v),
        (q.date_to, lambda v: date <= v),
        (q.is_raw, lambda v: F.col("is_raw") == v),
        (q.is_edited, lambda v: F.col("is_edited") == v),
        (q.color, lambda v: F.lower("color_label") == v.lower()),
        (q.lens, lambda v: has(F.col("lens"), v)),
        (q.camera, lambda v: has(F.concat_ws(" ", "camera_make", "camera_model"), v)),
        (q.folder, lambda v: folder_scope(F.col("relative_path"), v, q.recursive)),
        (q.text, lambda v: has(F.concat_ws("\n", "file_name", "relative_path", "title", "camera_make", "camera_model", "lens", "color_label"), v)),
    ]
    out = F.lit(True)
    for value, rule in rules:
        if value is not None:
            out = out & rule(value)
    return out


def _named(rows: DataFrame, names: list[str], every: bool) -> DataFrame:
    """(id): images with a row whose name contains any, or for each one, of names. One aggregation, whatever the number of names."""
    hits = [F.max(has(F.col("name"), n)) for n in names]
    found = rows.filter(_any([has(F.col("name"), n) for n in names])).groupBy(F.col("image_id").alias("id"))
    flags = found.agg(*[h.alias(f"h{i}") for i, h in enumerate(hits)])
    ok = F.lit(True)
    for i in range(len(names)):
        ok = ok & F.col(f"h{i}")
    return (flags.filter(ok) if every else flags).select("id")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def person_images(image_tags: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """(image_id, name): person tags and confirmed faces of active people."""
    seen = faces.filter("review_state = 'confirmed'").join(people.filter("state = 'active'"), faces["person_id"] == people["id"]).select("image_id", F.col("display_name").alias("name"))
    return image_tags.filter("kind = 'person'").select("image_id", "name").unionAll(seen)


def search(view: DataFrame, q: CatalogQuery, image_tags: DataFrame, ai_tags: DataFrame, people: DataFrame) -> DataFrame:
    """Rows of the base view that match, newest first, then by path. people: (image_id, name)."""
    out = view.filter(_conjuncts(q))
    live = ai_tags.filter("review_state != 'rejected'")
    every = q.tag_mode.upper() != "OR"
    for rows, names, mode in ((image_tags, q.tags, every), (live, q.ai_tags, every), (people, q.people[:MAX_NAMES], True)):
        if names:
            out = out.join(_named(rows, names, mode), "id", "left_semi")
    for rows, names in ((image_tags, q.exclude_tags), (live, q.exclude_ai_tags), (people, q.exclude_people)):
        if names:
            out = out.join(_named(rows, names[:MAX_NAMES], False), "id", "left_anti")
    out = out.withColumn("date", F.coalesce("date_taken", "modified_at")).orderBy(F.desc("date"), F.lower("relative_path"), "id")
    return out if q.limit is None else out.limit(max(1, min(q.limit, MAX_ROWS)))


def resolve_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root_id, relative): the longest root that is a prefix of each path.

    Every prefix of a path is looked up by equality, so nothing is compared all against all.
    """
    steps = F.split("path", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    each = paths.select("path", F.explode(prefix).alias("absolute_path"))
    best = each.join(roots.select(F.col("id").alias("root_id"), "absolute_path"), "absolute_path").groupBy("path").agg(F.max_by("root_id", F.length("absolute_path")).alias("root_id"), F.max(F.length("absolute_path")).alias("n"))
    return best.select("path", "root_id", F.expr("substring(path, n + 2)").alias("relative"))


def companions(faces: DataFrame, images: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(face_id, companion_id): faces of other images of the same folder and stem (its case counts) at about the same place.

    A stem with very many faces would meet in one task: places are cut into cells twice as wide
    as the tolerance, and each face also looks into the next cell on each side.
    """
    placed = faces.join(images.select(F.col("id").alias("image_id"), "folder_id", F.substring_index("file_name", ".", 1).alias("stem")), "image_id")
    cell = F.floor(F.col("bbox_x") / (2 * tolerance)).cast("bigint")
    side = lambda p, x: placed.select(F.col("id").alias(f"{p}_id"), F.col("image_id").alias(f"{p}_image"), "folder_id", "stem", F.col("bbox_x").alias(f"{p}_x"), F.col("bbox_y").alias(f"{p}_y"), x.alias("cell"))
    a, b = side("a", cell), side("b", F.explode(F.array(cell - 1, cell, cell + 1)))
    both = a.join(b, ["folder_id", "stem", "cell"]).filter("a_image != b_image")
    near = (F.abs(F.col("a_x") - F.col("b_x")) < tolerance) & (F.abs(F.col("a_y") - F.col("b_y")) < tolerance)
    return both.filter(near).select(F.col("a_id").alias("face_id"), F.col("b_id").alias("companion_id"))


def pending(images: DataFrame, analysis: DataFrame, kind: str) -> DataFrame:
    """Present images without a completed analysis of this kind at their present time of change."""
    done = analysis.filter((F.col("analysis_kind") == kind) & (F.col("state") == "completed")).select(F.col("image_id").alias("id"), F.col("image_modified_at").alias("modified_at"))
    return images.filter("status = 'present'").join(done, ["id", "modified_at"], "left_anti")


def distinct_faces(faces: DataFrame, images: DataFrame) -> DataFrame:
    """Unreviewed faces, one for each folder, stem and place (two decimals): the most confident, then the first."""
    placed = faces.filter("review_state = 'unreviewed'").join(images.filter("status = 'present'").select(F.col("id").alias("image_id"), "folder_id", "file_name"), "image_id")
    key = Window.partitionBy("folder_id", F.substring_index("file_name", ".", 1), F.round("bbox_x", 2), F.round("bbox_y", 2)).orderBy(F.desc("confidence"), "id")
    return placed.withColumn("rn", F.row_number().over(key)).filter("rn = 1").drop("rn")


def provenance(images: DataFrame, roots: DataFrame, versions: DataFrame, metadata: DataFrame, ai_tags: DataFrame, faces: DataFrame, species: DataFrame, errors: DataFrame) -> DataFrame:
    """What is known of each image and from where (F15, Q23): id, path, camera, lens, year, rating, and as arrays its machine tags, faces and species, each in the order in which they are shown, and the messages of failed analyses.

    Each part is gathered by image before it is joined, so parts do not multiply; filter images
    for those that are asked for. errors: image_id, message. Equal ranks go by id.
    """
    own = images.select("id", "root_id", "relative_path").join(roots.select(F.col("id").alias("root_id"), "absolute_path"), "root_id")
    about = metadata.select(F.col("image_id").alias("id"), F.when(F.coalesce("camera_make", "camera_model").isNotNull(), F.concat_ws(" ", "camera_make", "camera_model")).alias("camera"), "lens", "year")
    stars = versions.filter("copy_id = ''").select(F.col("image_id").alias("id"), "rating")

    def part(rows: DataFrame, name: str, columns: tuple[str, ...], *order) -> DataFrame:
        item = F.struct(*order, F.struct(*columns).alias("item"))
        return rows.groupBy(F.col("image_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias(name))

    down = -F.col("confidence")
    state = F.when(F.col("review_state") == "accepted", 0).when(F.col("review_state") == "suggested", 1).otherwise(2)
    parts = [
        part(ai_tags, "ai_tags", ("id", "name", "confidence", "review_state", "model_id"), down.alias("a"), F.col("id").alias("b")),
        part(faces, "faces", ("id", "person_id", "confidence", "bbox_x", "bbox_y", "bbox_width", "bbox_height", "review_state"), down.alias("a"), F.col("id").alias("b")),
        part(species, "species", ("id", "scientific_name", "common_name", "taxon_rank", "confidence", "review_state", "is_ambiguous"), state.alias("s"), down.alias("a"), F.col("id").alias("b")),
        errors.filter("message IS NOT NULL").groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_list("message")).alias("errors")),
    ]
    out = own.join(about, "id", "left").join(stars, "id", "left")
    for p in parts:
        out = out.join(p, "id", "left")
    whole = {name: F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType)) for name in ("ai_tags", "faces", "species", "errors")}
    return out.select("id", F.concat_ws("/", "absolute_path", "relative_path").alias("path"), "camera", "lens", "year", F.coalesce("rating", F.lit(0)).alias("rating"), *[c.alias(n) for n, c in whole.items()])


def face_scan_candidates(images: DataFrame, completed: DataFrame, faces: DataFrame) -> DataFrame:
    """(id, companions): what a face run still has to scan, one image for each name in a folder; its companions, an array of ids, get the result too.

    An image with any face at all, in whatever state, or with a completed scan is done. Of
    images of one name a JPEG is scanned before others, and what is not raw before raw.
    """
    done = completed.select(F.col("image_id").alias("id")).union(faces.select("image_id")).distinct()
    name = F.lower("file_name")
    left = images.join(done, "id", "left_anti").withColumn("stem", F.lower(parse.stem_before_last_dot(F.col("file_name"))))
    order = F.struct((~(name.endswith(".jpg") | name.endswith(".jpeg"))).alias("other"), "is_raw", "id")
    pairs = left.groupBy("folder_id", "stem").agg(F.array_sort(F.collect_list(order)).alias("all"))
    return pairs.select(F.col("all")[0]["id"].alias("id"), F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), lambda x: x["id"]).alias("companions"))
