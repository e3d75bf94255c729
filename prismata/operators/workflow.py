"""Lists and changes of the review workflow: faces, species, derivatives, jobs, culling, collections and albums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismata.operators import catalog
from prismata.operators.grouping import latest
from prismata.session import materialize, small_side


def full_path(images: DataFrame, roots: DataFrame) -> DataFrame:
    """images with path: that of the root, a slash, and the path below it."""
    root = small_side(roots.select(F.col("id").alias("root_id"), "absolute_path"))
    return images.join(root, "root_id").withColumn("path", F.concat("absolute_path", F.lit("/"), "relative_path"))


def faces_of_image(faces: DataFrame, image_id: int) -> DataFrame:
    """Faces of one image, the surest first."""
    return faces.filter(F.col("image_id") == image_id).orderBy(F.desc("confidence"), "id")


def faces_for_path(faces: DataFrame, images: DataFrame, roots: DataFrame, path: str) -> DataFrame:
    """Faces of the present image at a displayed path: its virtual copy is ignored, the longest root that fits is meant."""
    source = path.partition("?vc=")[0].replace("\\", "/")
    asked = roots.sparkSession.createDataFrame([(source,)], "path string")
    at = catalog.resolve_roots(asked, roots).select("root_id", F.col("relative").alias("relative_path"))
    image = images.filter("status = 'present'").join(F.broadcast(at), ["root_id", "relative_path"], "left_semi").select(F.col("id").alias("image_id"))  # one row
    return faces.join(F.broadcast(image), "image_id", "left_semi").orderBy(F.desc("confidence"), "id")


def unreviewed_faces(faces: DataFrame, images: DataFrame, roots: DataFrame, clusters: DataFrame, limit: int = 500) -> DataFrame:
    """The review list: one face for each folder, stem and place (catalog.distinct_faces) with its path and, if any, its newest open cluster.

    clusters: cluster_id, state, updated_at.
    """
    own = catalog.distinct_faces(faces, images).drop("folder_id", "file_name")
    placed = own.join(full_path(images, roots).select(F.col("id").alias("image_id"), "path"), "image_id")
    open_ = clusters.filter("state = 'unreviewed'").select("cluster_id", "updated_at")
    newest = faces.select("id", "cluster_id").join(small_side(open_), "cluster_id").groupBy("id").agg(F.max(F.struct("updated_at", "cluster_id"))["cluster_id"].alias("open_cluster"))
    return placed.join(newest, "id", "left").orderBy(F.desc("confidence"), "id").limit(limit)


def suggested_species(species: DataFrame, images: DataFrame, roots: DataFrame, state: str = "suggested", present_only: bool = True, limit: int = 500) -> DataFrame:
    """Species in a state of review, the surest first."""
    own = images.filter("status = 'present'") if present_only else images
    rows = species.filter(F.col("review_state") == state).join(full_path(own, roots).select(F.col("id").alias("image_id"), "path"), "image_id")
    return rows.orderBy(F.desc("confidence"), "id", "scientific_name").limit(limit)


def derivatives_of(derivatives: DataFrame, image_id: int) -> DataFrame:
    """What was made from one image, the newest first."""
    return derivatives.filter(F.col("source_image_id") == image_id).orderBy(F.desc("created_at"), F.desc("id"))


def job_events(log: DataFrame, job_id: int, limit: int = 200) -> DataFrame:
    """The newest events of one job."""
    return log.filter(F.col("job_id") == job_id).orderBy(F.desc("seq")).limit(limit)


FACTORS = "array<struct<id: string, impact: string>>"


def session_decisions(decisions: DataFrame, session_id: int) -> DataFrame:
    """Decisions of one culling session, the best image first, with their factors decoded (none if the JSON is broken)."""
    rows = decisions.filter(F.col("session_id") == session_id)
    return rows.withColumn("factors", F.coalesce(F.from_json("factors_json", FACTORS), F.array().cast(FACTORS))).orderBy(F.desc("quality_score"), "id")


def scan_candidates(images: DataFrame, roots: DataFrame, root_id: int | None = None) -> DataFrame:
    """(id, path, modified_at) of present images, of one root if given: the work list for thumbnails and metadata."""
    own = images.filter("status = 'present'")
    return full_path(own if root_id is None else own.filter(F.col("root_id") == root_id), roots).select("id", "root_id", "path", "modified_at")


def embedding_worklist(faces: DataFrame, images: DataFrame, model_pack: str, folder: str | None = None, root_id: int | None = None) -> DataFrame:
    """Faces of a model pack that are not rejected and have no embedding, on present images of a scope."""
    own = images.filter("status = 'present'")
    if root_id is not None:
        own = own.filter(F.col("root_id") == root_id)
    if folder not in (None, "", "."):
        own = own.filter((F.col("relative_path") == folder) | F.col("relative_path").startswith(folder + "/"))
    rows = faces.filter((F.col("model_pack_id") == model_pack) & (F.col("review_state") != "rejected") & F.col("embedding_id").isNull())
    return rows.join(own.select(F.col("id").alias("image_id")), "image_id", "left_semi")


def cover_candidates(scored: DataFrame, person_id: int) -> DataFrame:
    """Confirmed faces of a person: the most frontal first (an unknown pose counts as 0), then the surest. scored: id, person_id, review_state, frontal, confidence."""
    rows = scored.filter((F.col("person_id") == person_id) & (F.col("review_state") == "confirmed"))
    return rows.withColumn("frontal", F.coalesce("frontal", F.lit(0.0))).orderBy(F.desc("frontal"), F.desc("confidence"), "id")


def subject_evidence(images: DataFrame, faces: DataFrame, ai_tags: DataFrame, species: DataFrame, top: int = 6) -> DataFrame:
    """(id, faces, tags, species): what is known of each image's subject: faces not rejected, its top tags, and its best accepted or unambiguous species.

    Four pre-aggregations, joined by image; tags are cut to the top ones in the aggregation.
    """
    seen = faces.filter("review_state != 'rejected'").groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("faces"))
    ranked = ai_tags.filter("review_state != 'rejected'").select(F.col("image_id").alias("id"), "name", "confidence", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("confidence"), "name")).alias("rn"))
    best = ranked.filter(F.col("rn") <= top).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]).alias("tags"))
    rank = F.when(F.col("review_state") == "accepted", 0).otherwise(1)
    sure = species.filter("review_state != 'rejected' AND (NOT is_ambiguous OR review_state = 'accepted')")
    name = F.coalesce("common_name", "scientific_name")
    first = sure.groupBy(F.col("image_id").alias("id")).agg(F.min(F.struct(rank.alias("rank"), (-F.col("confidence")).alias("c"), name.alias("name")))["name"].alias("species"))
    out = images.select("id")
    for part in (seen, best, first):
        out = out.join(part, "id", "left")
    return out.fillna(0, ["faces"])


def with_image_ids(decisions: DataFrame, images: DataFrame, roots: DataFrame) -> DataFrame:
    """decisions (path) with the image that stands at each path: the root by its longest prefix, then the path below it by equality; null if there is none."""
    at = catalog.resolve_roots(decisions.select("path").distinct(), roots)
    known = at.join(images.select(F.col("id").alias("image_id"), "root_id", F.col("relative_path").alias("relative")), ["root_id", "relative"]).select("path", "image_id")
    return decisions.join(known, "path", "left")


# Face review (an append-only log; the last row of a face is its state).


def reviewed_faces(faces: DataFrame, decisions: DataFrame, images: DataFrame, people: DataFrame) -> DataFrame:
    """faces with person and state after decisions (seq, face_id, person_id, review_state), which companion faces of raw and JPEG pairs share.

    Decisions that name a person who is not active, or that confirm without one, are void. Of
    equal seq that on the face with the largest id counts, then the larger person and state, so
    that a result depends on the rows only.
    """
    active = people.filter("state = 'active'").select(F.col("id").alias("person_id"))
    named = decisions.filter("person_id IS NOT NULL").join(active, "person_id", "left_semi").select("seq", "face_id", "person_id", "review_state")
    valid = named.unionByName(decisions.filter("person_id IS NULL AND review_state != 'confirmed'").select("seq", "face_id", "person_id", "review_state"))
    also = catalog.companions(faces, images).distinct().join(valid, "face_id").select("seq", F.col("companion_id").alias("face_id"), "person_id", "review_state", F.col("face_id").alias("decided"))
    every = valid.withColumn("decided", F.col("face_id")).unionByName(also)
    last = latest(every.select(F.struct("seq", "decided", "person_id", "review_state").alias("seq"), "face_id", F.struct("person_id", "review_state").alias("d")), "face_id").select(F.col("face_id").alias("id"), "d")
    joined = faces.join(last, "id", "left")
    return joined.withColumn("person_id", F.when(F.col("d").isNull(), F.col("person_id")).otherwise(F.col("d.person_id"))).withColumn("review_state", F.coalesce("d.review_state", "review_state")).drop("d")


def confirmed_cluster(faces: DataFrame, images: DataFrame, people: DataFrame, cluster_id: int, person_id: int) -> DataFrame:
    """faces after a cluster is given to a person: its unreviewed faces, and the unreviewed companions of any of its faces, are confirmed.

    The person must be active, and the cluster must have a face to review: else it is an error.
    """
    if people.filter((F.col("id") == person_id) & (F.col("state") == "active")).isEmpty():
        raise ValueError(f"person {person_id} is not active")
    if faces.filter((F.col("cluster_id") == cluster_id) & (F.col("review_state") == "unreviewed")).isEmpty():
        raise ValueError(f"cluster {cluster_id} has no face to review")
    members = faces.filter(F.col("cluster_id") == cluster_id).select("id")
    also = catalog.companions(faces, images).join(members.withColumnRenamed("id", "face_id"), "face_id", "left_semi").select(F.col("companion_id").alias("id"))
    hit = members.union(also).distinct().withColumn("hit", F.lit(True))
    joined = faces.join(hit, "id", "left")
    changes = F.coalesce("hit", F.lit(False)) & (F.col("review_state") == "unreviewed")
    return joined.withColumn("person_id", F.when(changes, F.lit(person_id)).otherwise(F.col("person_id"))).withColumn("review_state", F.when(changes, "confirmed").otherwise(F.col("review_state"))).drop("hit")


def accepted_clusters(clusters: DataFrame, confirmed: DataFrame) -> DataFrame:
    """clusters (id, state) after some (confirmed: id) were given to people: accepted, so they leave the list of open ones."""
    done = confirmed.select("id").distinct().withColumn("done", F.lit(True))
    return clusters.join(done, "id", "left").withColumn("state", F.when(F.col("done"), "accepted").otherwise(F.col("state"))).drop("done")


def cleared_faces(rows: DataFrame, clears: DataFrame) -> DataFrame:
    """Rows of a face table's log (seq) after the last command to clear it (clears: seq); people and images are not touched. Without a command all rows stay."""
    last = clears.agg(F.max("seq").alias("cleared"))  # one row
    return rows.join(F.broadcast(last)).filter("cleared IS NULL OR seq > cleared").drop("cleared")


# Bulk edits of sidecars and catalog.


def bulk_edited(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows (path, rating, tags, adjustments) after edits (seq, path, rating, color, adjustments): of each field the last edit that gives it.

    A colour replaces the colour tags, an empty one takes them away; null fields change nothing.
    """
    field = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}")
    last = edits.groupBy("path").agg(field("rating"), field("color"), field("adjustments"))
    j = rows.join(last, "path", "left")
    plain = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: ~t.startswith("color:"))
    tags = F.when(F.col("new_color").isNull(), F.col("tags")).when(F.col("new_color") == "", plain).otherwise(F.array_append(plain, F.concat(F.lit("color:"), "new_color")))
    return j.select("path", F.coalesce("new_rating", "rating").alias("rating"), tags.alias("tags"), F.coalesce("new_adjustments", "adjustments").alias("adjustments"))


# Stored queries.


def saved_collections(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Stored queries (name, query) after changes (seq, name, query; a null query deletes): names are trimmed and compared without case, the last change wins; empty names and queries that are no JSON object are refused."""
    key = F.lower(F.trim("name"))
    fit = changes.filter((F.trim("name") != "") & (F.col("query").isNull() | F.trim("query").startswith("{") & F.try_parse_json("query").isNotNull()))
    rows = old.select(key.alias("k"), F.lit(-1).cast("bigint").alias("seq"), "name", "query").unionByName(fit.select(key.alias("k"), "seq", F.trim("name").alias("name"), "query"))
    kept = rows.groupBy("k").agg(F.min_by("name", "seq").alias("name"), F.max_by(F.struct("query"), "seq")["query"].alias("query"))  # the first spelling stays
    return kept.filter("query IS NOT NULL").select("name", "query")


def apply_collection(collections: DataFrame, name: str, view: DataFrame, image_tags: DataFrame, ai_tags: DataFrame, people: DataFrame) -> DataFrame:
    """Rows that a stored query finds; an unknown name is an error."""
    found = collections.filter(F.lower("name") == name.lower()).select("query").head()
    if found is None:
        raise KeyError(name)
    return catalog.search(view, catalog.CatalogQuery.of_json(found["query"]), image_tags, ai_tags, people)


def collection_list(collections: DataFrame) -> DataFrame:
    """Stored queries by name, with a mark for those that do not parse."""
    return collections.withColumn("valid", F.trim("query").startswith("{") & F.try_parse_json("query").isNotNull()).orderBy(F.lower("name"))


# Albums: a flat table (album, path) and a tree (id, parent_id, kind, name).


def added_to_album(albums: DataFrame, album: str, paths: DataFrame) -> DataFrame:
    """albums with paths that the album has not yet."""
    new = paths.select(F.lit(album).alias("album"), "path").distinct().join(albums, ["album", "path"], "left_anti")
    return albums.unionByName(new)


def synced_albums(albums: DataFrame, renames: DataFrame, deleted: DataFrame, folder: tuple[str, str] | None = None) -> DataFrame:
    """albums after a folder moved (old, new), files were renamed (path, target) and paths deleted, in this order: virtual copies follow their file, a deleted folder takes what is below it.

    Folders above a path are looked up by equality, so nothing is compared all against all.
    """
    now = albums.select("album", "path")
    if folder:
        old, new = (x.rstrip("/") for x in folder)
        now = now.withColumn("path", F.when((F.col("path") == old) | F.col("path").startswith(old + "/"), F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 20))).otherwise(F.col("path")))
    copy = F.regexp_extract("path", r"(\?vc=[^?]*)$", 1)
    base = F.regexp_replace("path", r"\?vc=[^?]*$", "")
    keyed = now.select("album", "path", base.alias("base"), copy.alias("copy"))
    whole = renames.select("path", F.col("target").alias("whole"))
    part = renames.select(F.col("path").alias("base"), F.col("target").alias("part"))
    moved = keyed.join(whole, "path", "left").join(part, "base", "left").select("album", F.coalesce("whole", F.concat("part", "copy"), "path").alias("path"))
    steps = F.split(F.regexp_replace("path", r"\?vc=[^?]*$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    numbered = moved.distinct()
    gone = numbered.select("album", "path", F.explode(F.array_union(above, F.array("path"))).alias("at")).join(deleted.select(F.col("path").alias("at")), "at", "left_semi").select("album", "path").distinct()
    return moved.join(gone, ["album", "path"], "left_anti")


def sorted_tree(tree: DataFrame, rounds: int = 64) -> DataFrame:
    """tree with place and depth in display order: at each level groups before albums, then by name without case; children right below their parent.

    Each level is joined to its parents' keys; the levels are as many rounds as the tree is deep.
    """
    key = F.concat(F.when(F.col("kind") == "group", "0").otherwise("1"), F.lower("name"), F.lit("\x01"), F.lpad(F.col("id").cast("string"), 20, "0"), F.lit("\x00"))
    rows = tree.select("id", "parent_id", "kind", "name", key.alias("own"))
    level = rows.filter("parent_id IS NULL").withColumn("sort", F.col("own")).withColumn("depth", F.lit(0))
    out = level
    for depth in range(1, rounds):
        up = level.select(F.col("id").alias("parent_id"), F.col("sort").alias("above"))
        level = materialize(rows.join(small_side(up), "parent_id").select("id", "parent_id", "kind", "name", "own", F.concat("above", "own").alias("sort"), F.lit(depth).alias("depth")), "tree-level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.orderBy("sort").select("id", "parent_id", "kind", "name", "depth", "sort")


# Culling plans.


def apply_plan(items: DataFrame, folder: str, rejected: str = "Rejected", conflict: str | None = None, delete: bool = False) -> DataFrame:
    """(path, action, target, label) for each file of the rejected items (path, keep, has_conflict, backing_paths): the plan only, no file is touched.

    Actions: move (into folder/rejected), delete, or skip (conflicts, if so asked); all but the skipped get the red label.
    """
    rows = items.filter("NOT keep").select("has_conflict", F.explode("backing_paths").alias("path"))
    skip = F.col("has_conflict") & F.lit(conflict == "skip" and not delete)
    action = F.when(skip, "skip").otherwise("delete" if delete else "move")
    target = F.when(action == "move", F.concat(F.lit(f"{folder.rstrip('/')}/{rejected}/"), F.regexp_extract("path", r"([^/]+)$", 1)))
    return rows.select("path", action.alias("action"), target.alias("target"), F.when(~skip, "red").alias("label"))


def undo_plan(applied: DataFrame) -> DataFrame:
    """(path, target) moves that put back what a plan moved; deleted files cannot come back."""
    return applied.filter("action = 'move'").select(F.col("target").alias("path"), F.col("path").alias("target"))
