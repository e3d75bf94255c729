"""Metrics, facets and coverage rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet(rows: DataFrame, value: str, limit: int | None = 50, distinct: str | None = None) -> DataFrame:
    """(value, count): the most frequent non-empty values, ties by value without regard to case. limit None: all of them."""
    n = F.count_distinct(distinct) if distinct else F.count("*")
    text = F.col(value).cast("string")
    found = rows.filter(text.isNotNull() & (text != "")).groupBy(text.alias("value")).agg(n.alias("count"))
    return found if limit is None else found.orderBy(F.desc("count"), F.lower("value"), "value").limit(limit)


def of_present(rows: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """The rows that belong to a present image."""
    return rows.join(images.filter("status = 'present'").select(F.col("id").alias(key)), key, "left_semi")


def camera() -> Column:
    """Make and model as one name."""
    return F.trim(F.concat(F.coalesce("camera_make", F.lit("")), F.lit(" "), F.coalesce("camera_model", F.lit(""))))


def metrics(images: DataFrame, versions: DataFrame, ai_tags: DataFrame, analysis: DataFrame, sessions: DataFrame, events: DataFrame, kind: str = "tags") -> DataFrame:
    """One row of counts: one pass over each table. Edited and rated count original versions of present images; a failed image counts as pending too."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    own = of_present(versions.filter("copy_id = ''"), images)
    parts = (
        images.agg(is_("status", "present").alias("total"), is_("status", "missing").alias("missing")),
        own.agg(F.count_if("is_edited").alias("edited"), F.count_if(F.col("rating") > 0).alias("rated")),
        ai_tags.agg(is_("review_state", "suggested").alias("tags_suggested"), is_("review_state", "accepted").alias("tags_accepted")),
        analysis_status(images, analysis, kind).drop("images"),
        sessions.agg(F.count("*").alias("sessions")),
        events.agg(F.count("*").alias("overrides")),
    )
    out = parts[0]
    for one in parts[1:]:
        out = out.join(F.broadcast(one))  # one row each
    return out


def image_states(images: DataFrame, analysis: DataFrame, kind: str) -> DataFrame:
    """(id, done, failed): whether each present image has a completed or failed analysis at its time of change."""
    states = analysis.filter(F.col("analysis_kind") == kind).groupBy(F.col("image_id").alias("id"), F.col("image_modified_at").alias("modified_at")).agg(F.max(F.col("state") == "completed").alias("done"), F.max(F.col("state") == "failed").alias("failed"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return images.filter("status = 'present'").join(states, ["id", "modified_at"], "left").select("id", "folder_id", "root_id", "relative_path", flag("done"), flag("failed"))


def analysis_status(images: DataFrame, analysis: DataFrame, kind: str) -> DataFrame:
    """analysed, pending (no completed state: failed images count) and failed (and never completed)."""
    s = image_states(images, analysis, kind)
    return s.agg(F.count("*").alias("images"), F.count_if("done").alias("analysed"), F.count_if(~F.col("done")).alias("pending"), F.count_if(F.col("failed") & ~F.col("done")).alias("failed"))


def coverage(images: DataFrame, analysis: DataFrame, kind: str) -> DataFrame:
    """(folder, total, done, failed, pending) of every folder and all above it: each path gives to its ancestors, so no recursion is needed.

    Counts are pre-aggregated by folder before they are spread; here pending leaves out failed images.
    """
    s = image_states(images, analysis, kind).withColumn("folder", F.concat_ws("/", F.col("root_id").cast("string"), F.regexp_replace("relative_path", r"/?[^/]*$", "")))
    own = s.groupBy("folder").agg(F.count("*").alias("total"), F.count_if("done").alias("done"), F.count_if(F.col("failed") & ~F.col("done")).alias("failed"))
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    spread = own.select(F.explode(above).alias("folder"), "total", "done", "failed").groupBy("folder").agg(*[F.sum(c).alias(c) for c in ("total", "done", "failed")])
    return spread.withColumn("pending", F.greatest(F.col("total") - F.col("done") - F.col("failed"), F.lit(0)))
