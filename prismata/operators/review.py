"""Review workflow on append-only decision logs (M1-M12): a change is a row, the present state is derived.

Every log has seq, a rising number; keys are whatever the rows are about. compact() writes
the present state as a new log, so that logs stay short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismata.operators.grouping import latest
from prismata.session import drop_materialized, materialize


def replace_for_key(log: DataFrame, rows: DataFrame, seq: int, *key: str) -> DataFrame:
    """Idempotent replacement: the rows of a key's last sequence number are its rows."""
    return log.unionByName(rows.withColumn("seq", F.lit(seq).cast("bigint")))


def present_rows(log: DataFrame, *key: str) -> DataFrame:
    """Rows of each key's last replacement."""
    last = log.groupBy(*key).agg(F.max("seq").alias("seq"))
    return log.join(last, [*key, "seq"], "left_semi")


def reviewed(items: DataFrame, decisions: DataFrame, key: str = "id", state: str = "review_state", batch_only: str = "suggested") -> DataFrame:
    """items with their state after decisions (seq, key, decision, batch): batch decisions touch only items that are still suggested."""
    singles = latest(decisions.filter("NOT batch").select("seq", key, "decision"), key).select(key, F.col("decision").alias("single"))
    batches = decisions.filter("batch").groupBy(key).agg(F.min_by("decision", "seq").alias("many"))
    joined = items.join(singles, key, "left").join(batches, key, "left")
    return joined.withColumn(state, F.coalesce("single", F.when(F.col(state) == batch_only, F.col("many")), state)).drop("single", "many")


def merged_people(people: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root): the person that each merge pointer chain ends at.

    Each round doubles the length followed and is written, so the plan stays short; it ends
    when nothing moves. A chain that never ends (a loop) is an error.
    """
    spark = people.sparkSession
    now = materialize(people.select("id", F.coalesce("merged_into", "id").alias("root")), "merged-people")
    for _ in range(rounds):
        hop = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        step = materialize(now.join(hop, "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")), "merged-people")
        drop_materialized(spark, now)
        now = step.select("id", "root")
        if step.filter("moved").isEmpty():
            return now
    raise ValueError("merge pointers form a loop")


def renamed(people: DataFrame, log: DataFrame) -> DataFrame:
    """people with their last name of a log (seq, id, display_name)."""
    names = latest(log.select("seq", "id", "display_name"), "id").select("id", F.col("display_name").alias("new"))
    return people.join(names, "id", "left").withColumn("display_name", F.coalesce("new", "display_name")).drop("new")


def moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows with the path of moves (path, target): the id stays."""
    return rows.join(moves.withColumnRenamed("target", "to"), "path", "left").withColumn("path", F.coalesce("to", "path")).drop("to")


def with_tags(tags: Column, add: Column | None = None, remove: Column | None = None) -> Column:
    """Set union with add, without remove."""
    out = F.coalesce(tags, F.array().cast("array<string>"))
    out = F.array_union(out, add) if add is not None else out
    return F.array_except(out, remove) if remove is not None else out


def cull_decisions(decisions: DataFrame, overrides: DataFrame) -> DataFrame:
    """decisions with the status after overrides (seq, id, next_status)."""
    last = latest(overrides.select("seq", "id", "next_status"), "id").select("id", "next_status")
    return decisions.join(last, "id", "left").withColumn("final_status", F.coalesce("next_status", "final_status")).drop("next_status")


def cull_sessions(decisions: DataFrame) -> DataFrame:
    """(session_id, total_count, rejected_count): counters are derived, never kept."""
    return decisions.groupBy("session_id").agg(F.count("*").alias("total_count"), F.count_if(F.col("final_status") == "reject").alias("rejected_count"))


def cache_hits(cache: DataFrame, images: DataFrame, version: str) -> DataFrame:
    """Cached analyses that are still valid: same image, feature version and time of change."""
    now = images.select(F.col("id").alias("image_id"), F.col("modified_at").alias("image_modified_at"))
    return cache.filter(F.col("feature_set_version") == version).join(now, ["image_id", "image_modified_at"], "left_semi")


def album_rows(rows: DataFrame, albums: DataFrame, name: str) -> DataFrame:
    """rows of an album (album, path)."""
    return rows.join(albums.filter(F.col("album") == name).select("path"), "path", "left_semi")


def compact(log: DataFrame, path: str, *key: str) -> None:
    """The present state as a fresh log; readers change over when the folder is complete."""
    latest(log, *key).write.mode("overwrite").parquet(path)
