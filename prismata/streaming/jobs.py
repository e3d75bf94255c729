"""Job log and incremental processing (N1-N6): append-only tables, the state is derived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIVE = ("running", "paused", "cancelling")
FINAL = ("completed", "failed", "cancelled")


def job_states(log: DataFrame) -> DataFrame:
    """(job_id, state, created_at, updated_at, completed_at, events) from an append-only log (seq, job_id, state, at)."""
    last = F.max_by("state", "seq")
    return log.groupBy("job_id").agg(last.alias("state"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.when(last.isin(*FINAL), F.max_by("at", "seq")).alias("completed_at"), F.count("*").alias("events"))


def job_list(states: DataFrame, limit: int = 100) -> DataFrame:
    """Active jobs first, then the last changed."""
    return states.orderBy(F.when(F.col("state").isin(*ACTIVE), 0).otherwise(1), F.desc("updated_at"), "job_id").limit(limit)


def recover(states: DataFrame, now: int) -> DataFrame:
    """Log rows that close jobs which a crash left unfinished; queued jobs still wait."""
    return states.filter(F.col("state").isin(*ACTIVE)).select("job_id", F.lit("failed").alias("state"), F.lit(now).alias("at"))


#: Command -> (states from which it is allowed, the state after it; none: it stays).
COMMANDS = {"pause": (("queued", "running"), "paused"), "resume": (("paused",), "running"), "cancel": (("queued", "running", "paused", "cancelling"), "cancelling"), "retry": (("failed", "cancelled"), None)}
# Kinds of jobs that can be started again, and what a kind's payload must have for it.
RETRIED = ("catalog_scan", "ram_plus_tagging", "ai_tagging", "face_detection", "face_recognition", "raw_denoise", "rgb_denoise", "deblur", "upscale", "cull_analysis", "model_download", "thumbnail_generation", "metadata_extraction", "sidecar_metadata")
NEEDED = {"raw_denoise": "imageId", "rgb_denoise": "imageId", "deblur": "imageId", "upscale": "imageId"}


def control(states: DataFrame, commands: DataFrame) -> DataFrame:
    """(job_id, state, at, refused) log rows of commands (job_id, command, at): those that the job's present state does not allow are refused and change nothing."""
    j = commands.join(states.select("job_id", F.col("state").alias("now")), "job_id", "left")
    ok, then = F.lit(False), F.lit(None).cast("string")
    for name, (allowed, after) in COMMANDS.items():
        ok = ok | ((F.col("command") == name) & F.col("now").isin(*allowed))
        then = F.when(F.col("command") == name, F.lit(after) if after else F.col("now")).otherwise(then)
    fits = F.coalesce(ok, F.lit(False))
    return j.select("job_id", F.when(fits, then).otherwise(F.col("now")).alias("state"), "at", (~fits).alias("refused"))


def retried(jobs: DataFrame, commands: DataFrame) -> DataFrame:
    """(job_id, kind, root_id, payload, state, at, retried_from, error) of retry commands: each allowed one is a new queued job of the old one's kind and payload.

    jobs: job_id, kind, root_id, payload (JSON), state. The old job keeps its state, as history.
    The new id is made of the old one and the time, so a command that is seen again makes the
    same job. A command that cannot be followed is a row with an error and no new job.
    """
    asked = commands.filter("command = 'retry'").select("job_id", "at").distinct().join(jobs, "job_id", "left")
    missing = F.lit(False)
    for kind, field in NEEDED.items():
        missing = missing | ((F.col("kind") == kind) & F.get_json_object("payload", f"$.{field}").try_cast("bigint").isNull())
    error = (
        F.when(F.col("kind").isNull(), "no such job")
        .when(~F.col("state").isin(*COMMANDS["retry"][0]), "only failed or cancelled jobs can be retried")
        .when(~F.col("kind").isin(*RETRIED), F.concat(F.lit("no retry for "), "kind"))
        .when((F.col("kind") == "catalog_scan") & F.col("root_id").isNull(), "no root")
        .when(missing, "no source image")
    )
    new = F.when(F.col("error").isNull(), F.concat_ws("-", "job_id", "at"))
    fresh = F.when(F.col("error").isNull(), F.lit("queued"))
    return asked.withColumn("error", error).select(new.alias("job_id"), "kind", "root_id", "payload", fresh.alias("state"), "at", F.col("job_id").alias("retried_from"), "error")


def run_incrementally(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], key: str = "id", files_per_batch: int = 100) -> None:
    """Process what is new in source, once: micro-batches through step, appended with their batch number; a batch that runs again replaces itself.

    step returns rows with the key, and an error column (null: fine), so a failed item is a row and not a failed batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deduplicated_queue(stream: DataFrame, key: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """A work queue in which a key waits at most once within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
