"""Metadata cache by (path, time of change): a table of generations with dirty folders.

A refresh extracts only what is new or changed, and writes only the folders in which something
was added, changed or removed, as the next generation; other folders keep their files. A
manifest names the generation of each folder. It is written beside the table and moved to
its place in one step, so readers see the old table or the new one, never a part of it,
and a refresh that dies leaves nothing that is read. Two refreshes at once: the second to
finish fails, as its manifest's place is taken.

Generations that the manifest no longer names are old files; vacuum() deletes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismata.session import drop_materialized, materialize


class MetadataCache:
    """root: a folder on shared storage. Rows have path, folder, mtime and what extract() adds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def generation(self) -> int:
        """The newest complete generation; 0: none."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0
        return max([0, *(int(s.getPath().getName().partition("=")[2]) for s in self._fs.listStatus(folder))])

    def manifest(self) -> DataFrame | None:
        """(folder, generation) of the newest generation."""
        now = self.generation()
        return self.spark.read.parquet(f"{self.root}/manifest/generation={now}").select("folder", F.col("of").alias("generation")) if now else None

    def read(self) -> DataFrame | None:
        """All cached rows, with the generation that wrote them; None before the first refresh."""
        manifest = self.manifest()
        if manifest is None:
            return None
        return self.spark.read.parquet(f"{self.root}/rows").join(manifest, ["folder", "generation"], "left_semi")

    def hits(self, scan: DataFrame) -> DataFrame:
        """Cached rows of the files of a scan (path, mtime) that have not changed since."""
        known = self.read()
        asked = scan.select("path", "mtime")
        return asked.join(known.drop("folder"), ["path", "mtime"]) if known is not None else asked.filter("false")

    def refresh(self, scan: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> int:
        """Bring the cache to the state of a scan (path, folder, mtime, one row a path); returns the generation that is then read.

        extract: the scan's rows that are new or changed -> the same rows with their metadata.
        """
        files = scan.select("path", "folder", "mtime")
        known, now = self.read(), self.generation()
        if known is None:
            return self._publish(extract(scan), None, 1)
        old = known.select("path", F.col("mtime").alias("was"), F.col("folder").alias("in"))
        compared = materialize(files.join(old, "path", "full").select("path", "folder", "mtime", "was", "in"), "cache-compared")
        changed = compared.filter("folder IS NOT NULL AND NOT (mtime <=> was AND folder <=> `in`)")
        gone = compared.filter("`in` IS NOT NULL AND NOT (folder <=> `in`)")
        dirty = materialize(changed.select("folder").union(gone.select(F.col("in").alias("folder"))).distinct(), "cache-dirty")
        if dirty.isEmpty():
            drop_materialized(self.spark, compared)
            return now
        fresh = extract(scan.join(changed.select("path"), "path", "left_semi"))
        same = compared.filter("mtime <=> was AND folder <=> `in`").select("path")
        kept = known.join(dirty, "folder", "left_semi").join(same, "path", "left_semi").drop("generation")
        out = self._publish(kept.unionByName(fresh), dirty, now + 1)
        for table in (compared, dirty):
            drop_materialized(self.spark, table)
        return out

    def _publish(self, rows: DataFrame, dirty: DataFrame | None, number: int) -> int:
        rows.write.mode("overwrite").parquet(f"{self.root}/rows/generation={number}")
        written = self.spark.read.parquet(f"{self.root}/rows/generation={number}").select("folder").distinct().withColumn("of", F.lit(number))
        if dirty is not None:
            clean = self.manifest().withColumnRenamed("generation", "of").join(dirty, "folder", "left_anti")
            written = clean.unionByName(written)
        draft, place = f"{self.root}/drafts/{uuid.uuid4().hex}", self._path(f"{self.root}/manifest/generation={number}")
        written.write.parquet(draft)
        self._fs.mkdirs(place.getParent())
        if self._fs.exists(place) or not self._fs.rename(self._path(draft), place):
            raise RuntimeError(f"another refresh has published generation {number}")
        return number

    def vacuum(self) -> list[int]:
        """Delete the rows of generations that no folder has any more, and old manifests; returns the generations deleted. Readers of older manifests must be done."""
        now = self.generation()
        alive = {r["generation"] for r in self.manifest().select("generation").distinct().collect()} if now else set()  # as many as refreshes since the last vacuum at most
        gone = []
        for s in self._fs.listStatus(self._path(f"{self.root}/rows")):
            number = int(s.getPath().getName().partition("=")[2])
            if number not in alive and number <= now:
                self._fs.delete(s.getPath(), True)
                gone.append(number)
        for s in self._fs.listStatus(self._path(f"{self.root}/manifest")):
            if int(s.getPath().getName().partition("=")[2]) < now:
                self._fs.delete(s.getPath(), True)
        return sorted(gone)
