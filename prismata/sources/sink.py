"""A sink of files (S10): each row becomes one file, and all of them appear together or none does.

Tasks write into a folder of their own attempt, and only what a task's message names is moved
to its place by the commit, so a task that fails and runs again, or runs twice, leaves each file once.
An aborted write leaves the target as it was. Messages hold one folder a task, not the files.

The target must be a file system that executors and driver mount (file:/ or a plain path), as Python
tasks write to it. Rows: path (below the target; names that leave it are an error) and content
(text or bytes; null writes an empty file).

    spark.dataSource.register(FileSink)
    rows.write.format("files").mode("append").save(target)
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


def _make(folder: str, made: set[str]) -> None:
    """Make a folder and what is missing above it, down from those already made; an error if these are gone."""
    if folder not in made:
        _make(os.path.dirname(folder), made)
        if not os.path.isdir(folder):
            os.mkdir(folder)
        made.add(folder)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], schema, overwrite)


class FileWriter(DataSourceWriter):
    def __init__(self, target: str, schema, overwrite: bool):
        if "://" in target and not target.startswith("file://"):
            raise ValueError(f"not a mounted folder: {target}")
        self.target = target.removeprefix("file://").removeprefix("file:").rstrip("/")
        self.staging = os.path.join(self.target, f".staging-{uuid.uuid4().hex}")  # one for the whole write
        os.makedirs(self.staging)
        self.at = [f.name for f in schema.fields].index("path"), [f.name for f in schema.fields].index("content")
        self.overwrite = overwrite

    def write(self, rows: Iterator[Row]) -> Staged:
        from pyspark import TaskContext

        task = TaskContext.get()
        folder = os.path.join(self.staging, f"{task.partitionId()}-{task.taskAttemptId()}")
        n, made = 0, {self.staging}
        for row in rows:
            path, content = row[self.at[0]], row[self.at[1]]
            place = os.path.normpath(os.path.join(folder, (path or "").lstrip("/")))
            if not path or not place.startswith(folder + os.sep):
                raise ValueError(f"not below the target: {path!r}")
            _make(os.path.dirname(place), made)
            with open(place, "wb") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            n += 1
        return Staged(folder, n)

    def commit(self, messages: list[Staged | None]) -> None:
        if self.overwrite and os.path.isdir(self.target):
            for name in os.listdir(self.target):
                if not name.startswith(".staging-"):
                    full = os.path.join(self.target, name)
                    shutil.rmtree(full) if os.path.isdir(full) else os.remove(full)
        for m in messages:
            for folder, _, names in os.walk(m.folder) if m and m.files else ():
                to = os.path.join(self.target, os.path.relpath(folder, m.folder))
                os.makedirs(to, exist_ok=True)
                for name in names:
                    os.replace(os.path.join(folder, name), os.path.join(to, name))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        """Tasks that still run lose their folder at once: it is moved away before it is deleted, and none makes it anew."""
        gone = self.staging + "-aborted"
        try:
            os.rename(self.staging, gone)
        except FileNotFoundError:
            return
        shutil.rmtree(gone, ignore_errors=True)
