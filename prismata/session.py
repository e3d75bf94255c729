"""Session factory, shared-storage helpers and checked broadcasts."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows, and its files this many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Rows of a table of known size for which a task of its own is worth while: each file costs a local file system several processes.
ROWS_A_FILE = 4096


def session(app: str = "prismata", cpus: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller's own session is used."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir of the session.

    Only a local session may lack it; it then gets a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="prismata-")
    return _local_dirs[app]


#: The folders of local sessions that name none.
_local_dirs: dict[str, str] = {}


class Scratch:
    """The tables written since it began; at its end all but those kept are deleted."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, whose files outlive the scratch."""
        own = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}  # a folder's name is unique
        self.kept += [p for p in self.paths if os.path.basename(p) in own]
        self.paths = [p for p in self.paths if p not in self.kept]
        return df


_open: list[Scratch] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Delete at the end what materialize() wrote inside, but for what is kept; a result that is still lazy must not read the rest."""
    own = Scratch()
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)
        for path in own.paths:
            _delete(spark, path)
        if _open:  # what was kept belongs to the scratch around it
            _open[-1].paths += own.kept


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there, and lost executors lose nothing.

    rows: about how many rows df has; a small table is then not cut into as many files as a shuffle has partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    if _open:
        _open[-1].paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_materialized(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table that materialize() wrote and that nothing will read again."""
    root = shared_dir(spark)
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.dirname(folder).endswith(root.split("://")[-1]):
            _delete(spark, folder)


#: Nodes of a plan that only reads files.
READS = ("Project", "Filter", "LogicalRelation", "DataSourceV2ScanRelation", "LocalRelation", "ResolvedHint")


def reads_files(df: DataFrame) -> bool:
    """Whether df is no more than columns and rows of files: to run it again costs a scan."""
    nodes = [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in READS:
            return False
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return True


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is proved small, else df as it is (Spark then shuffles both sides).

    What is more than a scan is written first, so it runs once, not for the count and again for the join.
    """
    known = df if reads_files(df) else materialize(df, "side")
    small = int(str(known._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= size and known.limit(rows + 1).count() <= rows
    return F.broadcast(known) if small else known


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
