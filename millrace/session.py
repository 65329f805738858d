"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the library is tested under; `conf` keys use `_` for `.`."""
    builder = (
        SparkSession.builder.master(master)
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


#: Paths of the tables written within each open `workspace`, innermost last.
_workspaces: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` of the session.

    Only where the session names none and everything runs in one local process, as in tests, a temporary folder is
    made, set as the checkpoint folder and removed at exit. A cluster without a folder raises RuntimeError: its
    executors would each write to a disk of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not is_local(spark.sparkContext.master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {spark.sparkContext.master} share")
    path = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return f"file://{path}"


def use_checkpoints(spark: SparkSession) -> None:
    """Have DataFrame.checkpoint write into the shared folder."""
    folder = shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder for files of a query, deleted when the application's JVM ends."""
    path = f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}"
    target, files = _path(spark, path)
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


def is_local(master: str) -> bool:
    """Whether a master URL stands for threads of one process."""
    return master == "local" or master.startswith("local[")


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write `df` as a Parquet table into the shared folder and read it back, in a folder per value of the column `by`.

    Cuts the lineage, survives lost executors, and lets several consumers read only their columns, or only one value
    of `by`. The table is deleted by `discard`, at the end of the innermost open `workspace`, or when the
    application's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    target, files = _path(spark, path)
    files.deleteOnExit(target)
    if _workspaces:
        _workspaces[-1].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Delete what `written` wrote, once nothing is to be read from it any more."""
    path = getattr(table, "_written_to", None)
    if path:
        target, files = _path(table.sparkSession, path)
        files.delete(target, True)
        files.cancelDeleteOnExit(target)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables of all queries built inside when the block ends. Their results have to be
    collected or written by then."""
    _workspaces.append([])
    try:
        yield
    finally:
        for path in _workspaces.pop():
            target, files = _path(spark, path)
            files.delete(target, True)
            files.cancelDeleteOnExit(target)


def spread(table: DataFrame) -> DataFrame:
    """The rows of a scan over at least as many partitions as there are cores.

    A table of one small or unsplittable file would otherwise keep one core busy with all that follows up to the first
    shuffle. Scans of as many partitions or more, as any large table has, are returned as they are. For plain scans only
    (selected and filtered): of other plans the number of partitions is known only by running them.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no installation of it.

    Called by every operator that runs Python in workers. A package that came as an archive was sent along already.
    """
    context, package = spark.sparkContext, Path(__file__).parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="millrace-code-")  # on the driver only, which serves it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
