"""Session factory and helpers that read cluster settings from the session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 4, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUILLSTONE_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints that the session names. A local session may do without; then it is a temporary one,
    removed at the end. On a cluster that would be a folder of each machine, so it is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not named:
            named = tempfile.mkdtemp(prefix="quillstone-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark reads, if it is there."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; so has the folder of a local one
        pass


class Files:
    """Small files and folders below a root, on any file system that Spark reads."""

    def __init__(self, root: str, spark: SparkSession | None = None) -> None:
        self.root, self.spark = root.rstrip("/"), spark or SparkSession.active()
        self.java = self.spark._jvm

    def _at(self, *parts: str):
        at = self.java.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, *parts: str) -> bool:
        at, files = self._at(*parts)
        return files.exists(at)

    def names(self) -> list[str]:
        """What lies directly below the root."""
        at, files = self._at()
        return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []

    def read(self, *parts: str) -> str:
        at, files = self._at(*parts)
        stream = files.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, text: str, *parts: str) -> None:
        """A whole file that appears in one step and replaces what was there."""
        at, files = self._at(*parts)
        new, _ = self._at(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        stream = files.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        option = self.java.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(self.java.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = next(x for x in option.getEnumConstants() if x.name() == "OVERWRITE")
        self.java.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, at, over)

    def remove(self, *parts: str) -> None:
        at, files = self._at(*parts)
        files.delete(at, True)


def fresh_folder(spark: SparkSession, kind: str) -> str:
    """A new folder under the checkpoint folder; it is removed when the process ends."""
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder that is removed at the end of the block."""
    path = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder and returns it without its lineage, so that it is computed once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder: like cut(), but compressed, and read by the columns that are needed."""
    path = fresh_folder(df.sparkSession, "table")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back


_KEPT: dict[tuple, object] = {}


def kept(spark: SparkSession, path: str, name: str, build):
    """What build() makes of the table at path, made once for a session as long as the table's files stay the same."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, path, name)
    state = (files.getFileStatus(at).getModificationTime(), files.getContentSummary(at).getLength())
    if key not in _KEPT or _KEPT[key][0] != state:
        _KEPT[key] = (state, build())
    return _KEPT[key][1]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table in the given folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores if it has fewer, so that costly expressions over a small file run in
    parallel; a table of many partitions isn't shuffled. For scans and projections: it looks at the plan only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
