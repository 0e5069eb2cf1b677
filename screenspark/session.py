"""Session set-up and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("screenspark")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder name below the one that ``spark.checkpoint.dir`` names.

    Without that setting, or a checkpoint folder set by the caller, this is an
    error: a machine-local folder would die with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run meanwhile delete their shuffle files when they end, not when the JVM collects garbage."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, columns read as needed."""
    path = shared_folder(df.sparkSession)
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and nothing reads any more."""
    files = table.inputFiles()
    if files:
        store, path = store_of(files[0].rsplit("/", 1)[0])
        store.delete_dir(path)


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a file that Spark names, and the path within it."""
    return fs.FileSystem.from_uri(re.sub("^file:/*", "/", uri))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def plan_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a table, the one its join choice goes by."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which Spark broadcasts a join side; negative when it never does."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
