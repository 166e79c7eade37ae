"""Session helpers: settings the operators rely on and reliable lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time; `conf` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.pythonUDF.arrow.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`, which driver and executors share.

    The setting is demanded, never guessed: see `use_local_folder` for single-machine sessions.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def use_local_folder(spark: SparkSession) -> None:
    """For the entry point, tests and the bench: where the setting is absent and the session runs
    inside one JVM (`local` or `local[n]`, never `local-cluster`), name a temporary folder."""
    sc = spark.sparkContext
    unset = not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None
    if unset and re.fullmatch(r"local(\[.*\])?", sc.master):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-quire-", dir="/tmp"))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, so that queries run from any directory."""
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="quire-code-"), "quire_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._quire_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and return a frame reading it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, in whatever store it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder and no file, in whatever store it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for tables a job writes and reads again. Folders that
    `drop_folder` has not removed go when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder whose readers have all run."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_rest() -> None:
    for spark, path in _SCRATCH:
        if spark.sparkContext._jsc is not None:
            drop_folder(spark, path)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table that several branches of a plan read, and read it back with pruning."""
    path = scratch_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
