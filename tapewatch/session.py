"""Session settings and the shared folder that intermediate tables go to."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_recording: list[list[str]] = []


def build_session(name: str = "tapewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; `conf` overrides them."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # Recording the Python call site of every expression slows down building plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application, so that it need not be installed there or on their path.

    Entry points call it; with a session of one's own, call it once before the first job. The driver serves the file.
    """
    context, name = spark.sparkContext, f"{__package__}.zip"
    if not any(f.endswith(f"/{name}") for f in context.listFiles):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="tapewatch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, name)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for at, _, files in os.walk(os.path.join(root, __package__)):
                for file in files:
                    if file.endswith(".py"):
                        archive.write(os.path.join(at, file), os.path.relpath(os.path.join(at, file), root))
        context.addPyFile(path)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir` or set on the context; without one there is nowhere to stage."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def use_local_folder(spark: SparkSession) -> None:
    """In local mode, where one machine is all there is, stage to a folder of its own unless one is set already.

    For tests and entry points; the library itself never calls it. The folder goes when the process ends.
    """
    context = spark.sparkContext
    unset = not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir())
    if unset and re.match(r"local(\[|$)", context.master):
        folder = tempfile.mkdtemp(prefix="tapewatch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)


def application_folder(spark: SparkSession) -> str:
    return os.path.join(checkpoint_root(spark), f"tapewatch-{spark.sparkContext.applicationId}")


def drop_staged(spark: SparkSession) -> None:
    """Delete all tables that this application has staged; call it when their results have been written elsewhere."""
    drop_tables(spark, [application_folder(spark)])


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; one folder per application, to remove when it has ended."""
    path = os.path.join(application_folder(spark), f"{name}-{uuid.uuid4().hex}")
    _record(path)
    return path


def _record(path: str) -> None:
    for paths in _recording:
        paths.append(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collect the paths of tables staged within the block, to drop them with `drop_tables` later on."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording[:] = [p for p in _recording if p is not paths]


def drop_tables(spark: SparkSession, paths: list[str], used_by: DataFrame | None = None) -> list[str]:
    """Delete staged tables, except those that `used_by` reads; returns the paths that stay."""
    def plain(path: str) -> str:
        return re.sub("^file:/+", "/", path)

    reads = [plain(f) for f in used_by.inputFiles()] if used_by is not None else []
    kept = [p for p in paths if any(f.startswith(plain(p) + "/") for f in reads)]
    for p in set(paths) - set(kept):
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return kept


def stage(df: DataFrame, name: str = "stage", rows_per_file: int = 0) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Use it where several passes must see the very same rows, or where recomputing would be dear. The
    files outlive lost executors, keep column pruning, and give the planner the true size. A limit of
    `rows_per_file` lets a small table be read by many tasks when the work per row is heavy.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
