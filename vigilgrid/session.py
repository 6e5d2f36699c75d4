"""Session defaults and staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "vigilgrid", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the engine expects; cluster sizing stays with the caller."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_folder: ContextVar[str | None] = ContextVar("staging_folder", default=None)


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (local tests) a
    temporary folder is made, once per session.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vigilgrid-stage-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """One folder for all tables staged within, deleted at the end, also on failure.

    What is built on these tables has to be written before.
    """
    folder = f"{staging_root(spark)}/vigilgrid/{uuid.uuid4().hex}"
    token = _folder.set(folder)
    try:
        yield folder
    finally:
        _folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes within delete their shuffle files as soon as they end.

    A write plans its own shuffles, which nothing reads again. Left alone they stay on the disks of the executors until
    the driver collects garbage, so a job of many steps holds those of all its steps at one time.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Used where one result feeds several branches: the expensive part runs once, the lineage is cut
    on storage that outlives executors, and the planner sees the real size of the table.
    """
    spark = df.sparkSession
    folder = _folder.get() or f"{staging_root(spark)}/vigilgrid"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
