"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_watched: list[list[DataFrame]] = []
#: Spark deletes the shuffle files of a command that ends while this is set; else they stay until the driver collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writing: dict[SparkSession, list] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC, so that TIMESTAMP holds plain wall-clock time."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Without that setting a temporary folder is used, but only in local mode.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="slotcast-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/slotcast/{name}-{uuid.uuid4().hex}"


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes go with their end; the session's own setting is back after the last of writes that run side by side."""
    with _lock:
        state = _writing.setdefault(spark, [0, spark.conf.get(TIDY, None)])
        state[0] += 1
        spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                del _writing[spark]
                if state[1] is None:
                    spark.conf.unset(TIDY)
                else:
                    spark.conf.set(TIDY, state[1])


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from a table written to the shared folder.

    The table survives the loss of executors, and its file sizes tell the optimizer whether
    a later join may broadcast it. Shuffle files of the write are deleted with its end: only the table is read again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    with _tidy(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at_ = path
    for made in _watched[-1:]:
        made.append(table)
    return table


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that :func:`materialise` writes meanwhile, for :func:`release` once the result that needs them is stored itself."""
    made: list[DataFrame] = []
    _watched.append(made)
    try:
        yield made
    finally:
        _watched.remove(made)


def release(*tables: DataFrame) -> None:
    """Delete what :func:`materialise` wrote for ``tables``; nothing built on them may be read afterwards."""
    for table in tables:
        path = getattr(table, "stored_at_", None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ship_code(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers of executors, once per application.

    The archive is made on the driver and served by it; executors keep it as any added file.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        home = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="slotcast-code-"), "slotcast-main.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(home):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("slotcast", os.path.relpath(full, home)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
