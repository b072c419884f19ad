"""Versioned folders: a new version is written beside the old ones, then one rename makes it the current one.

``CURRENT`` names the version in use and the note it was built under. Readers of an older version go on undisturbed: the
version before the current one stays, older ones go. A build that fails leaves ``CURRENT`` as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions that name no shared folder themselves (tests, local runs).
LOCAL = "/tmp/checkpoints/ionweave-store"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else a local one for tests."""
    return spark.conf.get("spark.checkpoint.dir", None) or LOCAL


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: it is computed once, and lost executors lose nothing of it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def source_mark(spark: SparkSession, path: str) -> str:
    """Name, size and time of a file or folder, so that a changed source is seen."""
    target, fs = _fs(spark, path)
    if not fs.exists(target):
        return path
    state = fs.getFileStatus(target)
    return f"{state.getPath().toString()}:{fs.getContentSummary(target).getLength()}:{state.getModificationTime()}"


def _read(spark: SparkSession, path: str) -> dict | None:
    target, fs = _fs(spark, f"{path}/CURRENT")
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> tuple[str, dict] | None:
    """(folder, note) of the version in use."""
    found = _read(spark, path)
    return None if found is None else (f"{path}/{found['version']}", found["note"])


def publish(spark: SparkSession, path: str, note: dict, write: Callable[[str], object]) -> str:
    """Writes a version with ``write(folder)`` and makes it the current one; returns its folder."""
    version, before = f"v-{uuid.uuid4().hex}", _read(spark, path)
    write(f"{path}/{version}")
    told, fs = _fs(spark, f"{path}/.{version}")
    out = fs.create(told, True)
    try:
        out.write(bytearray(json.dumps({"version": version, "before": before and before["version"], "note": note}).encode()))
    finally:
        out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    replace = spark.sparkContext._gateway.new_array(options, 1)
    replace[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(told.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(told), fs.makeQualified(_fs(spark, f"{path}/CURRENT")[0]), replace)
    if before and before["before"]:
        fs.delete(_fs(spark, f"{path}/{before['before']}")[0], True)
    return f"{path}/{version}"


def build_or_open(spark: SparkSession, path: str, note: dict, write: Callable[[str], object]) -> str:
    """The folder of the current version if it was built under ``note``, else of a new one."""
    found = current(spark, path)
    return found[0] if found and found[1] == note else publish(spark, path, note, write)
