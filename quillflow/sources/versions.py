"""Versioned snapshots of a small table: published by compare-and-set, restored by pointing back.

A folder holds snapshots (data/...) that never change, and one pointer for each version (versions/n) with the name
of a snapshot. A writer that read version n may publish n + 1 only if nobody has: the pointer is written beside
and then put in its place in one step that fails where there is one, so of two writers one fails with `Conflict`,
reads again and merges anew. A writer that is cut off before that leaves a snapshot that nothing points at. Restoring publishes an older snapshot as a new version,
so history only grows.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published the version."""


def _files(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """The snapshot of each version."""
    path, files = _files(spark, f"{folder}/versions")
    if not files.exists(path):
        return {}
    out = {}
    for status in files.listStatus(path):
        if status.getPath().getName().isdigit():
            stream = files.open(status.getPath())
            out[int(status.getPath().getName())] = bytes(stream.readAllBytes()).decode()
            stream.close()
    return dict(sorted(out.items()))


def current(spark: SparkSession, folder: str) -> int:
    """The last version's number, 0 for none; what the next publish has to expect."""
    return max(versions(spark, folder), default=0)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version, or the last one."""
    found = versions(spark, folder)
    number = max(found, default=0) if version is None else version
    if number not in found:
        raise FileNotFoundError(f"{folder} has no version {number}")
    return spark.read.parquet(f"{folder}/data/{found[number]}")


def _claim(spark: SparkSession, folder: str, number: int, snapshot: str) -> int:
    target, files = _files(spark, f"{folder}/versions/{number}")
    beside, _ = _files(spark, f"{folder}/versions/.{uuid.uuid4().hex}")
    stream = files.create(beside, False)
    stream.write(bytearray(snapshot.encode()))
    stream.close()
    try:
        if files.getUri().getScheme() == "file":  # where renaming overwrites: a hard link doesn't
            nio = spark._jvm.java.nio.file
            place = lambda path: nio.Path.of(files.makeQualified(path).toUri())
            nio.Files.createLink(place(target), place(beside))
        elif not files.rename(beside, target):
            raise Conflict(f"version {number} of {folder} is there already")
    except (Py4JJavaError, CapturedException) as error:
        if "FileAlreadyExists" not in str(error):
            raise
        raise Conflict(f"version {number} of {folder} is there already") from error
    finally:
        files.delete(beside, False)
    return number


def publish(df: DataFrame, folder: str, expected: int) -> int:
    """Publishes df as version expected + 1; its number. Conflict if that is there, and nothing is changed then."""
    spark, snapshot = df.sparkSession, uuid.uuid4().hex
    if current(spark, folder) != expected:
        raise Conflict(f"{folder} is not at version {expected}")
    df.write.parquet(f"{folder}/data/{snapshot}")
    return _claim(spark, folder, expected + 1, snapshot)


def restore(spark: SparkSession, folder: str, version: int, expected: int) -> int:
    """Publishes an older version's snapshot as version expected + 1."""
    snapshot = versions(spark, folder).get(version)
    if snapshot is None:
        raise FileNotFoundError(f"{folder} has no version {version}")
    return _claim(spark, folder, expected + 1, snapshot)
