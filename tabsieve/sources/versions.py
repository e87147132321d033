"""Sink published in one step (S3).

A target is a folder of versions and a folder of markers::

    sales.parquet/_v-<id>/part-...        one complete write each
    sales.parquet/_published/<number>.<id>

A version is written in full under its own name, then published by creating one
empty marker file, which a store does in one step. Readers take the version of
the greatest marker. Nothing is renamed or overwritten, so at no moment is the
target missing or half new, and a writer that dies before the marker leaves the
current version in place; its leftover is removed by a later publication.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MARKERS = "_published"
PREFIX = "_v-"
LEFTOVER_MS = 24 * 3600 * 1000
KEEP = 2  # versions: the current one, and the one that readers may still be reading


def _markers(spark: SparkSession, path: str) -> list[str]:
    from tabsieve.sources.tables import hadoop_path
    fs, folder = hadoop_path(spark, f"{path}/{MARKERS}")
    if not fs.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if not s.getPath().getName().startswith("."))


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the published version; None where ``path`` holds none."""
    found = _markers(spark, path.rstrip("/"))
    return f"{path.rstrip('/')}/{PREFIX}{found[-1].split('.', 1)[1]}" if found else None


def _publish(spark: SparkSession, path: str, version: str) -> None:
    """The one step: an empty file with the next number."""
    from tabsieve.sources.tables import hadoop_path
    found = _markers(spark, path)
    number = int(found[-1].split(".", 1)[0]) + 1 if found else 1
    fs, marker = hadoop_path(spark, f"{path}/{MARKERS}/{number:012d}.{version}")
    fs.create(marker, False).close()


def _tidy(spark: SparkSession, path: str, keep: int) -> None:
    """Deletes all but the last ``keep`` published versions, and unpublished
    leftovers that no writer has touched for ``LEFTOVER_MS``."""
    from tabsieve.sources.tables import hadoop_path
    found = _markers(spark, path)
    for name in found[:-keep]:
        for old in (f"{MARKERS}/{name}", PREFIX + name.split(".", 1)[1]):
            fs, place = hadoop_path(spark, f"{path}/{old}")
            fs.delete(place, True)
    kept = {PREFIX + name.split(".", 1)[1] for name in found[-keep:]}
    fs, folder = hadoop_path(spark, path)
    now = time.time() * 1000
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(PREFIX) and name not in kept and now - status.getModificationTime() > LEFTOVER_MS:
            fs.delete(status.getPath(), True)


def _check_folder(spark: SparkSession, path: str) -> None:
    from tabsieve.sources.tables import hadoop_path
    fs, folder = hadoop_path(spark, path)
    if fs.exists(folder) and fs.getFileStatus(folder).isFile():
        raise NotADirectoryError(f"{path} is a single file; publish to another path")


def publish_written(spark: SparkSession, path: str, write: Callable[[str], object], keep: int = KEEP) -> str:
    """Lets ``write`` fill the folder it is given and makes that the current
    version of ``path``. If ``write`` raises (a failed job, a verified scan that
    read other data than expected), the current version stays.

    With two writers at once both versions are complete and the greater marker
    wins. A plain folder of files at ``path`` is no longer seen by
    :func:`tables.read_table` after the first publication and is left alone."""
    from tabsieve.sources.tables import hadoop_path
    path = path.rstrip("/")
    _check_folder(spark, path)
    version = uuid.uuid4().hex
    target = f"{path}/{PREFIX}{version}"
    try:
        write(target)
    except Exception:
        fs, folder = hadoop_path(spark, target)
        fs.delete(folder, True)
        raise
    _publish(spark, path, version)
    _tidy(spark, path, keep)
    return target


def publish_table(df: DataFrame, path: str, fmt: str = "parquet", keep: int = KEEP) -> str:
    """Writes ``df`` as the next version of ``path`` and makes it current."""
    from tabsieve.sources.tables import save_files
    return publish_written(df.sparkSession, path, lambda target: save_files(df, target, fmt), keep)
