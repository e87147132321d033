"""Lineage cuts.

A frame whose partition ids feed two branches of one plan (see
``ranking.cumulative_before``) must be computed once. We use a reliable
checkpoint in the shared folder the cluster names in ``spark.checkpoint.dir``;
without one (e.g. a notebook without shared storage) the frame is persisted,
which recomputes lost blocks from the same shuffle dependency and therefore
reproduces the same partition ids.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    return None


_persisted: list[DataFrame] = []


def materialize(df: DataFrame) -> DataFrame:
    if checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=True)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _persisted.append(kept)
    return kept


def release_materialized() -> int:
    """Unpersist the frames kept by :func:`materialize` when no checkpoint
    folder was configured (call once their results are consumed). Checkpoint
    files are removed by Spark's cleaner when
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on."""
    n = len(_persisted)
    while _persisted:
        _persisted.pop().unpersist()
    return n
