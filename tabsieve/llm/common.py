"""Shared small pieces of the training-data operators.

Words are maximal runs of anything but the six ASCII white-space characters.
``bytes.split()`` in Python and :data:`WORD` in Java agree on that exactly,
and ``bytes.lower()`` and :func:`lower_ascii` both fold A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as
    the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow text column; null becomes the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, max_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``max_bytes`` at most (one
    row at least); keeps a worker's memory bounded when texts are long."""
    parts = max(1, min(batch.num_rows, -(-batch.nbytes // max_bytes)))
    step = -(-batch.num_rows // parts) if batch.num_rows else 1
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)
