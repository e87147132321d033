"""Pairwise sums of many columns in one scan.

A correlation needs five sums over the rows where both columns are present.
With a matrix Z of the values (absent cells zero) and P of ones where present,
the sums of all pairs are the blocks P'P, Z'P, (Z*Z)'P and Z'Z. A task folds its
Arrow batches into these blocks with numpy and sends one row per column, with an
array over the other columns; the rows of a column are added up as a stream.
What moves is four arrays per column and task, whatever the number of rows, and
no row is exploded into pairs (built-in aggregates would need one buffer per
pair and sum).

Values are shifted by the mean of the column's first thousand values, which
leaves correlations as they are and keeps the sums small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.columns import nan_to_null, quoted

SUMS = ("n", "sx", "sxx", "sxy")  # over rows where both are present; x is the row's column
BLOCK_SCHEMA = "i int, bad array<boolean>, " + ", ".join(f"{s} array<double>" for s in SUMS)
BATCH_ROWS = 1 << 14
FLAT = 1e-13  # variance below this share of the mean square is rounding


def _blocks(width: int, shift: Sequence[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), width, width))
        bad = np.zeros((width, width), dtype=bool)
        seen = False
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                seen = True
                z = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], axis=1).astype(np.float64) - shift
                p = ~np.isnan(z)
                endless = np.isinf(z)
                z[~p | endless] = 0.0
                if endless.any():  # an infinite value spoils the pairs whose row it is in
                    here = endless.astype(np.float64).T @ p > 0
                    bad |= here | here.T
                p = p.astype(np.float64)
                total[0] += p.T @ p
                total[1] += z.T @ p
                total[2] += (z * z).T @ p
                total[3] += z.T @ z
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array(list(bad), pa.list_(pa.bool_())),
                 *[pa.array(list(t), pa.list_(pa.float64())) for t in total]], ["i", "bad", *SUMS])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each column, which come one after another."""
    now, held = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), pa.array([held[0]], pa.list_(pa.bool_())),
             *[pa.array([h], pa.list_(pa.float64())) for h in held[1:]]], ["i", "bad", *SUMS])

    for batch in batches:
        for row in range(batch.num_rows):
            i = batch.column(0)[row].as_py()
            arrays = [batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in range(1, 2 + len(SUMS))]
            if i != now:
                if now is not None:
                    yield out()
                now, held = i, [np.array(a) for a in arrays]
            else:
                held[0] |= arrays[0]
                for h, a in zip(held[1:], arrays[1:]):
                    h += a
    if now is not None:
        yield out()


def gram_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, other_column, r`` for every ordered pair of numeric columns.
    Rows count for a pair where both are present (NaN is absent); r is null
    without variation, NaN with an infinite value among them."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    values = df.select(*[nan_to_null(quoted(c), fields[c]).cast("double").alias(f"_{k}") for k, c in enumerate(columns)])
    names = [f"_{k}" for k in range(len(columns))]
    some = values.limit(1000).agg(*[F.avg(F.when(F.abs(n) < float("inf"), F.col(n))).alias(n) for n in names]).first()
    shift = np.array([some[n] or 0.0 for n in names])
    parts = min(len(columns), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = (values.mapInArrow(_blocks(len(columns), shift), BLOCK_SCHEMA).repartition(parts, "i")
            .sortWithinPartitions("i").mapInArrow(_added, BLOCK_SCHEMA))
    # sums of a pair seen from its other side: a matrix of one cell per pair, turned over
    cells = sums.select("i", F.posexplode(F.arrays_zip("n", "sx", "sxx", "sxy", "bad")).alias("j", "s")).select("i", "j", "s.*")
    turned = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    both = cells.where("i <> j").join(turned, ["i", "j"])
    mx, my = F.try_divide("sx", "n"), F.try_divide("sy", "n")

    def variance(squares: str, mean: Column) -> Column:
        v = F.try_divide(squares, "n") - mean * mean
        return F.when(v > F.lit(FLAT) * F.try_divide(squares, "n"), v)

    r = F.try_divide(F.try_divide("sxy", "n") - mx * my, F.sqrt(variance("sxx", mx)) * F.sqrt(variance("syy", my)))
    titles = F.array(*[F.lit(c) for c in columns])
    return both.select(F.get(titles, F.col("i")).alias("column"), F.get(titles, F.col("j")).alias("other_column"),
                       F.when(F.col("bad"), F.lit(float("nan"))).when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r).alias("r"))
