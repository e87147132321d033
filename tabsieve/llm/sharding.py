"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents with one text form a group that must stay whole; the law is
``bytes``: shard sizes as near equal as the groups allow. Differencing keeps a
heap of partial partitions and repeatedly merges the two with the largest
spread, largest slot onto smallest slot.

The heap never sees all groups at once. Groups too large to be averaged out
(by the total, a bounded number of them) stay single. The others are dealt by
hash into bounded chunks and, inside a chunk, into classes of one half, one
quarter, one eighth and so on of the rows; differencing makes each class a few
bundles, so bundles of all sizes come out, and bundles are bundled again until
one bounded chunk is left. That last chunk, large groups included, is
differenced into the shards: large pieces level each other, the smallest
bundles fill what is left. Each round moves group hashes and sizes only; texts
are read once.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.plans.lineage import materialize
from tabsieve.plans.ranking import cumulative_before

CHUNK = 8192
SLOTS_PER_SHARD = 50
CLASSES = 10
ROW_BYTES = 16


def difference(sizes: Sequence[int], parts: int) -> np.ndarray:
    """Part number (0-based) of every item, by largest differencing."""
    n = len(sizes)
    if parts == 1 or n == 0:
        return np.zeros(n, dtype=np.int32)
    # a node holds its slot sums in falling order, smallest shifted to zero
    sums: list[np.ndarray | None] = []
    heap = []
    for i, s in enumerate(sizes):
        slots = np.zeros(parts, dtype=np.int64)
        slots[0] = s
        sums.append(slots)
        heap.append((-int(s), i))
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []  # left, right, order of the new slots
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joint = sums[a] + sums[b][::-1]
        order = np.argsort(-joint, kind="stable")
        joint = joint[order]
        joint -= joint[-1]
        sums[a] = sums[b] = None
        merged.append((a, b, order))
        sums.append(joint)
        heapq.heappush(heap, (-int(joint[0]), n + len(merged) - 1))
    # from the root down: where each slot of a node ends up
    place: dict[int, np.ndarray] = {n + len(merged) - 1: np.arange(parts)}
    for k in range(len(merged) - 1, -1, -1):
        a, b, order = merged[k]
        at = place.pop(n + k)
        final = np.empty(parts, dtype=np.int64)
        final[order] = at
        place[a], place[b] = final, final[::-1]
    return np.array([place[i][0] for i in range(n)], dtype=np.int32)


def _bundled(items: DataFrame, parts: int) -> DataFrame:
    """``chunk, item, bytes`` -> the same with ``part`` in each chunk."""

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values(["bytes", "item"], ascending=[False, True])
        return chunk.assign(part=difference(chunk["bytes"].tolist(), parts))

    return items.groupBy("chunk").applyInPandas(run, "chunk long, item binary, bytes long, part int")


def assign_groups(groups: DataFrame, shards: int, chunk: int = CHUNK) -> DataFrame:
    """``item`` (binary key), ``bytes`` -> ``item, shard``."""
    total, count = groups.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    if not count:
        return groups.select("item", F.lit(0).alias("shard"))
    singles = min(shards * SLOTS_PER_SHARD, chunk // 4)  # more of them cannot be this large
    large = F.col("bytes") * singles >= F.lit(total)
    paths: list[DataFrame] = []  # item -> bundle, per round
    items, n = groups.select("item", "bytes"), count
    classes = max(1, min(CLASSES, chunk.bit_length() - 4))  # the smallest class still has a few rows a chunk
    while n > chunk:
        chunks = -(-n // (chunk // 2))
        bundles = max(2, chunk // 2 // (chunks * classes))  # two at least, so that every class is differenced
        part = F.pmod(F.xxhash64("item", F.lit(len(paths))), F.lit(chunks)) * classes
        low = F.pmod(F.xxhash64("item", F.lit("class")), F.lit(1 << (classes - 1)))  # class c: 2 ** -(c + 1) of all
        scale = F.when(low == 0, classes - 1).otherwise(F.floor(F.lit(classes - 1) - F.log2(low + 0.5)))
        dealt = items.where(~large).withColumn("chunk", part + scale.cast("long"))
        dealt = materialize(_bundled(dealt.select("chunk", "item", "bytes"), bundles))
        name = F.unhex(F.md5(F.concat_ws("/", F.lit(len(paths)), "chunk", "part").cast("binary")))
        paths.append(dealt.select("item", name.alias("bundle")))
        made = dealt.groupBy(name.alias("item")).agg(F.sum("bytes").alias("bytes"))
        items = materialize(items.where(large).union(made))
        n = items.count()
    out = _bundled(items.select(F.lit(0).cast("long").alias("chunk"), "item", "bytes"), shards)
    out = materialize(out.select("item", F.col("part").alias("shard")))
    for path in reversed(paths):
        inside = path.join(out.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard")
        single = out.join(path.select(F.col("bundle").alias("item")).distinct(), "item", "left_anti")
        out = materialize(inside.union(single))
    return out


def shard_documents(docs: DataFrame, shards: int = 40, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per
    document. A null text has no bytes and shares a group with the empty
    text. Repeated rows and null ids stay and get slots of their own. Other
    columns are not read."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = materialize(docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("item")))
    groups = materialize(rows.groupBy("item").agg(F.sum("size").alias("bytes")))
    shard_of = assign_groups(groups, shards, chunk)
    # the row tag tells equal rows apart, so that a crowd of them is no single slice
    placed = rows.withColumn("tag", F.monotonically_increasing_id()).join(shard_of, "item")
    placed = cumulative_before(placed, [F.col("item"), F.col("doc_id"), F.col("tag")], ["shard"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("cum_before").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
