"""SimHash near-duplicate groups through BK-trees.

1. One Arrow pass turns each whole text into a 64-bit fingerprint.
2. Equal fingerprints collapse to one node (with the smallest doc_id).
3. Nodes are dealt into shards that cannot separate a linked pair: of
   ``radius + 1`` bit blocks two fingerprints within the radius share at
   least one, and with it every prefix of it. A shard is a prefix value, the
   shortest that leaves about ``shard_limit / 2`` nodes, so the trees below
   are as large as a task may search. Where fingerprints crowd, the prefix
   grows by ``PREFIX_STEP`` bits up to the whole block; a block value that is
   still above ``shard_limit`` is divided by the blocks of its remaining bits,
   which is exact for the same reason, until it fits (8 bits left: 256
   fingerprints at most). No pair is lost, no shard is capped.
4. Each shard becomes a BK-tree whose children are keyed by their Hamming
   distance to the parent; a lookup follows only the edges within the radius.
   A fingerprint is looked up before it is added, and only links that join
   two groups of the shard are given out (one per node at most).
5. Connected components of those links.

The shard trees stay where their fingerprints are instead of being broadcast:
together they hold a fingerprint of every document, which has no size bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.llm.components import connected_components
from tabsieve.plans.lineage import materialize

SEED = 42
BITS = 64
PREFIX_STEP = 4


def simhash(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of a UTF-8 text: majority bit over the XXH64 of its word
    shingles, repeats included; no word gives 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Signed 64-bit fingerprint column; a null text counts as empty."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            prints = np.array([simhash(b"" if t is None else t.encode(), shingle) for t in batch], dtype=np.uint64)
            yield pd.Series(prints.view(np.int64))

    return run(text)


class BKTree:
    """BK-tree in flat lists; ``edges[i]`` maps distance -> child position."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of all values within ``radius``."""
        if not self.values:
            return []
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            children = self.edges[at]
            if children:
                stack.extend(children[k] for k in range(d - radius, d + radius + 1) if k in children)
        return found

    def add(self, value: int) -> None:
        """Adds a value that the tree does not hold yet."""
        self.values.append(value)
        self.edges.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            d = (self.values[at] ^ value).bit_count()
            at = self.edges[at].setdefault(d, new)


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    tree, parent, links = BKTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        parent.append(i)
        for j in tree.near(value, radius):
            a, b = root(i), root(j)
            if a != b:
                links.append((values[i], values[j]))
                parent[max(a, b)] = min(a, b)
        tree.add(value)
    return links


def _masks(radius: int, level: int) -> tuple[list[int], int]:
    """Fixed bits of every shard path of a level (signed 64-bit masks), and
    the most bits that are still free in any of them."""
    paths = [(0, list(range(BITS)))]
    for _ in range(level + 1):
        longer = []
        for mask, free in paths:
            cut = [len(free) * k // (radius + 1) for k in range(radius + 2)]
            for k in range(radius + 1):
                block = free[cut[k]:cut[k + 1]]
                longer.append((mask | sum(1 << b for b in block), free[:cut[k]] + free[cut[k + 1]:]))
        paths = longer
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m, _ in paths], max(len(f) for _, f in paths)


def _prefix_masks(radius: int, bits: int) -> list[int]:
    """The first ``bits`` bits of every block (signed 64-bit masks)."""
    cut = [BITS * k // (radius + 1) for k in range(radius + 2)]
    masks = [sum(1 << b for b in range(cut[k], min(cut[k] + bits, cut[k + 1]))) for k in range(radius + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def bk_shards(prints: DataFrame, radius: int = 2, shard_limit: int = 2048) -> DataFrame:
    """``level, path, shard, fp``: the fingerprints of every tree (two at least)."""
    block = -(-BITS // (radius + 1))
    n = prints.count()
    bits = min(block, max(0, (-(-2 * n // shard_limit) - 1).bit_length()))
    first = [*range(bits, block, PREFIX_STEP), block]
    pending = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("path"))
    parts, deeper, last = [], 0, False
    for level in range(len(first) + BITS):
        if level < len(first):
            masks = _prefix_masks(radius, first[level])
        else:
            deeper += 1
            masks, free = _masks(radius, deeper)
            last = free <= 8  # 256 fingerprints at most
            start = F.col("path") * (radius + 1)
            pending = pending.select("fp", F.explode(F.sequence(start, start + radius)).alias("path"))
        mask = F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), F.col("path") + 1)
        keyed = pending.withColumn("shard", F.col("fp").bitwiseAND(mask))
        sizes = materialize(keyed.groupBy("path", "shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        shared = materialize(keyed.join(sizes, ["path", "shard"]).select("fp", "path", "shard", "n"))
        large = F.lit(False) if last else F.col("n") > shard_limit
        parts.append(shared.where(~large).select(F.lit(level).alias("level"), "path", "shard", "fp"))
        pending = shared.where(large).select("fp", "path")
        if last or pending.isEmpty():
            break
    shards = parts[0]
    for more in parts[1:]:
        shards = shards.union(more)
    return shards


def near_links(prints: DataFrame, radius: int = 2, shard_limit: int = 2048) -> DataFrame:
    """``fp`` (distinct) -> ``u, v`` links whose components are those of the
    graph of all pairs within ``radius`` bits."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, run, out = None, [], []

        def flush() -> pa.RecordBatch:
            u = pa.array([a - (1 << 64) if a >> 63 else a for a, _ in out], pa.int64())
            v = pa.array([b - (1 << 64) if b >> 63 else b for _, b in out], pa.int64())
            return pa.RecordBatch.from_arrays([u, v], ["u", "v"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for *this, fp in zip(*cols, strict=True):
                if this != key:
                    out.extend(shard_links(run, radius))
                    key, run = this, []
                run.append(fp & ((1 << 64) - 1))
            if len(out) > 10_000:
                yield flush()
                out.clear()
        out.extend(shard_links(run, radius))
        yield flush()

    shards = bk_shards(prints, radius, shard_limit)
    return (shards.repartition("level", "path", "shard").sortWithinPartitions("level", "path", "shard", "fp")
            .mapInArrow(trees, "u long, v long"))


def group_labels(prints: DataFrame, radius: int = 2, shard_limit: int = 2048) -> DataFrame:
    """``fp`` rows -> ``fp, label``: every distinct fingerprint once, with one
    label per component of the link graph."""
    nodes = materialize(prints.select("fp").distinct())
    roots = connected_components(near_links(nodes, radius, shard_limit))
    return materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("label")))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, shard_limit: int = 2048) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per document.

    Null and empty texts have fingerprint zero and link like any other;
    repeated rows stay repeated; a null doc_id keeps its row and gets its
    group's smallest non-null id (null if there is none). Columns other than
    ``doc_id`` and ``text`` are not read."""
    prints = materialize(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")))
    labels = group_labels(prints, radius, shard_limit)
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(labels, "fp")
    lowest = lowest.groupBy("label").agg(F.min("first_id").alias("component_id"))
    groups = materialize(labels.join(lowest, "label").select("fp", "component_id"))
    return prints.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """All columns of one document per near-duplicate group: the smallest
    doc_id, nulls last; among rows that share it, the smallest row hash; of
    rows equal in every column, one. Texts are read twice and shuffled once,
    in the final join."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*names).alias("row"), F.xxhash64(*names, *[c.isNull() for c in names]).alias("tag"))
    rows = whole.select("row", F.col("row.doc_id").alias("id"), "tag")
    keys = materialize(rows.select("id", "tag", fingerprint(F.col("row.text"), shingle).alias("fp")))
    labels = group_labels(keys, radius)
    counted = keys.groupBy("id", "tag", "fp").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag", "n")).alias("w")
    winners = materialize(counted.join(labels, "fp").groupBy("label").agg(first).select("w.id", "w.tag", "w.n"))

    def kept(some: DataFrame) -> DataFrame:
        same = F.col("r.id").eqNullSafe(F.col("w.id")) & (F.col("r.tag") == F.col("w.tag"))
        return rows.alias("r").join(some.alias("w"), same, "left_semi")

    once, again = kept(winners.where("n = 1")), kept(winners.where("n > 1")).dropDuplicates(["id", "tag"])
    return once.union(again).select("row.*")
