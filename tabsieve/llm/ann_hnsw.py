"""Approximate nearest neighbours: one navigable small-world graph per shard.

Equal vectors are one entry of the index, which keeps the smallest ids that
can be wanted of it, so a vector that very many rows share is one node and not
a clique. Entries are dealt by hash into shards of bounded size. A shard's
graph is built in one task and stored as flat neighbour arrays, one row per
shard; bounded blocks of queries then meet every shard by key, and the
shards' best are merged per query. Scores are computed in double precision
from the original vectors.

Vectors that are null, zero, or hold a null or non-finite component take no
part. Vectors meet only vectors of their own length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.plans.lineage import materialize

LINKS = 16  # per node above the ground layer; twice as many on it
BUILD_WIDTH, SEARCH_WIDTH = 64, 160
SHARD_SIZE, QUERY_BLOCK = 8192, 4096


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the power of two taken out first keeps
    very large and very small components exact."""
    v = np.asarray(vectors, dtype=np.float64)
    if not v.size:
        return v
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Graph:
    """Hierarchical navigable small-world graph over unit vectors.

    Nodes are ordered by falling level, so layer ``l`` holds nodes
    ``0 .. len(near[l]) - 1`` and each layer is one dense neighbour array
    (-1 where a slot is free)."""

    def __init__(self, vectors: np.ndarray, near: list[np.ndarray]) -> None:
        self.vectors, self.near = vectors, near
        self.seen, self.tick = np.zeros(len(vectors), dtype=np.int32), 0

    @classmethod
    def levels(cls, n: int, seed: int = 7) -> np.ndarray:
        draw = np.random.default_rng(seed).random(n)
        return np.sort((-np.log(1.0 - draw) / np.log(LINKS)).astype(int))[::-1]

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        n = len(vectors)
        level = cls.levels(n)
        top = int(level[0]) if n else 0
        near = [np.full((int((level >= k).sum()), LINKS * (1 if k else 2)), -1, dtype=np.int32) for k in range(top + 1)]
        graph = cls(np.ascontiguousarray(vectors, dtype=np.float32), near)
        sims = [np.full(a.shape, -np.inf, dtype=np.float32) for a in near]
        for node in range(1, n):
            q = graph.vectors[node]
            start = [(float(graph.vectors[0] @ q), 0)]
            for k in range(top, -1, -1):
                if k > level[node]:
                    start = graph._walk(q, start, 1, k)
                    continue
                found = graph._walk(q, start, BUILD_WIDTH, k)
                for s, other in graph._spread(found, LINKS):
                    graph._link(sims, k, node, other, s)
                    graph._link(sims, k, other, node, s)
                start = found
        return graph

    def _link(self, sims: list[np.ndarray], layer: int, a: int, b: int, s: float) -> None:
        row = sims[layer][a]
        at = int(row.argmin())
        if row[at] < s:
            if row[at] == -np.inf:
                row[at], self.near[layer][a, at] = s, b
                return
            # full: of all neighbours and the new one, keep the diverse ones
            pool = [*zip(row.tolist(), self.near[layer][a].tolist(), strict=True), (s, b)]
            pool.sort(key=lambda x: -x[0])
            kept = self._spread(pool, len(row))
            row[:], self.near[layer][a] = -np.inf, -1
            for i, (sim, other) in enumerate(kept):
                row[i], self.near[layer][a, i] = sim, other

    def _spread(self, found: list[tuple[float, int]], limit: int) -> list[tuple[float, int]]:
        """Neighbours nearest first that are nearer to the node than to any
        neighbour taken before; the others fill up what is left."""
        if len(found) <= limit // 2:
            return found
        ids = np.fromiter((i for _, i in found), dtype=np.int64, count=len(found))
        own = np.fromiter((s for s, _ in found), dtype=np.float32, count=len(found))
        vectors = self.vectors[ids]
        close = np.zeros(len(found), dtype=bool)
        between = vectors @ vectors.T > own[:, None]
        taken = []
        for i in range(len(found)):
            if not close[i]:
                taken.append(i)
                close |= between[:, i]
                if len(taken) == limit:
                    break
        if len(taken) < limit:
            rest = [i for i in range(len(found)) if i not in set(taken)]
            taken += rest[:limit - len(taken)]
        return [found[i] for i in taken]

    def _walk(self, q: np.ndarray, start: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """Best-first search of one layer; ``width`` best, nearest first."""
        self.tick += 1
        tick, seen, near, vectors = self.tick, self.seen, self.near[layer], self.vectors
        best = [(s, i) for s, i in start[:width]]
        heapq.heapify(best)
        todo = [(-s, i) for s, i in best]
        heapq.heapify(todo)
        for _, i in best:
            seen[i] = tick
        while todo:
            s, node = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            around = near[node]
            around = around[around >= 0]
            around = around[seen[around] != tick]
            if not len(around):
                continue
            seen[around] = tick
            sims = vectors[around] @ q
            if len(best) >= width:
                good = sims > best[0][0]
                around, sims = around[good], sims[good]
            for s, i in zip(sims.tolist(), around.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (s, i))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, i))
                else:
                    continue
                heapq.heappush(todo, (-s, i))
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, width: int) -> list[int]:
        """Nodes found for a unit vector, nearest first."""
        if not len(self.vectors):
            return []
        q = q.astype(np.float32)
        start = [(float(self.vectors[0] @ q), 0)]
        for k in range(len(self.near) - 1, 0, -1):
            start = self._walk(q, start, 1, k)
        return [i for _, i in self._walk(q, start, width, 0)]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` (array of double), with the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select("vec_id", v.alias("v")).where("v is not null and vec_id is not null")
    return rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def build_index(vectors: DataFrame, keep_ids: int, shard_size: int = SHARD_SIZE) -> DataFrame:
    """``vec_id, v`` rows -> one row per shard: ``dim, shard, n, vectors, ids,
    layers`` (flat arrays). Every distinct vector is a node and carries its
    ``keep_ids`` smallest ids."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    lowest = vectors.withColumn("rank", rank).where(F.col("rank") <= keep_ids)
    nodes = materialize(lowest.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    per_dim = nodes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    per_dim = per_dim.withColumn("shards", F.ceil(F.col("n") / shard_size))
    dealt = nodes.withColumn("dim", F.size("v")).join(F.broadcast(per_dim), "dim")  # a row per vector length
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        original = np.array(rows["v"].tolist(), dtype=np.float64)
        order = np.lexsort(original.T[::-1])  # the same graph whatever the order of arrival
        order = order[np.random.default_rng(11).permutation(len(order))]
        original = original[order]
        graph = Graph.build(unit(original))
        lists = [rows["ids"].iloc[i] for i in order]
        return pd.DataFrame({
            "dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "n": [len(rows)],
            "vectors": [original.tobytes()], "ids": [np.concatenate(lists).astype(np.int64).tobytes()],
            "ends": [np.cumsum([len(x) for x in lists]).astype(np.int64).tobytes()],
            "layers": [[a.tobytes() for a in graph.near]]})

    return dealt.select("dim", "shard", "v", "ids").groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard long, n long, vectors binary, ids binary, ends binary, layers array<binary>")


def search_index(queries: DataFrame, index: DataFrame, k: int, width: int = SEARCH_WIDTH,
                 block: int = QUERY_BLOCK) -> DataFrame:
    """``vec_id, v`` queries against every shard: ``query_id, vec_id, score``,
    the ``k`` best of each shard without the query's own row."""
    shards = materialize(index.groupBy("dim").agg(F.collect_list("shard").alias("shards")))
    blocks = max(1, -(-queries.count() // block))
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"),
                           F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
    asked = asked.join(shards, "dim").withColumn("shard", F.explode("shards")).drop("shards")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            shard = held.iloc[0]
            dim = int(shard["dim"])
            original = np.frombuffer(shard["vectors"], np.float64).reshape(-1, dim)
            near = [np.frombuffer(a, np.int32).reshape(-1, LINKS * (1 if i else 2)) for i, a in enumerate(shard["layers"])]
            exact = unit(original)
            graph = Graph(np.ascontiguousarray(exact, dtype=np.float32), near)
            ids, ends = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["ends"], np.int64)
            wanted = unit(np.array(asked["v"].tolist(), dtype=np.float64))
            for query_id, q in zip(asked["query_id"], wanted, strict=True):
                nodes = graph.search(q, max(width, k + 1))
                scores = (exact[nodes] * q).sum(axis=1)
                rows = [(-s, int(i)) for s, node in zip(scores.tolist(), nodes, strict=True)
                        for i in ids[ends[node - 1] if node else 0:ends[node]] if i != query_id]
                out += [(query_id, i, -s) for s, i in sorted(rows)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return asked.groupBy("dim", "shard", "block").cogroup(held.groupBy("dim", "shard", "block")).applyInPandas(
        search, "query_id long, vec_id long, score double")


def nearest_neighbours(vectors: DataFrame, k: int = 5, every: int = 50, shard_size: int = SHARD_SIZE,
                       width: int = SEARCH_WIDTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible
    by ``every`` its ``k`` nearest other rows found by cosine, ties to the
    smaller id; fewer where there are not as many. Rows without an id take no
    part. Rows that repeat an id are one candidate per distinct vector; a
    repeated query id is asked once, with its smallest vector."""
    rows = usable(vectors)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialize(asked)
    index = materialize(build_index(rows.dropDuplicates(["vec_id", "v"]), k + 1, shard_size))
    found = search_index(asked, index, k, width)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
