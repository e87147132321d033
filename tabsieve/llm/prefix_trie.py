"""Prefix trie of conversations: what a shared prefix saves, node by node.

Turns are numbered by a dictionary (dense ids over the distinct turns), so a
conversation is a list of numbers. Equal conversations become one row before
anything else. The distinct lists are sorted across the cluster and cut into
shards of about ``SHARD_TURNS`` turns; a shard is a stretch of the order, so a
trie node spans several shards only if it lies on the prefix that the last list
of one shard shares with the first list of the next.

Each shard builds a ternary search tree, inserting the median list first, then
the medians of both halves, so that siblings are balanced; one iterative
traversal lists the nodes and one backward pass adds up members, leaves and
savings. Nodes on shared prefixes ("boundary nodes", at most the shared depth
times the number of shards) come out with the part sums of their shard; Spark
adds the parts by node key, one small task adds them up along the prefixes, and
the nodes below take their parent from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.plans.lineage import materialize
from tabsieve.plans.ranking import cumulative_before

SHARD_TURNS = 1 << 16
ENDS_CHUNK = 1 << 16  # conversation ids joined in one cell
BASE = 100  # conversations of one hundred share a beginning in the report
BROADCAST_NODES = 200_000  # boundary nodes of about 60 bytes; more are joined by a shuffle
TURNS = "array<struct<id: bigint, chars: bigint>>"
NODE_SCHEMA = ("node_key binary, parent_key binary, conv_id long, depth int, parent_conv_id long, n_convs long, "
               "n_children long, n_leaves long, saved_tokens long, chars long, ends binary")
MERGED_SCHEMA = "node_key binary, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, " \
                "n_leaves long, saved_tokens long, ends binary"


def number_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the conversation's turns in order as (dictionary id,
    code points of the text). ``turns`` holds ``conv_id, turn, role, text``.

    A null turn number comes first; turns of one number follow each other by
    dictionary id, that is by the 128-bit key of role and text. A null role or
    text is empty. Rows without a conv_id take no part, repeated rows are
    turns of their own, other columns are not read. A conversation is one row
    of 16 bytes a turn from here on; texts never move."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat_ws(":", F.octet_length(role), role, text).cast("binary")))
    keyed = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"),
        F.char_length(text).cast("long").alias("chars"))
    keyed = materialize(keyed)
    # equal turns meet in partial aggregates first; a hot turn is a row per task
    distinct = keyed.groupBy("key").agg(F.min("chars").alias("chars"))
    numbered = cumulative_before(distinct, [F.col("key")]).select("key", F.col("cum_before").cast("long").alias("id"))
    coded = keyed.join(materialize(numbered), "key")
    listed = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("t"))
    return listed.select("conv_id", F.expr("transform(t, x -> struct(x.id as id, x.chars as chars))").alias("turns"))


def share_beginnings(lists: DataFrame, base: int = BASE) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation
    c - c % base, then its own after its first h; h = crc32(c) % 6."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    start = F.col("conv_id") - F.col("conv_id") % base
    first = lists.where(F.col("conv_id") % base == 0).select(
        F.col("conv_id").alias("first_id"), F.slice("turns", 1, 5).alias("first"))
    joined = lists.join(first, start == F.col("first_id"), "left")
    shared = F.coalesce(F.slice("first", F.lit(1), h), F.array().cast(TURNS))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(shared, own).alias("turns"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``key, conv_id`` -> ``key, low, n, ids`` with ids comma-joined,
    ``ENDS_CHUNK`` of them at most."""
    key, ids, out = None, [], []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
             pa.array(columns[3], pa.binary())], ["key", "low", "n", "ids"])

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or len(ids) == ENDS_CHUNK:
                if ids:
                    out.append((key, ids[0], len(ids), ",".join(map(str, ids)).encode()))
                    if len(out) >= 10_000 or len(ids) == ENDS_CHUNK:
                        yield flush()
                key, ids = k, []
            ids.append(c)
    if ids:
        out.append((key, ids[0], len(ids), ",".join(map(str, ids)).encode()))
    if out:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks -> ``low, n, ends`` per key; the hash is fed chunk by chunk."""
    key, low, n, state, out = None, 0, 0, None, []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
            ["low", "n", "ends"])

    for batch in batches:
        for k, first, count, ids in zip(*[batch.column(c).to_pylist() for c in range(4)]):
            if k != key:
                if state is not None:
                    out.append((low, n, state.digest()))
                    if len(out) >= 10_000:
                        yield flush()
                key, low, n, state = k, first, 0, hashlib.sha256()
            else:
                state.update(b",")
            n += count
            state.update(ids)
    if state is not None:
        out.append((low, n, state.digest()))
    if out:
        yield flush()


def distinct_lists(lists: DataFrame) -> DataFrame:
    """``turns, conv_id, n, ends``: each distinct list once, with its smallest
    conversation, their number and the SHA-256 of their ids. A list that very
    many conversations share is spread over tasks by conversation id; only its
    comma-joined ids, in chunks, pass through one task as a stream."""
    spark = lists.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = F.array_join(F.transform("turns", lambda t: t["id"].cast("string")), ",")
    keyed = lists.select(F.unhex(F.md5(ids.cast("binary"))).alias("key"), "conv_id")
    chunks = (keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
              .mapInArrow(_chunks, "key binary, low long, n long, ids binary"))
    digests = (chunks.repartition("key").sortWithinPartitions("key", "low")
               .mapInArrow(_digests, "low long, n long, ends binary"))
    return lists.join(digests, F.col("conv_id") == F.col("low")).select("turns", "conv_id", "n", "ends")


def shard_lists(distinct: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Adds ``shard`` (stretch of the order of ``turns`` with about
    ``shard_turns`` turns) and ``before`` / ``after``: how many turns the
    shard's first list shares with the list before it, its last list with the
    list after it (-1 where there is none)."""
    ranked = cumulative_before(distinct, [F.col("turns")], weight=F.size("turns").cast("long") + 1)
    sharded = materialize(ranked.select("turns", "conv_id", "n", "ends",
                                        F.floor(F.col("cum_before") / shard_turns).alias("shard")))
    # one row a shard: its ends, next to its neighbours' ends
    ends = sharded.groupBy("shard").agg(F.min("turns").alias("first"), F.max("turns").alias("last"))
    order = Window.orderBy("shard")
    ends = ends.select("shard", "first", "last", F.lag("last").over(order).alias("prior"),
                       F.lead("first").over(order).alias("next"))

    def shared(a: str, b: str) -> Column:
        same = F.zip_with(a, b, lambda x, y: x["id"].eqNullSafe(y["id"]))
        upto = F.array_position(same, F.lit(False)).cast("int") - 1
        return F.when(F.col(a).isNull() | F.col(b).isNull(), -1).when(upto < 0, F.size(a)).otherwise(upto)

    bounds = ends.select("shard", shared("prior", "first").alias("before"), shared("last", "next").alias("after"))
    # a hash join by shard would move the lists: the few bounds go to them
    return sharded.join(F.broadcast(bounds) if bounds.count() <= BROADCAST_NODES else bounds, "shard")


class TernaryTree:
    """Trie of number lists; the children of a node form a binary search tree
    (``low``, ``high``), ``equal`` leads to a node's children. Node 0 is the
    root of the trie and has no number."""

    def __init__(self) -> None:
        self.number, self.low, self.high, self.equal = [-1], [0], [0], [0]

    def _new(self, number: int) -> int:
        self.number.append(number)
        for links in (self.low, self.high, self.equal):
            links.append(0)
        return len(self.number) - 1

    def insert(self, numbers: list[int]) -> list[int]:
        """Nodes on the list's path, the root first."""
        low, high, equal, number = self.low, self.high, self.equal, self.number
        path, above = [0], 0
        for x in numbers:
            at = equal[above]
            if not at:
                at = equal[above] = self._new(x)
            while number[at] != x:
                side = low if x < number[at] else high
                if not side[at]:
                    side[at] = self._new(x)
                at = side[at]
            path.append(at)
            above = at
        return path

    def preorder(self) -> tuple[list[int], list[int], list[int]]:
        """``node, parent, depth`` lists, parents before children, iteratively."""
        nodes, parents, depths = [], [], []
        stack = [(0, -1, 0)]
        while stack:
            node, parent, depth = stack.pop()
            nodes.append(node)
            parents.append(parent)
            depths.append(depth)
            siblings = [self.equal[node]] if self.equal[node] else []
            while siblings:
                child = siblings.pop()
                stack.append((child, node, depth + 1))
                siblings += [s for s in (self.low[child], self.high[child]) if s]
        return nodes, parents, depths


def median_order(n: int) -> Iterator[int]:
    """0 to n-1, the middle first, then the middles of both halves."""
    ranges = [(0, n)]
    for a, b in ranges:
        if a < b:
            middle = (a + b) // 2
            yield middle
            ranges += [(a, middle), (middle + 1, b)]


def _child_key(key: bytes, number: int) -> bytes:
    return hashlib.md5(key + number.to_bytes(8, "little")).digest()


ROOT_KEY = hashlib.md5(b"").digest()


def trie_nodes(numbers: list[list[int]], chars: list[list[int]], low: list[int], n: list[int], ends: list[bytes],
               before: int, after: int) -> dict[str, list]:
    """Nodes of one shard's sorted distinct lists, as columns of NODE_SCHEMA.

    Boundary nodes (the root, the first ``before`` turns of the first list, the
    first ``after`` of the last) carry a key and the sums without themselves
    and without boundary nodes below; others are final, but for their parent
    when that is a boundary node (``parent_key``)."""
    tree = TernaryTree()
    paths: dict[int, list[int]] = {}
    last_node = [0] * len(numbers)
    size = [0]
    for k in median_order(len(numbers)):
        path = tree.insert(numbers[k])
        last_node[k] = path[-1]
        size.extend([0] * (len(tree.number) - len(size)))
        for node, c in zip(path[1:], chars[k]):
            size[node] = c
        if k in (0, len(numbers) - 1):
            paths[k] = path
    total = len(tree.number)
    members, smallest, end = [0] * total, [None] * total, [None] * total
    for k, node in enumerate(last_node):
        members[node], smallest[node], end[node] = n[k], low[k], ends[k]
    keys: dict[int, bytes] = {0: ROOT_KEY}
    for path, depth in ((paths[0], before), (paths[len(numbers) - 1], after)):
        for parent, node in zip(path[:depth], path[1:depth + 1]):
            keys[node] = _child_key(keys[parent], tree.number[node])
    nodes, parents, depths = tree.preorder()
    children, leaves, saved = [0] * total, [0] * total, [0] * total
    for node, parent in zip(reversed(nodes), reversed(parents)):
        if node not in keys:
            leaves[node] = leaves[node] or 1
            saved[node] += (members[node] - 1) * size[node]
        if parent < 0:
            continue
        members[parent] += members[node]
        if smallest[parent] is None or smallest[node] < smallest[parent]:
            smallest[parent] = smallest[node]
        if node not in keys:
            children[parent] += 1
            # sums stop at the next boundary node above, which passes nothing on
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    by = {"node_key": [keys.get(v) for v in nodes],
          "parent_key": [keys.get(p) for p in parents],
          "conv_id": [smallest[v] for v in nodes], "depth": depths,
          "parent_conv_id": [None if p < 0 or p in keys else smallest[p] for p in parents],
          "chars": [size[v] for v in nodes], "ends": [end[v] for v in nodes]}
    for name, values in (("n_convs", members), ("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved)):
        by[name] = [values[v] for v in nodes]
    return by


NODE_FIELDS = pa.schema([
    ("node_key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int32()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("chars", pa.int64()), ("ends", pa.binary())])


def _shard_nodes(shard: pa.Table) -> pa.Table:
    numbers, chars = shard.column("numbers").to_pylist(), shard.column("chars").to_pylist()
    by = sorted(range(len(numbers)), key=numbers.__getitem__)
    take = lambda c: [c[k] for k in by]
    columns = trie_nodes(take(numbers), take(chars), take(shard.column("conv_id").to_pylist()),
                         take(shard.column("n").to_pylist()), take(shard.column("ends").to_pylist()),
                         shard.column("before")[0].as_py(), shard.column("after")[0].as_py())
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in NODE_FIELDS}, schema=NODE_FIELDS)


def _merge_boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds boundary nodes, summed over shards, up along their prefixes."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    rows.sort(key=lambda r: -r["depth"])
    at = {r["node_key"]: r for r in rows}
    for r in rows:
        r["saved_tokens"] += (r["n_convs"] - 1) * r["chars"]
        r["n_leaves"] = r["n_leaves"] or 1
        above = at.get(r["parent_key"])
        if above:
            above["n_children"] += 1
            above["n_leaves"] += r["n_leaves"]
            above["saved_tokens"] += r["saved_tokens"]
    for r in rows:
        above = at.get(r["parent_key"])
        r["parent_conv_id"] = above["conv_id"] if above else None
    fields = [f for f in NODE_FIELDS if f.name not in ("parent_key", "chars")]
    yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in fields],
                                     schema=pa.schema(fields))


def prefix_trie(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie over ``conv_id, turns`` (see :func:`number_turns`):
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends`` (SHA-256 of the ids of conversations that end there, null if none).

    A conversation without turns is a member of the root only; an empty table
    has no nodes. Shards hold ``shard_turns`` turns and one conversation more."""
    sharded = shard_lists(distinct_lists(lists), shard_turns)
    cells = sharded.select(
        "shard", F.expr("turns.id").alias("numbers"), F.expr("turns.chars").alias("chars"), "conv_id", "n", "ends",
        "before", "after")
    nodes = materialize(cells.groupBy("shard").applyInArrow(_shard_nodes, NODE_SCHEMA))
    parts = nodes.where(F.col("node_key").isNotNull()).groupBy("node_key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("chars").alias("chars"), F.max("ends").alias("ends"))
    parts = parts.select(*[f.name for f in NODE_FIELDS if f.name != "parent_conv_id"]).coalesce(1)
    merged = materialize(parts.mapInArrow(_merge_boundary, MERGED_SCHEMA))
    above = merged.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("above_id"))
    if merged.count() <= BROADCAST_NODES:
        above = F.broadcast(above)
    inner = nodes.where(F.col("node_key").isNull()).join(above, "parent_key", "left")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_id"))
    return inner.select(*names).union(merged.select(*names))


def trie_report(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations, all numbers long, with
    ``ends_sha256`` in hexadecimal (none: hash of the empty text)."""
    nodes = prefix_trie(materialize(share_beginnings(number_turns(conversations))), shard_turns)
    none = hashlib.sha256(b"").hexdigest()
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                        "n_leaves", "saved_tokens", F.coalesce(F.lower(F.hex("ends")), F.lit(none)).alias("ends_sha256"))


REPORT_SQL = """
with bits as (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, step:
    case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end)) as t
), turn_rows as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos,
         coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
), convs as (
  select conv_id, xor(4294967295, list_reduce(
      list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda crc, b: xor(crc // 256, t[(xor(crc, b) % 256 + 1)::int]))) % 6 as h
  from (select distinct conv_id from conversations where conv_id is not null), bits
), rebuilt as (
  select c.conv_id, b.pos, b.role, b.text
  from convs c join turn_rows b on b.conv_id = c.conv_id - c.conv_id % 100 and b.pos <= c.h
  union all
  select c.conv_id, (select least(count(*), c.h) from turn_rows b where b.conv_id = c.conv_id - c.conv_id % 100)
                    + o.pos - c.h, o.role, o.text
  from convs c join turn_rows o on o.conv_id = c.conv_id and o.pos > c.h
), prefixes as (
  select conv_id, pos as depth, length(text) as chars,
         md5(string_agg(md5(length(role) || ':' || role || text), '' order by pos) over (
             partition by conv_id order by pos)) as node
  from rebuilt
  union all
  select conv_id, 0, 0, 'root' from convs
), last_of as (
  select conv_id, max(depth) as last from prefixes group by conv_id
), nodes as (
  select node, depth, min(p.conv_id) as conv_id, count(*) as n_convs, max(chars) as chars,
         coalesce(string_agg(p.conv_id::varchar, ',' order by p.conv_id) filter (depth = last), '') as ends
  from prefixes p join last_of using (conv_id) group by node, depth
), linked as (
  select n.*, up.node as parent, un.conv_id as parent_conv_id
  from nodes n left join prefixes up on up.conv_id = n.conv_id and up.depth = n.depth - 1
  left join nodes un on un.node = up.node
), counted as (
  select l.*, (select count(*) from linked c where c.parent = l.node) as n_children from linked l
), sums as (
  select up.node, sum((c.n_convs - 1) * c.chars) as saved_tokens, count(*) filter (c.n_children = 0) as n_leaves
  from counted c join prefixes up on up.conv_id = c.conv_id and up.depth <= c.depth group by up.node
)
select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) as ends_sha256
from counted join sums using (node)
"""
