"""Prefix trie against a brute-force trie, with shards so small that most nodes lie on boundaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tabsieve.llm import prefix_trie

from .helpers import save

SCHEMA = "conv_id long, turn long, role string, text string, depth int, ends string"


def slow_lists(rows):
    """conv_id -> rebuilt (role, text) lists."""
    own = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).digest()
            own[conv_id].append((turn is not None, turn or 0, key, (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(c / abs(c) * (abs(c) % 100)) if c else 0, [])
        out[c] = tuple(base[:h] + turns[h:])
    return out


def slow_trie(lists):
    members = defaultdict(list)
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[b] for b in below) or 1
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[b] for b in below)
    out = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if lists[c] == node)
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table_rows(seed=5, n=260):
    rng = random.Random(seed)
    words = ["hi", "héllo 🙂", "", "a longer answer, with words", None, "no"]
    rows = []
    for c in rng.sample(range(-150, 700), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 7, 30])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(words), 9, "x"))
    rows += [(c, t, "user", "hi", 1, "y") for c in range(2000, 2060) for t in range(6)]  # copies
    rows += [(5000, None, "system", "first", 0, ""), (5000, 3, "user", "x", 0, ""), (5000, 3, "user", "w", 0, ""),
             (5000, 3, "user", "w", 0, ""), (None, 0, "user", "lost", 0, ""), (5001, -4, None, None, 0, "")]
    rows += [(7000, t, "user", str(t % 7), 0, "") for t in range(1500)]  # a long conversation and its long copy
    rows += [(7001, t, "user", str(t % 7) if t < 1490 else "other", 0, "") for t in range(1500)]
    rng.shuffle(rows)
    return rows


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("shard_turns", [prefix_trie.SHARD_TURNS, 60, 1])
def test_report_matches_brute_force(spark, shard_turns, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS_CHUNK", 7)
    rows = [r for r in table_rows() if shard_turns > 1 or r[0] is None or r[0] < 300]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(prefix_trie.trie_report(docs, shard_turns)) == slow_trie(slow_lists(rows))


def test_shuffle_joins_replace_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_NODES", 0)
    rows = table_rows(6, 120)
    out = prefix_trie.trie_report(spark.createDataFrame(rows, SCHEMA), 200)
    assert found(out) == slow_trie(slow_lists(rows))


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie_report(empty).count() == 0
    # crc32("3") % 6 is above 0 and conversation 0 is missing: no turn is left
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    one = spark.createDataFrame([(c, 0, "user", "hi", 0, "")], SCHEMA)
    ends = hashlib.sha256(str(c).encode()).hexdigest()
    assert found(prefix_trie.trie_report(one)) == [(c, 0, None, 1, 0, 1, 0, ends)]


def test_equal_hashes_of_role_and_text_do_not_mix(spark):
    rows = [(1, 0, "a", "b:c", 0, ""), (2, 0, "a:b", "c", 0, "")]
    lists = {r["conv_id"]: r["turns"] for r in prefix_trie.number_turns(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert lists[1][0]["id"] != lists[2][0]["id"]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_medians_balance_the_tree(n):
    order = list(prefix_trie.median_order(n))
    assert sorted(order) == list(range(n))
    tree = prefix_trie.TernaryTree()
    for k in order:
        tree.insert([k])
    depth, level = 0, [tree.equal[0]] if n else []
    while level:
        depth += 1
        level = [s for v in level for s in (tree.low[v], tree.high[v]) if s]
    assert depth <= max(0, n.bit_length())


def test_sql_twin(spark, tmp_path):
    rows = [r for r in table_rows() if r[1] is not None and r[0] != 5000]
    folder = save(spark, spark.createDataFrame(rows, SCHEMA), tmp_path, "conversations")
    with duckdb.connect() as db:
        db.execute(f"create view conversations as select * from read_parquet('{folder}/conversations.parquet/*.parquet')")
        assert sorted(db.execute(prefix_trie.REPORT_SQL).fetchall(), key=str) == slow_trie(slow_lists(rows))
