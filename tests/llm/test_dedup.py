"""SimHash groups and line dedup against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tabsieve.llm import line_dedup, simhash_dedup
from tabsieve.llm.components import connected_components

from .helpers import documents, empty, rows

BLANK = " \t\n\x0b\x0c\r"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, radius=2):
    """Component number of every fingerprint, by comparing all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_near_duplicates_match_all_pairs(spark):
    expected = Counter()
    prints = [(r[0], slow_fingerprint(r[1])) for r in rows()]
    label = slow_groups([p for _, p in prints])
    lowest = defaultdict(list)
    for i, p in prints:
        if i is not None:
            lowest[label[p]].append(i)
    for i, p in prints:
        expected[i, f"{p:016x}", min(lowest[label[p]], default=None)] += 1
    found = Counter(tuple(r) for r in simhash_dedup.near_duplicates(documents(spark)).collect())
    assert found == expected
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    kept = simhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    label = slow_groups([slow_fingerprint(r[1]) for r in rows()])
    found = kept.collect()
    groups = Counter(label[slow_fingerprint(r["text"])] for r in found)
    assert set(groups) == set(label.values()) and set(groups.values()) == {1}
    for r in found:
        mates = [x[0] for x in rows() if label[slow_fingerprint(x[1])] == label[slow_fingerprint(r["text"])]]
        assert r["doc_id"] == min((i for i in mates if i is not None), default=None)
        assert tuple(r) in rows()
    assert simhash_dedup.drop_near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [2, 8, 2048])
def test_crowded_shards_lose_no_link(spark, limit):
    """A dense ball of fingerprints and a chain; small limits force every
    level of division and must not change the groups."""
    centre = 0x0123456789ABCDEF
    values = {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 7)}
    chain = 0xF0F0F0F0F0F0F0F0
    for b in range(0, 40, 2):
        chain ^= 3 << b
        values.add(chain)
    values |= {0, 1, 7, (1 << 63) | 5, (1 << 63) | 4}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    labels = simhash_dedup.group_labels(spark.createDataFrame(signed, "fp long"), shard_limit=limit).collect()
    expected, mine = slow_groups(values), {r["fp"] & (2 ** 64 - 1): r["label"] for r in labels}
    assert set(mine) == values
    pairs = {(expected[v], mine[v]) for v in values}
    assert len(pairs) == len(set(expected.values())) == len(set(mine.values()))


def test_trees_hold_hundreds_of_fingerprints(spark):
    """The search is the trees', not the bit blocks': shards are as coarse as
    their limit allows, and crowded prefixes grow until they fit."""
    values = [v * 0x9E3779B97F4A7C15 % (1 << 64) for v in range(1, 6001)]
    values += [(0xABC << 52) | v for v in range(900)]  # one crowded prefix
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in set(values)], "fp long")
    sizes = [r["n"] for r in simhash_dedup.bk_shards(prints, shard_limit=512).groupBy("level", "path", "shard")
             .agg(F.count("fp").alias("n")).collect()]
    assert max(sizes) <= 512 and sum(n for n in sizes if n > 100) >= 3 * 6000
    labels = simhash_dedup.group_labels(prints, shard_limit=512).collect()
    expected, mine = slow_groups(values), {r["fp"] & (2 ** 64 - 1): r["label"] for r in labels}
    pairs = {(expected[v], mine[v]) for v in values}
    assert len(pairs) == len(set(expected.values())) == len(set(mine.values()))


def test_bk_tree_follows_only_edges_within_the_radius():
    tree, values = simhash_dedup.BKTree(), [v * 0x9E3779B97F4A7C15 % (1 << 64) for v in range(1, 300)]
    for v in values:
        tree.add(v)
    for radius in (0, 2, 20):
        for v in (*values[:20], 12345):
            found = {tree.values[i] for i in tree.near(v, radius)}
            assert found == {w for w in values if (v ^ w).bit_count() <= radius}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(600, 700)] + [(9, 9), (3, 2), (2, 3)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 100 for i in range(101, 141)}, **{k: 500 for k in range(600, 700)}, 3: 2}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_lines(table, min_chars=20, min_docs=3):
    fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(BLANK))
    holders = defaultdict(set)
    for r in table:
        for line in (r[1] or "").split("\n"):
            if len(fold(line)) >= min_chars:
                holders[fold(line)].add(r[0])
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = Counter()
    for r in table:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if fold(x) not in keeper or keeper[fold(x)] == r[0]]
        out[r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def test_line_report_matches_brute_force(spark):
    found = Counter(tuple(r) for r in line_dedup.line_report(documents(spark)).collect())
    assert found == slow_lines(rows())
    assert sum(n for (_, _, dropped, _), n in found.items() if dropped) >= 10
    assert line_dedup.line_report(empty(spark)).count() == 0


def test_long_shared_texts_and_null_ids(spark, tmp_path):
    """Very many shared lines, one text twice under an id, and a line whose
    third holder has no id: Spark, brute force and SQL agree."""
    import duckdb

    long = [f"shared line number {i} of a very long text" for i in range(6000)]
    own = [f"an own line {i} that nobody else has got" for i in range(6000)]
    texts = ["\n".join(x for pair in zip(long, own) for x in pair), "\n".join(long), "\n".join(reversed(long))]
    table = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (1, texts[2] + "\ntail"), (None, long[0]), (None, own[3]),
                                                     (8, own[3]), (9, own[3].upper()), (None, None), (5, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    found = Counter(tuple(r) for r in line_dedup.line_report(docs).collect())
    assert found == slow_lines(table)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert Counter(db.execute(line_dedup.REPORT_SQL).fetchall()) == found


def test_line_keys_keep_other_white_space(spark):
    """A no-break space or a line separator is not stripped and not a break."""
    table = [(i, f"  padded line of the text   {'' if i % 2 else ' '}", "en", "s", 1, 0.0, "", i)
             for i in range(4)]
    from .helpers import SCHEMA
    found = Counter(tuple(r) for r in line_dedup.line_report(spark.createDataFrame(table, SCHEMA)).collect())
    assert found == slow_lines(table)
