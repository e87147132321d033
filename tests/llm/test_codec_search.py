"""Piece codec and vector search against brute force, and the pipeline."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tabsieve.llm import ann_hnsw, language_id, sentencepiece_codec

from .helpers import documents, empty, rows, save


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.model_path())


def slow_best(codec, word):
    """Best score of a marked word by plain dynamic programming."""
    best = [0.0] + [-np.inf] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            piece = codec.score.get(word[i:j])
            if piece:
                best[j] = max(best[j], best[i] + piece[0])
        best[j] = max(best[j], best[j - 1] + codec.unknown)
    return best[-1]


def test_shared_prefix_viterbi_is_optimal(codec):
    words = sorted({w for r in rows() if r[1] for w in codec.words(r[1])} | {" internationalization", " inter", " in"})
    score = {i: s for s, i in codec.score.values()}
    for word, packed in codec.best(words):
        ids = np.frombuffer(packed, "<i4").tolist()
        assert b"".join(codec.spelled[i] for i in ids).decode() == word
        spelt = [i for i in ids if i in score]
        unknown = len(word) - sum(len(codec.spelled[i].decode()) for i in spelt)
        total = sum(score[i] for i in spelt) + unknown * codec.unknown
        assert total == pytest.approx(slow_best(codec, word))


def test_order_of_words_does_not_matter(codec):
    words = sorted({w for r in rows() if r[1] for w in codec.words(r[1])})
    together = dict(codec.best(words))
    assert all(dict(codec.best([w]))[w] == together[w] for w in words[::7])


def test_exact_round_trip(spark):
    docs = documents(spark)
    report = sentencepiece_codec.codec_report(docs).collect()
    assert len(report) == len(rows()) and all(r["round_trip"] for r in report)
    encoded = sentencepiece_codec.encode(docs)
    back = sentencepiece_codec.decode(encoded).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((r[0], r[1]) for r in rows())
    lengths = Counter((r["doc_id"], r["n_pieces"]) for r in encoded.collect())
    assert lengths == Counter((r["doc_id"], r["n_pieces"]) for r in report)
    assert sentencepiece_codec.codec_report(empty(spark)).count() == 0


def vectors(spark, n=1500, dim=12):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, dim))
    data = centres[rng.integers(0, 20, n)] + 0.6 * rng.standard_normal((n, dim))
    data[200:700] = data[200]  # one vector very many rows share
    out = [(i, [float(x) for x in np.float32(v)], 0) for i, v in enumerate(data)]
    out[50] = (50, None, 1)
    out[100] = (100, [0.0] * dim, 1)
    out[150] = (150, [float("nan")] + out[150][1][1:], 1)
    out[750] = (750, [float("inf")] + out[750][1][1:], 1)
    out[800] = (800, [None] + out[800][1][1:], 1)
    out += [(None, out[3][1], 2), (850, [1.0, 2.0], 2), (9001, [2.0, 4.0], 2), (9002, [-1.0, 0.5], 2), (1100, [], 2)]
    return out


def test_search_against_brute_force(spark):
    data = vectors(spark)
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int").repartition(4)
    found = ann_hnsw.nearest_neighbours(frame, shard_size=400).collect()
    ok = [(i, np.array(v, dtype=float)) for i, v, _ in data if i is not None and v and None not in v
          and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    hits = total = 0
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [(i, v) for i, v in ok if i % 50 == 0]
    assert set(by) <= {i for i, _ in queries}
    for i, q in queries:
        # a repeated id: vectors of the query's own length only
        same = [(j, v) for j, v in ok if len(v) == len(q)]
        if len([x for x in queries if x[0] == i]) > 1:
            continue
        ids = np.array([j for j, _ in same])
        m = np.array([v for _, v in same])
        cosine = (m @ q) / np.linalg.norm(m, axis=1) / np.linalg.norm(q)
        got = sorted(by[i])
        assert [g[0] for g in got] == list(range(1, len(got) + 1))
        value = {}
        for j, c in zip(ids.tolist(), cosine.tolist(), strict=True):
            value[j] = max(c, value.get(j, -2.0))
        value.pop(i)
        best = sorted(value.items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]
        assert len(got) == len(best)
        assert all(abs(value[g[1]] - g[2]) < 1e-12 for g in got)
        hits += len({g[1] for g in got} & {b[0] for b in best})
        total += len(best)
    assert hits / total >= 0.95
    hot = sorted(by[250])  # own copies: the smallest ids of the shared vector, never the query itself
    assert [g[1] for g in hot] == [200, 201, 202, 203, 204]


def test_search_of_tiny_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann_hnsw.nearest_neighbours(spark.createDataFrame([], schema)).count() == 0
    assert ann_hnsw.nearest_neighbours(spark.createDataFrame([(0, [1.0, 0.0])], schema)).count() == 0
    two = ann_hnsw.nearest_neighbours(spark.createDataFrame([(0, [1.0, 0.0]), (3, [2.0, 2.0])], schema)).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in two] == [(0, 1, 3)]
    assert two[0]["score"] == pytest.approx(0.5 ** 0.5)


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == names and docs.dtypes == before.dtypes, i
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= 3 * before.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "simhash_dedup", "source_mixing", "sentencepiece"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.columns == ["doc_id", "n_pieces", "ids"] and last.count() == docs.count()


def test_pipeline_against_plain_python(spark, tmp_path):
    """The first three stages on a small table, done by hand."""
    from .helpers import SCHEMA, SHARED, story
    from .test_dedup import slow_fingerprint, slow_groups

    table = [(i, story(i % 20, 60) + f"\n{SHARED}" + (f"\nown closing line of text number {i % 25}"), ["en", "xx"][i % 2], ["a", None][i % 2],
              7, 0.1, "f", i) for i in range(60)]
    table += [(90, None, None, None, None, None, None, None), (91, "123", "en", "a", 3, None, None, None), table[0]]
    folder = save(spark, spark.createDataFrame(table, SCHEMA), tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, folder).collect()
    assert {r["doc_id"] for r in table_rows(kept)} <= {t[0] for t in table} - {90, 91}
    model = language_id.train_language_model(docs)
    scorer = language_id.Scorer(model)
    want = [t for t in table if t[1] and scorer.predict(t[1])[0] != "und" and scorer.predict(t[1])[1] >= 0.5]
    assert Counter(map(tuple, kept)) == Counter(want)
    lined = corpus_pipeline.dedup_lines(spark, spark.createDataFrame(kept, docs.schema), folder).collect()
    holders = [r for r in lined if SHARED in r["text"]]
    assert {r["doc_id"] for r in holders} == {max(t[0] for t in want)}
    assert all(r["n_chars"] == len(r["text"]) for r in lined if SHARED not in r["text"])
    one = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(lined, docs.schema), folder).collect()
    label = slow_groups([slow_fingerprint(r["text"]) for r in lined])
    lowest = {}
    for r in lined:
        group = label[slow_fingerprint(r["text"])]
        lowest[group] = min(lowest.get(group, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in one) == sorted(lowest.values())


def table_rows(found):
    return [r.asDict() for r in found]


def test_pipeline_on_odd_and_empty_rows(spark, tmp_path):
    out = corpus_pipeline.run(spark, save(spark, documents(spark), tmp_path / "odd"))
    assert out.columns == ["doc_id", "n_pieces", "ids"]
    assert corpus_pipeline.run(spark, save(spark, empty(spark), tmp_path / "none")).count() == 0
