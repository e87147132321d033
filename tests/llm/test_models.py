"""Language id, quality rules, classifier and language model."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.llm import catalog, language_id, lm_scoring, quality_classifier, quality_rules
from tabsieve.llm.common import table

from .helpers import SCHEMA, documents, empty, rows, save, story

EN = "the house and the garden with the people of this town that they have seen"
DE = "das haus und der garten mit den menschen dieser stadt die sie gesehen haben"


def test_language_backs_off_to_shorter_grams():
    counts = [("de", w, n) for w, n in Counter(DE.split()).items()] + [("en", w, n) for w, n in Counter(EN.split()).items()]
    model = language_id.build_model(counts)
    assert model.languages == ["de", "en"]
    known = model.words["garden"]
    assert known[1] > known[0]
    unseen = model.unseen("gardens")  # not a word: its 5-grams are
    assert unseen[1] > unseen[0]
    far = model.unseen("schenmen")
    assert far[0] > far[1]
    assert model.unseen("木").tolist() == [0.0, 0.0]
    scorer = language_id.Scorer(model, remember=3)
    assert scorer.predict(DE)[0] == "de" and scorer.predict(EN.upper())[0] == "en" and scorer.predict(DE)[0] == "de"
    assert scorer.predict("12 ...!") == ("und", 0.0) and scorer.predict("") == ("und", 0.0)


def test_language_query_on_odd_rows(spark, tmp_path):
    more = [(1000 + i, (DE, EN)[i % 2] + f" {i}", ("de", "en")[i % 2], "s", 1, 0.0, "", 0) for i in range(60)]
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string")).union(
        spark.createDataFrame(more, SCHEMA))
    out = catalog.op1_language_id(spark, save(spark, docs, tmp_path)).collect()
    assert len(out) == len(rows()) + 60
    by = {r["doc_id"]: r for r in out}
    assert all(by[1000 + i]["lang_pred"] == ("de", "en")[i % 2] for i in range(60))
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 9, 16))
    assert all(0 <= r["score"] <= 1 for r in out)
    nothing = catalog.op1_language_id(spark, save(spark, empty(spark), tmp_path / "none"))
    assert nothing.count() == 0


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_quality_counts_match_brute_force(spark):
    found = Counter(tuple(r) for r in quality_rules.judge_quality(documents(spark)).select(
        "doc_id", *quality_rules.COUNTS[:5]).collect())
    assert found == Counter((r[0], *slow_counts(r[1])) for r in rows())


def test_votes_agree_with_the_rule_names(spark):
    assert tuple(quality_rules.votes()) == quality_rules.RULES


def test_estimation_finds_planted_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    votes = np.zeros((len(good), 5), dtype=int)
    for k, right in enumerate((0.95, 0.9, 0.85, 0.5, 0.8)):
        truth = np.where(rng.random(len(good)) < right, good, ~good)
        votes[:, k] = np.where(rng.random(len(good)) < 0.7, np.where(truth, 1, -1), 0)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    prior, plus, minus = quality_rules.estimate(patterns, n.astype(float))
    odds = prior + (votes == 1) @ plus + (votes == -1) @ minus
    assert ((odds > 0) == good).mean() > 0.93
    assert abs(plus[3]) < 0.2 and abs(minus[3]) < 0.2 and plus[0] > plus[4] > 0 and minus[0] < minus[4] < 0


def test_verdict_and_edges(spark):
    good = [(100 + i, "\n".join(story(i * 9 + k, 30) for k in range(4)), None, None, None, None, None, None)
            for i in range(60)]
    junk = [(300 + i, " ".join(f"{w}***" for w in story(i, 90).split()), None, None, None, None, None, None) for i in range(15)]
    out = {r["doc_id"]: r for r in quality_rules.judge_quality(spark.createDataFrame(good + junk, SCHEMA)).collect()}
    assert all(out[100 + i]["kept"] for i in range(60)) and not any(out[300 + i]["kept"] for i in range(15))
    odd = {r["doc_id"]: r for r in quality_rules.judge_quality(documents(spark)).collect()}
    assert odd[3]["base_failed"] and not odd[4]["kept"] and odd[18]["base_failed"]
    assert quality_rules.judge_quality(empty(spark)).count() == 0


def test_repeated_words_with_very_many_distinct_words():
    ids = np.concatenate([np.arange(50), [1, 2, 3, 4]])
    assert quality_rules.repeated_words(ids, 50) == quality_rules.repeated_words(ids, 1 << 21) == 8


def labelled(n=400):
    good = [(i, story(i, 50), 1) for i in range(0, n, 2)]
    return good + [(i, " ".join(w + "!!" for w in story(i, 50).split()), 0) for i in range(1, n, 2)]


def test_classifier_learns_and_scores_alike(spark):
    train = spark.createDataFrame(labelled(), "doc_id long, text string, label int")
    model = quality_classifier.train_classifier(train)
    held = [(1000 + i, story(1000 + i, 50) if i % 2 else story(i, 50).replace(" ", "!! "), "s") for i in range(60)]
    docs = spark.createDataFrame([*held, (1, None, "s"), (2, "", "s"), (None, "", "s")], "doc_id long, text string, score string")
    out = quality_classifier.score_quality(docs, model).collect()
    assert len(out) == 63 and all(0 <= r["score"] <= 1 for r in out)
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in out if r["doc_id"] and r["doc_id"] >= 1000]) > 0.95
    assert len({r["score"] for r in out if not r["doc_id"] or r["doc_id"] < 1000}) == 1
    for r in out:  # the sparse dot product, done slowly
        text = next((t for i, t, _ in held if i == r["doc_id"]), "") or ""
        slots = quality_classifier.features(text.encode())
        margin = sum(model[s] * x for s, x in zip(slots, quality_classifier.values(slots), strict=True))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_classifier_without_labels(spark):
    model = quality_classifier.train_classifier(spark.createDataFrame([], "doc_id long, text string, label int"))
    out = quality_classifier.score_quality(documents(spark), model).collect()
    assert {r["score"] for r in out} == {0.5} and len(out) == len(rows())
    repeated = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, label int")
    assert sorted(tuple(r) for r in quality_classifier.sample_labels(repeated).collect()) == [(1, 1), (3, 0)]


def test_model_is_a_distribution_and_ignores_the_future():
    rng = np.random.default_rng(1)
    params = {k: rng.standard_normal(s).astype(np.float32) * 0.3 for k, s in lm_scoring.SHAPES.items()}
    hidden = rng.standard_normal((1, lm_scoring.WIDTH)).astype(np.float32)
    every = np.arange(lm_scoring.TOKENS)
    logs = lm_scoring._token_logs(params, np.repeat(hidden, len(every), 0), every)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    docs = [rng.integers(0, lm_scoring.END, n).astype(np.uint16) for n in (5, 16, 17, 70, 1, 300)]
    batched = np.zeros(len(docs))
    inputs, targets, starts, owner = lm_scoring.blocks(docs)
    np.add.at(batched, owner, lm_scoring.log_probs(params, inputs, targets, starts, lot=7))
    alone = [lm_scoring.log_probs(params, *lm_scoring.blocks([d])[:3]).sum() for d in docs]
    assert batched == pytest.approx(alone, rel=1e-5)
    # the training pass and the scoring pass agree
    loss, _ = lm_scoring.gradients(params, inputs, targets, starts)
    assert loss == pytest.approx(-sum(alone) / sum(map(len, docs)), rel=1e-4)
    # a token's score does not depend on what follows
    cut = lm_scoring.log_probs(params, *lm_scoring.blocks([docs[3][:33]])[:3])
    assert cut[:2] == pytest.approx(lm_scoring.log_probs(params, *lm_scoring.blocks([docs[3]])[:3])[:2], rel=1e-5)


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    params = {k: (rng.standard_normal(s) * 0.2).astype(np.float64) for k, s in lm_scoring.SHAPES.items()}
    docs = [rng.integers(0, 60, n).astype(np.uint16) for n in (40, 20)]
    inputs, targets, starts, _ = lm_scoring.blocks(docs)
    _, g = lm_scoring.gradients(params, inputs, targets, starts)
    for name in params:
        flat, grad = params[name].reshape(-1), g[name].reshape(-1)
        at = int(np.abs(grad).argmax())
        old = flat[at]
        flat[at] = old + 1e-3
        up, _ = lm_scoring.gradients(params, inputs, targets, starts)
        flat[at] = old - 1e-3
        down, _ = lm_scoring.gradients(params, inputs, targets, starts)
        flat[at] = old
        assert (up - down) / 2e-3 == pytest.approx(grad[at], rel=0.03, abs=1e-5), name


def test_scores_on_odd_rows(spark, monkeypatch):
    import zlib

    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", 5)  # most words take the shuffle
    out = lm_scoring.score_texts(documents(spark)).collect()
    cut = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [cut(r[1]) for r in rows() if not held(r[0])]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()) + len(train), len(count) + 1
    expected = Counter()
    for r in rows():
        words = cut(r[1])
        base = sum(np.log10((count[w] + 1) / (n + v + 1)) for w in words) + np.log10((len(train) + 1) / (n + v + 1))
        expected[r[0], held(r[0]), len(words) + 1, sum(w in count for w in words) + 1, n, round(base, 6)] += 1
    assert Counter((r[0], r[1], r[2], r[3], r[4], round(r["base_score"], 6)) for r in out) == expected
    assert all(r["score"] < 0 for r in out)
    same = {round(r["score"], 5) for r in out if r["doc_id"] in (3, 4, 5)}
    assert len(same) == 1  # null, empty and blank texts are an end token
    assert lm_scoring.score_texts(empty(spark)).count() == 0


def test_training_lowers_the_loss(spark, sf_dir):
    texts = [r["text"] for r in table(spark, sf_dir, "documents").select("text").limit(150).collect()]
    known = lm_scoring.Subwords(lm_scoring.vocabulary_path())
    ids = [known.ids(t.encode().lower().split()) for t in texts]
    params = lm_scoring.initial(np.bincount(np.concatenate(ids[:120]), minlength=lm_scoring.TOKENS).astype(float))
    score = lambda p: lm_scoring.log_probs(p, *lm_scoring.blocks(ids[120:])[:3]).sum()
    before = score(params)
    after = score(lm_scoring.train_group(params, ids[:120], 0.01, batch=32))
    assert after > before * 0.95  # both negative


def test_model_learns_from_every_document(spark):
    known = lm_scoring.Subwords(lm_scoring.vocabulary_path())
    first = {}
    for word in (a + b + c for a in "bcdfgmpst" for b in "aeiou" for c in "dlmnrst"):
        ids = known.ids([word.encode()])
        if len(ids) == 2:
            first.setdefault(int(ids[0]), word)
    rare = list(first.items())[:60]
    assert len(rare) == 60
    train = spark.createDataFrame([(w,) for _, w in rare] + [("one and two",)] * 2940, "text string").repartition(4)
    params = lm_scoring.train_model(train)
    # an input's row moves only if a document with it is learned from
    still = lm_scoring.initial(np.zeros(lm_scoring.TOKENS))["embed"]
    assert all((params["embed"][token] != still[token]).any() for token, _ in rare)


def test_steps_grow_with_the_documents():
    plans = [lm_scoring.rounds_of(n, 400) for n in (0, 300, 2_000, 40_000, 200_000, 2_000_000)]
    assert plans[:3] == [(1, 1), (1, 1), (1, 5)]
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(plans[2:], plans[3:]))


def test_a_token_sees_at_least_33_subwords_back():
    rng = np.random.default_rng(4)
    params = {k: rng.standard_normal(s).astype(np.float32) * 0.3 for k, s in lm_scoring.SHAPES.items()}
    doc = rng.integers(0, lm_scoring.END, 200).astype(np.uint16)

    def score_of(place: int, doc: np.ndarray) -> float:
        until = [lm_scoring.log_probs(params, *lm_scoring.blocks([doc[:n]])[:3]).sum() for n in (place, place + 1)]
        return until[1] - until[0]

    for place in (96, 103, 111, 127, 128):  # input ``place`` is token ``place - 1``
        for back, seen in ((33, True), (48, True), (66, False)):
            other = doc.copy()
            other[place - back] = (other[place - back] + 1000) % lm_scoring.END
            assert (abs(score_of(place, other) - score_of(place, doc)) > 1e-5) == seen


def test_a_rare_language_is_learned_from_a_large_corpus(spark):
    greek = ["το σπίτι και ο κήπος", "οι άνθρωποι της πόλης", "ένα παλιό βιβλίο"]
    many = spark.range(60_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(EN)).otherwise(F.lit(DE)).alias("text"),
        F.when(F.col("id") % 2 == 0, F.lit("en")).otherwise(F.lit("de")).alias("lang"))
    few = spark.createDataFrame([(t, "el") for t in greek], "text string, lang string")
    model = language_id.train_language_model(many.union(few), train_docs=2_000)
    assert model.languages == ["de", "el", "en"]
    scorer = language_id.Scorer(model)
    for text, lang in [(greek[0], "el"), ("η πόλη και το βιβλίο", "el"), (EN, "en"), (DE, "de")]:
        found, score = scorer.predict(text)
        assert found == lang and score >= 0.5
