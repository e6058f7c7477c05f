import zlib

import numpy as np
import pytest
from corpus import documents, labels, prose

from barloom.llm import quality_gam, toxicity
from barloom.llm.queries import QUERIES

BAD = ["worthless", "pathetic", "scum"]


def in_fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def auc(scores, truth):
    good, bad = scores[truth == 1], scores[truth == 0]
    return (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()


@pytest.fixture(scope="module")
def toxic(spark):
    def text(i):
        words = prose(i, 80).split(" ")
        if i % 2:
            for k in (5, 30, 60):
                words[k] = BAD[(i + k) % 3]
        return " ".join(words)

    docs = documents(spark, [text(i) for i in range(600)])
    return docs, toxicity.fit(docs, labels(spark, 600))


def test_held_out_toxicity(toxic):
    docs, model = toxic
    rows = [r for r in toxicity.score_toxicity(docs, model).collect() if r.id is not None and in_fold(r.id)]
    scores, truth = np.array([r.score for r in rows]), np.array([r.id % 2 for r in rows])
    assert auc(scores, truth) > 0.95
    assert ((scores >= 0.5) == truth).mean() > 0.85


def test_scores_are_a_softmax_over_averaged_embeddings(toxic):
    docs, model = toxic
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.score_toxicity(docs, model).limit(50).collect():
        buckets = toxicity.subword_buckets(texts[r.id])
        logits = model.embeddings[buckets].mean(axis=0) @ model.weights + model.bias
        raised = np.exp(logits - logits.max())
        assert r.score == pytest.approx(raised[1] / raised.sum(), abs=1e-9)


def test_bags_of_a_fit_are_bounded_in_bytes(spark):
    """Long texts and repeated ids do not take more than the budget; each label has its half."""
    rows = spark.createDataFrame(
        [(i, prose(i, 400 if i % 4 == 0 else 20), i % 2) for i in range(60)] + [(7, prose(90, 20), 1)] * 200,
        "id long, text string, label int",
    )
    everything = toxicity.training_bags(rows, 1 << 30).collect()
    assert sorted(r.id for r in everything) == list(range(60))
    repeated = next(r for r in everything if r.id == 7)
    smallest = np.unique(toxicity.subword_buckets(min(prose(7, 20), prose(90, 20))))
    assert np.frombuffer(repeated.buckets, np.uint16).tolist() == smallest.tolist()

    def size(rows, label):
        return sum(len(r.buckets) + len(r.shares) for r in rows if r.label == label)

    budget = size(everything, 0)
    some = toxicity.training_bags(rows, budget).collect()
    assert 0 < size(some, 0) <= budget // 2 and 0 < size(some, 1) <= budget // 2
    assert {r.id for r in some if r.label == 0} < {r.id for r in everything if r.label == 0}
    assert {(r.id, r.buckets) for r in some} <= {(r.id, r.buckets) for r in everything}
    assert toxicity.training_bags(rows.limit(0), budget).collect() == []


def test_unseen_misspellings(toxic):
    """Words that no training text has share most n-grams with those that mark toxic texts."""
    _, model = toxic
    lead = model.logits_by_bucket()

    def logit(text):
        return lead[toxicity.subword_buckets(text)].mean()

    clean = [logit(prose(5000 + i, 60)) for i in range(40)]
    masked = [logit(prose(5000 + i, 60) + " wworthless patheticc pathetick") for i in range(40)]
    assert np.mean(masked) > np.mean(clean) + 2 * np.std(clean)


def test_scores_of_awkward_rows(spark, toxic):
    docs = documents(spark)
    quality = quality_gam.fit(docs, labels(spark, 19))
    for scored in (toxicity.score_toxicity(docs, toxic[1]), quality_gam.score_quality(docs, quality)):
        rows = scored.collect()
        assert len(rows) == docs.count()
        assert all(0 <= r.score <= 1 for r in rows)
        assert scored.limit(0).collect() == []
    assert quality_gam.score_quality(docs.limit(0), quality).collect() == []


@pytest.mark.parametrize("module", [quality_gam, toxicity])
def test_fits_without_labels_or_with_one_class(spark, module):
    docs = documents(spark)
    score = quality_gam.score_quality if module is quality_gam else toxicity.score_toxicity
    for given in (labels(spark, 0).limit(0), labels(spark, 19, lambda i: 1, lambda i: 1)):
        scores = {round(r.score, 6) for r in score(docs, module.fit(docs, given)).collect()}
        assert len(scores) == 1


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = documents(spark, [prose(i, 40) if i % 2 else "buy now !!! " * 9 for i in range(120)])
    plain = quality_gam.fit(docs, labels(spark, 120))
    turned = quality_gam.fit(docs, labels(spark, 120, lambda i: i % 2 if not in_fold(i) else 1 - i % 2))
    assert (plain.tables == turned.tables).all() and plain.base == turned.base


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality_gam.train(x, y, 0.5)
    assert (0, 1) in model.pairs
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("name,label,threshold", [("op6_quality_gam", "quality", 0.3), ("op4_toxicity", "toxic", 0.5)])
def test_registered_query(spark, sf_dir, name, label, threshold):
    rows = QUERIES[name](spark, sf_dir).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == in_fold(r.doc_id) and r.predicted == (r.score >= threshold) for r in rows)
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in judged]) > 0.8
