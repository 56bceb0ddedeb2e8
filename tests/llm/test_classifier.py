import random
import zlib

import pytest
from helpers import collected, frame, sentence

from plinth.llm import classifier


def corpus(n=240):
    rng, rows, labels = random.Random(9), [], []
    for i in range(n):
        bad = i % 3 == 0
        text = sentence(rng, 60)
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, "en", "s", 1))
        labels.append((i, int(not bad), 0))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    return classifier.fit(frame(spark, rows), spark.createDataFrame(labels + [(None, 1, 0), (9999, None, 0)], "doc_id long, quality int, toxic int"))


def test_held_out_rows_are_told_apart(spark, model):
    rows, labels = corpus()
    got = collected(classifier.score(frame(spark, rows), model))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i]["predicted"], q) for i, q, _ in labels if got[i]["held_out"]]
    assert sum(p == q for p, q in held) >= 0.98 * len(held)


def test_the_shortcut_equals_the_averaged_vectors(model):
    from plinth.llm.common import WordHash

    text = b"w1x w2x w2x !! \xc3\xa9t\xc3\xa9"
    own, share = classifier.document_buckets(text, WordHash())
    direct = 1 / (1 + 2.718281828459045 ** -(model.bias + float(share @ model.weights[own])))
    assert abs(model.scorer()(text) - direct) < 1e-5


def test_nulls_empties_and_filters(spark, model):
    rows = [(1, None, None, None, None), (2, "", None, None, 0), (None, "w1x w2x", None, None, 1), (3, "W1X!! W2X!! " * 20, None, None, 1)]
    got = classifier.score(frame(spark, rows), model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    docs = frame(spark, rows)
    kept = classifier.accepted(docs, model)
    assert kept.schema == docs.schema and 3 not in {r.doc_id for r in kept.collect()}
    assert classifier.score(frame(spark, []), model).count() == 0


def test_without_labels_every_text_scores_alike(spark):
    none = classifier.fit(frame(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in classifier.score(frame(spark), none).collect()} == {0.5}


def test_training_equals_plain_gradient_descent():
    """Dense vectors, one example after the other, no shortcuts."""
    import numpy as np

    from plinth.llm.common import WordHash

    rows, labels = corpus(40)
    texts, y = [r[1].encode() for r in rows], [q for _, q, _ in labels]
    prior = sum(y) / len(y)
    got = classifier.train([classifier.document_buckets(t, WordHash()) for t in texts], y, prior)
    rng = np.random.default_rng(classifier.SEED)
    vectors = rng.uniform(-1 / classifier.DIM, 1 / classifier.DIM, (classifier.BUCKETS, classifier.DIM)).astype(np.float32)
    out, bias, at = np.zeros((2, classifier.DIM)), np.zeros(2), 0
    for _ in range(classifier.EPOCHS):
        for i in rng.permutation(len(y)):
            found: dict[int, float] = {}
            parts = texts[i].split()
            ids = WordHash().of(parts)
            own = [b for w in parts for b in classifier.word_buckets(w)] + classifier.pair_buckets(ids).tolist()
            for b in own:
                found[b] = found.get(b, 0) + 1 / len(own)
            weight = (prior / sum(y) if y[i] else (1 - prior) / (len(y) - sum(y))) * len(y)
            step = classifier.RATE * (1 - at / (classifier.EPOCHS * len(y))) * min(weight, 3)
            at += 1
            hidden = sum(s * vectors[b].astype(float) for b, s in found.items())
            z = np.exp(out @ hidden + bias)
            error = z / z.sum() - np.eye(2)[y[i]]
            for b, s in found.items():
                vectors[b] -= (step * 20 * s * (error @ out)).astype(np.float32)
            out -= step * np.outer(error, hidden)
            bias -= step * error
    np.testing.assert_allclose(got.weights, vectors @ (out[1] - out[0]), atol=2e-3)
    score = got.scorer()
    plain = classifier.Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])).scorer()
    assert all(abs(score(t) - plain(t)) < 1e-3 for t in texts)


def test_rows_that_share_an_id_teach_once(spark):
    rows, labels = corpus(60)
    many = frame(spark, rows + [(1, f"other text {i}", "en", "s", 1) for i in range(2000)])
    model = classifier.fit(many, spark.createDataFrame(labels * 2, "doc_id long, quality int, toxic int"))
    assert model.weights.any()
