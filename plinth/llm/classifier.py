"""Quality classifier: learned word, word-pair and character n-gram vectors averaged per document, softmax output.

The embedding table is hashed (BUCKETS rows); numpy stochastic gradient descent trains it with the output layer on a
bounded sample of labelled documents.  Because the output is linear in the averaged vectors, a trained model reduces to
one number a bucket, and a document's score is a sum of cached word contributions.

Sampled texts become bucket shares where they lie (at most BUCKETS numbers a text, whatever its length); one task trains
on them, and only the model, BUCKETS numbers, reaches the driver.  A text of any length is scored as one list of words.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import LONG_WORD, WordHash, blocks, discard, mix, unused, with_columns, written

BUCKETS = 1 << 17
DIM = 16
NGRAMS = (4,)
#: Bound of the training sample: labelled rows of each class, texts of any length.
SAMPLE_PER_CLASS = 1000
EPOCHS, RATE, SEED = 5, 0.5, 7
ACCEPT = 0.7
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def word_buckets(word: bytes) -> list[int]:
    """Buckets of a word and its character n-grams."""
    marked = b"<" + word + b">"
    out, crc = [zlib.crc32(marked) % BUCKETS], zlib.crc32
    for n in NGRAMS:
        out += [crc(marked[i : i + n], n) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def pair_buckets(ids: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words; all pairs of equal words share one, so that its vector is learned across words."""
    out = (mix(ids[:-1] * _PAIR + ids[1:]) % np.uint64(BUCKETS)).astype(np.int64)
    out[ids[:-1] == ids[1:]] = 0
    return out


def document_buckets(text: bytes, words: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    parts = text.split()
    found = [np.fromiter((b for w in parts for b in word_buckets(w)), np.int64)]
    if len(parts) > 1:
        found.append(pair_buckets(words.of(parts)))
    own, counts = np.unique(np.concatenate(found), return_counts=True)
    return own, (counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    """weights: a bucket's contribution to the log odds of label 1; bias: of a text without words."""

    weights: np.ndarray
    bias: float

    def scorer(self):
        """text -> score; words' contributions are cached, a bounded number of them."""
        table, weights = self.weights.tolist(), self.weights
        words = WordHash()

        class Sums(dict):
            def __missing__(self, word: bytes) -> complex:
                own = word_buckets(word)
                found = complex(sum([table[b] for b in own]), len(own))
                if len(word) <= LONG_WORD:
                    if len(self) >= 300_000:
                        self.clear()
                    self[word] = found
                return found

        sums = Sums()

        def score(text: bytes) -> float:
            parts = text.split()
            total, n = 0.0, 0.0
            if parts:
                both = np.fromiter(map(sums.__getitem__, parts), np.complex128, len(parts)).sum()
                total, n = both.real, both.imag
                if len(parts) > 1:
                    total += float(weights[pair_buckets(words.of(parts))].sum(dtype=np.float64))
                    n += len(parts) - 1
            return float(1 / (1 + np.exp(-np.clip(self.bias + total / max(1.0, n), -60, 60))))

        return score


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], prior: float, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """SGD over (buckets, shares) of texts; each class's examples weigh as much as `prior` (the share of label 1) says."""
    y = np.asarray(labels)
    if not len(y) or y.min() == y.max():
        prior = prior if len(y) else 0.5
        odds = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
        return Model(np.zeros(BUCKETS, np.float32), float(odds))
    rng = np.random.default_rng(SEED)
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, at = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            own, share = examples[i]
            step = rate * (1 - at / steps) * min(weight[i], 3.0)
            at += 1
            hidden = share @ vectors[own] if len(own) else np.zeros(DIM, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            if len(own):
                vectors[own] -= (step * 20) * share[:, None] * (p @ out)
            out -= step * np.outer(p, hidden)
            bias -= step * p
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def _examples(batches):
    words = WordHash()
    for batch in batches:
        at = 0
        for (texts,) in blocks(batch, ["text"], 1 << 20):
            own = [document_buckets(t, words) for t in texts]
            rest = [batch.column(c).slice(at, len(texts)) for c in ("doc_id", "quality")]
            at += len(texts)
            columns = [pa.array([o[0].astype(np.int32).tobytes() for o in own], pa.binary()), pa.array([o[1].tobytes() for o in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([*rest, *columns], names=["doc_id", "quality", "buckets", "shares"])


def _trained(prior: float):
    def run(batches):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "quality", "buckets", "shares")), strict=True)]
        rows.sort()
        model = train([(np.frombuffer(b, np.int32).astype(np.int64), np.frombuffer(s, np.float32)) for *_, b, s in rows], [q for _, q, *_ in rows], prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["weights", "bias"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model of labels.quality, from rows of labels (doc_id, quality) whose crc32(doc_id) mod 4 is not 2.

    The sample is the first per_class rows of each class by a hash of doc_id; no other column is looked at.  Labels
    without a document or with other values teach nothing; of rows that share a doc_id one, by a hash of its text, does."""
    ship(docs.sparkSession)
    known = with_columns(labels, ["doc_id", "quality"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    share = known.agg(F.avg("quality")).first()[0]
    picked = None
    for label in (0, 1):
        one = known.where(F.col("quality") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    texts = with_columns(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id")  # at most 2 * per_class rows of two numbers
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    examples = written(rows.mapInArrow(_examples, "doc_id long, quality int, buckets binary, shares binary"), "examples")
    model = examples.repartition(1).mapInArrow(_trained(0.5 if share is None else share), "weights binary, bias double").first()
    discard(examples)
    if model is None:
        return train([], [], 0.5)
    return Model(np.frombuffer(bytes(model.weights), np.float32), model.bias)


def _score(model: Model):
    def run(batches):
        score = model.scorer()
        for batch in batches:
            for ids, texts in blocks(batch, ["doc_id", "text"]):
                yield pa.RecordBatch.from_arrays([ids, pa.array([score(t or b"") for t in texts], pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text); other columns are ignored.

    Null and empty texts get the score of a text without words; repeated rows are each scored; a null doc_id is not
    held out; an empty table gives an empty result."""
    ship(docs.sparkSession)
    rows = with_columns(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return rows.mapInArrow(_score(model), "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def _filter(model: Model, accept: float, column: str):
    def run(batches):
        score = model.scorer()
        for batch in batches:
            keep = [score(t or b"") >= accept for (texts,) in blocks(batch, [column]) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns([column])

    return run


def accepted(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least `accept`."""
    ship(docs.sparkSession)
    column = unused("_scored", docs.columns)
    return docs.withColumn(column, F.col("text").cast("binary")).mapInArrow(_filter(model, accept, column), docs.schema)
