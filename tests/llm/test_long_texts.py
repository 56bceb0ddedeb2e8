"""A word of three megabytes and texts of many, which cross every slice that operators work in."""

import hashlib
import random
import zlib

import pytest
from helpers import collected, frame, sentence, words
from tokenizers import Tokenizer

from plinth.llm import classifier, decontam, minhash, packing, phrases, quality_rules, sharding, token_orc
from plinth.llm.common import WordHash
from plinth.llm.tokens import tokenizer_path

ITEM = "the answer of this question is surely not what anyone would expect from a long text but it is forty two"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    long = sentence(rng, 300_000, 60_000)
    return [(1, "q" * 3_000_000), (2, f"{long} {ITEM}"), (3, f"{ITEM} {long}"), (4, f"{sentence(rng, 50)} {'é' * 500_000} {sentence(rng, 50)}"), (5, "short")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, [(i, t, "en", "s", len(t)) for i, t in rows]).repartition(2)


def test_near_duplicates(docs, rows):
    from test_minhash import brute

    got = {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in collected(minhash.near_duplicates(docs)).items()}
    assert got == brute(rows)


def test_phrases(docs, rows):
    from test_phrases import brute, got

    assert got(phrases.digest(docs)) == brute(rows)


def test_quality_rules(docs, rows):
    got = collected(quality_rules.judged(docs))
    for i, text in rows:
        assert (got[i]["n_words"], got[i]["word_chars"]) == (len(words(text)), sum(map(len, words(text))))


def test_decontamination(spark, docs):
    got = collected(decontam.contaminated(docs, spark.createDataFrame([(7, ITEM)], "item_id long, text string")))
    assert {i for i, r in got.items() if r["contaminated"]} == {2, 3}


def test_classifier(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = classifier.fit(docs, labels)  # long texts teach like others
    learned = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    own = classifier.train([classifier.document_buckets(t.encode(), WordHash()) for _, t in learned], [i % 2 for i, _ in learned], sum(i % 2 for i, _ in learned) / len(learned))
    score = own.scorer()
    for i, r in collected(classifier.score(docs, model)).items():
        assert abs(r["score"] - score(dict(rows)[i].encode())) < 1e-6


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens(docs, rows, name):
    own = Tokenizer.from_file(tokenizer_path(name))
    rows = [(i, own.encode(t, add_special_tokens=False).ids + [0]) for i, t in rows]
    if name.startswith("byte"):
        got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_orc.round_trip(docs).collect()}
        assert got == {i: (len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))) for i, ids in rows}
        return
    by = {}
    for r in packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32").collect():
        by.setdefault(r.doc_id, []).append(r)
    for i, ids in rows:
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        want = [(k, at, min(2048, len(ids) - at), zlib.crc32(data[4 * at : 4 * (at + 2048)])) for k, at in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i]) == want


def test_shards(docs, rows):
    from test_sharding import brute

    got = sharding.shard(docs, 2_000_000).collect()
    assert sorted([(r.doc_id, r.shard, r.shard_bytes) for r in got], key=str) == brute(rows, 2_000_000)


def test_cleaned_texts(docs, rows):
    kept = {r.doc_id: r.text for r in phrases.cleaned(docs).select("doc_id", "text").collect()}
    assert kept[2] == dict(rows)[2] and len(words(kept[3])) < 100 and hashlib.md5(kept[1].encode()).digest() == hashlib.md5(rows[0][1].encode()).digest()
