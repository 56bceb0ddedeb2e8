import zlib

import pyarrow as pa
from helpers import fixture, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plinth.llm import packing, token_orc, tokens
from plinth.llm.tokens import Encoder, tokenizer_path


def test_round_trip(spark):
    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_orc.round_trip(frame(spark)).collect()}
    start, want = 0, {}
    for i, text, *_ in fixture():
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        want[i] = (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    assert got == want


def scanned(df):
    """Rows that the scan handed on."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        assert df.count() >= 0
        plan.executeCollect()
        while plan.children().size():
            plan = plan.children().head()
        return plan.metrics().apply("numOutputRows").value()
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_bloom_filters_row_indexes_and_stripes_prune(spark, tmp_path):
    path = str(tmp_path / "orc")
    rows = [(2 * i, f"w{i % 50}x w{i % 7}x", None, None, None) for i in range(12_000)]
    token_orc.write_tokens(frame(spark, rows, extra=False).repartition(3), path)
    found = token_orc.read_tokens(spark, path)
    one = found.where(F.col("doc_id") == 7000).drop("file")
    assert "EqualTo(doc_id,7000)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and scanned(one) <= 1000  # one row group of 12
    # odd ids lie between the row groups' bounds: only a Bloom filter can tell that they are absent
    absent = [scanned(found.where(F.col("doc_id") == odd).drop("file")) for odd in range(1001, 21_001, 1000)]
    assert sum(absent) <= 2000 and absent.count(0) >= 18
    file = max((tmp_path / "orc").glob("*.orc"), key=lambda p: p.stat().st_size)
    reader = spark._jvm.org.apache.orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(file)), spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getRowIndexStride() == 1000 and reader.getCompressionKind().toString() == "ZSTD"


def test_a_file_is_read_by_its_stripes_in_parallel(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(token_orc.ORC, "orc.stripe.size", str(64 << 10))
    path = str(tmp_path / "orc")
    rows = [(i, " ".join(f"w{(i * 7919 + k * 104729) % 9973}" for k in range(60)), None, None, None) for i in range(9000)]
    docs = frame(spark, rows, extra=False)
    token_orc.write_tokens(docs.coalesce(1), path)
    file = max((tmp_path / "orc").glob("*.orc"), key=lambda p: p.stat().st_size)
    reader = spark._jvm.org.apache.orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(file)), spark._jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getStripes().size() > 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 << 10))
    try:
        found = token_orc.read_tokens(spark, path)
        parts = found.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == reader.getStripes().size() and sum(r["count"] for r in parts) == 9000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_table_nulls_and_repeated_rows(spark):
    assert token_orc.round_trip(frame(spark, [])).count() == 0
    rows = [(2, "b", None, None, None), (None, "a", None, None, None), (2, "b", None, None, None), (1, None, None, None, None)]
    got = sorted((r.start, str(r.doc_id), r.n_tokens) for r in token_orc.round_trip(frame(spark, rows)).collect())
    assert got == [(0, "None", 2), (2, "1", 1), (3, "2", 2), (5, "2", 2)]


def test_added_tokens_have_the_library_s_plain_ids(spark):
    texts = ["x <|endoftext|> y", "<|startoftext|>a b", "a b<|endoftext|>", "one<|endoftext|>two  \n<|endoftext|><|endoftext|>", "A <|ENDOFTEXT|> b", "a <|endof text|> b", "plain"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = Tokenizer.from_file(tokenizer_path(name))
        want = [own.encode(t, add_special_tokens=False).ids for t in texts]
        assert [list(memoryview(Encoder(tokenizer_path(name)).encode(t)).cast("I")) for t in texts] == want
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    ids = {r.doc_id: r.n_tokens for r in token_orc.round_trip(frame(spark, rows)).collect()}
    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert ids == {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    lengths = {r.doc_id: r.length for r in packing.pack(frame(spark, rows)).collect()}
    assert lengths == {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_half_a_million_pieces_are_encoded_once(monkeypatch):
    texts = [" " + " ".join("".join(chr(97 + n // 26**k % 26) for k in range(4)) + end for n in range(at, at + 20_000)) for end in ("", "é") for at in range(0, 280_000, 20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array([t.encode() for t in texts])], names=["doc_id", "tie", "text"])
    tokens.encoder.cache_clear()
    calls, plain = [], Encoder.letters
    monkeypatch.setattr(Encoder, "letters", lambda self, word, spaced: calls.append(word) or plain(self, word, spaced))
    run = token_orc._tokens(tokenizer_path("byte_bpe_50k.json"))
    first, again = (pa.Table.from_batches(list(run([batch]))).column("ids") for _ in range(2))
    assert len(calls) == len(set(calls)) == 560_000 and first == again
    own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for i in (0, 27):
        assert first[i].as_py() == own.encode(texts[i], add_special_tokens=False).ids + [0]
    tokens.encoder.cache_clear()
