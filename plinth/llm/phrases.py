"""Substring de-duplication by recurring phrases.

A window is LENGTH consecutive words of one document; its key is the least hash among its ANCHOR-word phrases, so equal
windows have equal keys wherever they stand.  Neighbouring windows with one key form a run.

1. Runs of all documents are counted by key (map-side combined).  A window whose key occurs once cannot recur.
2. Documents are joined with their recurring runs, whose words are cut out as segments; equal segments are aggregated
   to their first place, so copies, however many, collapse before any comparison.  Later copies go as a whole.
3. Distinct segments are dealt by key into shards.  The confirmed phrases of a shard are compiled into an Aho-Corasick
   automaton, the segments of all documents are streamed through it, and the windows about every located occurrence are
   entered by their words: all but the first go.  What the automaton does not locate is not removed.
4. A key with more than SPLIT distinct segments is dealt over several chunks by the segments' hashes.  Each chunk meets
   the automaton like any shard and settles all but its own first place of a window; the chunks' first places, one a
   chunk and window, are settled by one more aggregation.

Only segments can hold a recurring window, and those of one phrase meet in its shard: every document is streamed, but
through the automata of its own phrases alone, so the work does not grow as documents times shards.

A text of any length is one list of words in one task; it is cut into segments before it is shuffled by key.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import mark, ship, sweep
from .common import WordHash, blocks, discard, grams, odd_constants, unused, with_columns, written

LENGTH, ANCHOR = 20, 8
SPAN = LENGTH - ANCHOR + 1
SPLIT = 2000
#: Phrases of one automaton, and the bytes of segments held with it.
PHRASES, HELD = 20_000, 16 << 20
#: Rows of two numbers up to which a table is broadcast.
BROADCAST = 200_000
_K = odd_constants(ANCHOR, 5)
_NONE = -(1 << 63)


def window_keys(g: np.ndarray) -> np.ndarray:
    """The key of each window: the sliding minimum of the phrase hashes."""
    width, have = 1, g
    while 2 * width <= SPAN:
        have = np.minimum(have[:-width], have[width:])
        width *= 2
    n = len(g) - SPAN + 1
    return np.minimum(have[:n], have[SPAN - width : SPAN - width + n])


def runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, starts, windows, weights) of the runs of a document's word hashes; a run whose phrase stands in it more
    than once (periodic text) weighs 2, as its windows may repeat among themselves."""
    if len(ids) < LENGTH:
        return np.zeros(0, np.int64), *(np.zeros(0, np.int32) for _ in range(3))
    g = grams(ids, ANCHOR, _K)
    keys = window_keys(g)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.append(starts, len(keys)))
    weights = np.ones(len(starts), np.int32)
    in_order = np.sort(g)
    if (in_order[1:] == in_order[:-1]).any():
        for i, (at, size) in enumerate(zip(starts.tolist(), n.tolist(), strict=True)):
            if np.count_nonzero(g[at : at + size + SPAN - 1] == keys[at]) > 1:
                weights[i] = 2
    return keys[starts].view(np.int64), starts.astype(np.int32), n.astype(np.int32), weights


def _keyed(docs: DataFrame) -> DataFrame:
    """doc and tie name a document: its id (null: the least long) and a hash of its text."""
    docs = with_columns(docs, ["doc_id", "text"])
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc"), F.xxhash64("text").alias("tie"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _runs(batches):
    words = WordHash()
    for batch in batches:
        for doc, tie, texts in blocks(batch, ["doc", "tie", "text"], 2 << 20):
            own = [runs(words.of(t.split())) for t in texts]
            ends = pa.array(np.cumsum([0] + [len(r[0]) for r in own], dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[i] for r in own]))) for i in range(4)]
            yield pa.RecordBatch.from_arrays([doc, tie, *lists], names=["doc", "tie", "keys", "starts", "windows", "weights"])


def _segments(batches):
    for batch in batches:
        at = 0
        for (texts,) in blocks(batch, ["text"], 2 << 20):
            doc, tie = ([*batch.column(c).slice(at, len(texts)).to_pylist()] for c in ("doc", "tie"))
            found = batch.column("found").slice(at, len(texts)).to_pylist()
            at += len(texts)
            words, rows = WordHash(), []
            for d, t, own, text in zip(doc, tie, found, texts, strict=True):
                parts = text.split()
                g = grams(words.of(parts), ANCHOR, _K).view(np.int64)
                for r in own:
                    start, n, key = r["start"], r["n"], r["key"]
                    anchor = int(np.argmax(g[start : start + n + SPAN - 1] == key))
                    segment = b" ".join(parts[start : start + n - 1 + LENGTH])
                    rows.append((key, d, t, start, n, anchor, xxhash.xxh3_128_digest(segment), segment))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "doc", "tie", "start", "n", "anchor", "hash", "segment"])


def located(shard: list[tuple]) -> list[list[int]]:
    """For each (key, chunks, first, anchor, segment) the starts of the windows about the occurrences of its phrase.

    The phrases, each confirmed by two occurrences at least, stand in one automaton; a phrase is ANCHOR whole words."""
    automaton = ahocorasick.Automaton()
    for key, _, _, anchor, segment in shard:
        automaton.add_word(b" ".join([b"", *segment.split()[anchor : anchor + ANCHOR], b""]).decode("latin-1"), key)
    automaton.make_automaton()
    out = []
    for key, _, _, _, segment in shard:
        text, last = f" {segment.decode('latin-1')} ", segment.count(b" ") + 1 - LENGTH
        starts: set[int] = set()
        for end, found in automaton.iter(text):
            if found == key:
                at = text.count(" ", 0, end) - ANCHOR
                starts.update(range(max(0, at - SPAN + 1), min(at, last) + 1))
        out.append(sorted(starts))
    return out


def settled(shard: list[tuple]) -> list[tuple]:
    """(doc, tie, low, high, window) of a shard (as located() takes it): words of windows with an earlier twin in it
    (window None), and the first places of windows whose key has other chunks."""
    first_place: dict[bytes, tuple] = {}
    places = []
    for (_, chunks, first, _, segment), starts in zip(shard, located(shard), strict=True):
        parts, (doc, tie, start) = segment.split(), first
        for i in starts:
            window, place = b" ".join(parts[i : i + LENGTH]), (doc, tie, start + i)
            if place <= first_place.setdefault(window, place):
                first_place[window] = place
            places.append((window, place, chunks))
    out: list[tuple] = []
    for window, place, chunks in places:
        doc, tie, at = place
        if first_place[window] < place:
            if out and out[-1][4] is None and out[-1][:2] == (doc, tie) and out[-1][2] <= at <= out[-1][3]:
                out[-1] = (doc, tie, out[-1][2], at + LENGTH, None)
            else:
                out.append((doc, tie, at, at + LENGTH, None))
        elif chunks > 1:
            out.append((doc, tie, at, at + LENGTH, xxhash.xxh3_128_digest(window)))
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "tie", "low", "high", "window"])


def _located(batches):
    """Shards of whole chunks from rows sorted by key and chunk."""
    shard, size, keys, last = [], 0, 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "chunk", "chunks", "doc", "tie", "start", "n", "anchor", "segment")]
        for key, chunk, chunks, doc, tie, start, n, anchor, segment in zip(*columns, strict=True):
            if (key, chunk) != last:
                if keys >= PHRASES or size >= HELD:
                    yield _rows(settled(shard))
                    shard, size, keys = [], 0, 0
                last, keys = (key, chunk), keys + 1
            shard.append((key, chunks, (doc, tie, start), anchor, segment))
            size += len(segment) * (1 + n // 2)
    yield _rows(settled(shard) if shard else [])


def _kept(batches):
    for batch in batches:
        at = 0
        for (texts,) in blocks(batch, ["text"]):
            doc = batch.column("doc").slice(at, len(texts))
            found = batch.column("ranges").slice(at, len(texts)).to_pylist()
            at += len(texts)
            totals, removed, kept = [], [], []
            for own, text in zip(found, texts, strict=True):
                parts = text.split()
                keep = np.ones(len(parts), bool)
                for r in own or ():
                    keep[r["low"] : r["high"]] = False
                left = parts if keep.all() else [parts[i] for i in np.flatnonzero(keep)]
                totals.append(len(parts))
                removed.append(len(parts) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([doc, batch.column("tie").slice(at - len(texts), len(texts)), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc", "tie", "n_words", "n_removed", "kept"])


def repeated_ranges(keyed: DataFrame, split: int = SPLIT) -> DataFrame:
    """(doc, tie, ranges): the word ranges of each document that windows with an earlier twin cover."""
    spans = written(keyed.mapInArrow(_runs, "doc long, tie long, keys array<long>, starts array<int>, windows array<int>, weights array<int>"), "runs")
    flat = spans.select("doc", "tie", F.inline(F.arrays_zip("keys", "starts", "windows", "weights"))).toDF("doc", "tie", "key", "start", "n", "weight")
    twice = flat.groupBy("key").agg(F.sum("weight").alias("c")).where("c > 1").select("key")
    found = flat.join(twice, "key").groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n", "key")).alias("found"))
    segments = written(
        keyed.join(found, ["doc", "tie"]).dropDuplicates(["doc", "tie"]).select("doc", "tie", "found", "text").mapInArrow(_segments, "key long, doc long, tie long, start int, n int, anchor int, hash binary, segment binary"),
        "segments",
        "zstd",
    )
    discard(spans)
    firsts = segments.groupBy("key", "hash").agg(F.min(F.struct("doc", "tie", "start")).alias("f"), F.first("n").alias("n"), F.first("anchor").alias("anchor"), F.first("segment").alias("segment"))
    firsts = written(firsts.select("key", "hash", "f.doc", "f.tie", "f.start", "n", "anchor", "segment"), "firsts", "zstd")
    place = lambda df: df.select("hash", "key", F.struct("doc", "tie", "start").alias("first"))
    later = segments.drop("segment").join(place(firsts), ["key", "hash"]).where("struct(doc, tie, start) > first").select("doc", "tie", F.col("start").alias("low"), (F.col("start") + F.col("n") - 1 + LENGTH).alias("high"))
    crowded = written(firsts.groupBy("key").agg(F.ceil(F.count("*") / split).cast("int").alias("chunks")).where("chunks > 1"), "crowded")
    some = F.broadcast(crowded) if crowded.count() <= BROADCAST else crowded  # two numbers a row
    dealt = firsts.join(some, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("hash"), F.col("chunks")).cast("int"))
    dealt = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk").select("key", "chunk", "chunks", "doc", "tie", "start", "n", "anchor", "segment")
    found = written(dealt.mapInArrow(_located, "doc long, tie long, low int, high int, window binary"), "located")
    # a chunk has one first place of a window: as many rows a group as its key has chunks
    firsts_of = found.where("window is not null").groupBy("window").agg(F.array_sort(F.collect_list(F.struct("doc", "tie", "low", "high"))).alias("places"))
    beaten = firsts_of.select(F.inline(F.slice("places", F.lit(2), F.size("places"))))
    ranges = later.unionByName(found.where("window is null").drop("window")).unionByName(beaten)
    return ranges.groupBy("doc", "tie").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))


def _written_ranges(keyed: DataFrame, split: int) -> DataFrame:
    since = mark()
    ranges = written(repeated_ranges(keyed, split), "ranges")
    sweep(keyed.sparkSession, since, ranges._plinth_path)
    return ranges


def deduplicated(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """(doc_id, tie, n_words, n_removed, kept) of every row of docs (doc_id, text): `kept` is what is left of the text,
    its words joined by one space.

    A word goes if a window covering it has an earlier twin: one in a smaller doc_id, or earlier in its own document.
    Null and empty texts have no words.  A null doc_id comes before all others; rows that share a doc_id come in the
    order of a hash of their texts; wholly repeated rows count as one document.  An empty table gives an empty result."""
    ship(docs.sparkSession)
    keyed = _keyed(docs)
    ranges = _written_ranges(keyed, split)
    out = keyed.join(ranges, ["doc", "tie"], "left").select("doc", "tie", "ranges", "text").mapInArrow(_kept, "doc long, tie long, n_words long, n_removed long, kept binary")
    return out.select(F.when(F.col("doc") != _NONE, F.col("doc")).alias("doc_id"), "tie", "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def _cleaned(names: list[str], ranges: str):
    def run(batches):
        for batch in batches:
            texts, found = batch.column("text").to_pylist(), batch.column(ranges).to_pylist()
            kept = []
            for own, text in zip(found, texts, strict=True):
                if own:
                    parts = text.encode().split()
                    keep = np.ones(len(parts), bool)
                    for r in own:
                        keep[r["low"] : r["high"]] = False
                    text = b" ".join([parts[i] for i in np.flatnonzero(keep)]).decode()
                kept.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return run


def cleaned(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """docs with all its columns and rows, texts without the words that deduplicated() removes; n_chars, where there is
    one, follows.  Texts that lose nothing stay as they are."""
    ship(docs.sparkSession)
    doc, tie, found = (unused(c, docs.columns) for c in ("_doc", "_tie", "_ranges"))
    ranges = _written_ranges(_keyed(docs), split).toDF(doc, tie, found)
    own = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))).withColumn(tie, F.xxhash64("text"))
    out = own.join(ranges, [doc, tie], "left").select(*[F.col(f"`{c}`") for c in docs.columns], found).mapInArrow(_cleaned(docs.columns, found), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
