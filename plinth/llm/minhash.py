"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds the hashes of its distinct 5-word shingles.  SuperMinHash gives each element one random
permutation of the signature's slots (drawn step by step, Fisher-Yates) and the rank j + r at its j-th step; a slot
keeps its least rank.  Ranks of step j lie in [j, j + 1), so a slot filled at one step cannot change at a later one:
the steps run for all elements of a block at once and stop, document by document, when every slot is filled.

Skew: documents with equal sets collapse into a class before anything is compared (pre-aggregated), and a bucket is
never expanded into pairs.  Each round tests a bucket's members against a few pivots only, merges what is linked and
drops the pivots; a bucket is done when its members share one component.  No link between components is lost to this.
Before that, shingles that no other candidate holds are counted.  They bound a pair's similarity from above without a
look at its sets: a text with many of its own can link with nothing, and of a group of variously edited copies only the
pairs that are close enough to each other are left to verify.  Odd sketches of the sets bound a pair from above once more:
the sets differ in as many elements at least as their sketches in bits.  The first round has one pivot a bucket, which
merges nearly all of a group of mutual near-copies; later rounds, for the buckets whose members still differ, have up to
PIVOTS[i] of them, so that rounds stay few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import WordHash, blocks, dealt_join, discard, grams, mix, odd_constants, with_columns, written

WORDS = 5
BANDS, ROWS = 32, 6
SLOTS = BANDS * ROWS
PIVOTS = (1, 4, 16, 64, 256)
#: 64-bit words of a set's sketch.
SKETCH = 16
#: Copies from which a set's rows are dealt over tasks, and how many such sets are: others are joined as they are.
HOT, MOST_HOT = 100_000, 50_000
#: Links, after each task's contraction, that one task may join: two numbers each.
ONE_TASK = 1_000_000
_K = odd_constants(WORDS + 1, 11)
_BAND = odd_constants(ROWS, 23)
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)
_WHOLE = np.array([n * int(_K[WORDS]) % 2**64 for n in range(WORDS)], np.uint64)
_STEP = np.array([(s + 1) * 0x9E3779B97F4A7C15 % 2**64 for s in range(SLOTS)], np.uint64)


def shingle_set(text: bytes | None, words: WordHash) -> np.ndarray:
    """Sorted hashes of the distinct WORDS-word shingles; fewer words count as one shingle; no word gives the empty set."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    ids = words.of(parts)
    if len(ids) < WORDS:
        return mix((ids * _K[: len(ids)]).sum(keepdims=True) + _WHOLE[len(ids)])
    return np.unique(grams(ids, WORDS, _K))


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures of non-empty sets, one row each: (step << 32 | rank) of the least element in every slot."""
    sizes = np.array([len(s) for s in sets])
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    out = np.full(len(sets) * slots, _UNSET)
    order = None
    for step in range(slots):
        x = mix(elements + _STEP[step])
        rank, draw = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
        k = step + ((draw * np.uint64(slots - step)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = k
        else:
            at = np.arange(len(elements))
            slot = order[at, k].astype(np.int64)
            order[at, k] = order[:, step]
        np.minimum.at(out, owner * slots + slot, rank | np.uint64(step << 32))
        open_ = (out.reshape(-1, slots) == _UNSET).any(1)
        if not open_.any():
            break
        keep = open_[owner]
        if order is None:  # the first step swapped slot 0 with slot k
            elements, owner, k = elements[keep], owner[keep], k[keep]
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
            order[np.arange(len(elements)), k] = 0
        elif not keep.all():
            elements, owner, order = elements[keep], owner[keep], order[keep]
    return out.reshape(-1, slots)


def band_hashes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signatures.reshape(-1, bands, rows) * _BAND[:rows]
    return mix(parts.sum(2) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _features(batches):
    words = WordHash()
    for batch in batches:
        for ids, texts in blocks(batch, ["doc_id", "text"], 1 << 20):
            sets = [shingle_set(t, words) for t in texts]
            full = [s for s in sets if len(s)]
            bands = band_hashes(super_minhash(full)) if full else np.zeros((0, BANDS), np.int64)
            ends = np.cumsum([0] + [BANDS if len(s) else 0 for s in sets], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))],
                names=["doc_id", "n_shingles", "set_key", "bands"],
            )


def odd_sketch(elements: np.ndarray) -> np.ndarray:
    """SKETCH * 64 parities: bit b is set if an odd number of elements have it as their place.  The sketches of two sets
    differ in at most as many bits as the sets in elements, as whatever both hold cancels out."""
    places = (mix(elements) >> np.uint64(32)) % np.uint64(64 * SKETCH)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=64 * SKETCH) & 1).view(np.int64)


def _sets(batches):
    words = WordHash()
    for batch in batches:
        for ids, texts in blocks(batch, ["rep", "text"], 2 << 20):
            sets = [shingle_set(t, words) for t in texts]
            ends = np.cumsum([0] + [len(s) for s in sets], dtype=np.int32)
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH), pa.array(np.concatenate([odd_sketch(s) for s in sets])))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64))), sketches], names=["rep", "elements", "sketch"])


def _forest(batches):
    """Union-find over one task's links: each node with the least node of its local component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := root.setdefault(x, x)) != x:
            root[x] = x = root[p]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    own = [(x, r) for x in list(root) if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.int64()), pa.array([r for _, r in own], pa.int64())], names=["u", "v"])


def components(links: DataFrame, one_task: int | None = None) -> DataFrame:
    """(u, v): each linked node u with the least node v of its component, v itself left out.

    Every task first contracts its own links by union-find.  Forests of ONE_TASK rows at most, counted, are joined by
    one more task; larger ones by alternating large-star and small-star rounds, in which the edges of a hub are dealt
    over tasks.  Nothing is collected but a count and a checksum a round."""
    forest = lambda df: df.mapInArrow(_forest, "u long, v long")
    edges, before = written(forest(links.select("u", "v")), "links"), None
    while True:
        state = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if before == tuple(state) or not state[0]:
            return edges
        if state[0] <= (ONE_TASK if one_task is None else one_task):
            after = written(forest(edges.coalesce(1)), "links")
            discard(edges)
            return after
        before = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = dealt_join(both.where("v > u"), least, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = dealt_join(large, low, ["u"], ["v"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = written(small.distinct(), "links")
        discard(edges)
        edges = after


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text; other columns are ignored).

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets.  Nulls: a null text has
    the empty set, which links with nothing and is its own component; a row without doc_id takes its class's smallest
    doc_id as component_id (null if there is none) and is not kept.  Rows that share a doc_id count as one node.
    An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    docs = with_columns(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    features = written(docs.mapInArrow(_features, "doc_id long, n_shingles long, set_key binary, bands array<long>"), "features")
    reps = written(features.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "classes")
    entries = reps.where("rep is not null").select("rep", "n", F.explode("bands").alias("band"))
    many = entries.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("band")
    members = written(entries.join(many, "band").withColumn("comp", F.col("rep")), "members")
    wanted = members.select("rep").distinct()
    sets = written(docs.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep").mapInArrow(_sets, "rep long, elements array<long>, sketch array<long>"), "sets")
    # own: shingles that no other candidate has; they are in no intersection
    held = sets.select(F.struct("rep", F.size("elements").cast("long").alias("n")).alias("s"), F.explode("elements").alias("e"))
    alone = held.groupBy("e").agg(F.min("s").alias("s"), F.max("s").alias("other")).where("s = other")
    own = alone.groupBy("s.rep", "s.n").agg(F.count("*").alias("own"))
    bounded = members.join(own, ["rep", "n"], "left").withColumn("own", F.coalesce("own", F.lit(0))).where(f"100 * (n - own) >= {percent} * n")
    # a bucket's least `own` bounds what any of its members can share with another: one sieve instead of tests of all pairs
    sieve = f"100 * (n - own) >= {percent} * (n + least_own)"
    several = bounded.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.min("own").alias("least_own")).where("low < high").select("band", "least_own")
    active = bounded.join(several, "band").where(sieve).drop("least_own")
    # all bands of a text go along (BANDS at most): a pair is tested in its least common band and nowhere else
    # of an id with several texts no sketch holds for all
    one = F.when(F.min("sketch") == F.max("sketch"), F.min("sketch")).alias("sketch")
    sketches = sets.groupBy("rep").agg(one)
    whole = active.groupBy("rep", "n").agg(F.collect_set("band").alias("bands")).join(sketches, "rep")
    before, members = members, written(active.join(whole, ["rep", "n"]), "members")
    discard(before)
    differing = " + ".join(f"bit_count(sketch[{i}] ^ p.sketch[{i}])" for i in range(SKETCH))
    # the cheap conditions first; most pairs of a large bucket end at them
    possible = (
        f"comp <> p.comp and 100 * least(n - own, p.n - p.own) >= {percent} * greatest(n + p.own, p.n + own)"
        f" and coalesce({100 + percent} * ({differing}) <= {100 - percent} * (n + p.n), true) and band = array_min(array_intersect(bands, p.bands))"
    )
    labels, turn = None, 0
    while not members.isEmpty():
        share = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(PIVOTS[min(turn, len(PIVOTS) - 1)]))
        pivots = members.groupBy("band", share.alias("share")).agg(F.min(F.struct("rep", "n", "own", "comp", "bands", "sketch")).alias("p")).select("band", "p")
        turn += 1
        pairs = (
            members.join(pivots, "band")
            .where(possible)
            .select(F.when(F.col("rep") < F.col("p.rep"), F.struct("rep", "n", "comp")).otherwise(F.struct("p.rep", "p.n", "p.comp")).alias("p"), F.when(F.col("rep") < F.col("p.rep"), F.struct("p.rep", "p.n", "p.comp")).otherwise(F.struct("rep", "n", "comp")).alias("m"))
            .select("m.rep", "m.comp", F.col("p.rep").alias("pivot"), F.col("p.comp").alias("pivot_comp"), "m.n", F.col("p.n").alias("pivot_n"))
            .distinct()
        )
        pairs = written(pairs, "pairs")
        shared = F.size(F.array_intersect("elements", "pivot_elements"))
        links = (
            pairs.join(sets.select("rep", "elements"), "rep")
            .join(sets.select(F.col("rep").alias("pivot"), F.col("elements").alias("pivot_elements")), "pivot")
            .withColumn("shared", shared.cast("long"))
            .where(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("n") + F.col("pivot_n") - F.col("shared")))
            .select(F.col("comp").alias("u"), F.col("pivot_comp").alias("v"))
        )
        merged = components(links)
        moved = merged.select(F.col("u").alias("comp"), F.col("v").alias("to"))
        left = members.join(pivots.select("band", "p.rep"), ["band", "rep"], "left_anti")
        left = dealt_join(left, moved, ["comp"], ["rep", "band"], "left").select("band", "rep", "n", "own", "bands", "sketch", F.coalesce("to", "comp").alias("comp"))
        alive = left.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("own").alias("least_own")).where("low < high").select("band", "least_own")
        after = written(left.join(alive, "band").where(sieve).drop("least_own"), "members")
        if labels is None:
            new_labels = merged
        else:  # what was a component's least node may have moved on
            new_labels = written(labels.join(moved, labels["v"] == moved["comp"], "left").select("u", F.coalesce("to", "v").alias("v")).unionByName(merged), "labels")
            discard(labels, merged)
        discard(members, pairs)
        members, labels = after, new_labels
    discard(members, sets)
    classes = reps.select("set_key", "rep")
    if labels is not None:
        classes = classes.join(labels.select(F.col("u").alias("rep"), F.col("v").alias("to")), "rep", "left").select("set_key", F.coalesce("to", "rep").alias("component"))
    else:
        classes = classes.withColumnRenamed("rep", "component")
    # sets of very many copies are dealt over tasks; their number is bounded by the rows over HOT
    hot = F.broadcast(written(reps.where(F.col("copies") > HOT).select("set_key", F.lit(True).alias("hot")).limit(MOST_HOT), "hot"))
    many_salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))
    classes = classes.join(hot, "set_key", "left").select("set_key", "component", F.explode(many_salts).alias("salt"))
    narrow = features.select("doc_id", "n_shingles", "set_key").join(hot, "set_key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")).otherwise(0))
    out = narrow.join(classes, ["set_key", "salt"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
