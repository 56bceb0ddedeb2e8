"""Best-fit-decreasing packing of documents into token sequences.

Documents are tokenised where they lie into a narrow table (doc_id, piece, start, length, crc, row).  Full pieces are
sequences of their own.  The others, a document's last pieces, are dealt by a hash of their row, which no two share, into
groups of about GROUP and each group is packed by itself, so no task grows with the input or with a hot key.  Bins that
a group leaves open (filled under FULL) are opened again: their pieces, now few, are dealt and packed anew, until one
group holds them all or packing them again saves nothing.

A text of any length is tokenised in one task; its pieces are then rows like any others.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .common import blocks, with_columns, written
from .tokens import END, encoder, tokenizer_path

CAPACITY = 2048
GROUP = 8192
#: Share of its capacity from which a bin is left closed while other groups have open ones.
FULL = 0.995
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: how many open bins have each; finds the least one >= need."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        at = self.size + capacity
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least remaining capacity of at least need that an open bin has, else -1."""
        at = self.size + need
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return -1
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length: the longest first, each into the tightest open bin that takes it, else a new one."""
    tree, open_bins, out, bins = CapacityTree(capacity), {}, [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room = tree.tightest(n)
        if room < 0:
            b, room = bins, capacity
            bins += 1
        else:
            b = open_bins[room].pop()
            tree.add(room, -1)
        out[i] = (b, capacity - room)
        if room > n:
            open_bins.setdefault(room - n, []).append(b)
            tree.add(room - n, 1)
    return out


def _pieces(path: str, capacity: int):
    def run(batches):
        own, row = encoder(path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for ids, texts in blocks(batch, ["doc_id", "text"]):
                rows = []
                for doc, text in zip(ids.to_pylist(), texts, strict=True):
                    data = own.encode((text or b"").decode()) + END
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), row))
                        row += 1
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return run


def _pack(capacity: int, turn: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("row", "ascending")])
        lengths = group.column("length").to_pylist()
        places = best_fit_decreasing(lengths, capacity)
        first, filled = turn << 56 | key[0].as_py() << 16, {}
        for (b, _), n in zip(places, lengths, strict=True):
            filled[b] = filled.get(b, 0) + n
        columns = [pa.array([first + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64()), pa.array([filled[b] < FULL * capacity for b, _ in places], pa.bool_())]
        for name, column in zip(("sequence_id", "offset", "open"), columns, strict=True):
            group = group.append_column(name, column)
        return group.drop(["group"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Every piece of every row of docs (doc_id, text) with its place in a sequence of at most `capacity` tokens.

    Only documents of more than `capacity` tokens (end id 0 included) are cut.  Null and empty texts are the end id
    alone; rows with equal or null doc_ids are packed like any others; an empty table gives an empty result.
    """
    if group > 1 << 15:
        raise ValueError("a group has at most 32768 pieces")
    ship(docs.sparkSession)
    docs = with_columns(docs, ["doc_id", "text"])
    pieces = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
            _pieces(path or tokenizer_path("word_bpe_49k.json"), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
        ),
        "pieces",
    )
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    # negative ids: full pieces
    out = pieces.where(F.col("length") == capacity).select(*names[:5], (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, turn, n = pieces.where(F.col("length") < capacity), 0, None
    while True:
        before, n = n, rest.count()
        if not n:
            return out
        groups = -(-n // group)
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))
        packed = written(dealt.groupBy("group").applyInArrow(_pack(capacity, turn), f"{SCHEMA}, row long, open boolean"), "packed")
        if groups == 1 or before is not None and n > 0.9 * before or turn == 100:
            return out.unionByName(packed.select(*names))
        out = out.unionByName(packed.where("not open").select(*names))
        rest, turn = packed.where("open").select(*pieces.columns), turn + 1
