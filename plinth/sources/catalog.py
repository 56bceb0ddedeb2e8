"""Tables by name: schema, index kind, key, text and point columns, and the snapshot that holds the rows now."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fulltext, spatial
from ..runtime import delete, read_versioned, write_versioned

#: Columns taken as text first, and parts of names of point columns.
TEXT_NAMES = ("text", "content", "body", "description", "title", "titulo", "name", "nombre")
POINT_NAMES = ("ubicacion", "lat", "lon")


POS = "_pos"
BUCKET = "_bucket"
#: Appended parts that are merged into a new snapshot; a sequential file has fewer.
PARTS, SEQ_PARTS = 64, 5
#: Rows of a hash bucket or grid cell.
BUCKET_ROWS = 1_000_000


@dataclass
class TableEntry:
    name: str
    index_kind: str
    key: str
    path: str  # the current snapshot, Parquet
    schema: str  # JSON
    source: str = ""
    text_column: str | None = None
    points: dict[str, tuple[str, str]] = field(default_factory=dict)
    added: list[str] = field(default_factory=list)  # parts appended since the snapshot
    next_pos: int = 0
    buckets: int = 1
    previous: list[str] = field(default_factory=list)  # what the snapshot before is made of
    index_path: str | None = None  # a saved text index of these very rows

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


def text_column(schema: T.StructType, key: str) -> str | None:
    names = schema.fieldNames()
    return next((c for c in TEXT_NAMES if c in names), next((c for c in names if c not in (key, POS)), None))


def point_columns(schema: T.StructType) -> dict[str, tuple[str, str]]:
    """Names for the table's points: two numeric columns whose names say so, else the first two numeric ones."""
    numbers = [f.name for f in schema if f.name != POS and isinstance(f.dataType, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType))]
    named = [c for c in numbers if any(p in c.lower() for p in POINT_NAMES)]
    pair = named[:2] if len(named) >= 2 else [f.name for f in schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))][:2]
    if len(pair) < 2:
        pair = numbers[:2]
    return {n: (pair[0], pair[1]) for n in ("ubicacion", "point", pair[0])} if len(pair) == 2 else {}


class Catalog:
    """Entries in a small versioned file beside the data.  A table is a snapshot and the parts appended since.  A write
    makes a new snapshot or part and then swaps the entry, so readers of the old one are not disturbed and a failed
    write leaves the table as it was.  The snapshot before the current one is kept for its readers, older ones go.

    Layouts: btree, isam and seq by ranges of the key; hash by buckets of the key's hash, one folder each; rtree by grid
    cells of its points.  Lookups by key, ranges and boxes prune files or row groups by them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.entries: dict[str, TableEntry] = {}
        self.reload()

    def reload(self) -> None:
        text = read_versioned(self.spark, f"{self.root}/catalog.json")
        if text is not None:
            raw = json.loads(text)
            self.entries = {n: TableEntry(**(e | {"points": {k: tuple(v) for k, v in e["points"].items()}})) for n, e in raw.items()}

    def persist(self) -> None:
        text = json.dumps({n: asdict(e) for n, e in self.entries.items()}, ensure_ascii=False, indent=1)
        write_versioned(self.spark, f"{self.root}/catalog.json", text)

    def entry(self, name: str) -> TableEntry:
        if name not in self.entries:
            raise KeyError(f"no table is called {name}")
        return self.entries[name]

    def create(self, name: str, df: DataFrame, index_kind: str, key: str, source: str = "", replace: bool = False) -> TableEntry:
        if name in self.entries and not replace:
            raise ValueError(f"{name} exists")
        if key not in df.columns:
            raise ValueError(f"{name} has no column {key}")
        entry = TableEntry(name, index_kind, key, "", df.schema.json(), source, text_column(df.schema, key), point_columns(df.schema))
        self.entries[name] = entry
        try:
            self.store(name, df)
        except Exception:
            del self.entries[name]
            raise
        return entry

    def fresh(self, name: str) -> str:
        return f"{self.root}/{name}/{uuid.uuid4().hex}"

    def _laid(self, entry: TableEntry, df: DataFrame) -> DataFrame:
        kind, key = entry.index_kind, F.col(f"`{entry.key}`")
        if kind in ("btree", "isam", "seq"):
            return df.repartitionByRange(key).sortWithinPartitions(key)
        if kind == "hash":
            return df.withColumn(BUCKET, bucket_of(key, entry.buckets)).repartition(BUCKET).sortWithinPartitions(BUCKET, key)
        if kind == "rtree" and entry.points:
            x, y = (F.col(f"`{c}`") for c in next(iter(entry.points.values())))
            size = spatial.cell_size(df, x, y, BUCKET_ROWS)
            cells = spatial.with_cells(df, x, y, size)
            return cells.repartitionByRange("cell_x", "cell_y").sortWithinPartitions("cell_x", "cell_y").drop("cell_x", "cell_y")
        return df

    def _write(self, entry: TableEntry, df: DataFrame, path: str) -> None:
        writer = self._laid(entry, df).write
        (writer.partitionBy(BUCKET) if entry.index_kind == "hash" else writer).parquet(path)

    def store(self, name: str, df: DataFrame) -> None:
        """df becomes the table's snapshot."""
        entry = self.entry(name)
        path = self.fresh(name)
        if entry.index_kind == "hash":
            rows = df.count()
            entry.buckets = 1 << max(0, math.ceil(math.log2(max(1, rows / BUCKET_ROWS))))
        self._write(entry, df, path)
        old, entry.previous = entry.previous, [p for p in (entry.path, *entry.added, entry.index_path) if p]
        entry.path, entry.added, entry.schema, entry.index_path = path, [], df.schema.json(), None
        if POS in df.columns:
            entry.next_pos = max(entry.next_pos, (self.spark.read.schema(df.schema).parquet(path).agg(F.max(POS)).first()[0] or 0) + 1)
        self.persist()
        for p in old:
            delete(self.spark, p)

    def append(self, name: str, df: DataFrame, path: str | None = None) -> None:
        """Adds rows, numbered after the last, as a part of its own; when there are many, part and snapshot are merged.
        A path that is named again (a batch delivered twice) is replaced, so that no row comes twice."""
        entry = self.entry(name)
        if path is not None and path in entry.added:
            return
        if POS in entry.struct().fieldNames() and POS not in df.columns:
            df = df.withColumn(POS, F.monotonically_increasing_id() + entry.next_pos)
        part = path or self.fresh(name)
        if path is not None:
            delete(self.spark, part)
        own = df.select(*[F.col(f"`{c}`") for c in entry.struct().fieldNames()])
        self._write(entry, own, part)
        if POS in own.columns:
            entry.next_pos = max(entry.next_pos, (self.spark.read.schema(own.schema).parquet(part).agg(F.max(POS)).first()[0] or 0) + 1)
        entry.added.append(part)
        if entry.index_path:
            entry.previous.append(entry.index_path)
            entry.index_path = None
        if len(entry.added) >= (SEQ_PARTS if entry.index_kind == "seq" else PARTS):
            self.store(name, self.load(name))
        else:
            self.persist()

    def _read(self, entry: TableEntry, paths: list[str]) -> DataFrame:
        schema = entry.struct()
        if entry.index_kind == "hash":
            return self.spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(*paths)
        return self.spark.read.schema(schema).parquet(*paths)

    def load(self, name: str) -> DataFrame:
        entry = self.entry(name)
        return self._read(entry, [entry.path, *entry.added]).drop(BUCKET)

    def keyed(self, name: str, value) -> DataFrame:
        """Rows that may hold a key: of a hash table its bucket alone."""
        entry = self.entry(name)
        df = self._read(entry, [entry.path, *entry.added])
        if entry.index_kind == "hash":
            df = df.where(F.col(BUCKET) == bucket_of(F.lit(value).cast(entry.struct()[entry.key].dataType), entry.buckets))
        return df.drop(BUCKET)

    def parts(self, name: str) -> tuple[DataFrame, DataFrame]:
        """(main, added) rows of a sequential table."""
        entry = self.entry(name)
        main = self._read(entry, [entry.path]).drop(BUCKET)
        return main, self._read(entry, entry.added).drop(BUCKET) if entry.added else main.limit(0)

    def text_index(self, name: str) -> fulltext.Index:
        """The saved index of the table's text column; built anew after the rows have changed."""
        entry = self.entry(name)
        docs = fulltext.documents(self.load(name), entry.key, entry.text_column)
        if entry.index_path is None:
            path = self.fresh(name)
            fulltext.Index(docs).save(path)
            entry.index_path = path
            self.persist()
        return fulltext.Index.saved(docs, entry.index_path)

    def tables(self) -> DataFrame:
        own = lambda e: [f for f in e.struct() if f.name != POS]
        rows = [(e.name, e.index_kind, e.key, e.source, len(own(e))) for e in sorted(self.entries.values(), key=lambda e: e.name)]
        return self.spark.createDataFrame(rows, "table_name string, index_kind string, key string, source string, n_columns int")

    def columns(self, name: str) -> DataFrame:
        """One row a column of a table."""
        e = self.entry(name)
        rows = [(f.name, f.dataType.simpleString(), (f.metadata or {}).get("size"), f.name == e.key, f.name == e.text_column) for f in e.struct() if f.name != POS]
        return self.spark.createDataFrame(rows, "column_name string, type string, size int, is_key boolean, is_text boolean")

    def find(self, part: str) -> DataFrame:
        """Tables whose name holds a text, ignoring case."""
        return self.tables().where(F.contains(F.lower("table_name"), F.lit(part.lower())))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
