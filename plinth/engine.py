"""The engine: named tables, the SQL dialect, keyed record access."""

from __future__ import annotations

from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import dml, fulltext, keyed, paging, spatial, vectors
from .plans import dialect, planner
from .runtime import fresh_path
from .sources import files
from .sources.catalog import POS, Catalog

_TYPES = {"INT": T.LongType(), "INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "DATE": T.DateType(), "VARCHAR": T.StringType(), "STRING": T.StringType(), "ARRAY": T.ArrayType(T.DoubleType())}


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, base: str | None = None, strict: bool = False):
        """root: where snapshots and the catalog live; base: FROM FILE reads inside base/data only; strict: unknown
        columns are errors."""
        self.spark, self.base, self.strict = spark, base, strict
        self.root = root
        self.views: dict[str, tuple[DataFrame, str]] = {}

    @cached_property
    def catalog(self) -> Catalog:
        return Catalog(self.spark, self.root or fresh_path(self.spark, "tables"))

    def register(self, name: str, df: DataFrame, key: str) -> None:
        """A table that is read where it lies and can't be changed."""
        if key not in df.columns:
            raise ValueError(f"{name} has no column {key}")
        self.views[name] = (df, key)

    def frame(self, name: str) -> tuple[DataFrame, str]:
        if name in self.views:
            return self.views[name]
        return self.catalog.load(name), self.catalog.entry(name).key

    def sql(self, text: str) -> DataFrame:
        """Runs a script; the last statement's result: rows of a SELECT, else one row (operation, table_name, rows)."""
        out = None
        for statement in dialect.parse(text):
            out = self.run(statement)
        if out is None:
            raise dialect.DialectError("there is no statement")
        return out

    def run(self, s: Any) -> DataFrame:
        if isinstance(s, dialect.Select):
            df, key = self.frame(s.table)
            entry = None if s.table in self.views else self.catalog.entry(s.table)
            if entry and entry.index_kind == "hash" and isinstance(s.where, dialect.Compare) and (s.where.field, s.where.op) == (key, "="):
                df = self.catalog.keyed(s.table, s.where.value)
            return planner.select(df, s, key, self.strict, entry and entry.points, lambda name: self.vector(s.table, name), lambda field: self.text_index(s.table, field)).drop(POS)
        if isinstance(s, dialect.ImageSearch):
            df, key = self.frame("images")
            return vectors.cosine_top(df.where(F.col("folder") == s.folder), "v", self.vector("images", s.target), s.k, key)
        if isinstance(s, dialect.CreateTable):
            return self._created(s)
        if isinstance(s, dialect.CreateFromFile):
            df = files.read_csv(self.spark, files.confined(s.path, self.base), "strings" if s.index == "fulltext" else "inferred")
            self.catalog.create(s.table, df.withColumn(POS, F.monotonically_increasing_id()), s.index, s.key, s.path)
            if s.index == "fulltext":
                self.catalog.text_index(s.table)
            return self._said("create", s.table, self.catalog.load(s.table).count())
        if s.table in self.views:
            raise dialect.DialectError(f"{s.table} is read-only")
        df, key = self.frame(s.table)
        points = self.catalog.entry(s.table).points
        if isinstance(s, dialect.Insert):
            rows, names = df.drop(POS), [c for c in df.columns if c != POS]
            if s.values[names.index(key)] is None:
                raise ValueError(f"{key} needs a value")
            self.catalog.append(s.table, dml.row(rows, s.values))
            return self._said("insert", s.table, 1)
        if s.where is None and isinstance(s, dialect.Delete):
            raise dialect.DialectError("DELETE needs a WHERE")
        where = F.lit(True) if s.where is None else planner.predicate(df, s.where, points)
        n = df.where(where).count()
        if isinstance(s, dialect.Delete):
            if not n:
                raise KeyError(f"{s.table} has no such row")
            self.catalog.store(s.table, dml.deleted(df, where))
            return self._said("delete", s.table, n)
        changes = {}
        for name, value in s.assignments:
            if name not in df.columns:
                raise dialect.DialectError(f"{s.table} has no column {name}")
            bound = vectors.array(list(value)) if isinstance(value, tuple) else planner.literal(value, df.schema[name].dataType)
            if bound is None:
                raise ValueError(f"{name} can't be {value!r}")
            changes[name] = bound
        self.catalog.store(s.table, dml.updated(df, changes, where))
        return self._said("update", s.table, n)

    def _created(self, s: dialect.CreateTable) -> DataFrame:
        indexed = [c for c in s.columns if c.index]
        first = indexed[0] if indexed else s.columns[0]
        schema = T.StructType([T.StructField(c.name, _TYPES[c.type], True, {"size": c.size} if c.size else None) for c in s.columns])
        schema.add(POS, T.LongType())
        self.catalog.create(s.table, self.spark.createDataFrame([], schema), first.index or "seq", first.name)
        return self._said("create", s.table, 0)

    def _said(self, operation: str, table: str, rows: int) -> DataFrame:
        return self.spark.createDataFrame([(operation, table, rows)], "operation string, table_name string, rows long")

    def vector(self, table: str, row_id: str) -> list[float]:
        """The vector of a row, by id, for similarity to it."""
        df, key = self.frame(table)
        column = next(f.name for f in df.schema if isinstance(f.dataType, T.ArrayType))
        found = df.where(planner.comparison(df, key, "=", row_id)).select(column).first()
        if found is None:
            raise KeyError(f"{table} has no row {row_id}")
        return [float(x) for x in found[0]]

    def page(self, text: str, number: int = 1, size: int = 10) -> tuple[DataFrame, int]:
        """A page of a SELECT's rows and the number of all rows."""
        df = self.sql(text)
        return paging.page(df, number, size), df.count()

    def text_index(self, name: str, field: str) -> fulltext.Index | None:
        """The saved index of a FULLTEXT table, if it covers the field."""
        entry = None if name in self.views else self.catalog.entry(name)
        return self.catalog.text_index(name) if entry and entry.index_kind == "fulltext" and entry.text_column == field else None

    # keyed record access
    def _rows(self, name: str, value: Any) -> tuple[DataFrame, str, str]:
        """Rows that may hold a key, the key's column and the index kind; a view is read in its own order."""
        if name in self.views:
            df, key = self.views[name]
            return df.withColumn(POS, F.monotonically_increasing_id()), key, "seq"
        entry = self.catalog.entry(name)
        return self.catalog.keyed(name, value), entry.key, entry.index_kind

    def get(self, name: str, value: Any) -> DataFrame:
        df, key, kind = self._rows(name, value)
        if kind == "seq" and name not in self.views:
            return keyed.sequential_point(*self.catalog.parts(name), key, value, POS).drop(POS)
        return keyed.point(df, key, value, POS, kind).drop(POS)

    def all(self, name: str, value: Any) -> DataFrame:
        """Every row of a key in load order, base and overflow."""
        df, key, _ = self._rows(name, value)
        return keyed.all_for(df, key, value, POS).drop(POS)

    def range(self, name: str, low: Any, high: Any) -> DataFrame:
        df, key = self.frame(name)
        if name in self.views:
            return df.where(F.col(key).between(F.lit(low), F.lit(high))).orderBy(key)
        kind = self._kind(name)
        if kind == "seq":
            return keyed.sequential_between(*self.catalog.parts(name), key, low, high, POS).drop(POS)
        return keyed.between(df, key, low, high, POS, kind).orderBy(key).drop(POS)

    def box(self, name: str, box: tuple[float, float, float, float]) -> DataFrame:
        """Rows whose point, or rectangle (columns min_x, min_y, max_x, max_y), shares a point with the box."""
        df, _ = self.frame(name)
        sides = ("min_x", "min_y", "max_x", "max_y")
        if set(sides) <= set(df.columns):
            own = tuple(F.col(c) for c in sides)
        else:
            points = self.catalog.entry(name).points if name not in self.views else {}
            x, y = (F.col(c) for c in next(iter(points.values()))) if points else planner.axes(df, next(f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)), None)
            own = (x, y, x, y)
        return df.where(spatial.intersects(own, box)).drop(POS)

    def add(self, name: str, rows: DataFrame) -> None:
        """Appends rows with the table's columns, as a part that is merged with others later."""
        self._writable(name)
        self.catalog.append(name, rows)

    def remove(self, name: str, value: Any) -> None:
        """Removes what the index kind removes for a key: one row, all for B+ and R-trees."""
        self._writable(name)
        df, key = self.frame(name)
        kind = self._kind(name)
        if kind in ("btree", "rtree"):
            self.catalog.store(name, dml.deleted(df, F.col(key) == F.lit(value)))
        elif kind == "seq":
            self.catalog.store(name, keyed.sequential_without(*self.catalog.parts(name), key, value, POS))
        else:
            self.catalog.store(name, keyed.without_first(df, key, value, POS))

    def update(self, name: str, value: Any, **changes: Any) -> None:
        """Changes the row that get() finds; an ISAM table gets one if the key is absent."""
        self._writable(name)
        df, key = self.frame(name)
        kind, own = self._kind(name), {c: F.lit(v).cast(df.schema[c].dataType) for c, v in changes.items()}
        if kind == "isam":
            self.catalog.store(name, keyed.updated_or_inserted(df, key, value, POS, own))
        else:
            self.catalog.store(name, keyed.updated_first(df, key, value, POS, own, last=kind == "btree"))

    def _writable(self, name: str) -> None:
        if name in self.views:
            raise dialect.DialectError(f"{name} is read-only")

    def info(self, name: str) -> DataFrame:
        df, key = self.frame(name)
        return keyed.statistics(df, key, self._kind(name))

    def similar(self, image: Any, k: int = 10, name: str = "histograms") -> DataFrame:
        """Images most like one, over a table (image_id, word_id, weight): by its postings where a table
        `{name}_postings` is registered, else by a scan."""
        weighted, key = self.frame(name)
        query = weighted.where(F.col(key) == F.lit(image)).select("word_id", F.col("weight").alias("qw"))
        if f"{name}_postings" in self.views:
            return vectors.inverted_search(self.views[f"{name}_postings"][0], query, key, k)
        return vectors.sequential_search(weighted, query, key, k)

    def _kind(self, name: str) -> str:
        return "seq" if name in self.views else self.catalog.entry(name).index_kind
