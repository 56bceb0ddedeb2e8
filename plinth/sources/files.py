"""File sources: CSV with inferred, named or declared types, JSON feature maps, image folders, SQL scripts."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column names that stand for integers and for floats when types go by name.
INTEGER_NAMES = ("id", "codigo", "numero", "usuario_id")
FLOAT_NAMES = ("precio", "valor", "costo", "rating", "total", "ubicacion_x", "ubicacion_y")
#: Image file endings.
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".bmp")


def confined(path: str, base: str | None) -> str:
    """path, which must lie inside base/data; outside it, the file of that name there.  With a base, other stores are
    closed, and a file:// path is one like any other."""
    if base is None:
        return path
    path = re.sub(r"^file:/+", "/", path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        raise PermissionError(f"{path} is not a local file")
    root = (Path(base) / "data").resolve()
    for candidate in (Path(path), Path(base) / path, root / path):
        full = candidate.resolve()
        if full.is_relative_to(root) and full.exists():
            return str(full)
    full = root / Path(path).name
    if not full.exists():
        raise FileNotFoundError(f"{path} is not in {root}")
    return str(full)


def read_csv(spark: SparkSession, path: str, types: str = "inferred", schema: T.StructType | None = None, coalesce_empty: bool = False, multiline: bool = False) -> DataFrame:
    """A CSV file with a header.  types: inferred from the data, by_name, or all strings; a schema overrides them.
    Rows that do not parse are dropped; coalesce_empty turns missing numbers into 0.  multiline admits line ends inside
    quotes, but then a file is one task's."""
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("multiLine", multiline).option("escape", '"')
    if schema is not None:
        out = reader.schema(schema).csv(path)
    elif types == "inferred":
        out = reader.option("inferSchema", True).csv(path)
        out = out.select(*[F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, T.IntegerType) else F.col(f"`{f.name}`") for f in out.schema])
    else:
        out = reader.csv(path)
        if types == "by_name":
            kind = lambda c: "long" if c in INTEGER_NAMES else "double" if c in FLOAT_NAMES else None
            out = out.select(*[F.col(f"`{c}`").try_cast(kind(c)).alias(c) if kind(c) else F.col(f"`{c}`") for c in out.columns])
    if coalesce_empty:
        out = out.select(*[F.coalesce(F.col(f"`{f.name}`"), F.lit(0)).cast(f.dataType).alias(f.name) if isinstance(f.dataType, T.NumericType) else F.col(f"`{f.name}`") for f in out.schema])
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, v) from a JSON object that maps ids to numbers; one object a line or a file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("image_id", "v"))


def write_features(df: DataFrame, path: str, key: str, vector: str) -> None:
    """One JSON object {id: [...]} a line, each with one entry: lines are written in parallel and read like a file."""
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), F.col(vector).cast("array<double>"))).alias("value")).write.mode("overwrite").text(path)


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("image_id", "v"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, image_id, title, content) of a folder's images, not of those below it, by path."""
    from ..functions.text import basename, extension, stem

    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(folder)
    found = files.where(extension(F.col("path")).isin(*IMAGE_ENDINGS))
    return found.select("path", basename(F.col("path")).alias("image_id"), stem(F.col("path")).alias("title"), "content").orderBy("path")


def extract(images: DataFrame, extractor: Callable[[bytes], list[list[float]]]) -> DataFrame:
    """(image_id, at, v): the vectors that an extractor finds in each image's content, batch by batch on the executors.
    What it needs is imported inside it; an image it raises ValueError for gives no rows."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for image, content in zip(batch.column("image_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [(image, i, [float(x) for x in v]) for i, v in enumerate(extractor(content))]
                except ValueError:
                    continue
            columns = zip(*rows, strict=True) if rows else [[], [], []]
            kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["image_id", "at", "v"])

    return images.select("image_id", "content").mapInArrow(run, "image_id string, at int, v array<double>")
