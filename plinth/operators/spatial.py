"""Points and rectangles in the plane: radius, nearest neighbours, boxes, distances, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance2(x: Column, y: Column, px: float, py: float) -> Column:
    return (x - F.lit(px)) * (x - F.lit(px)) + (y - F.lit(py)) * (y - F.lit(py))


def within(x: Column, y: Column, px: float, py: float, radius: float) -> Column:
    """Euclidean distance at most radius; the bounding box beside it is what a Parquet scan can prune by."""
    box = x.between(px - radius, px + radius) & y.between(py - radius, py + radius)
    return box & (distance2(x, y, px, py) <= F.lit(radius * radius))


def nearest(df: DataFrame, x: Column, y: Column, px: float, py: float, k: int, key: str) -> DataFrame:
    """The k rows nearest to a point, exactly; ties go to the smaller key.  Adds `distance`."""
    away = F.round(F.sqrt(distance2(x, y, px, py)), 9)
    return df.where(x.isNotNull() & y.isNotNull()).withColumn("distance", away).orderBy("distance", key).limit(k)


def intersects(box: tuple[Column, Column, Column, Column], query: tuple[float, float, float, float]) -> Column:
    """Closed rectangles (min x, min y, max x, max y) that share a point."""
    return (box[0] <= query[2]) & (box[2] >= query[0]) & (box[1] <= query[3]) & (box[3] >= query[1])


def min_distance(box: tuple[Column, Column, Column, Column], px: float, py: float) -> Column:
    """Distance from a point to a rectangle: 0 inside."""
    dx = F.greatest(box[0] - F.lit(px), F.lit(0.0), F.lit(px) - box[2])
    dy = F.greatest(box[1] - F.lit(py), F.lit(0.0), F.lit(py) - box[3])
    return F.sqrt(dx * dx + dy * dy)


def area(box: tuple[Column, Column, Column, Column]) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def enlargement(box: tuple[Column, Column, Column, Column], other: tuple[float, float, float, float]) -> Column:
    """Area a rectangle gains when it is stretched over another."""
    low = [F.least(box[i], F.lit(other[i])) for i in (0, 1)]
    high = [F.greatest(box[i], F.lit(other[i])) for i in (2, 3)]
    return area((*low, *high)) - area(box)


def bounds(df: DataFrame, x: Column, y: Column, by: list[str]) -> DataFrame:
    """Least rectangle about each group's points."""
    return df.groupBy(*by).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def cell_size(df: DataFrame, x: Column, y: Column, rows: int) -> float:
    """A grid width at which a cell of evenly spread points holds about `rows` of them."""
    b = df.agg(F.count("*").alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    if not b.n or None in (b.x0, b.x1, b.y0, b.y1):
        return 1.0
    width = max(float(b.x1 - b.x0), float(b.y1 - b.y0))
    return width / max(1.0, (b.n / rows) ** 0.5) or 1.0


def with_cells(df: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """Grid cells, the layout column to range-partition point tables by before they are written."""
    return df.withColumn("cell_x", F.floor(x / size).cast("int")).withColumn("cell_y", F.floor(y / size).cast("int"))
