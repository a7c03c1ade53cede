"""Pages of a list with their totals, and small shapes of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a page by default, and at most. Fixed values.
PAGE_SIZE, MOST = 10, 100


def clamped(value: object, fallback: int, most: int | None = None) -> int:
    """A positive whole number of what was asked for, ``fallback`` where it isn't one, ``most`` at most."""
    try:
        n = int(str(value).strip())
    except ValueError:
        return fallback
    return fallback if n < 1 else min(n, most) if most else n


def page_of(rows: DataFrame, order: list[Column], page: object = 1, size: object = PAGE_SIZE) -> DataFrame:
    """A page of ``rows`` in ``order`` with ``page``, ``page_size``, ``total`` and ``total_pages`` (one at least); the total is of the same rows."""
    page, size = clamped(page, 1), clamped(size, PAGE_SIZE, MOST)
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    numbers = {"page": F.lit(page), "page_size": F.lit(size), "total_pages": F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("int")}
    return cut.crossJoin(F.broadcast(total)).withColumns(numbers)


def rows_of(arrays: DataFrame, columns: list[str], position: str | None = None) -> DataFrame:
    """A row for each place of parallel arrays, the shorter ones filled with null; ``position`` from 1 where it is asked for. Other columns are repeated."""
    others = [c for c in arrays.columns if c not in columns]
    each = arrays.select(*others, F.posexplode(F.arrays_zip(*columns)).alias("_at", "_row"))
    place = [(F.col("_at") + 1).alias(position)] if position else []
    return each.select(*others, *place, *[F.col("_row")[c].alias(c) for c in columns])


def tiles(images: DataFrame, grid: int = 2, overlap: float = 0.08, least: int = 1000) -> DataFrame:
    """The cuts of ``images`` (image_id, width, height) for a closer look: image_id, ord, label, x, y, width, height.

    The whole first, then ``grid`` by ``grid`` tiles that overlap, from the left edge to the right and from
    the top to the bottom; an image whose shorter side is under ``least`` is the whole alone.
    """
    part = lambda c: F.ceil(F.col(c) / grid * (1 + overlap)).cast("long")
    n = F.sequence(F.lit(0), F.lit(grid - 1))
    whole = images.select("image_id", F.lit(0).alias("ord"), F.lit("whole page").alias("label"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
    if grid < 2:
        return whole
    large = images.where(F.least("width", "height") >= least).withColumn("r", F.explode(n)).withColumn("c", F.explode(n))
    at = lambda size, i: F.floor((F.col(size) - part(size)) * F.col(i) / (grid - 1) + 0.5).cast("long")
    named = F.concat(F.lit("zoomed "), F.element_at(F.array(F.lit("top"), F.lit("bottom")), F.col("r") + 1), F.lit("-"), F.element_at(F.array(F.lit("left"), F.lit("right")), F.col("c") + 1), F.lit(" quarter"))
    label = named if grid == 2 else F.concat(F.lit("zoomed tile row "), (F.col("r") + 1).cast("string"), F.lit(", column "), (F.col("c") + 1).cast("string"))
    return whole.unionByName(large.select("image_id", (F.col("r") * grid + F.col("c") + 1).alias("ord"), label.alias("label"), at("width", "c").alias("x"), at("height", "r").alias("y"), part("width").alias("width"), part("height").alias("height")))
