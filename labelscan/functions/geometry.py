"""Box arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def overlap_ratio(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over the smaller area; boxes as left, top, width, height."""
    wide = F.least(a["left"] + a["width"], b["left"] + b["width"]) - F.greatest(a["left"], b["left"])
    tall = F.least(a["top"] + a["height"], b["top"] + b["height"]) - F.greatest(a["top"], b["top"])
    area = F.least(a["width"] * a["height"], b["width"] * b["height"])
    return F.when(area == 0, 0.0).otherwise(F.greatest(wide, F.lit(0)) * F.greatest(tall, F.lit(0)) / area)


def bounds(left: Column, top: Column, width: Column, height: Column) -> list[Column]:
    """Aggregates of the box around a group."""
    return [F.min(left).alias("box_left"), F.min(top).alias("box_top"), (F.max(left + width) - F.min(left)).alias("box_width"), (F.max(top + height) - F.min(top)).alias("box_height")]


def clamp(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """The part of a box in an image, at least a pixel each way."""
    left = F.greatest(F.lit(0), F.least(box["left"], width - 1))
    top = F.greatest(F.lit(0), F.least(box["top"], height - 1))
    right = F.least(width, F.greatest(left + 1, box["left"] + box["width"]))
    bottom = F.least(height, F.greatest(top + 1, box["top"] + box["height"]))
    return {"left": left, "top": top, "width": right - left, "height": bottom - top}


def to_source(x: Column, scale: float, offset: Column) -> Column:
    """A scaled coordinate in source pixels (ties to even)."""
    return (offset + F.bround(x / scale)).cast("int")


def tiles(width: Column, height: Column, rows: int = 3, columns: int = 1, overlap: float = 0.18) -> Column:
    """Array of overlapping tiles (left, top, width, height), row by row."""

    def span(size: Column, k: Column, n: int) -> tuple[Column, Column]:
        cell = F.greatest(F.lit(1), F.ceil(size / n))
        extra = F.bround(cell * overlap)
        return F.greatest(F.lit(0), k * cell - extra).cast("int"), F.least(size, F.least(size, (k + 1) * cell) + extra).cast("int")

    def tile(i: Column) -> Column:
        top, bottom = span(height, F.floor(i / columns), rows)
        left, right = span(width, i % columns, columns)
        return F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), tile), lambda t: (t["width"] > 0) & (t["height"] > 0))
