"""Captions of evidence boxes, placed so that no caption hides another of its image.

The captions of an image are placed in order; each keeps clear of those before it.  That is a fold whose state is the list of occupied
rectangles, written with higher-order functions over the image's own boxes, so only an image's boxes (a handful) ever meet.
Font metrics are parameters: every character is ``char`` pixels wide and ``line`` high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import clipped, overlaps

#: Margin of a caption, gap to its box, room left at the sides, what stands for a text's cut end.
MARGIN, GAP, SIDES, MORE = 6, 2, 8, "..."
RECT = "struct<left:int,top:int,right:int,bottom:int>"


def fitted(text: Column, width: Column, char: int) -> Column:
    """The text, or as much of its beginning as leaves room for the dots."""
    room = F.floor(width / char).cast("int")
    return F.when(F.length(text) <= room, text).otherwise(F.concat(F.substring(text, F.lit(1), F.greatest(F.lit(0), room - len(MORE))), F.lit(MORE)))


def within(x: Column, most: Column) -> Column:
    return F.least(F.greatest(F.lit(0), x), F.greatest(F.lit(0), most)).cast("int")


def rect(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(left.alias("left"), top.alias("top"), (left + width).alias("right"), (top + height).alias("bottom"))


def first_free(b: Column, occupied: Column) -> Column:
    """The caption's rectangle at the first height, outwards from its own, where it overlaps none of the occupied ones."""
    step = b["height"] + GAP
    steps = F.when(step < b["image_height"], F.sequence(step, b["image_height"] - 1, step)).otherwise(F.array().cast("array<int>"))
    heights = F.concat(F.array(b["top"]), F.flatten(F.transform(steps, lambda s: F.array(b["top"] + s, b["top"] - s))))
    spots = F.transform(heights, lambda y: rect(b["left"], within(y, b["image_height"] - b["height"]), b["width"], b["height"]))
    free = lambda s: ~F.exists(occupied, lambda o: overlaps(s, o))
    # nearly every caption has its own height, within the image, free; only the others look at all heights
    own, near = rect(b["left"], b["top"], b["width"], b["height"]), rect(b["left"], within(b["top"], b["image_height"] - b["height"]), b["width"], b["height"])
    return F.when(free(near), near).otherwise(F.coalesce(F.get(F.filter(spots, free), F.lit(0)), own))


def placed(decisions: DataFrame, image: str = "image_id", order: str = "pos", char: int = 6, line: int = 11) -> DataFrame:
    """``image, order, caption, box, caption_box`` of decisions ``text, left, top, width, height, image_width, image_height``.

    Decisions without a box in the image are left out.  A caption stands above its box where there is room, else below it.
    """
    corners = clipped({c: F.col(c) for c in ("left", "top", "width", "height")}, F.col("image_width"), F.col("image_height"))
    df = decisions.withColumn("box", corners).filter("box is not null").withColumn("caption", fitted(F.col("text"), F.greatest(F.lit(1), F.col("image_width") - SIDES), char))
    wide, high = (F.length("caption") * char + MARGIN).cast("int"), F.lit(line + MARGIN)
    above = F.when(F.col("box.top") >= high + GAP, F.col("box.top") - high - GAP).otherwise(F.col("box.bottom") + GAP)
    own = {"left": within(F.col("box.left"), F.col("image_width") - wide), "top": within(above, F.col("image_height") - high), "width": wide, "height": high, "image_height": F.col("image_height").cast("int")}
    item = F.struct(F.col(order).alias("order"), "caption", "box", *[v.alias(k) for k, v in own.items()])
    rows = df.groupBy(image).agg(F.array_sort(F.collect_list(item)).alias("items"))
    spots = F.aggregate("items", F.array().cast(f"array<{RECT}>"), lambda occupied, b: F.concat(occupied, F.array(first_free(b, occupied).cast(RECT))))
    shown = F.arrays_zip(F.col("items").alias("item"), spots.alias("caption_box"))
    return rows.select(image, F.explode(shown).alias("x")).select(image, F.col("x.item.order").alias(order), "x.item.caption", "x.item.box", "x.caption_box")
