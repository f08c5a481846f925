"""Relational operators over OCR words: line text, boxes, spatial joins within a document.

Band joins become equi-joins: words lie in the cells of a grid, the anchor side is repeated for the few cells its
reach touches, and both sides share one exchange on (document, cell).  Long lines and documents spread over many cells.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bounds, distance, overlap_ratio
from ..functions.text import ratio
from .extract import numbered


def line_text(words: DataFrame) -> DataFrame:
    """Words of a line in reading order, joined by blanks."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "pos", "word"))), lambda w: w["word"]), " ")
    return words.groupBy("doc_id", "line").agg(text.alias("text"), F.count(F.lit(1)).alias("n_words"), F.avg("conf").alias("mean_conf"))


def boxes(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id", "line").agg(*bounds(F.col("x"), F.col("top"), F.col("width"), F.col("height")))


#: Side of the cells in which words look for anchors, in pixels.
CELL = 256


def center(prefix: str = "") -> tuple[Column, Column]:
    return F.col(f"{prefix}x") + F.col(f"{prefix}width") / 2, F.col(f"{prefix}top") + F.col(f"{prefix}height") / 2


def in_cells(words: DataFrame) -> DataFrame:
    """Words with the cell of their centre."""
    x, y = center()
    return words.withColumn("gx", F.floor(x / CELL)).withColumn("gy", F.floor(y / CELL))


def around(anchors: DataFrame, x_reach: int, y_reach: int) -> DataFrame:
    """Anchors once for each cell that their reach touches; their columns get the prefix ``a_``."""
    own = anchors.select("doc_id", *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "doc_id"])
    x, y = center("a_")
    own = own.withColumn("gx", F.explode(F.sequence(F.floor((x - x_reach) / CELL), F.floor((x + x_reach) / CELL))))
    return own.withColumn("gy", F.explode(F.sequence(F.floor((y - y_reach) / CELL), F.floor((y + y_reach) / CELL))))


def apart() -> Column:
    return distance(*center(), *center("a_"))


def nearby(words: DataFrame, anchors: DataFrame, x_reach: int = 350, y_reach: int = 90) -> DataFrame:
    """Semi-join: words whose centre lies in the box around some anchor's centre."""
    # centres travel instead of boxes
    (x, y), (ax, ay) = center(), center("a_")
    within = (F.abs(F.col("_x") - F.col("_ax")) <= x_reach) & (F.abs(F.col("_y") - F.col("_ay")) <= y_reach)
    w = in_cells(words).withColumns({"_x": x, "_y": y}).alias("w")
    a = around(anchors, x_reach, y_reach).select("doc_id", "gx", "gy", ax.alias("_ax"), ay.alias("_ay")).alias("a")
    same = (F.col("w.doc_id") == F.col("a.doc_id")) & (F.col("w.gx") == F.col("a.gx")) & (F.col("w.gy") == F.col("a.gy"))
    return w.join(a, same & within, "left_semi").select(*words.columns)


def nearest(values: DataFrame, markers: DataFrame, limit: int = 180) -> DataFrame:
    """Each value's nearest marker within ``limit`` that its reading direction allows: to its left on the line, or above and about in line."""
    (x, y), (ax, ay) = center(), center("a_")
    same = F.abs(y - ay) <= F.greatest(F.lit(16), F.col("height"), F.col("a_height"))
    fits = F.when(same, x >= ax - 12).otherwise((y >= ay - 8) & (x >= ax - 50) & (x <= ax + 180))
    met = in_cells(values).join(around(markers, limit, limit), ["doc_id", "gx", "gy"]).withColumn("distance", apart()).filter((F.col("distance") <= limit) & fits)
    best = F.min(F.struct("distance", F.col("a_line").alias("marker_line"), F.col("a_pos").alias("marker_pos"), F.col("a_word").alias("marker"))).alias("m")
    return met.groupBy("doc_id", "line", "pos", "word").agg(best).select("doc_id", "line", "pos", "word", "m.marker_line", "m.marker_pos", "m.marker", "m.distance")


def without_above(values: DataFrame, markers: DataFrame, limit: int = 220) -> DataFrame:
    """Anti-join: values that have no marker within ``limit`` at their height or above."""
    w, a = in_cells(values).alias("w"), around(markers, limit, limit).alias("a")
    same = (F.col("w.doc_id") == F.col("a.doc_id")) & (F.col("w.gx") == F.col("a.gx")) & (F.col("w.gy") == F.col("a.gy"))
    return w.join(a, same & (apart() <= limit) & (F.col("a_top") <= F.col("top")), "left_anti").select(*values.columns)


def overlapping(first: DataFrame, second: DataFrame, least: float = 0.2, cell: int = 256) -> DataFrame:
    """Pairs of boxes of two passes over an image whose overlap is at least ``least`` (above 0), whatever lines the passes put them in.

    Both boxes go to every grid cell that they cover, so boxes of any size meet; of the cells they share, the pair counts in the
    one with the left upper corner of their intersection.
    """
    columns = ["line", "pos", "word", "x", "top", "width", "height"]
    box = lambda p: {"left": F.col(f"{p}x"), "top": F.col(f"{p}top"), "width": F.col(f"{p}width"), "height": F.col(f"{p}height")}
    at = lambda c: F.floor(c / cell)

    def covered(df: DataFrame, p: str) -> DataFrame:
        for name, low, size in (("gx", f"{p}x", f"{p}width"), ("gy", f"{p}top", f"{p}height")):
            df = df.withColumn(name, F.explode(F.sequence(at(F.col(low)), at(F.col(low) + F.greatest(F.col(size), F.lit(1)) - 1))))
        return df

    b = second.select("doc_id", *[F.col(c).alias(f"b_{c}") for c in columns])
    corner = (F.col("gx") == at(F.greatest("x", "b_x"))) & (F.col("gy") == at(F.greatest("top", "b_top")))
    met = covered(first, "").join(covered(b, "b_"), ["doc_id", "gx", "gy"]).filter(corner).withColumn("ratio", overlap_ratio(box(""), box("b_")))
    return met.filter(F.col("ratio") >= least).select("doc_id", "line", "pos", "b_line", "b_pos", "ratio")


def upper_median_height(words: DataFrame) -> DataFrame:
    """The upper median of a document's word heights."""
    return words.groupBy("doc_id").agg(F.element_at(F.array_sort(F.collect_list("height")), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int")).alias("median_height"))


def merged(passes: DataFrame, keys: list[str], order: str, words_col: str = "words") -> DataFrame:
    """``keys, words``: the words of several passes over an image without repeated readings of a place.

    In the order of the passes, a word that overlaps one that is held, of equal or nearly equal text, takes its place if it is surer and has no
    less detail, and goes otherwise; held words come from top to bottom.  The fold needs its order, so it is one helper in Python.
    """
    kind = passes.schema[words_col].dataType.simpleString()

    @F.pandas_udf(kind)
    def fold(rows: pd.Series) -> pd.Series:
        return pd.Series([sorted(held(list(row)), key=lambda w: (w["top"], w["left"])) for row in rows])

    every = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.coalesce(words_col, F.array().cast(kind)).alias("w")))), lambda x: x["w"]))
    return passes.groupBy(*keys).agg(every.alias("_words")).select(*keys, fold("_words").alias(words_col))


def held(words: list[dict]) -> list[dict]:
    """Words that stay of a sequence of readings; a grid tells which held ones a word can overlap."""
    kept: list[dict] = []
    grid: dict[tuple[int, int], list[int]] = {}
    cells = lambda w: [(x, y) for x in range(w["left"] // 64, (w["left"] + w["width"]) // 64 + 1) for y in range(w["top"] // 64, (w["top"] + w["height"]) // 64 + 1)]
    for word in words:
        near = sorted({k for c in cells(word) for k in grid.get(c, ())})
        place = next((k for k in near if same_reading(word, kept[k])), None)
        if place is None:
            place = len(kept)
            kept.append(word)
        elif word["conf"] > kept[place]["conf"] and detail(word["text"]) >= detail(kept[place]["text"]):
            kept[place] = word
        else:
            continue
        for c in cells(word):
            grid.setdefault(c, []).append(place)
    return kept


def same_reading(a: dict, b: dict) -> bool:
    x, y = a["text"].casefold(), b["text"].casefold()
    sides = [max(0, min(a[s] + a[n], b[s] + b[n]) - max(a[s], b[s])) for s, n in (("left", "width"), ("top", "height"))]
    area = min(a["width"] * a["height"], b["width"] * b["height"])
    share = sides[0] * sides[1] / area if area else 0.0
    return share >= (0.2 if x == y else 0.7) and (x == y or ratio(x, y) >= 0.75)


def detail(text: str) -> int:
    """Alphanumeric characters, one more where letters and digits are mixed."""
    own = [c for c in text if c.isalnum()]
    return len(own) + (any(map(str.isalpha, own)) and any(map(str.isdigit, own)))


def rebuilt(results: DataFrame, words_col: str = "words") -> DataFrame:
    """``results`` with ``text`` for the words: line by line in the order given, a line's words from left to right."""
    keep = [c for c in results.columns if c != words_col]
    df = results.withColumn("_w", F.coalesce(F.col(words_col), F.array().cast(results.schema[words_col].dataType))).withColumn("_n", numbered(F.col("_w"), 8))
    place = F.zip_with(F.transform("_w", lambda w, i: F.struct(w["left"].alias("left"), i.alias("i"), w["text"].alias("text"))), "_n", lambda w, n: F.struct(n.alias("n"), w["left"].alias("left"), w["i"].alias("i"), w["text"].alias("text")))
    of_line = lambda n: F.array_join(F.transform(F.filter(F.array_sort(place), lambda x: x["n"] == n), lambda x: x["text"]), " ")
    text = F.when(F.size("_w") == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.array_max("_n")), of_line), "\n"))
    return df.select(*keep, text.alias("text"))
