"""Pixel metrics of images of any size: tiles with their neighbours' border, mergeable moments.

An image is cut into tiles.  A tile is taken together with the border that its neighbours lend it, so its Laplacian needs
nothing else and no pixel leaves its task; what is computed at once is bounded by the tile.  Tiles give integer sums (pixels, values,
squares, bright pixels, Laplacian and its squares), so the sums of an image don't depend on how it was cut.

Images that can't be read (no bytes, sides that aren't positive, a length that doesn't fit, channels other than 1, 3 or 4) keep
their row, with the reason: they are unusable, not an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decisions import quality_checks

#: Weights of blue, green and red in grey, of 2 to the power of SHIFT; bright pixels.
BLUE, GREEN, RED, SHIFT, BRIGHT = 1868, 9617, 4899, 14, 250
SUMS = ["n", "total", "squares", "bright", "edges", "edge_squares"]


def unusable(width: Column, height: Column, channels: Column, pixels: Column) -> Column:
    """Why an image can't be assessed, null if it can."""
    said = lambda x: F.format_string("Image could not be assessed safely (%s).", F.lit(x))
    size = width.cast("long") * height * channels
    return (
        F.when(pixels.isNull() | (F.octet_length(pixels) == 0), said("image must not be empty"))
        .when(~F.coalesce(channels.isin(1, 3, 4), F.lit(False)), said("image must be grayscale, BGR, or BGRA"))
        .when(~F.coalesce((width > 0) & (height > 0) & (F.octet_length(pixels) == size), F.lit(False)), said("size and pixels differ"))
    )


def grey(raw: bytes, height: int, width: int, channels: int) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8)
    if channels == 1:
        return own.reshape(height, width)
    c = own.reshape(height, width, channels).astype(np.int64)
    return ((c[..., 0] * BLUE + c[..., 1] * GREEN + c[..., 2] * RED + (1 << SHIFT - 1)) >> SHIFT).astype(np.uint8)


def framed(g: np.ndarray) -> np.ndarray:
    """The image with a border: beyond an edge lies the second row or column from it (the only one where there is one); corners mean nothing."""
    h, w = g.shape
    out = np.empty((h + 2, w + 2), np.uint8)
    out[1:-1, 1:-1] = g
    out[0, 1:-1], out[-1, 1:-1] = g[min(1, h - 1)], g[max(h - 2, 0)]
    out[1:-1, 0], out[1:-1, -1] = g[:, min(1, w - 1)], g[:, max(w - 2, 0)]
    return out


def tile_sums(tile: np.ndarray) -> np.ndarray:
    """SUMS of a tile that comes with its border."""
    t = tile.astype(np.int64)
    g = t[1:-1, 1:-1]
    edges = t[:-2, 1:-1] + t[2:, 1:-1] + t[1:-1, :-2] + t[1:-1, 2:] - 4 * g
    return np.array([g.size, g.sum(), (g * g).sum(), np.count_nonzero(g >= BRIGHT), edges.sum(), (edges * edges).sum()])


def moments(images: DataFrame, side: int = 512) -> DataFrame:
    """``id`` and SUMS of readable images ``id, width, height, channels, pixels``, a row for each band of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, found = [], []
            for k, (i, w, h, c) in enumerate(zip(*(batch.column(n).to_pylist() for n in range(4)))):
                whole = framed(grey(batch.column(4)[k].as_buffer(), h, w, c))
                for y in range(0, h, side):
                    own.append(i)
                    found.append(sum(tile_sums(whole[y : y + side + 2, x : x + side + 2]) for x in range(0, w, side)))
            sums = np.array(found, np.int64).reshape(len(own), len(SUMS)).T
            yield pa.RecordBatch.from_arrays([pa.array(own, batch.column(0).type), *map(pa.array, sums)], ["id", *SUMS])

    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", "width", "height", "channels", "pixels").mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in SUMS)}")


def metrics(images: DataFrame, side: int = 512) -> DataFrame:
    """``id, width, height, blur, brightness, glare, contrast, problem`` of every image; metrics are null where there is a problem."""
    told = images.withColumn("problem", unusable(F.col("width"), F.col("height"), F.col("channels"), F.col("pixels")))
    sums = moments(told.filter("problem is null"), side).groupBy("id").agg(*[F.sum(c).alias(c) for c in SUMS])
    share = lambda c: F.col(c) / F.col("n")
    spread = lambda squares, total: F.greatest(F.lit(0.0), share(squares) - share(total) * share(total))
    found = sums.select("id", spread("edge_squares", "edges").alias("blur"), share("total").alias("brightness"), share("bright").alias("glare"), F.sqrt(spread("squares", "total")).alias("contrast"))
    return told.select("id", "width", "height", "problem").join(found, "id", "left")


def assessed(measured: DataFrame) -> DataFrame:
    """Quality of every image of ``metrics``: checks, status, score, recommendation; unusable ones are poor, score nought, and need review."""
    bad = F.col("problem").isNotNull()
    df = quality_checks(measured)
    checks = ("resolution", "blur", "brightness", "glare", "readability")
    put = {f"{c}_score": F.when(bad, 0.0).otherwise(F.col(f"{c}_score")) for c in checks} | {f"{c}_rank": F.when(bad, 2).otherwise(F.col(f"{c}_rank")) for c in checks}
    flagged = F.filter(F.array(*[F.when(F.col(f"{c}_rank") > 0, c) for c in checks]), lambda c: c.isNotNull())
    put |= {"status": F.when(bad, "POOR").otherwise(F.col("status")), "quality_score": F.when(bad, 0.0).otherwise(F.col("quality_score")), "recommendation": F.when(bad, "REVIEW").otherwise(F.col("recommendation")), "allows_ocr": ~bad & F.col("allows_ocr")}
    said = F.when(bad, F.concat(F.lit("Image quality needs review: "), "problem")).when(F.size(flagged) == 0, "Image quality is good and the label is likely readable.")
    return df.withColumns(put).withColumn("explanation", F.coalesce(said, F.concat(F.lit("Image quality needs review: "), F.array_join(flagged, ", "), F.lit("."))))
