"""Row positions of a distributed table, and the zip of two tables by position.

Boundaries of the order column (a bounded number of approximate quantiles) cut the table into ranges; the rows before a range are a prefix
sum over the ranges' counts, and only inside a range are rows numbered one by one.  No task sees the whole table, and recomputing a
task gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of the first images of an upload that says nothing of its sides.
SIDES = ("front", "back", "side")


def with_positions(df: DataFrame, order: str, *then: str, ranges: int = 200) -> DataFrame:
    """Adds ``position``, from 0, in the order of a numeric or time column (null first) and then the others.

    A value of ``order`` that very many rows share lies in one range.
    """
    timed = isinstance(df.schema[order].dataType, T.DatetimeType)
    number = (F.col(order).cast("timestamp") if timed else F.col(order)).cast("double")
    cuts = sorted(set(df.agg(F.percentile_approx(number, [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []))
    part = F.when(number.isNull(), -1).otherwise(F.aggregate(F.array(*map(F.lit, cuts)).cast("array<double>"), F.lit(0), lambda n, c: n + (number > c).cast("int")))
    cut = df.withColumn("_range", part)
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # at most ``ranges`` + 1 rows
    ahead = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order, *then))
    return cut.join(F.broadcast(ahead), "_range").withColumn("position", F.col("_ahead") + inside - 1).drop("_range", "_ahead")


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of the same position beside each other; what only the longer table has is left out.  Columns must differ in name."""
    return with_positions(left, left_order).join(with_positions(right, right_order), "position")


def labelled(uploads: DataFrame, key: str, pos: str = "pos", label: str = "label") -> DataFrame:
    """Fills labels that are null or blank from the position within an upload: front, back, side, then image-4 and so on."""
    names = F.array(*map(F.lit, SIDES))
    own = F.coalesce(F.get(names, F.col(pos)), F.concat(F.lit("image-"), (F.col(pos) + 1).cast("string")))
    return uploads.withColumn(label, F.coalesce(F.nullif(F.trim(label), F.lit("")), own))
