"""The daily trend on a stream of inspections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.dims import STATUSES


def daily(reports: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts per day of event time ``ts``; reports later than ``late`` behind the newest are left out once a day has closed."""
    per = [F.count_if(F.col("overall_result") == s).alias(f"n_{s.lower()}") for s in STATUSES]
    days = reports.withWatermark("ts", late).groupBy(F.window("ts", "1 day"))
    return days.agg(*per, F.count(F.lit(1)).alias("total")).select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), *[f"n_{s.lower()}" for s in STATUSES], "total")
