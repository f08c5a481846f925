"""The inspection history as an append-only log: latest view, filters, pages, counts, rates and trends.

Timestamps are ISO text and compared as text.  Limits are checked on the driver; bounds are literals, so that status
and range predicates reach the scan.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_fold
from ..sources.dims import STATUSES


def checked(value: int, low: int, high: int, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"{what} must be an integer from {low} to {high}")
    return value


def bound(value: str, end: bool) -> str:
    """The text bound of an ISO date or time; a date alone means its first or last moment (UTC)."""
    if len(value) == 10 and re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        date.fromisoformat(value)
        return value + ("T23:59:59.999999+00:00" if end else "T00:00:00+00:00")
    moment = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return moment.isoformat()


def predicates(query: str | None = None, status: str | None = None, start: str | None = None, end: str | None = None) -> Column:
    """Search over file name, product name or id; status; inclusive range. Empty parameters don't filter."""
    tests = []
    if query and query.strip():
        q = query.strip()
        tests.append(reduce(lambda a, b: a | b, [contains_fold(F.col(c).cast("string"), q) for c in ("filename", "product_name", "id")]))
    if status:
        if status.upper() not in STATUSES:
            raise ValueError(f"status must be one of {', '.join(STATUSES)}")
        tests.append(F.upper("overall_result") == status.upper())
    low, high = bound(start, False) if start else None, bound(end, True) if end else None
    if low and high and low > high:
        raise ValueError("the range is reversed")
    if low:
        tests.append(F.col("created_at") >= low)
    if high:
        tests.append(F.col("created_at") <= high)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def page(reports: DataFrame, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """Newest first, then larger ids first: a total order."""
    checked(limit, 1, 100, "limit"), checked(offset, 0, 10_000, "offset")
    return reports.filter(predicates(**filters)).orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def count(reports: DataFrame, **filters) -> DataFrame:
    return reports.filter(predicates(**filters)).agg(F.count(F.lit(1)).alias("total"))


def known(status: str) -> Column:
    return F.count_if(F.col("overall_result") == status)


def status_counts(reports: DataFrame, **filters) -> DataFrame:
    """One row per known status, with nought where there is none; unknown ones are left out."""
    sums = reports.filter(predicates(**filters)).agg(*[known(s).alias(s) for s in STATUSES])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(s).alias("overall_result"), F.col(s).alias("n")) for s in STATUSES])).alias("r")).select("r.*")


def rates(reports: DataFrame, **filters) -> DataFrame:
    sums = reports.filter(predicates(**filters)).agg(*[known(s).alias(f"n_{s.lower()}") for s in STATUSES])
    total = sum(F.col(f"n_{s.lower()}") for s in STATUSES)
    share = lambda c: F.when(total == 0, 0.0).otherwise(F.col(c) / total)
    return sums.select("*", total.alias("total"), share("n_review").alias("review_rate"), share("n_violation").alias("violation_rate"))


def daily_trend(reports: DataFrame, days: int = 30, **filters) -> DataFrame:
    """The newest days that have reports; the newest 3 x days groups of day and status count, as stored."""
    checked(days, 1, 90, "days")
    groups = reports.filter(predicates(**filters)).groupBy(F.substring("created_at", 1, 10).alias("date"), "overall_result").agg(F.count(F.lit(1)).alias("n"))
    newest = groups.orderBy(F.desc("date"), "overall_result").limit(3 * days)
    per = [F.coalesce(F.sum(F.when(F.col("overall_result") == s, F.col("n"))), F.lit(0)).alias(f"n_{s.lower()}") for s in STATUSES]
    out = newest.groupBy("date").agg(*per).withColumn("total", sum(F.col(f"n_{s.lower()}") for s in STATUSES))
    return out.orderBy(F.desc("date")).limit(days)


def monthly_trend(reports: DataFrame) -> DataFrame:
    """Per month; timestamps that can't be parsed are left out."""
    month = F.date_format(F.try_to_timestamp("created_at"), "yyyy-MM")
    return reports.select(month.alias("month"), "overall_result").filter("month is not null").groupBy("month").agg(F.count(F.lit(1)).alias("total"), known("PASS").alias("compliant"))


def dashboard(reports: DataFrame) -> DataFrame:
    sums = reports.agg(F.count(F.lit(1)).alias("total_scanned"), known("PASS").alias("compliant_count"))
    return sums.withColumn("compliance_rate", F.when(F.col("total_scanned") == 0, 0.0).otherwise(100.0 * F.col("compliant_count") / F.col("total_scanned")))


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """Upsert: of each key's rows the last of the log wins in every column."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def insert_or_ignore(stored: DataFrame, arriving: DataFrame, key: str, *order: str) -> DataFrame:
    """Stored rows, and the first arriving row of each key that isn't stored."""
    first = Window.partitionBy(key).orderBy(*order)
    new = arriving.join(stored.select(key), key, "left_anti").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return stored.unionByName(new)


def product_name(argument: Column, reported: Column, extracted: Column) -> Column:
    """Argument before report before the extracted value; white space collapsed, blank is none."""
    from ..functions.text import collapse

    return F.coalesce(collapse(argument), collapse(reported), collapse(extracted))


def with_reviews(reports: DataFrame, decisions: DataFrame) -> DataFrame:
    """A report with its inspector decision, if there is one."""
    return reports.join(decisions, "id", "left")


def fan_out(records: DataFrame, stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Star rows of records ``id, product_name, created_at, overall_result, fields map<string, boolean>``; keys are derived, not serial.

    Rows whose key is stored already, or comes again, are ignored, so a record may be delivered any number of times.
    """
    product_id = F.sha2(F.col("id").cast("string"), 256)
    new = {
        "products": records.select(product_id.alias("product_id"), F.col("id").alias("item_id"), "product_name"),
        "inspections": records.select(F.col("id").alias("inspection_id"), product_id.alias("product_id"), "created_at", (F.col("overall_result") == "PASS").alias("compliant")),
        "violations": records.select(F.col("id").alias("inspection_id"), F.explode("fields").alias("field_key", "present")).filter("not present").select("inspection_id", "field_key"),
    }
    keys = {"products": ["product_id"], "inspections": ["inspection_id"], "violations": ["inspection_id", "field_key"]}
    out = {}
    for name, rows in new.items():
        # dealt first, to a number of tasks that holds: a task then holds the keys of its own part only, not those of all it has read
        rows = rows.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys[name]).dropDuplicates(keys[name])
        old = (stored or {}).get(name)
        out[name] = rows if old is None else old.unionByName(rows.join(old.select(*keys[name]), keys[name], "left_anti"))
    return out
