"""URL rules by a sort-merge range join over reversed-host keys.

A host is turned round by its labels (``a.example.net`` -> ``net.example.a.``), so that a rule's host and all its
subdomains form the interval of keys that start with the rule's key.  Urls are sorted by key over range
partitions; every rule is sent only to the partitions whose keys its interval meets; and one sweep over the
merged, sorted rows of a partition keeps a stack of the active, nested rules.  The innermost ones whose path
also starts the url's path are compared: the longest rule (host and path together) wins, ties go to the deeper host.
Urls without a rule are judged by ``default``.

Edge cases: a null url, or one without ``://``, has empty host and path and no rule; repeated urls and identifiers are
judged each for itself; urls of any length are judged whole; equal rules with different verdicts: block wins; an empty table
gives an empty result.
Columns besides the identifier and the url are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Above every character of a host; ends the interval of a prefix.
TOP = "\U0010ffff"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    has = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.when(has, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "?", 1)).otherwise("")
    rest = F.substring_index(rest, "#", 1)
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.when(F.instr(rest, "/") > 0, F.substr(rest, F.instr(rest, "/"))).otherwise("")
    return host, path


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, key, kind); kind 0 is a rule, 1 a url."""
    stack: list[tuple] = []
    part = None
    for pdf in batches:
        out = []
        for p, key, kind, page_id, host, path, verdict in zip(pdf["part"], pdf["key"], pdf["kind"], pdf["page_id"], pdf["host"], pdf["path"], pdf["verdict"]):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, host, path, verdict))
                continue
            best = max((r for r in stack if path.startswith(r[2])), key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[3]), default=None)
            out.append((page_id, host, path, best and best[1] + best[2], best and best[3]))
        yield pd.DataFrame({n: pd.Series([r[i] for r in out], dtype="int64" if i == 0 else "object") for i, n in enumerate(("page_id", "host", "path", "rule", "verdict"))})


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; ``rules`` has ``host, path, verdict``.

    The bounds of the range partitions (two keys a partition) are the only thing that reaches the driver.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_path(F.col(url_col))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", F.when(F.col("host") == "", F.lit("")).otherwise(reversed_key(F.col("host"))))
    urls = urls.repartitionByRange(n, "key", "path", "row").withColumn("part", F.spark_partition_id())
    urls = scratch.save(urls, "urls")
    bounds = [(r.part, r.low, r.high) for r in urls.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()]
    ranges = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(a).alias("low"), F.lit(b).alias("high")) for p, a, b in bounds]) if bounds else F.array().cast("array<struct<part:int,low:string,high:string>>")
    own = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct().withColumn("key", reversed_key(F.col("host")))
    met = F.filter(ranges, lambda r: (r["high"] >= F.col("key")) & (r["low"] < F.concat(F.col("key"), F.lit(TOP))))
    own = own.withColumn("part", F.explode(F.transform(met, lambda r: r["part"])))
    merged = urls.select("part", "key", F.lit(1).alias("kind"), "page_id", "row", "host", "path", F.lit(None).cast("string").alias("verdict")).unionByName(
        own.select("part", "key", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("page_id"), F.lit(-1).cast("long").alias("row"), "host", "path", "verdict")
    )
    merged = merged.repartition(n, "part").sortWithinPartitions("part", "key", "kind", "path", "row")
    out = merged.mapInPandas(sweep, "page_id long, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
