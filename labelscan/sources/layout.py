"""A layout for lookups by key: hashed folders, sorted files, Bloom filters.

A lookup lists one folder of many; in its files, minima, maxima and the Bloom filter of the key let it skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "_part"


def part_of(key, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_for_lookup(df: DataFrame, path: str, key: str, parts: int = 64, distinct: int = 1_000_000) -> None:
    """``distinct``: about how many keys a row group has, which sizes its filter."""
    dealt = df.withColumn(PART, part_of(F.col(key), parts)).repartition(parts, PART).sortWithinPartitions(PART, key)
    writer = dealt.write.partitionBy(PART).option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", distinct)
    writer.parquet(path)


def lookup(spark: SparkSession, path: str, key: str, value, parts: int = 64) -> DataFrame:
    """The rows of one key; ``value`` must be of the column's type (a plain integer is a long)."""
    wanted = F.lit(value).cast("long") if isinstance(value, int) else F.lit(value)
    return spark.read.parquet(path).filter((F.col(PART) == part_of(wanted, parts)) & (F.col(key) == wanted)).drop(PART)
