"""Helpers shared by the corpus operators: scratch tables, distributed prefix sums, word expressions.

Scratch tables live below ``spark.checkpoint.dir`` (a folder all executors share), so a lost executor
never takes an intermediate result with it.  Only where that setting is absent and Spark runs in one process (tests) a
temporary folder of our own is used.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage: space, \t, \n, \v, \f, \r.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; set to a temporary folder only where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="labelscan-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """Written intermediate tables of one operator run, each readable from every executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` once and reads it back: cuts the lineage and fixes what was computed."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Deletes a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words (runs of anything but white space) of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without building them: removes what isn't white space run by run."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit(*cols: Column) -> Column:
    """A reproducible pseudo-random number in [0, 1) of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def before(df: DataFrame, groups: list[str], bucket: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds exclusive running sums without gathering a group in one task.

    ``bucket`` must not decrease along ``order`` within a group.  Sums per bucket are made first (with
    map-side combine), only these few rows are run through in sequence, and a window then runs inside each
    bucket.  ``sums`` maps new column to summed column; group columns and the bucket must not be null.
    """
    keys = [*groups, bucket]
    per = df.groupBy(*keys).agg(*[F.sum(v).alias(f"_in_{k}") for k, v in sums.items()])
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    over = over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*keys, *[F.coalesce(F.sum(f"_in_{k}").over(over), F.lit(0)).alias(f"_base_{k}") for k in sums])
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(base, keys)
    out = reduce(
        lambda d, k: d.withColumn(k, F.col(f"_base_{k}") + F.coalesce(F.sum(sums[k]).over(within), F.lit(0))), sums, out
    )
    return out.drop(*[f"_base_{k}" for k in sums])


class Bits:
    """A bitmap of 64-bit keys: says no only for keys that aren't in it."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) & np.uint64(8 * len(self.bytes) - 1)
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


#: Bits of one collected row of a bitmap; least and most bits of a bitmap (16 MB), which bounds what is broadcast.
ROW_BITS, LEAST_BITS, MOST_BITS = 1 << 15, 1 << 16, 1 << 27


def size_of(keys: DataFrame) -> int:
    """Bits of a bitmap: about 16 a key, at most MOST_BITS however many there are."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))


def chunks(keys: DataFrame, col: str, size: int) -> DataFrame:
    """``chunk, bits``: the rows of a bitmap that aren't empty, ROW_BITS bits each."""
    at = F.col(col).bitwiseAND(F.lit(size - 1))
    return keys.select(F.shiftright(at, 15).alias("chunk"), (at % ROW_BITS).alias("bit")).groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("bits"))


def bitmap(keys: DataFrame, col: str) -> bytes:
    """Data of ``Bits`` for a column of longs."""
    size = size_of(keys)
    out = bytearray(size // 8)
    for r in chunks(keys, col, size).toLocalIterator():
        out[r["chunk"] * ROW_BITS // 8 : (r["chunk"] + 1) * ROW_BITS // 8] = r["bits"]
    return bytes(out)



def among(df: DataFrame, value: Column, keys: DataFrame, name: str) -> DataFrame:
    """Adds the boolean ``name``: false only where the one column of ``keys`` doesn't hold the long ``value`` (null: 0).

    The bitmap is broadcast as rows, so what ``df`` holds neither moves nor passes through Python.
    """
    size, chunk, bits = size_of(keys), f"{name}_chunk", f"{name}_bits"
    at = F.coalesce(value, F.lit(0)).bitwiseAND(F.lit(size - 1))
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at % ROW_BITS, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    out = df.join(F.broadcast(chunks(keys, keys.columns[0], size).toDF(chunk, bits)), F.shiftright(at, 15) == F.col(chunk), "left")
    return out.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(chunk, bits)
