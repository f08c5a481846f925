"""Sources and sinks: tables, evaluation manifests, image files, compact reports, the append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<text:string,conf:double,left:int,top:int,width:int,height:int,provider:string,original_text:string>"
MANIFEST = "products array<struct<id:string,images:array<struct<path:string,label:string,visible_text:array<string>>>,expected:map<string,string>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to ``spark.sql.shuffle.partitions`` tasks: however few tasks read a small file, work that is large for a row goes to all cores.

    Rows should be narrow when they are dealt.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, expectations) of an evaluation manifest; a missing file is an error of the read."""
    products = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("products").alias("p"))
    images = products.select(F.col("p.id").alias("product_id"), F.posexplode("p.images").alias("pos", "image")).select("product_id", "pos", "image.*")
    expected = products.select(F.col("p.id").alias("product_id"), F.explode("p.expected").alias("field_key", "expected"))
    return images, expected


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Image bytes with their identity and the side named in the file name, null where none is."""
    files = spark.read.format("binaryFile").load(path)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    label = F.when(name.contains("front"), "front").when(name.contains("back"), "back").when(name.contains("side"), "side")
    return files.select("path", label.alias("label"), "length", bytes_identity(F.col("content")).alias("source_identity"), "content")


def jdbc_table(spark: SparkSession, url: str, name: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table of a database, read in ``parts`` ranges of a numeric column; predicates and columns are pushed to it."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if column:
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def source_identity(source):
    return F.sha2(F.concat(F.lit("source:").cast("binary"), F.unhex(F.lit("00")), F.encode(source, "UTF-8")), 256)


def bytes_identity(content):
    return F.sha2(F.concat(F.lit("bytes:").cast("binary"), F.unhex(F.lit("00")), content), 256)


def append_log(df: DataFrame, path: str, day_column: str = "created_at") -> None:
    """Appends report rows to the log, partitioned by day."""
    df.withColumn("day", F.substring(day_column, 1, 10)).write.mode("append").partitionBy("day").parquet(path)
