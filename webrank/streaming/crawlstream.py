"""The crawler's state as streams: pages seen once, and the last access of each host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table's files as a stream."""
    schema = spark.read.parquet(path).schema
    if path.rstrip("/").endswith(".parquet") and not _is_directory(spark, path):
        folder, name = path.rsplit("/", 1)
        return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 16).parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def _is_directory(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def visited(stream: DataFrame, key: str, time: str, delay: str = "3650 days") -> DataFrame:
    """Each key once, whichever of its rows comes first; keys older than ``delay`` are forgotten (JOI5)."""
    return stream.where(F.col(key).isNotNull()).withWatermark(time, delay).dropDuplicatesWithinWatermark([key]).select(key)


def host_state(stream: DataFrame, host: str, time: str) -> DataFrame:
    """``(host, fetches, last_access)`` kept up to date as fetches come in (CRW5)."""
    return stream.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("fetches"), F.max(time).alias("last_access"))


def fetch_windows(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """``(start, fetches)`` per window of event time; rows later than ``late`` after the newest are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("fetches")).select(F.col("window.start").alias("start"), "fetches")


def run_available(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Processes all there is in micro-batches and returns the result, kept under ``path``.

    ``append`` writes rows as they become final; ``update`` keeps each batch's changed rows with its number, of which the
    caller takes the latest per key.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state").outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/rows").start()
    else:
        query = writer.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/rows/n={n}")).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
