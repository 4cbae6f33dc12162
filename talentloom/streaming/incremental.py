"""Incremental processing: a file stream, all available at once, with a checkpoint as the resume ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.sources.io import fresh_path


def process_available(spark: SparkSession, source: str, transform, target: str, checkpoint: str) -> None:
    """Append transform(new files' rows) to target; files seen before stay out (the checkpoint knows them)."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    q = transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def processed_in_batches(spark: SparkSession, source: str, key: str) -> DataFrame:
    folder = source.rsplit("/", 1)[0]
    target, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "ledger")
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", source.rsplit("/", 1)[1]).parquet(folder)
    q = stream.select(key).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.schema(f"{key} string").parquet(target).groupBy(key).agg(F.count("*").alias("n"))
