"""Events from lines of text: `message`, and `source_type` where one is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_lines(lines: DataFrame, column: str = "value", source_type: str | None = None) -> DataFrame:
    """A column of lines as events."""
    event = lines.select(F.col(column).cast("string").alias("message"))
    return event if source_type is None else event.withColumn("source_type", F.lit(source_type))


def read_lines(spark: SparkSession, path: str, source_type: str | None = None) -> DataFrame:
    """Text files, a line to an event."""
    return from_lines(spark.read.text(path), source_type=source_type)


def stream_lines(spark: SparkSession, path: str, source_type: str | None = None, files_a_batch: int = 100) -> DataFrame:
    """A folder of text files as a stream."""
    return from_lines(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path), source_type=source_type)


def read_kafka_lines(spark: SparkSession, servers: str, topic: str, source_type: str | None = None) -> DataFrame:
    """A Kafka topic's values as a stream (needs Spark's Kafka package)."""
    return from_lines(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load(), source_type=source_type)
