"""Message logs (ts, topic, payload): JSON-line folders, and Kafka where its connector is on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_SCHEMA = "ts TIMESTAMP, topic STRING, payload STRING, seq BIGINT"


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MESSAGE_SCHEMA).json(folder)


def stream_messages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(MESSAGE_SCHEMA).json(folder)


def stream_kafka(spark: SparkSession, servers: str, kafka_topic: str) -> DataFrame:
    """Messages bridged to Kafka: the record key is the message topic, the value its payload."""
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", kafka_topic)
        .load()
    )
    return records.select(
        F.col("timestamp").alias("ts"),
        F.col("key").cast("string").alias("topic"),
        F.col("value").cast("string").alias("payload"),
        F.col("offset").alias("seq"),
    )


def publish_kafka(messages: DataFrame, servers: str, kafka_topic: str, checkpoint: str):
    """The way back: a stream of messages to Kafka; returns the running query."""
    records = messages.select(F.col("topic").alias("key"), F.col("payload").alias("value"))
    return (
        records.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", kafka_topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def write_messages(messages: DataFrame, folder: str) -> None:
    messages.write.mode("append").json(folder)


def read_text_log(spark: SparkSession, folder: str) -> DataFrame:
    """Serial logs, one read per line, in a column ``text``."""
    return spark.read.text(folder).withColumnRenamed("value", "text")
