"""Topics: from brokers where Spark's Kafka connector is installed, or as folders of files.

A folder topic has ``<root>/<topic>/partition=<n>/`` with text files, a message a
line. It is what the tests and a cluster without brokers run on; the plan behind
the source is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Input, PipelineConfig
from ..errors import ConfigError
from .files import Files

FOLDER = T.StructType([T.StructField("value", T.StringType()), T.StructField("partition", T.IntegerType())])


def folder_of(brokers: list[str]) -> str | None:
    """The root folder, if the brokers name one (``file:``, ``hdfs:``, any ``scheme:/``)."""
    if len(brokers) == 1 and (brokers[0].startswith("/") or ":/" in brokers[0]):
        return brokers[0].rstrip("/")
    return None


def kafka_options(config: PipelineConfig, i: Input, max_offsets: int | None = None) -> dict[str, str]:
    """Reading from the earliest offset, committed messages only; a retention gap warns."""
    options = {
        "kafka.bootstrap.servers": ",".join(config.connectors.redpanda.brokers),
        "subscribe": i.topic.strip(),
        "startingOffsets": "earliest",
        "kafka.isolation.level": "read_committed",
        "failOnDataLoss": "false",
    }
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def read_topic_stream(spark: SparkSession, config: PipelineConfig, i: Input, *, files_per_trigger: int | None = None) -> DataFrame:
    """``partition, value`` of a topic, as a stream."""
    root = folder_of(config.connectors.redpanda.brokers)
    if root is None:
        raw = spark.readStream.format("kafka").options(**kafka_options(config, i, config.deployment.batch_size)).load()
        return raw.select(F.col("partition").cast("int").alias("partition"), F.col("value"))
    path = f"{root}/{i.topic.strip()}"
    found = sum(n.startswith("partition=") for n in Files(spark).names(path))
    if found != config.deployment.partitions:
        raise ConfigError(f"the topic '{i.topic}' has {found} partitions, deployment.partitions is {config.deployment.partitions}")
    reader = spark.readStream.schema(FOLDER).format("text").option("wholetext", "false")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select("partition", "value")


def write_topic(rows: DataFrame, root: str, topic: str, partitions: int) -> None:
    """Append ``key, value`` messages to a folder topic, dealt by the hash of the key."""
    part = F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int")
    rows.select("value", part.alias("partition")).write.mode("append").partitionBy("partition").text(f"{root}/{topic}")
