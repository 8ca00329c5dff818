"""Event sources and sinks.

In production events arrive on Kafka (``key``/``value`` bytes); in tests and replays they are
files. Start positions map the stream vocabulary: ``TRIM_HORIZON`` -> earliest,
``LATEST`` -> latest. Progress is kept in the checkpoint, so a restart resumes where it stopped
instead of jumping to the newest record (which would lose records).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The driver's events table layout (explicit, no inference).
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])

# The driver's documents table layout, for reading it as a stream.
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])

# Transport records: sequence number, routing key, envelope text.
WIRE_WITH_SEQ = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

STARTS = {"TRIM_HORIZON": "earliest", "LATEST": "latest"}


def read_event_files(spark: SparkSession, folder: str, schema: T.StructType = EVENTS,
                     glob: str | None = None, max_files_per_trigger: int | None = None,
                     fmt: str = "parquet") -> DataFrame:
    """Streaming read of event files in ``folder`` (optionally only names matching ``glob``)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.load(folder)


def read_table_files(spark: SparkSession, folder: str, name: str,
                     schema: T.StructType = EVENTS) -> DataFrame:
    """Streaming read of the table ``name`` in ``folder``, which is one Parquet file or a folder of
    part files. The path is a pattern that only the name matches: a file stream without a pattern
    takes folders only, and a filter on file names leaves out the part files."""
    return read_event_files(spark, f"{folder.rstrip('/')}/{{{name}.parquet}}", schema)


def read_event_topic(spark: SparkSession, servers: str, topic: str, start: str = "TRIM_HORIZON",
                     max_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of a Kafka topic as ``(key string, value string, ts)``; needs the Kafka
    connector on the classpath."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic).option("startingOffsets", STARTS.get(start, start)))
    if max_per_trigger:
        r = r.option("maxOffsetsPerTrigger", int(max_per_trigger))
    return r.load().selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value",
                               "timestamp AS ts")


def write_events(wire: DataFrame, path: str | None = None, servers: str | None = None,
                 topic: str | None = None) -> None:
    """Publish ``(key, value)`` rows (batch): to a Kafka topic, or as JSON lines to ``path``."""
    if servers and topic:
        (wire.selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value")
         .write.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("topic", topic).save())
    else:
        wire.select("key", "value").write.mode("append").json(path)
