"""Streams of telemetry: an extension beside the batch operators, with the same results on a finished stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "2 days"


def telemetry_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def prepared(stream: DataFrame) -> DataFrame:
    """With a zoned event time for the watermark; observations without a transaction are left out."""
    return stream.where("txid IS NOT NULL").withColumn("event_time", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Repeated observations within the allowed lateness, dropped; the state holds keys no longer than that."""
    return prepared(stream).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["txid", "src_ip", "dst_ip", "src_port", "ts"])


def first_seen(stream: DataFrame) -> DataFrame:
    """First source and number of observations per transaction, in update mode."""
    order = F.struct("ts", F.col("src_ip").isNull(), "src_ip", "obs_id")
    return prepared(stream).groupBy("txid").agg(F.min_by("src_ip", order).alias("first_ip"), F.count("src_ip").alias("ip_observation_count"), F.min("ts").alias("first_ts"))


def hourly(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Observations per hour and country, in append mode once the watermark has passed."""
    return prepared(stream).withWatermark("event_time", late).groupBy(F.window("event_time", "1 hour"), "geo_country").agg(F.count(F.lit(1)).alias("n_obs"))


def sessions(stream: DataFrame, gap: str = "10 minutes", late: str = LATE) -> DataFrame:
    """Bursts of one source: sessions that end after ``gap`` without an observation."""
    return prepared(stream).withWatermark("event_time", late).groupBy(F.session_window("event_time", gap), "src_ip").agg(F.count(F.lit(1)).alias("n_obs"))


def joined(stream: DataFrame, ledger_stream: DataFrame, late: str = LATE) -> DataFrame:
    """Observations with their ledger row if that comes within a day: a left stream-stream join, bounded by both watermarks."""
    wire = prepared(stream).withWatermark("event_time", late).alias("w")
    chain = ledger_stream.withColumn("chain_time", F.col("ts").cast("timestamp")).withWatermark("chain_time", late).alias("c")
    near = F.expr("w.txid = c.txid AND c.chain_time BETWEEN w.event_time - INTERVAL 1 DAY AND w.event_time + INTERVAL 1 DAY")
    return wire.join(chain, near, "left").select("w.obs_id", "w.txid", "c.row_idx", "c.fee")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there, into a memory table: for tests and small backfills."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)
