"""Telemetry and ledger: first observations, enrichment, match statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import columns as X


def first_seen(wire: DataFrame) -> DataFrame:
    """Per txid: the first observation (by time, then source address, nulls last, then obs_id), how many have a source, and the spread of times in seconds.

    One aggregation with map-side combine; observations without a txid belong to none.
    """
    order = F.struct(F.col("ts").isNull(), F.col("ts"), F.col("src_ip").isNull(), F.col("src_ip"), F.col("obs_id"))
    spread = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    got = wire.where("txid IS NOT NULL").groupBy("txid").agg(F.min_by(F.struct("src_ip", "src_port", "ts"), order).alias("o"), F.count("src_ip").alias("ip_observation_count"), X.rounded(spread, 2).alias("observation_spread_s"))
    return got.select("txid", F.col("o.src_ip").alias("first_ip"), F.col("o.src_port").alias("first_port"), F.col("o.ts").alias("first_ts"), "ip_observation_count", "observation_spread_s")


def correlate(tx: DataFrame, wire: DataFrame) -> DataFrame:
    """Transactions with what the wire says about them; those never seen get an empty address, the standard port and no observations."""
    seen = first_seen(wire).withColumnRenamed("first_ts", "first_seen_at")
    rows = tx.drop("src_ip", "src_port").join(seen, "txid", "left")
    return rows.select("*", F.coalesce("first_ip", F.lit("")).alias("src_ip"), F.coalesce("first_port", F.lit(8333)).alias("src_port")).withColumns({"ip_observation_count": F.coalesce("ip_observation_count", F.lit(0)), "observation_spread_s": F.coalesce("observation_spread_s", F.lit(0.0))})


def match_stats(tx: DataFrame, wire: DataFrame) -> DataFrame:
    """One row: transactions in both layers, in one of them alone, and the share of the former."""
    a = tx.select("txid").distinct().withColumn("a", F.lit(1))
    b = wire.select("txid").where("txid IS NOT NULL").distinct().withColumn("b", F.lit(1))
    both = a.join(b, "txid", "full").agg(F.count_if(F.expr("a = 1 AND b = 1")).alias("matched"), F.count_if(F.col("a").isNull()).alias("telemetry_only"), F.count_if(F.col("b").isNull()).alias("chain_only"), F.count(F.lit(1)).alias("n"))
    return both.select("matched", "telemetry_only", "chain_only", X.rounded(F.col("matched") / F.col("n"), 4).alias("match_rate"))
