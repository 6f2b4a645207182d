"""The feature matrix: expressions over one-row aggregates and joins with small frequency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import columns as X
from tracewell.operators.order import numbered
from tracewell.runtime import Scratch, with_row


def frequency(df: DataFrame, column: str, name: str) -> DataFrame:
    """Share of each value among the rows that have one."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return with_row(counts, counts.agg(F.sum("n").alias("all"))).select(column, (F.col("n") / F.col("all")).alias(name))


def port_frequency(tx: DataFrame) -> DataFrame:
    """Share of each port among all source and destination ports. At most 65,536 rows."""
    ports = tx.select(F.explode(F.array("src_port", "dst_port")).alias("port"))
    return frequency(ports, "port", "freq")


def feature_matrix(tx: DataFrame, chains: DataFrame | None = None, owners: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """``row_idx`` and the features; those of chains, entities and telemetry only where these are given."""
    scratch = Scratch(tx.sparkSession, "features")
    ports = scratch.small(port_frequency(tx), "ports")
    stats = tx.agg(*[f(F.col(x)).alias(f"{n}_{x}") for x in ("total_in", "fee") for n, f in (("lo", F.min), ("hi", F.max))], F.avg("total_in").alias("mean"), F.stddev_samp("total_in").alias("sd"))
    shares = [scratch.small(frequency(tx, x, f"{x}_freq"), x) for x in ("script_type", "src_ip")]
    rows = tx.join(shares[0], "script_type", "left").join(shares[1], "src_ip", "left")
    rows = rows.join(ports.select(F.col("port").alias("src_port"), F.col("freq").alias("sf")), "src_port", "left").join(ports.select(F.col("port").alias("dst_port"), F.col("freq").alias("df")), "dst_port", "left")
    rows = with_row(rows, stats).withColumns({"src_port_risk": X.port_risk("src_port", "sf"), "dst_port_risk": X.port_risk("dst_port", "df")})
    z = F.coalesce(X.rounded((F.col("total_in") - F.col("mean")) / F.nullif("sd", F.lit(0.0)), 4), F.lit(0.0))
    out = [
        *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("script_type_freq", "src_ip_freq")],
        X.scaled("total_in", "lo_total_in", "hi_total_in").alias("amount_btc_scaled"),
        X.scaled("fee", "lo_fee", "hi_fee").alias("fee_scaled"),
        (F.col("total_in") < K.MICRO_TX).cast("double").alias("is_micro_tx"),
        "src_port_risk",
        "dst_port_risk",
        X.rounded(0.6 * F.col("src_port_risk") + 0.4 * F.col("dst_port_risk"), 4).alias("port_risk_combined"),
        X.peel_disparity("out_amts").alias("peel_chain_disparity"),
        F.col("fan_in").cast("double").alias("fan_in"),
        F.col("fan_out").cast("double").alias("fan_out"),
        X.fan_ratio("fan_in", "fan_out").alias("fan_ratio"),
        X.fee_urgency("fee", "total_in").alias("fee_rate_urgency"),
        z.alias("value_zscore"),
        F.abs(z).alias("value_zscore_abs"),
    ]
    got = rows.select("row_idx", "txid", F.get("ins", F.lit(0)).alias("first_in"), "src_ip", *out)
    if chains is not None:
        got = got.join(chains.select("row_idx", F.col("chain_length").cast("double").alias("peel_chain_length"), F.col("hop_position").cast("double").alias("peel_chain_hop_position"), F.col("fund_ratio").alias("fund_diminishment_ratio")), "row_idx", "left")
        got = got.fillna(0.0, ["peel_chain_length", "peel_chain_hop_position", "fund_diminishment_ratio"])
    if owners is not None:
        got = got.join(owners.select(F.col("address").alias("first_in"), "entity_id"), "first_in", "left").withColumn("entity_id", F.coalesce("entity_id", F.lit("UnknownEntity")))
        by_entity = got.groupBy("entity_id").agg(F.countDistinct("src_ip").cast("double").alias("entity_ip_diversity"), F.count(F.lit(1)).alias("ne"))
        by_ip = got.where("src_ip IS NOT NULL").groupBy("src_ip").agg(F.countDistinct("entity_id").cast("double").alias("ip_entity_diversity"))
        total = got.agg(F.count(F.lit(1)).alias("nt"))
        got = with_row(got.join(by_entity, "entity_id").join(by_ip, "src_ip", "left"), total).withColumn("entity_tx_freq", F.col("ne") / F.col("nt")).drop("ne", "nt").fillna(0.0, ["ip_entity_diversity"])
    if seen is not None:
        got = got.join(seen.select("txid", F.col("ip_observation_count").cast("double").alias("ip_observation_count"), "observation_spread_s"), "txid", "left").fillna({"ip_observation_count": 1.0, "observation_spread_s": 0.0})
    return got.drop("first_in", "src_ip", "txid")


def informative(df: DataFrame, features: Sequence[str], least: float = 1e-9) -> list[str]:
    """The features whose sample deviation exceeds ``least``; one aggregation, one row to the driver."""
    row = df.agg(*[F.stddev_samp(x).alias(x) for x in features]).collect()[0]
    return [x for x in features if (row[x] or 0.0) > least]


def aligned(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with all of a model's features: missing columns and values are 0."""
    return df.withColumns({x: F.coalesce(F.col(x).cast("double"), F.lit(0.0)) if x in df.columns else F.lit(0.0) for x in features})


def leak_free(features: Sequence[str]) -> None:
    if leaks := K.LABEL_COLUMNS.intersection(features):
        raise ValueError(f"label columns among the features: {sorted(leaks)}")


def fold_of(df: DataFrame, label: str, key: str, folds: int) -> DataFrame:
    """``df`` with a stratified ``fold``: rows of a label are dealt out in the order of an integer hash of ``key`` (a unique long)."""
    keyed = df.withColumn("_h", F.struct(F.pmod(F.pmod(F.col(key), F.lit(1000003)) * 7919 + 104729, F.lit(1000003)).alias("h"), F.col(key).alias("k")))
    return numbered(keyed, label, "_h").withColumn("fold", (F.col("row_no") % folds).cast("int")).drop("_h", "row_no")
