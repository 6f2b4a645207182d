"""From raw rows to explained, tiered transactions: all stages in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import columns as X
from tracewell.ml import iforest
from tracewell.operators import chains, correlate, entities, explain, features, ingest, intel, order
from tracewell.plans import base
from tracewell.runtime import Scratch, read, with_row

#: Features that explanations speak of, where the feature matrix has them.
SPOKEN = {k: v for k, v in explain.LABELS.items() if k in ("fan_in", "fan_out", "fee_rate_urgency", "port_risk_combined", "ip_observation_count", "observation_spread_s")}


def run(ledger: DataFrame, whitelist: DataFrame, watchlist: DataFrame | None = None, wire: DataFrame | None = None, tx: DataFrame | None = None) -> DataFrame:
    """One row per accepted transaction: entity, type, anomaly, whitelist, watchlist, taint, fused ``risk_score``, ``risk_tier``, ``explanation``.

    ``ledger``: raw rows with ``row_idx`` and ``ts``, lists in any notation. Without a watchlist there is no taint; without telemetry a transaction counts as seen once. What a model or an iteration needs is
    written to the shared folder once; the rest is one plan. ``tx``: the canonical rows of the ledger, where they have been written already.
    """
    spark = ledger.sparkSession
    scratch = Scratch(spark, "pipeline")
    t = tx if tx is not None else scratch.cut(ingest.canonical(ledger), "tx")
    chain = scratch.cut(chains.peel_chains(t), "chains")
    seen = correlate.first_seen(wire) if wire is not None else None
    f = scratch.cut(features.feature_matrix(t, chain, entities.entities(t), seen), "features")
    kept = features.informative(f, [c for c in f.columns if c not in ("row_idx", "entity_id")])
    score = scratch.cut(iforest.score(f, "row_idx", kept, iforest.fit(f, "row_idx", kept)), "scores")
    ends = score.agg(F.min("anomaly_score").alias("lo"), F.max("anomaly_score").alias("hi"))
    cut = order.percentiles(score, ["anomaly_score"], [1 - K.CONTAMINATION]).select(F.get("q", F.lit(0)).alias("cut"))
    score = with_row(with_row(score, ends), cut).select("row_idx", X.rounded(100 * X.scaled("anomaly_score", "lo", "hi"), 1).alias("deviation"), (F.col("anomaly_score") > F.col("cut")).alias("is_anomaly"))
    narrow = t.select("row_idx", "txid", "ts", "src_port", "dst_port", "fee", "total_in", "fan_in", "fan_out", X.is_mixer("fan_in", "fan_out", "out_amts").alias("mixer"))
    spoken = {k: v for k, v in SPOKEN.items() if k in f.columns}
    rows = narrow.join(f.select("row_idx", "entity_id", "peel_chain_length", *[x for x in spoken if x not in ("fan_in", "fan_out")]), "row_idx").join(score, "row_idx").join(intel.whitelisted(t, intel.whitelist(whitelist)), "row_idx", "left")
    if watchlist is not None:
        rows = rows.join(intel.watched(t, watchlist), "row_idx", "left").join(intel.taint_hops(t, watchlist), "row_idx", "left").join(intel.taint_scores(t, watchlist), "row_idx", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast(k) for c, k in (("watchlist_indicator", "string"), ("watchlist_label", "string"), ("taint_hops", "int"), ("taint_nearest_label", "string"), ("taint_score", "double"))})
    structural = X.structural_type("mixer", F.coalesce("peel_chain_length", F.lit(0.0)), "fan_in", "fan_out", "fee_rate_urgency")
    rows = rows.withColumn("detected_type", X.final_type(structural, "whitelisted_side"))
    rows = rows.withColumn("_v", explain.verdict(F.col("whitelisted_side"), F.col("deviation"), F.col("is_anomaly"))).withColumns({"score_ml": F.col("_v.risk_score"), "is_anomaly": F.col("_v.is_anomaly")}).drop("_v")
    risk = rows.agg(F.min("port_risk_combined").alias("_lo"), F.max("port_risk_combined").alias("_hi"))
    anon = F.col("src_port").isin(*K.FUSION_ANON_PORTS) | F.col("dst_port").isin(*K.FUSION_ANON_PORTS)
    hit = F.col("watchlist_indicator").isNotNull()
    rows = with_row(rows, risk).withColumns(
        {
            "score_pattern": X.pattern_score("detected_type"),
            "score_network": F.when(anon, 100.0).otherwise(X.rounded(100 * X.scaled("port_risk_combined", "_lo", "_hi"), 1)),
            "score_graph": F.when(hit, 100.0).otherwise(F.coalesce("taint_score", F.lit(0.0))),
            "whitelist_factor": X.whitelist_factor("whitelisted_side"),
        }
    )
    rows = rows.withColumn("risk_score", X.fused("score_ml", "score_pattern", "score_network", "score_graph", "whitelist_factor")).withColumn("risk_tier", X.tier("risk_score"))
    direct = X.signals("src_port", "dst_port", "detected_type", "fee", "total_in", "fan_in", "fan_out", F.col("peel_chain_length").cast("int"))
    rows = scratch.cut(rows, "rows")
    told = explain.profiled(rows, explain.profile(rows, spoken)).withColumn("text", F.when(F.col("is_anomaly"), explain.explanation(F.lit(100.0), direct, spoken)).otherwise("Normal network traffic behavior."))
    text = explain.with_intelligence(F.col("text"), hit, F.col("watchlist_label"), F.col("watchlist_indicator"), F.col("taint_hops"), F.col("taint_nearest_label"))
    columns = "row_idx txid ts entity_id detected_type is_anomaly whitelisted_side whitelisted_entity watchlist_indicator watchlist_label taint_hops taint_score score_ml score_pattern score_network score_graph whitelist_factor risk_score risk_tier".split()
    return told.select(*columns, text.alias("explanation"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    t = base.cut_tx(spark, d)
    watch = Scratch(spark, "watchlist").cut(base.watchlist(t), "rows")
    return run(read(spark, d, "tx_ledger"), read(spark, d, "institutional_whitelist"), watch, read(spark, d, "telemetry"), t)


QUERIES = {"pipeline": pipeline}
ORACLE: dict[str, str] = {}
