"""Queries that learn: no SQL can state them; their invariants are tested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import columns as X
from tracewell.ml import clusters, evaluation, iforest, supervised
from tracewell.operators import explain, ingest, order, scoring
from tracewell.operators.reports import checksums
from tracewell.runtime import Scratch, read, with_row
from tracewell.sources import generator

FEATURES = ("amount_btc", "fee", "fan_in", "fan_out", "fee_rate_urgency", "port_risk_combined", "ip_observation_count", "observation_spread_s")
PROFILE = ("tx_count", "total_btc", "mean_btc", "mean_fan_out", "mean_fan_in", "mean_fee_urgency", "mean_port_risk", "distinct_ips", "night_share", "mean_risk")


def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all rows; the top 5 % are anomalies."""
    rows = read(spark, d, "scored_rows")
    scores = Scratch(spark, "forest").cut(iforest.score(rows, "score_id", FEATURES, iforest.fit(rows, "score_id", FEATURES)), "scores")
    cut = order.percentiles(scores, ["anomaly_score"], [1 - K.CONTAMINATION]).select(F.get("q", F.lit(0)).alias("cut"))
    return with_row(scores, cut).select("score_id", X.rounded("anomaly_score", 6).alias("anomaly_score"), (F.col("anomaly_score") > F.col("cut")).alias("is_outlier"))


def rf_calibrated(spark: SparkSession, d: str) -> DataFrame:
    return supervised.out_of_fold(read(spark, d, "scored_rows"), "score_id", FEATURES, "is_anomaly")


def hdbscan(spark: SparkSession, d: str) -> DataFrame:
    return clusters.behaviour_clusters(scoring.entity_profile(read(spark, d, "scored_rows")), "entity_id", PROFILE)


def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    return clusters.components_2d(scoring.entity_profile(read(spark, d, "scored_rows")), "entity_id", PROFILE)


def entity_graph(spark: SparkSession, d: str) -> DataFrame:
    """Entities, transactions and addresses on the wire as one graph."""
    rows = read(spark, d, "scored_rows").select(F.concat(F.lit("tx:"), F.col("txid")).alias("t"), scoring.trimmed("entity_id").alias("e"), scoring.trimmed("src_ip").alias("ip")).where("t IS NOT NULL")
    ends = F.array_compact(F.array(F.concat(F.lit("entity:"), F.col("e")), F.concat(F.lit("ip:"), F.col("ip"))))
    return rows.select(F.col("t").alias("a"), F.explode(ends).alias("b")).groupBy("a", "b").agg(F.lit(1.0).alias("w"))


def louvain(spark: SparkSession, d: str) -> DataFrame:
    return clusters.community_names(clusters.louvain(entity_graph(spark, d)))


def behaviour_rows(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters mapped back to the rows, and what their explanation says of outliers."""
    rows = read(spark, d, "scored_rows")
    labels = Scratch(spark, "behaviour").cut(hdbscan(spark, d), "labels")
    got = scoring.labelled(rows, labels, "entity_id", "behaviour_cluster", "Cluster 0")
    text = F.when(F.col("is_anomaly"), F.concat(F.lit("Flagged as "), F.coalesce("detected_type", F.lit("unknown")))).otherwise("Normal.")
    return got.select("score_id", "behaviour_cluster", explain.with_outlier(text, F.col("behaviour_cluster")).alias("explanation"))


def holdout_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated forests and three baselines on 30 % of generated transactions, and on fresh sets of another seed."""
    made = generator.transactions(spark, 2_000)
    rows = evaluation.prepared(ingest.canonical(made), made.select("row_idx", (F.col("attack_type") != "Normal").alias("label")))
    names = [c for c in rows.columns if c not in ("row_idx", "label", "rules", "pattern", "anonymous")]
    fresh = None
    for i, (kind, n) in enumerate((("benign", 300), ("hard_negative", 100), ("known", 300), ("novel", 200))):
        one = generator.evaluation_set(spark, kind, n).withColumn("row_idx", F.col("row_idx") + i * 1_000_000)
        fresh = one if fresh is None else fresh.unionByName(one)
    fresh = Scratch(spark, "fresh").cut(fresh, "rows")
    return evaluation.report(rows, {"seed_999": evaluation.prepared(ingest.canonical(fresh), fresh.select("row_idx", "label"))}, names)


def evaluation_sets(spark: SparkSession, d: str) -> DataFrame:
    """What the evaluation sets hold, after validation."""
    out = None
    for kind in generator.PROFILES:
        made = generator.evaluation_set(spark, kind, 1_000)
        one = ingest.canonical(made).join(made.select("row_idx", "profile", "label"), "row_idx").groupBy("profile", "label").agg(F.count(F.lit(1)).alias("n_tx"), F.max("fan_in").alias("most_inputs"), F.max("fan_out").alias("most_outputs")).select(F.lit(kind).alias("part"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def generated(spark: SparkSession, d: str) -> DataFrame:
    """What the synthetic source makes, by kind, after validation."""
    rows = generator.transactions(spark, 20_000)
    kinds = rows.select("row_idx", "attack_type")
    return ingest.canonical(rows).join(kinds, "row_idx").groupBy("attack_type").agg(F.count(F.lit(1)).alias("n_tx"), F.max("fan_out").alias("most_outputs"))


def file_checksums(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of the whitelist's files."""
    return checksums(spark, f"{d}/institutional_whitelist.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


QUERIES = {f.__name__: f for f in (isolation_forest, rf_calibrated, hdbscan, pca_2d, louvain, behaviour_rows, holdout_evaluation, evaluation_sets, generated, file_checksums)}
ORACLE: dict[str, str] = {}
