"""The hold-out evaluation: calibrated forests against three baselines on the same rows, and on a fresh set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import columns as X
from tracewell.ml import iforest, supervised
from tracewell.operators import chains, entities, features, metrics, order
from tracewell.runtime import Scratch, with_row


def prepared(tx: DataFrame, labels: DataFrame) -> DataFrame:
    """Canonical transactions with all features, the rules' flag, the pattern's score and ``label`` (from ``row_idx``, ``label``)."""
    t = Scratch(tx.sparkSession, "prepared").cut(tx, "tx")
    chain = chains.peel_chains(t)
    f = features.feature_matrix(t, chain, entities.entities(t)).drop("entity_id")
    equal = (F.size("out_amts") >= 10) & (X.dominant_ratio("out_amts") >= 0.5)
    fee = F.coalesce(F.col("fee") / F.nullif("total_in", F.lit(0.0)), F.lit(0.0))
    rules = (F.col("src_port").isin(*K.FUSION_ANON_PORTS) | (fee > 0.1) | (F.col("fan_out") > 20) | equal).cast("double").alias("rules")
    length = t.join(chain.select("row_idx", "chain_length"), "row_idx", "left")
    kind = X.structural_type(X.is_mixer("fan_in", "fan_out", "out_amts"), F.coalesce("chain_length", F.lit(0)), "fan_in", "fan_out", X.fee_urgency("fee", "total_in"))
    flags = length.select("row_idx", rules, X.pattern_score(kind).alias("pattern"), F.when(F.col("src_port").isin(*K.FUSION_ANON_PORTS) | F.col("dst_port").isin(*K.FUSION_ANON_PORTS), 100.0).alias("anonymous"))
    return f.join(flags, "row_idx").join(labels.select("row_idx", F.col("label").cast("double").alias("label")), "row_idx")


def report(rows: DataFrame, fresh: Mapping[str, DataFrame], names: Sequence[str], trees: int = 300, depth: int = 64, parts: int = 3) -> DataFrame:
    """One row per set and model: ``n``, precision, recall, f1, fpr, roc_auc, average_precision, ece. ``rows`` and the ``fresh`` sets are as of ``prepared``.

    70 % of the rows, stratified by label, are learnt from; the rest is the set "holdout". Models: the calibrated forests (``ece`` also before calibration, as "uncalibrated"), the isolation forest alone, the rules
    alone, and the fused score of isolation forest, pattern and port risk.
    """
    features.leak_free(names)
    scratch = Scratch(rows.sparkSession, "evaluation")
    rows = scratch.cut(features.fold_of(rows, "label", "row_idx", 10).withColumnRenamed("fold", "tenth"), "rows")
    train, test = rows.where("tenth < 7"), rows.where("tenth >= 7").drop("tenth")
    x, y, _, part_ = supervised.sampled(supervised.assembled(train, "row_idx", names, "label", 1, parts))
    model_, trees_ = supervised.fit(rows.sparkSession, x, y, part_, parts, trees, depth), iforest.fit(train, "row_idx", names)
    scores = scratch.cut(iforest.score(train, "row_idx", names, trees_), "scores")
    cut = order.percentiles(scores, ["anomaly_score"], [1 - K.CONTAMINATION]).select(F.get("q", F.lit(0)).alias("cut"))
    ends = scores.agg(F.min("anomaly_score").alias("lo"), F.max("anomaly_score").alias("hi")).join(cut)
    out = None
    for name, part in (("holdout", test), *fresh.items()):
        p = supervised.predicted(model_, supervised.assembled(part, "row_idx", names, "label", 1, parts), len(names)).select(F.col("key").alias("row_idx"), "raw", "p")
        unusual = with_row(iforest.score(part, "row_idx", names, trees_), ends)
        unusual = unusual.select("row_idx", F.least(F.greatest(X.scaled("anomaly_score", "lo", "hi"), F.lit(0.0)), F.lit(1.0)).alias("unusual"), (F.col("anomaly_score") > F.col("cut")).alias("outlier"))
        joined = part.select("row_idx", "label", "rules", "pattern", "anonymous", "port_risk_combined").join(p, "row_idx").join(unusual, "row_idx")
        fused = (K.WEIGHTS["ml"] * 100 * F.col("unusual") + K.WEIGHTS["pattern"] * F.col("pattern") + K.WEIGHTS["network"] * F.coalesce("anonymous", 100 * F.col("port_risk_combined"))) / 100
        joined = scratch.cut(joined.withColumn("fused", fused).withColumn("y", F.col("label") == 1), f"joined-{name}")
        for model, score, flag in (("calibrated", "p", F.col("p") >= 0.5), ("uncalibrated", "raw", F.col("raw") >= 0.5), ("isolation_forest", "unusual", F.col("outlier")), ("rules", "rules", F.col("rules") == 1), ("fused", "fused", F.col("fused") >= 0.4)):
            one = metrics.confusion(joined, flag, "y").join(metrics.roc_auc(joined, score, "y")).join(metrics.average_precision(joined, score, "y")).join(metrics.ece(joined, F.col(score), "y"))  # one row each
            one = one.select(F.lit(name).alias("part"), F.lit(model).alias("model"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), "precision", "recall", "f1", "fpr", "roc_auc", "average_precision", "ece")
            out = one if out is None else out.unionByName(one)
    passes = (F.col("precision") >= 0.70) & (F.col("recall") >= 0.65) & (F.col("f1") >= 0.65) & (F.col("fpr") <= 0.20)
    return out.withColumn("passes", passes)
