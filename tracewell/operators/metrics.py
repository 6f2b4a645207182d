"""Evaluation metrics over whole tables: counts per distinct score, then sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import columns as X
from tracewell.operators.order import cumulative

#: The ten bins' inner edges as binary fractions.
EDGES = (0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9)


def bin_of(p: Column) -> Column:
    """Bins 0 to 9; an edge belongs to the bin above it, 1 to the last."""
    out = F.lit(0)
    for e in EDGES:
        out = out + (p >= e).cast("int")
    return out


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """Distinct scores with rows (``n``), positives (``pos``) and the numbers of both below them."""
    counts = df.where(F.col(score).isNotNull() & ~F.isnan(score)).select(F.lit(0).alias("g"), F.col(score).cast("double").alias("value"), F.col(label).cast("long").alias("y")).groupBy("g", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    rows = cumulative(counts, "g", "value", "n").withColumnsRenamed({"before": "n_below", "total": "n_all"})
    pos = cumulative(counts, "g", "value", "pos").select("value", F.col("before").alias("pos_below"), F.col("total").alias("pos_all"))
    return rows.join(pos, "value").drop("g")


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    s = by_score(df, score, label)
    neg, neg_below = F.col("n") - F.col("pos"), F.col("n_below") - F.col("pos_below")
    wins = F.sum(F.col("pos") * (neg_below + neg / 2))
    return s.agg(wins.alias("w"), F.max("pos_all").alias("p"), F.max(F.col("n_all") - F.col("pos_all")).alias("q")).select(X.rounded(F.col("w") / F.col("p") / F.col("q"), 6).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    s = by_score(df, score, label)
    hits, rows = F.col("pos_all") - F.col("pos_below"), F.col("n_all") - F.col("n_below")
    return s.agg(X.rounded(F.sum(F.col("pos") / F.col("pos_all") * hits / rows), 6).alias("average_precision"))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """``threshold``, ``tpr``, ``fpr``, ``precision`` at each distinct score."""
    s = by_score(df, score, label)
    hits, rows = F.col("pos_all") - F.col("pos_below"), F.col("n_all") - F.col("n_below")
    return s.select(F.col("value").alias("threshold"), X.rounded(hits / F.col("pos_all"), 6).alias("tpr"), X.rounded((rows - hits) / (F.col("n_all") - F.col("pos_all")), 6).alias("fpr"), X.rounded(hits / rows, 6).alias("precision"))


def calibration(df: DataFrame, p: Column, label: str) -> DataFrame:
    """Bins that hold rows: their number, mean prediction and share of positives."""
    rows = df.select(p.alias("p"), F.col(label).cast("double").alias("y")).where("p IS NOT NULL")
    return rows.groupBy(bin_of(F.col("p")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


def ece(df: DataFrame, p: Column, label: str) -> DataFrame:
    c = calibration(df, p, label)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("e")).select(X.rounded("e", 6).alias("ece"))


def precision_at(df: DataFrame, score: str, label: str, key: str, k: int) -> DataFrame:
    top = df.orderBy(F.desc(score), key).limit(k)
    return top.agg(X.rounded(F.avg(F.col(label).cast("double")), 6).alias("precision_at_k"), F.count(F.lit(1)).alias("k"))


def confusion(df: DataFrame, predicted: Column, label: str) -> DataFrame:
    p, y = predicted, F.col(label)
    c = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    ratio = lambda a, b: F.coalesce(X.rounded(a / F.nullif(b, F.lit(0)), 6), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"))


def passes(metrics: dict[str, float]) -> bool:
    """The evaluation's bounds: precision 0.70, recall 0.65, F1 0.65 at least, false positive rate 0.20 at most."""
    return metrics["precision"] >= 0.70 and metrics["recall"] >= 0.65 and metrics["f1"] >= 0.65 and metrics["fpr"] <= 0.20
