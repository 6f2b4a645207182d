"""Ranks, cumulative counts and exact percentiles over whole tables, without a window in a single task.

Equal values are counted first; the distinct values are range-partitioned and summed within each partition; what lies in the partitions before is a sum over as many rows as
there are partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.runtime import Scratch, partitions


def cumulative(counts: DataFrame, group: str, value: str, n: str = "n") -> DataFrame:
    """``counts`` (distinct values of a group with their number) with ``before`` (rows of the group below the value) and ``total``."""
    spark = counts.sparkSession
    ranged = counts.repartitionByRange(partitions(spark), group, value).withColumn("_part", F.spark_partition_id())
    ranged = Scratch(spark, "ranks").cut(ranged, "ranged")
    sums = ranged.groupBy(group, "_part").agg(F.sum(n).alias("_sum"))
    ordered = Window.partitionBy(group).orderBy("_part")
    base = sums.select(group, "_part", (F.sum("_sum").over(ordered) - F.col("_sum")).alias("_base"), F.sum("_sum").over(Window.partitionBy(group)).alias("total"))
    inside = F.sum(n).over(Window.partitionBy(group, "_part").orderBy(value)) - F.col(n)
    return ranged.withColumn("_in", inside).join(base, [group, "_part"]).withColumn("before", F.col("_base") + F.col("_in")).drop("_part", "_base", "_in")


def unpivoted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``measure`` and ``value`` of all finite values of the columns."""
    pairs = F.array(*[F.struct(F.lit(x).alias("measure"), F.col(x).cast("double").alias("value")) for x in columns])
    return df.select(F.inline(pairs)).where(F.abs("value") < float("inf"))


def quantiles_of(placed: DataFrame, group: str, quantiles: Sequence[float]) -> DataFrame:
    """The group, ``total`` and ``q`` (array) from ``cumulative`` counts of its distinct values: exact percentiles with linear interpolation."""
    aggs = []
    for j, q in enumerate(quantiles):
        at = q * (F.col("total") - 1)
        for name, k in ((f"l{j}", F.floor(at)), (f"h{j}", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value"))).alias(name))
    out = placed.groupBy(group).agg(F.max("total").alias("total"), *aggs)
    values = [F.col(f"l{j}") + (F.col(f"h{j}") - F.col(f"l{j}")) * (q * (F.col("total") - 1) - F.floor(q * (F.col("total") - 1))) for j, q in enumerate(quantiles)]
    return out.select(group, "total", F.array(*values).alias("q"))


def percentiles(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """Exact percentiles of columns: ``measure`` and ``q`` (array)."""
    placed = cumulative(unpivoted(df, columns).groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n")), "measure", "value")
    return quantiles_of(placed, "measure", quantiles).drop("total")


def weak_rank(df: DataFrame, column: str) -> DataFrame:
    """``value``, ``n`` and ``rank_pct`` (share of values at most as large, in percent, one decimal) of the distinct finite values of a column."""
    placed = cumulative(unpivoted(df, [column]).groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n")), "measure", "value")
    return placed.select("value", "n", (F.floor((F.col("before") + F.col("n")) / F.col("total") * 1000 + 0.5) / 10).alias("rank_pct"))


def numbered(df: DataFrame, group: str, key: str) -> DataFrame:
    """``df`` with ``row_no`` from 0 within each group, in the order of ``key``, which must be unique."""
    counted = df.withColumn("_n", F.lit(1).cast("long"))
    return cumulative(counted, group, key, "_n").withColumnRenamed("before", "row_no").drop("_n", "total")
