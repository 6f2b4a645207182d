"""Peel chains over several hops: pointer doubling on the graph in which each transaction has at most one successor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import columns as X
from tracewell.runtime import Scratch


def links(tx: DataFrame, least: float = K.PEEL_DISPARITY) -> DataFrame:
    """``row_idx`` of each candidate (two outputs of unlike size) and ``next_row``, the last transaction that spends its change; null if none does."""
    cand = tx.where((F.size("outs") == 2) & (X.disparity("out_amts") >= least)).select("row_idx", F.when(F.get("out_amts", F.lit(0)) >= F.get("out_amts", F.lit(1)), F.get("outs", F.lit(0))).otherwise(F.get("outs", F.lit(1))).alias("a"))
    spender = tx.select("row_idx", F.explode("ins").alias("a")).groupBy("a").agg(F.max("row_idx").alias("next_row"))
    return cand.join(spender, "a", "left").select("row_idx", F.when(F.col("next_row") != F.col("row_idx"), F.col("next_row")).alias("next_row"))


def peel_chains(tx: DataFrame, least_length: int = K.MIN_CHAIN) -> DataFrame:
    """``row_idx``, ``chain_head``, ``chain_length``, ``hop_position``, ``fund_ratio`` of the transactions in chains.

    Chains start at candidates that no candidate leads to; a stretch that several reach belongs to the earliest. After round k every node knows the earliest start within 2^k
    steps, so the number of rounds is the logarithm of the longest chain. Nodes that only a cycle reaches are in no chain.
    """
    scratch = Scratch(tx.sparkSession, "chains")
    step = scratch.cut(links(tx), "links")
    targets = step.where("next_row IS NOT NULL").select(F.col("next_row").alias("row_idx")).distinct()
    nodes = step.select("row_idx", "next_row").join(targets.withColumn("t", F.lit(1)), "row_idx", "full").select("row_idx", F.col("next_row").alias("jump"), F.when(F.col("t").isNull(), F.struct(F.col("row_idx").alias("head"), F.lit(0).alias("d"))).alias("best"))
    nodes = scratch.cut(nodes, "nodes")
    reach = 1
    while True:
        sent = nodes.where("jump IS NOT NULL AND best IS NOT NULL").groupBy(F.col("jump").alias("row_idx")).agg(F.min(F.struct(F.col("best.head").alias("head"), (F.col("best.d") + reach).alias("d"))).alias("got"))
        ahead = nodes.select(F.col("row_idx").alias("jump"), F.col("jump").alias("far"))
        new = nodes.join(sent, "row_idx", "left").join(ahead, "jump", "left")
        better = F.least("best", "got")
        nodes = scratch.cut(new.select("row_idx", F.col("far").alias("jump"), better.alias("best"), (F.col("best").isNull() & better.isNotNull() | (F.coalesce(F.col("best.head") != better["head"], F.lit(False)))).alias("moved")), "nodes")
        if not nodes.where("moved").limit(1).count():
            break
        nodes, reach = nodes.drop("moved"), reach * 2
    placed = nodes.where("best IS NOT NULL").select("row_idx", F.col("best.head").alias("chain_head"), (F.col("best.d") + 1).alias("hop_position"))
    length = placed.groupBy("chain_head").agg(F.count(F.lit(1)).alias("chain_length")).where(F.col("chain_length") >= least_length)
    paid = tx.select("row_idx", "total_in")
    first = paid.select(F.col("row_idx").alias("chain_head"), F.when(F.col("total_in") > 0, F.col("total_in")).otherwise(1.0).alias("initial"))
    out = placed.join(length, "chain_head").join(paid, "row_idx").join(first, "chain_head")
    return out.select("row_idx", "chain_head", "chain_length", "hop_position", X.rounded(F.col("total_in") / F.col("initial"), 6).alias("fund_ratio"))
