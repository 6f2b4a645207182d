"""Whitelist, watchlist and taint of transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import columns as X
from tracewell.runtime import Scratch, with_row


TOGETHER = 3  # PageRank rounds between two writes


def whitelist(df: DataFrame) -> DataFrame:
    """``address`` (trimmed, lower case) and ``label``, one row each (the smallest label); blank addresses are none. Accepts ``institution`` for ``entity_name``."""
    label = "institution" if "institution" in df.columns else "entity_name"
    return df.select(F.lower(F.trim("address")).alias("address"), F.col(label).alias("label")).where("address <> ''").groupBy("address").agg(F.min("label").alias("label"))


def first_match(tx: DataFrame, items: str, table: DataFrame, name: str) -> DataFrame:
    """``row_idx`` and, as the struct ``name``, the table's row for the first item of the list that stands in it. ``table``: ``address`` and further columns."""
    extra = [x for x in table.columns if x != "address"]
    hits = tx.select("row_idx", F.posexplode(items).alias("pos", "item")).withColumn("address", F.lower("item")).join(table, "address")
    return hits.groupBy("row_idx").agg(F.min_by(F.struct(F.col("address"), *extra), "pos").alias(name))


def whitelisted(tx: DataFrame, table: DataFrame) -> DataFrame:
    """``row_idx``, ``whitelisted_side`` (input, output, both), ``whitelisted_entity`` of the transactions with a whitelisted side."""
    table = Scratch(tx.sparkSession, "listed").small(table, "table")
    both = first_match(tx, "ins", table, "i").join(first_match(tx, "outs", table, "o"), "row_idx", "full")
    side = F.when(F.col("i").isNotNull() & F.col("o").isNotNull(), "both").when(F.col("i").isNotNull(), "input").otherwise("output")
    labels = F.array_join(F.array_distinct(F.array_compact(F.array("i.label", "o.label"))), ", ")
    return both.select("row_idx", side.alias("whitelisted_side"), F.when(F.col("i").isNotNull() & F.col("o").isNotNull(), "Regulated Entity").otherwise(F.nullif(labels, F.lit(""))).alias("whitelisted_entity"))


def watched(tx: DataFrame, table: DataFrame) -> DataFrame:
    """``row_idx``, ``watchlist_indicator``, ``watchlist_label`` of direct hits; an input comes before an output, that before the address on the wire, that before its network (``asn``, where ``tx`` has
    one). ``table``: indicator, type (address, ip, asn), label, severity; compared in lower case. Of equal indicators the first by bytes counts."""
    table = Scratch(tx.sparkSession, "watched").small(table.select("type", F.lower(F.trim("indicator")).alias("address"), "indicator", "label").groupBy("type", "address").agg(F.min(F.struct("indicator", "label")).alias("w")).select("type", "address", "w.indicator", "w.label"), "table")
    of = lambda kind: table.where(F.col("type") == kind).select("address", "indicator", "label")
    hits = first_match(tx, "ins", of("address"), "i").join(first_match(tx, "outs", of("address"), "o"), "row_idx", "full")
    for kind, column in (("ip", "src_ip"), ("asn", "asn")):
        if column in tx.columns:
            wire = tx.select("row_idx", F.lower(F.trim(column)).alias("address")).join(of(kind), "address").select("row_idx", F.struct("indicator", "label").alias(kind))
            hits = hits.join(wire, "row_idx", "full")
    found = [x for x in ("i", "o", "ip", "asn") if x in hits.columns]
    pick = lambda f: F.coalesce(*[F.col(f"{x}.{f}") for x in found])
    return hits.select("row_idx", pick("indicator").alias("watchlist_indicator"), pick("label").alias("watchlist_label"))


def nodes_of(tx: DataFrame) -> DataFrame:
    """``row_idx`` and each distinct node it touches: addresses in lower case and the address on the wire."""
    ip = F.trim("src_ip")
    nodes = F.concat(F.transform(F.concat("ins", "outs"), lambda a: F.concat(F.lit("addr:"), F.lower(a))), F.when(ip != "", F.array(F.concat(F.lit("ip:"), ip))).otherwise(F.array().cast("array<string>")))
    return tx.select("row_idx", F.explode(F.array_distinct(nodes)).alias("node"))


def seeds_of(table: DataFrame) -> DataFrame:
    kind: Column = F.when(F.col("type") == "address", F.concat(F.lit("addr:"), F.lower("indicator"))).when(F.col("type") == "ip", F.concat(F.lit("ip:"), F.col("indicator")))
    return table.select(kind.alias("node"), "label", "severity").where("node IS NOT NULL").groupBy("node").agg(F.min("label").alias("label"), F.max("severity").alias("severity"))


def taint_hops(tx: DataFrame, table: DataFrame) -> DataFrame:
    """``row_idx``, ``taint_hops`` (1 or 3) and the smallest ``taint_nearest_label`` of the transactions within four steps of a watched node."""
    scratch = Scratch(tx.sparkSession, "hops")
    touch, seeds = scratch.cut(nodes_of(tx), "touch"), scratch.small(seeds_of(table), "seeds")
    near = scratch.cut(touch.join(seeds, "node").groupBy("row_idx").agg(F.min("label").alias("label")), "near")
    shared = touch.join(near, "row_idx").groupBy("node").agg(F.min("label").alias("label"))
    far = touch.join(shared, "node").groupBy("row_idx").agg(F.min("label").alias("far"))
    return far.join(near, "row_idx", "left").select("row_idx", F.when(F.col("label").isNotNull(), 1).otherwise(3).alias("taint_hops"), F.coalesce("label", "far").alias("taint_nearest_label"))


def taint_scores(tx: DataFrame, table: DataFrame, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """``row_idx``, ``taint_score``: personalised PageRank from the watched nodes, the largest rank among a transaction and its nodes, scaled to 100.

    The graph of transactions and nodes is undirected, so a node sends its rank in equal parts along its edges; the seeds' weights are their severities. Ends after
    ``iterations`` or when the ranks change by less than ``tolerance`` a node in all. A hub's edges are joined with its one row and aggregated before they are shuffled.
    """
    scratch = Scratch(tx.sparkSession, "taint")
    touch = nodes_of(tx).select(F.concat(F.lit("tx:"), F.col("row_idx").cast("string")).alias("t"), "node", "row_idx")
    ways = scratch.cut(touch.select(F.col("t").alias("s"), F.col("node").alias("d")).unionByName(touch.select(F.col("node").alias("s"), F.col("t").alias("d"))), "ways")
    degree = ways.groupBy("s").agg(F.count(F.lit(1)).alias("deg"))
    seeds = scratch.small(seeds_of(table).select(F.col("node").alias("s"), "severity").join(degree.select("s"), "s", "left_semi"), "seeds")
    weight = seeds.agg(F.sum("severity")).collect()[0][0]
    if not weight:
        return tx.select("row_idx", F.lit(0.0).alias("taint_score"))
    base = scratch.cut(degree.join(seeds, "s", "left").select("s", "deg", (F.coalesce("severity", F.lit(0.0)) / weight).alias("p")), "base")
    n = base.count()
    rank = base.select("s", "deg", "p", F.lit(1.0 / n).alias("r"))
    for k in range(0, iterations, TOGETHER):
        for _ in range(min(TOGETHER, iterations - k)):  # rounds of one plan: one write and one test for all of them
            sent = ways.join(rank.select("s", (F.col("r") / F.col("deg")).alias("x")), "s").groupBy(F.col("d").alias("s")).agg(F.sum("x").alias("x"))
            rank = rank.join(sent, "s", "left").select("s", "deg", "p", (K.TAINT_ALPHA * F.coalesce("x", F.lit(0.0)) + (1 - K.TAINT_ALPHA) * F.col("p")).alias("r"), F.col("r").alias("old"))
        new, seen = scratch.measured(rank, "rank", change=F.sum(F.abs(F.col("r") - F.col("old"))))
        rank = new.select("s", "deg", "p", "r")
        if tolerance and seen["change"] < n * tolerance:
            break
    own = touch.join(rank.select(F.col("s").alias("node"), "r"), "node").groupBy("row_idx", "t").agg(F.max("r").alias("r"))
    own = own.join(rank.select(F.col("s").alias("t"), F.col("r").alias("tr")), "t").select("row_idx", F.greatest("r", "tr").alias("r"))
    ends = own.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    return with_row(own, ends).select("row_idx", F.when(F.col("hi") > F.col("lo"), X.rounded((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100, 4)).otherwise(50.0).alias("taint_score"))
