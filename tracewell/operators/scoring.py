"""Scores, tiers, profiles and summaries of scored transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import columns as X
from tracewell.operators.order import percentiles
from tracewell.runtime import Scratch, with_row

MEASURES = ("amount_btc", "fee", "fan_in", "fan_out", "fee_rate_urgency", "port_risk_combined", "ip_observation_count", "observation_spread_s", "risk_score")
SEVERITY = ("fan_in", "fan_out", "fee_rate_urgency", "port_risk_combined", "ip_observation_count", "observation_spread_s", "amount_btc")


def finite(x: str) -> Column:
    """The value; null if it is NaN or infinite."""
    return F.when(F.abs(F.col(x).cast("double")) < float("inf"), F.col(x).cast("double"))


def trimmed(x: str) -> Column:
    return F.nullif(F.trim(F.col(x)), F.lit(""))


def whitelisted_side(kind: str = "detected_type") -> Column:
    return F.when(F.col(kind) == "Whitelisted_Institutional", "input")


def deviation(df: DataFrame, raw: str, key: str) -> DataFrame:
    """``key`` and ``deviation_score``: the raw score turned, scaled to 0-100, one decimal; 0 if all are equal. Rows without a finite score have none."""
    ends = df.agg(F.min(finite(raw)).alias("lo"), F.max(finite(raw)).alias("hi"))
    x = 100 * (F.col("hi") - finite(raw)) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return with_row(df, ends).where(finite(raw).isNotNull()).select(key, F.coalesce(X.rounded(F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0)), 1), F.lit(0.0)).alias("deviation_score"))


def fused_priority(df: DataFrame, key: str = "score_id", anonymous: Column | None = None, hit: Column | None = None, graph: Column | None = None) -> DataFrame:
    """The four part scores, the whitelist's factor, the fused score and its tier. The ends of the port risk come from one aggregate row.

    ``anonymous``: rows with an anonymiser's port, whose network score is 100; ``hit``: watchlist hits, whose graph score is 100; ``graph``: the graph score of the others, 0 if none is given or known.
    """
    no = F.lit(False)
    anonymous, hit, graph = (F.coalesce(x, d) if x is not None else d for x, d in ((anonymous, no), (hit, no), (graph, F.lit(0.0))))
    ends = df.agg(F.min(finite("port_risk_combined")).alias("lo"), F.max(finite("port_risk_combined")).alias("hi"))
    rows = with_row(df, ends).select(
        key,
        F.col("risk_score").alias("score_ml"),
        X.pattern_score("detected_type").alias("score_pattern"),
        F.when(anonymous, 100.0).otherwise(X.rounded(F.coalesce(X.scaled(finite("port_risk_combined"), "lo", "hi"), F.lit(0.0)) * 100, 1)).alias("score_network"),
        F.when(hit, 100.0).otherwise(graph).alias("score_graph"),
        X.whitelist_factor(whitelisted_side()).alias("whitelist_factor"),
    )
    rows = rows.withColumn("priority", X.fused("score_ml", "score_pattern", "score_network", "score_graph", "whitelist_factor"))
    return rows.withColumn("tier", X.tier("priority"))


def severity_index(df: DataFrame, key: str = "score_id", features: Sequence[str] = SEVERITY) -> DataFrame:
    """How many features lie above their own 75th percentile, and 0.7 score + 0.3 share of those in percent."""
    p = percentiles(df, features, [0.75]).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("measure", F.get("q", F.lit(0))))).alias("p"))
    above = [F.coalesce((finite(x) > F.element_at("p", F.lit(x))).cast("int"), F.lit(0)) for x in features]
    n = above[0]
    for a in above[1:]:
        n = n + a
    return with_row(df, p).select(key, n.alias("n_above"), X.rounded(0.7 * F.col("risk_score") + 0.3 * 100 * n / len(features), 2).alias("severity_index"))


def entity_profile(df: DataFrame) -> DataFrame:
    """Ten measures per entity; rows without an entity have none. Partial aggregates come first, so a heavy entity is no heavier to shuffle than any other."""
    # sums of scaled integers, so that no order of the rows changes them
    whole = lambda x, unit: F.floor(finite(x) * unit + 0.5)
    mean = lambda x, unit=1e8: X.rounded(F.sum(whole(x, unit)) / F.count(finite(x)) / unit, 4)
    night = F.avg(F.when(F.hour("ts") < 5, 1.0).when(F.col("ts").isNotNull(), 0.0))
    return df.withColumn("entity_id", trimmed("entity_id")).where("entity_id IS NOT NULL").groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("tx_count"),
        X.rounded(F.sum(whole("amount_btc", 1e8)) / 1e8, 4).alias("total_btc"),
        mean("amount_btc").alias("mean_btc"),
        mean("fan_out").alias("mean_fan_out"),
        mean("fan_in").alias("mean_fan_in"),
        mean("fee_rate_urgency").alias("mean_fee_urgency"),
        mean("port_risk_combined").alias("mean_port_risk"),
        F.countDistinct(trimmed("src_ip")).alias("distinct_ips"),
        X.rounded(night, 4).alias("night_share"),
        mean("risk_score").alias("mean_risk"),
    )


def group_summary(df: DataFrame, group: str, name: str) -> DataFrame:
    """Per group: entities, addresses on the wire, rows, mean risk, flagged rows, commonest type (the smallest of equals)."""
    stats = df.groupBy(group).agg(
        F.countDistinct(trimmed("entity_id")).alias("n_entities"),
        F.countDistinct(trimmed("src_ip")).alias("n_ips"),
        F.count(F.lit(1)).alias("n_tx"),
        X.rounded(F.avg("risk_score"), 4).alias("mean_risk"),
        F.count_if(F.col("is_anomaly")).alias("n_flagged"),
    )
    kinds = df.groupBy(group, "detected_type").agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.min_by("detected_type", F.struct(-F.col("n"), F.col("detected_type"))).alias("dominant_type"))
    return stats.join(kinds, F.equal_null(stats[group], kinds[group])).select(stats[group].alias(name), *stats.columns[1:], "dominant_type")


def geo_enriched(df: DataFrame, ip: str = "src_ip", country: str = "geo_country") -> DataFrame:
    """``df`` with the country filled where it is missing or unknown, and asn and organisation of the address. Each distinct address is resolved by an expression, no lookup is needed for reserved ranges."""
    g = X.geo(ip)
    missing = F.col(country).isNull() | F.col(country).isin("", "nan", "XX")
    return df.withColumn("_g", g).withColumns({country: F.when(missing, F.col("_g.geo_country")).otherwise(F.col(country)), "asn": F.col("_g.asn"), "asn_org": F.col("_g.asn_org")}).drop("_g")


def range_lookup(df: DataFrame, ip: str, ranges: DataFrame, bits: int = 16) -> DataFrame:
    """``df`` with the columns of the range (``lo``, ``hi`` as longs, disjoint) its address lies in: an equi-join on address blocks with a residual test.

    A range is repeated for each block of 2^``bits`` addresses it touches, so no nested loop is needed however many ranges there are.
    """
    blocks = ranges.withColumn("_block", F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright("hi", bits))))
    rows = df.withColumn("_n", X.ip_number(ip)).withColumn("_block", F.shiftright("_n", bits))
    return rows.join(blocks, (rows["_block"] == blocks["_block"]) & F.col("_n").between(F.col("lo"), F.col("hi")), "left").drop("_n", "_block", "lo", "hi")


def ego_network(df: DataFrame, entity: str) -> DataFrame:
    """Edges (``src``, ``dst``) of the entity's neighbourhood: its rows, rows that share one of its addresses, and their entities. A union of semi-joins, no OR."""
    rows = df.select(F.concat(F.lit("tx:"), F.col("score_id").cast("string")).alias("t"), trimmed("entity_id").alias("e"), trimmed("src_ip").alias("ip"))
    own = rows.where(F.col("e") == entity)
    near = rows.join(own.select("ip").where("ip IS NOT NULL").distinct(), "ip", "left_semi").select("t", "e", "ip").unionByName(own).distinct()
    by_entity = near.where("e IS NOT NULL").select(F.concat(F.lit("entity:"), F.col("e")).alias("src"), F.col("t").alias("dst"))
    by_ip = near.where("ip IS NOT NULL").select(F.col("t").alias("src"), F.concat(F.lit("ip:"), F.col("ip")).alias("dst"))
    return by_entity.unionByName(by_ip).distinct()


def ego_graph(edges: DataFrame, start: str, radius: int = 2) -> DataFrame:
    """The edges (``src``, ``dst``) among the nodes within ``radius`` steps of ``start``: frontier joins, as many as the radius."""
    scratch = Scratch(edges.sparkSession, "ego")
    edges = scratch.cut(edges.select("src", "dst"), "edges")
    ways = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = scratch.small(edges.sparkSession.range(1).select(F.lit(start).alias("node")), "near-0")
    for k in range(radius):
        step = ways.join(near.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
        near = scratch.small(near.unionByName(step).distinct(), f"near-{k + 1}")
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct()


def tripartite(df: DataFrame) -> DataFrame:
    """Edges (``src``, ``dst``) between entities, rows and addresses on the wire."""
    rows = df.select(F.concat(F.lit("tx:"), F.col("score_id").cast("string")).alias("t"), trimmed("entity_id").alias("e"), trimmed("src_ip").alias("ip"))
    by_entity = rows.where("e IS NOT NULL").select(F.concat(F.lit("entity:"), F.col("e")).alias("src"), F.col("t").alias("dst"))
    return by_entity.unionByName(rows.where("ip IS NOT NULL").select(F.col("t").alias("src"), F.concat(F.lit("ip:"), F.col("ip")).alias("dst"))).distinct()


def labelled(df: DataFrame, labels: DataFrame, key: str, label: str, default: str) -> DataFrame:
    """``df`` with the ``label`` that ``labels`` gives its ``key``; ``default`` for rows without a key or a label. The join is split where a key holds many rows."""
    named = labels.select(F.col(key).alias("_k"), F.col(label).alias("_l"))
    return df.join(named, trimmed(key) == F.col("_k"), "left").withColumn(label, F.coalesce("_l", F.lit(default))).drop("_k", "_l")


def home_address(df: DataFrame) -> DataFrame:
    """``entity_id`` and the address on the wire that it uses most (the smallest of equals)."""
    pairs = df.select(trimmed("entity_id").alias("entity_id"), trimmed("src_ip").alias("ip")).where("entity_id IS NOT NULL AND ip IS NOT NULL").groupBy("entity_id", "ip").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("entity_id").agg(F.min_by("ip", F.struct(-F.col("n"), F.col("ip"))).alias("ip"))
