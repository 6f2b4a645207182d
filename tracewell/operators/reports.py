"""Evidence, reports and exports as tables and texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import columns as X
from tracewell.runtime import with_row


def evidence(tx: DataFrame, hops: DataFrame) -> DataFrame:
    """``rank``, ``txid`` and ``evidence`` (JSON) of each traced lead. A trace is bounded, so a lead's hops fit one cell."""
    trail = hops.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("hop", "row", "txid", "role", "btc_in", "retained_pct", "peeled_btc", "delta_t_minutes"))).alias("trace"))
    leads = tx.join(trail, F.col("row_idx") == F.col("seed"))
    body = F.to_json(F.struct("txid", "ts", "kind", "whitelisted_side", F.col("total_in").alias("btc_in"), "fee", "src_ip", "geo_country", F.size("trace").alias("n_hops"), "trace"))
    return leads.select("row_idx", "txid", body.alias("evidence"))


LEADS, DETAILED = 25, 10
#: What a reader of the package must keep in mind.
LIMITS = {
    "data": "Synthetic or simulated data stand for no real conduct.",
    "attribution": "An address on the wire is a point of observation or relay, not a person: tunnels, gateways and exit relays stand between.",
    "leads": "A lead is a place to look, not a finding; each must be confirmed through lawful process and other evidence.",
}


def package(rows: DataFrame, hops: DataFrame, meta: Mapping[str, str]) -> DataFrame:
    """One row, ``package``: the evidence file as JSON. Metadata, funnel and tiers of all rows, the 25 leads of highest risk (ties: the smallest ``row_idx``), the first 10 of them in detail with their traces, limits.

    ``rows``: one per transaction, with row_idx, txid, ts, risk_score, is_anomaly, detected_type, total_in, fee, addresses and ports, geo_country, whitelisted_side, kind, explanation; ``hops``: traces of
    the first leads. Leads and traces are bounded, so they fit a cell.
    """
    trail = hops.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("hop", "row", "txid", "role", "btc_in", "retained_pct", "peeled_btc", "delta_t_minutes"))).alias("trace"))
    top = rows.orderBy(F.desc("risk_score"), "row_idx").limit(LEADS).join(trail, F.col("row_idx") == F.col("seed"), "left")
    r = F.struct((-F.col("risk_score")).alias("o"), "row_idx", "txid", "ts", F.round("risk_score", 2).alias("risk_score"), X.tier("risk_score").alias("risk_tier"), "detected_type", F.round("total_in", 6).alias("amount_btc"), F.round("fee", 8).alias("fee_btc"), "src_ip", "dst_ip", "src_port", "dst_port", "geo_country", "whitelisted_side", "kind", "explanation", "trace")
    leads = top.agg(F.sort_array(F.collect_list(r)).alias("l"))
    short = ("txid", "ts", "risk_score", "risk_tier", "detected_type", "amount_btc", "fee_btc", "src_ip", "dst_ip", "src_port", "dst_port", "geo_country")
    ranked = F.transform("l", lambda x, i: F.struct((i + 1).alias("rank"), *[x[c].alias(c) for c in short]))
    detail = F.transform(F.slice("l", 1, DETAILED), lambda x, i: F.struct((i + 1).alias("rank"), *[x[c].alias(c) for c in (*short, "whitelisted_side", "kind", "explanation")], x["trace"].alias("forward_flow_trace")))
    tier = X.tier("risk_score")
    sums = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("whitelisted_side") == "both").alias("cleared"), F.count_if("is_anomaly").alias("flagged"), *[F.count_if(tier == t).alias(t) for t in ("Critical", "High", "Medium", "Low")])
    one = with_row(leads, sums)
    return one.select(
        F.to_json(
            F.struct(
                F.struct(*[F.lit(v).alias(k) for k, v in meta.items()]).alias("metadata"),
                F.struct(F.struct(F.col("total").alias("total_ingested"), F.col("cleared").alias("whitelisted_cleared"), F.col("flagged").alias("flagged_anomalies")).alias("funnel_numbers"), F.struct("Critical", "High", "Medium", "Low").alias("tier_counts")).alias("executive_summary"),
                ranked.alias("ranked_leads_top25"),
                detail.alias("top_10_detailed_profiles"),
                F.struct(*[F.lit(v).alias(k) for k, v in LIMITS.items()]).alias("limitations"),
            )
        ).alias("package")
    )


def text_report(totals: DataFrame, title: str) -> DataFrame:
    """One text from a small table of ``name`` and ``value``, a line each."""
    lines = totals.groupBy().agg(F.sort_array(F.collect_list(F.concat(F.col("name"), F.lit(": "), F.col("value").cast("string")))).alias("lines"))
    return lines.select(F.concat(F.lit(title + "\n"), F.array_join("lines", "\n")).alias("text"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def score_parts(scored: DataFrame) -> DataFrame:
    """The weighted parts of a fused score and what the whitelist takes off, one row each."""
    from tracewell.constants import WEIGHTS

    parts = [F.struct(F.lit(n).alias("part"), X.rounded(w * F.col(f"score_{n}"), 1).alias("points")) for n, w in WEIGHTS.items()]
    raw = sum(w * F.col(f"score_{n}") for n, w in WEIGHTS.items())
    parts.append(F.struct(F.lit("whitelist discount").alias("part"), X.rounded(raw * F.col("whitelist_factor") - raw, 1).alias("points")))
    return scored.select("score_id", F.inline(F.array(*parts)))
