"""Explanations: deviations from the data set's profile, ranked per row, and their assembly with direct signals."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import columns as X
from tracewell.operators.order import cumulative, quantiles_of, unpivoted
from tracewell.runtime import Scratch, with_row

THRESHOLD = 75.0
MOST = 4

#: Labels of the features and the side on which a value is noteworthy.
LABELS: Mapping[str, tuple[str, str]] = {
    "fan_in": ("Input address count", "high"), "fan_out": ("Output address count", "high"), "fee_rate_urgency": ("Fee rate urgency", "high"), "port_risk_combined": ("Port risk score", "high"), "ip_observation_count": ("Telemetry observation count", "high"),
    "observation_spread_s": ("Telemetry observation spread (s)", "high"), "amount_btc": ("BTC amount", "high"), "fee": ("Fee", "high"),
}


#: The profiled features with their label, the side on which a value is noteworthy, their tag, how values are written, and what a noteworthy value means.
FEATURES: Mapping[str, tuple[str, str, str, str, str]] = {
    "fan_in": ("Input address count", "high", "mass_consolidation", "%d", " — mass input consolidation pattern"),
    "fan_out": ("Output address count", "high", "rapid_dispersal", "%d", " — rapid 1-to-many dispersal pattern"),
    "fan_ratio": ("Fan-in / fan-out ratio", "low", "fan_ratio_anomaly", "%.4f", ""),
    "peel_chain_disparity": ("Peel-pattern disparity", "high", "peel_pattern_candidate", "%.6f", " — peel-pattern output asymmetry"),
    "fee_rate_urgency": ("Fee rate urgency", "high", "fee_spike_urgency", "%.6f", " — miner-priority overpayment (time-sensitive hop)"),
    "value_zscore_abs": ("Transaction value |Z-score|", "high", "volume_outlier", "%.4f", " — statistically anomalous transaction volume"),
    "entity_ip_diversity": ("Entity IP diversity", "high", "ip_anonymization", "%.4f", " — entity broadcasts from anomalously many IPs"),
    "ip_entity_diversity": ("IP entity diversity", "high", "shared_infrastructure", "%.4f", " — multiple entities sharing the same IP relay"),
    "port_risk_combined": ("Port risk score", "high", "proxy_tunneling", "%.4f", " — proxy/Tor/tunneling port profile"),
    "peel_chain_length": ("Multi-hop peel chain length", "high", "multihop_peel_chain", "%d", " — multi-hop peel chain (%d linked hops)"),
    "fund_diminishment_ratio": ("Fund diminishment ratio", "high", "progressive_peeling", "%.6f", " — progressive fund siphoning across hops"),
    "amount_btc_scaled": ("Scaled BTC amount", "high", "high_value_transfer", "%.4f", " — unusually large transfer value"),
    "fee_scaled": ("Scaled fee", "high", "fee_anomaly", "%.4f", " — fee deviates from typical range"),
    "src_port_risk": ("Source port risk", "high", "src_port_anomaly", "%.4f", " — source port associated with anonymization"),
    "dst_port_risk": ("Destination port risk", "high", "dst_port_anomaly", "%.4f", " — destination port associated with hidden services"),
    "ip_observation_count": ("Telemetry observation count", "high", "relay_propagation", "%d", " — multi-relay observation profile"),
    "observation_spread_s": ("Telemetry observation spread (s)", "high", "observation_delay_spread", "%.2fs", " — wide temporal spread across relay observations"),
}


def written(value: Column, form: str) -> Column:
    """A value as reasons show it; rounded before it is written, so that no engine's ties matter."""
    if form == "%d":
        return value.cast("long").cast("string")
    digits = int(form[2])
    return F.concat(F.format_string(form[:4], X.rounded(value, digits)), F.lit(form[4:]))


def dataset_profile(df: DataFrame, features: Iterable[str] = tuple(FEATURES)) -> DataFrame:
    """``measure`` with mean, sample deviation, least, greatest, median, p75, p95 and p99: exact, from counts of distinct values."""
    features = [f for f in features if f in df.columns]
    values = unpivoted(df, features)
    stats = values.groupBy("measure").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    placed = cumulative(values.groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n")), "measure", "value")
    q = quantiles_of(placed, "measure", (0.5, 0.75, 0.95, 0.99)).select("measure", *[F.get("q", F.lit(j)).alias(n) for j, n in enumerate(("median", "p75", "p95", "p99"))])
    return stats.join(q, "measure")


def telemetry(df: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each noteworthy feature of a row: ``key``, feature_name, label, observed_value, dataset_median, dataset_p95, percentile_rank, heuristic_flag, audit_reason.

    A value is noteworthy if its percentile rank reaches the threshold and it exceeds the median (for features of the low side: the reverse); or if it is a disparity, observation count (of at least 2) or spread
    above 0 and the median, or a chain of at least two hops. The rank is the share of values at most as large. Missing and infinite values, and features that ``df`` lacks, give no row.
    """
    names = [f for f in FEATURES if f in df.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("measure"), F.col(f).cast("double").alias("value")) for f in names])
    values = Scratch(df.sparkSession, "telemetry").cut(df.select(F.col(key).alias("k"), F.inline(pairs)).where(F.abs("value") < float("inf")), "values")
    placed = cumulative(values.groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n")), "measure", "value")
    stats = F.broadcast(quantiles_of(placed, "measure", (0.5, 0.95)).select("measure", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p95")))  # a row a feature
    v, m, rank = F.col("value"), F.col("median"), F.col("rank")
    low = F.col("measure").isin(*[f for f in names if FEATURES[f][1] == "low"])
    special = (
        F.col("measure").isin("peel_chain_disparity", "observation_spread_s") & (v > 0) & (v > m)
        | (F.col("measure") == "peel_chain_length") & (v >= 2)
        | (F.col("measure") == "ip_observation_count") & (v >= 2) & (v > m)
    )
    noteworthy = F.when(low, (rank <= 100 - threshold) & (v < m)).otherwise((rank >= threshold) & (v > m)) | special
    # ranks of distinct values, of which only the noteworthy ones meet the rows
    ranked = placed.join(stats, "measure").withColumn("rank", F.floor((F.col("before") + F.col("n")) / F.col("total") * 1000 + 0.5) / 10).where(noteworthy)
    by_name = lambda of: F.coalesce(*[F.when(F.col("measure") == f, of(f)) for f in names])
    rows = values.join(ranked.select("measure", "value", "median", "p95", "rank"), ["measure", "value"])
    means = lambda f: F.concat(F.lit(FEATURES[f][4].split("%d")[0]), v.cast("long").cast("string"), F.lit(FEATURES[f][4].split("%d")[1])) if "%d" in FEATURES[f][4] else F.lit(FEATURES[f][4])
    reason = lambda f: F.concat(F.lit(FEATURES[f][0] + " of "), written(v, FEATURES[f][3]), F.lit(" is in the "), F.format_string("%.1f", rank), F.lit("th percentile (dataset median: "), written(m, FEATURES[f][3]), F.lit(")"), means(f))
    return rows.select(
        F.col("k").alias(key), F.col("measure").alias("feature_name"), by_name(lambda f: F.lit(FEATURES[f][0])).alias("label"), X.rounded(v, 6).alias("observed_value"), X.rounded(m, 6).alias("dataset_median"), X.rounded("p95", 6).alias("dataset_p95"),
        rank.alias("percentile_rank"), by_name(lambda f: F.lit(FEATURES[f][2])).alias("heuristic_flag"), by_name(reason).alias("audit_reason"),
    )


def telemetry_lists(df: DataFrame, key: str) -> DataFrame:
    """``key`` and ``telemetry``, the JSON list of a row's noteworthy features in their order; rows without any are missing."""
    place = F.array_position(F.array(*map(F.lit, FEATURES)), F.col("feature_name"))
    item = F.struct("feature_name", "label", "observed_value", "dataset_median", "dataset_p95", "percentile_rank", F.array("heuristic_flag").alias("heuristic_flags"), "audit_reason")
    lists = telemetry(df, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place.alias("o"), item.alias("i")))).alias("l"))
    return lists.select(key, F.to_json(F.transform("l", lambda x: x["i"])).alias("telemetry"))


def regulated(text: Column) -> Column:
    """Whether an explanation speaks of a regulated entity; false for a missing one."""
    return F.coalesce(text.contains("Regulated"), F.lit(False))


def profile(df: DataFrame, features: Mapping[str, tuple[str, str]] = LABELS, threshold: float = THRESHOLD) -> DataFrame:
    """Per feature: mean, sample deviation, median, and the values from (up to) which the percentile rank is noteworthy. All exact, from counts of distinct values."""
    values = unpivoted(df, list(features))
    stats = values.groupBy("measure").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    placed = cumulative(values.groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n")), "measure", "value")
    half = 0.5 * (F.col("total") - 1)
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value")))
    rank = F.floor((F.col("before") + F.col("n")) / F.col("total") * 1000 + 0.5) / 10
    cuts = placed.groupBy("measure").agg(((at(F.floor(half)) + at(F.ceil(half))) / 2).alias("median"), F.min(F.when(rank >= threshold, F.col("value"))).alias("high"), F.max(F.when(rank <= 100 - threshold, F.col("value"))).alias("low"))
    return stats.join(cuts, "measure")


def profiled(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` with ``profile``, a map from feature to its statistics: a few dozen numbers, as a literal."""
    return with_row(df, stats.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("mean", "std", "median", "high", "low")))).alias("profile")))


def deviations(features: Mapping[str, tuple[str, str]] = LABELS, most: int = MOST) -> Column:
    """The noteworthy features of a row of ``profiled``, at most ``most``, largest deviation from the median (in deviations) first: structs ``z``, ``o``, ``feature``, ``value``."""
    found = []
    for i, (f, (_, side)) in enumerate(features.items()):
        v, p = F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")), F.element_at("profile", F.lit(f))
        z = F.coalesce(F.abs(v - p["median"]) / F.nullif(p["std"], F.lit(0.0)), F.lit(0.0))
        noteworthy = (v >= p["high"]) & (v > p["median"]) if side == "high" else (v <= p["low"]) & (v < p["median"])
        found.append(F.when(noteworthy, F.struct(z.alias("z"), F.lit(-i).alias("o"), F.lit(f).alias("feature"), v.alias("value"))))
    return F.slice(F.sort_array(F.filter(F.array(*found), lambda x: x.isNotNull()), asc=False), 1, most)


def farthest(features: Mapping[str, tuple[str, str]] = LABELS) -> Column:
    """The feature farthest from its mean, in deviations: the fallback where nothing else is noteworthy."""
    all_ = []
    for i, f in enumerate(features):
        v, p = F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")), F.element_at("profile", F.lit(f))
        all_.append(F.struct(F.coalesce(F.abs(v - p["mean"]) / F.nullif(p["std"], F.lit(0.0)), F.lit(0.0)).alias("z"), F.lit(-i).alias("o"), F.lit(f).alias("feature")))
    return F.array_max(F.array(*all_))


def explanation(score: Column, direct: Column, features: Mapping[str, tuple[str, str]] = LABELS) -> Column:
    """The text of a row of ``profiled``: nothing below a score of 50; else direct signals, then deviations that say nothing already said, else the farthest feature."""
    label = F.create_map(*[F.lit(x) for f, (name, _) in features.items() for x in (f, name)])
    said = F.lower(F.array_join(direct, " "))
    word = lambda name: F.when(name.contains("port"), "port").when(name.contains("output address"), "fan-out").when(name.contains("input address"), "fan-in").when(name.contains("peel"), "peel").when(name.contains("fee"), "fee")
    lines = F.transform(deviations(features), lambda d: F.concat(F.element_at(label, d["feature"]), F.lit(" of "), F.format_string("%.6g", d["value"]), F.lit(" ("), F.format_string("%.1f", d["z"]), F.lit(" deviations from the median)")))
    new = F.filter(lines, lambda x: ~F.coalesce(said.contains(word(F.lower(x))), F.lit(False)))
    reasons = F.concat(direct, new)
    far = farthest(features)
    fallback = F.when(far["z"] > 0, F.concat(F.lit("Largest deviation: "), F.element_at(label, far["feature"]), F.lit(" ("), F.format_string("%.1f", far["z"]), F.lit(" deviations from the mean)"))).otherwise("Multivariate anomaly")
    return F.when(score < 50, "Normal network traffic behavior.").otherwise(F.concat(F.lit("Anomaly indicators: "), F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(fallback), F.lit(".")))


def with_intelligence(text: Column, hit: Column, label: Column, indicator: Column, hops: Column, nearest: Column) -> Column:
    """The text behind a note on the watchlist or on taint of one to three hops, unless it already starts so."""
    note = F.when(hit, F.concat(F.lit("Direct watchlist match: "), F.coalesce(label, F.lit("Threat Indicator")), F.lit(" ("), F.coalesce(indicator, F.lit("")), F.lit(")"))).when(
        hops.between(1, 3), F.concat(hops.cast("string"), F.lit(" hop(s) from known-bad indicator ("), F.coalesce(nearest, F.lit("Threat Indicator")), F.lit(")"))
    )
    old = F.trim(F.coalesce(text, F.lit("")))
    return F.when(note.isNull() | old.startswith(note), text).when((old != "") & (old != "Normal."), F.concat(note, F.lit(". "), old)).otherwise(F.concat(note, F.lit(".")))


def with_outlier(text: Column, cluster: Column) -> Column:
    """The text with a sentence on entities outside all clusters, once; in place of a text that says nothing."""
    note = "Entity behaves unlike every known group (HDBSCAN outlier)"
    old = F.coalesce(text, F.lit(""))
    longer = F.when(F.trim(old).isin("", "Normal.", "Normal"), F.lit(note + ".")).otherwise(F.concat(old, F.when(old.endswith("."), " ").otherwise(". "), F.lit(note + ".")))
    return F.when(F.coalesce(cluster == "Outlier", F.lit(False)) & ~old.contains(note), longer).otherwise(text)


def display_country(country: Column) -> Column:
    """What tables show for the sentinels."""
    return F.when(country.isNull() | country.isin("", "nan", "XX"), "Unknown").when(country == "PRIVATE", "Private network").when(country == "LOCAL", "Local").when(country == "DOC", "Documentation range").otherwise(country)


def short(txid: Column, head: int = 8) -> Column:
    return F.when(F.length(txid) > head, F.concat(F.substring(txid, 1, head), F.lit("…"))).otherwise(txid)


def verdict(side: Column, score: Column, flagged: Column) -> Column:
    """Score and flag after the whitelist: both sides listed clear a transaction, one side leaves it as it is (its discount comes with the fusion)."""
    both = F.coalesce(side == "both", F.lit(False))
    return F.struct(F.when(both, 0.0).otherwise(score).alias("risk_score"), F.when(both, F.lit(False)).otherwise(flagged).alias("is_anomaly"))


def rounded_z(z: Column) -> Column:
    return X.rounded(z, 1)
