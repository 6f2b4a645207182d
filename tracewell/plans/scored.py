"""Queries over scored rows and telemetry: scores, summaries, metrics, geography."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import columns as X
from tracewell.operators import explain, metrics, order, reports, scoring
from tracewell.operators.scoring import MEASURES, SEVERITY, finite, trimmed
from tracewell.plans.base import r
from tracewell.runtime import read, with_row
from tracewell.sources import readers

TOP = 100
FLAGGED = 40.0


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "scored_rows")


def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).groupBy("detected_type").agg(F.count(F.lit(1)).alias("n_tx"), F.count_if("is_anomaly").alias("n_flagged"))


def risk_tier(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).groupBy("run_no", X.tier("risk_score").alias("tier")).agg(F.count(F.lit(1)).alias("n_tx"), F.max("risk_score").alias("top_score"))


def funnel(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).agg(F.count(F.lit(1)).alias("scored"), F.count_if("is_anomaly").alias("flagged"), F.count_if(F.col("detected_type") == "Whitelisted_Institutional").alias("cleared"), F.count_if(F.expr("is_anomaly AND detected_type <> 'Whitelisted_Institutional'")).alias("actionable"), F.count_if(F.col("risk_score") >= 80).alias("critical"))


def fused_priority(spark: SparkSession, d: str) -> DataFrame:
    return scoring.fused_priority(_rows(spark, d))


def score_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return reports.score_parts(scoring.fused_priority(_rows(spark, d)))


def severity_index(spark: SparkSession, d: str) -> DataFrame:
    return scoring.severity_index(_rows(spark, d))


def deviation_score(spark: SparkSession, d: str) -> DataFrame:
    return scoring.deviation(_rows(spark, d), "observation_spread_s", "score_id")


def ip_diversity(spark: SparkSession, d: str) -> DataFrame:
    pairs = _rows(spark, d).select(trimmed("entity_id").alias("e"), trimmed("src_ip").alias("i")).where("e IS NOT NULL AND i IS NOT NULL").distinct()
    by = lambda k, name: pairs.groupBy(F.col(k).alias("key")).agg(F.count(F.lit(1)).alias("n_distinct")).select(F.lit(name).alias("kind"), "key", "n_distinct")
    return by("e", "entity_ip_diversity").unionByName(by("i", "ip_entity_diversity"))


def profile_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    stats = order.unpivoted(rows, MEASURES).groupBy("measure").agg(X.rounded(F.avg("value"), 4).alias("mean"), X.rounded(F.stddev_samp("value"), 3).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    p = order.percentiles(rows, MEASURES, [0.5, 0.75, 0.95, 0.99])
    return stats.join(p, "measure").select("*", *[X.rounded(F.col("q")[j], 6).alias(n) for j, n in enumerate(("median", "p75", "p95", "p99"))]).drop("q")


def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    """The rank of every row's amount, from the ranks of the distinct amounts."""
    rows = _rows(spark, d)
    ranks = order.weak_rank(rows, "amount_btc").select(F.col("value").alias("amount_btc"), "rank_pct")
    return rows.select("score_id", "amount_btc").join(ranks, "amount_btc").select("score_id", "rank_pct")


def entity_profile(spark: SparkSession, d: str) -> DataFrame:
    return scoring.entity_profile(_rows(spark, d))


def _clustered(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the tier of their entity's mean risk as its cluster; rows without an entity are of cluster 0."""
    labels = scoring.entity_profile(_rows(spark, d)).select("entity_id", F.concat(F.lit("Cluster "), X.tier("mean_risk")).alias("behaviour_cluster"))
    return scoring.labelled(_rows(spark, d), labels, "entity_id", "behaviour_cluster", "Cluster 0")


def _communities(spark: SparkSession, d: str) -> DataFrame:
    """Rows with their entity's community: the entities whose most used addresses on the wire share their first two parts."""
    labels = scoring.home_address(_rows(spark, d)).select("entity_id", F.concat(F.lit("Community "), F.regexp_extract("ip", r"^[^.:]+[.:][^.:]*", 0)).alias("graph_community"))
    return scoring.labelled(_rows(spark, d), labels, "entity_id", "graph_community", "Community 0")


def cluster_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labels of profiles mapped back to the rows."""
    return _clustered(spark, d).select("score_id", "behaviour_cluster").join(_communities(spark, d).select("score_id", "graph_community"), "score_id")


def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    return scoring.group_summary(_clustered(spark, d), "behaviour_cluster", "cluster")


def community_summary(spark: SparkSession, d: str) -> DataFrame:
    """Communities of at least three entities, by flagged rows and mean risk."""
    return scoring.group_summary(_communities(spark, d), "graph_community", "community").where("n_entities >= 3").orderBy(F.desc("n_flagged"), F.desc("mean_risk"), "community")


def isolated_total(spark: SparkSession, d: str) -> DataFrame:
    """Communities that qualify, and those too small to."""
    return scoring.group_summary(_communities(spark, d), "graph_community", "community").agg(F.count_if(F.col("n_entities") >= 3).alias("n_qualifying"), F.count_if(F.col("n_entities") < 3).alias("n_isolated"))


def risk_sorted(spark: SparkSession, d: str) -> DataFrame:
    """All rows by falling risk: a global order without a sort in one task."""
    rows = _rows(spark, d).select("score_id", F.lit(0).alias("g"), F.struct((-F.col("risk_score")).alias("r"), F.col("score_id").alias("i")).alias("o"))
    return order.numbered(rows, "g", "o").select("score_id", "row_no")


def graph_top400(spark: SparkSession, d: str) -> DataFrame:
    """The graph of the 400 rows of highest risk."""
    return scoring.tripartite(_rows(spark, d).orderBy(F.desc("risk_score"), "score_id").limit(400))


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).select(F.greatest(F.ceil(F.col("risk_score") / 10), F.lit(1)).cast("int").alias("bin"), (F.col("detected_type") == "Whitelisted_Institutional").alias("whitelisted"))
    return rows.groupBy("bin", "whitelisted").agg(F.count(F.lit(1)).alias("n_tx"))


def lead_top25(spark: SparkSession, d: str) -> DataFrame:
    top = _rows(spark, d).orderBy(F.desc("risk_score"), "score_id").limit(25).select("score_id", "txid", "risk_score", "detected_type")
    items = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("risk_score")).alias("o"), "score_id", "txid", "risk_score", "detected_type"))).alias("l"))
    return items.select(F.posexplode("l").alias("p", "s")).select((F.col("p") + 1).alias("rank"), "s.score_id", "s.txid", "s.risk_score", "s.detected_type")


def filtered_view(spark: SparkSession, d: str) -> DataFrame:
    """Anomalies of the two upper tiers of some types, within a score range: chained filters that all reach the scan."""
    rows = _rows(spark, d).where("is_anomaly").where(F.col("detected_type").isin("Peel_Chain", "Fee_Spike", "FanOut_Dispersal", "CoinJoin_Mixer")).where(F.col("risk_score").between(40, 100))
    return rows.where(X.tier("risk_score").isin("Critical", "High")).select("score_id", "txid", "risk_score", "detected_type")


def filter_values(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return rows.select(F.lit("detected_type").alias("field"), F.col("detected_type").alias("value")).distinct().unionByName(rows.select(F.lit("run_no").alias("field"), F.col("run_no").cast("string").alias("value")).distinct())


def country_top10(spark: SparkSession, d: str) -> DataFrame:
    flagged = _rows(spark, d).groupBy("txid").agg(F.max("risk_score").alias("risk"), F.max(F.col("is_anomaly").cast("int")).alias("flag"))
    wire = read(spark, d, "telemetry").select("txid", "geo_country").where("txid IS NOT NULL AND geo_country IS NOT NULL").distinct()
    stats = wire.join(flagged, "txid").groupBy("geo_country").agg(F.count(F.lit(1)).alias("total"), F.sum("flag").alias("flagged"), X.rounded(F.avg("risk"), 4).alias("avg_risk"))
    named = stats.join(F.broadcast(readers.iso_codes(spark).select("iso2", "country_name")), F.col("geo_country") == F.col("iso2"), "left")
    return named.select("geo_country", "country_name", "total", "flagged", "avg_risk").orderBy(F.desc("flagged"), F.desc("total"), "geo_country").limit(10)


def asn_top10(spark: SparkSession, d: str) -> DataFrame:
    """Networks and organisations by flagged observations."""
    flagged = _rows(spark, d).where("is_anomaly").select("txid").where("txid IS NOT NULL").distinct()
    wire = read(spark, d, "telemetry").join(flagged, "txid", "left_semi").withColumn("asn_org", X.geo("src_ip")["asn_org"])
    return wire.groupBy("asn", "asn_org").agg(F.count(F.lit(1)).alias("n_flagged")).orderBy(F.coalesce(F.col("asn") == "AS0", F.lit(True)), F.desc("n_flagged"), "asn", "asn_org").limit(10)


def cidr_resolve(spark: SparkSession, d: str) -> DataFrame:
    ips = read(spark, d, "telemetry").select(F.trim("src_ip").alias("ip")).where("ip <> ''").distinct()
    return ips.select("ip", X.geo("ip").alias("g")).select("ip", "g.geo_country", "g.asn", "g.asn_org")


def geo_enrich(spark: SparkSession, d: str) -> DataFrame:
    return scoring.geo_enriched(read(spark, d, "telemetry")).groupBy("geo_country", "asn_org").agg(F.count(F.lit(1)).alias("n_obs"))


def range_join(spark: SparkSession, d: str) -> DataFrame:
    """Observations per address range, by a blocked range join with a range table."""
    ranges = spark.createDataFrame([(X.ip_to_long(a), X.ip_to_long(b), c, o) for a, b, c, o in K.RESERVED if not a.startswith("240.")], "lo long, hi long, label string, org string")
    got = scoring.range_lookup(read(spark, d, "telemetry").select("obs_id", "src_ip"), "src_ip", ranges)
    return got.groupBy(F.coalesce("org", F.lit("none")).alias("org")).agg(F.count(F.lit(1)).alias("n_obs"))


def ego_network(spark: SparkSession, d: str) -> DataFrame:
    """Around the entity with the highest mean risk of at least three rows."""
    rows = _rows(spark, d)
    best = scoring.entity_profile(rows).where("tx_count >= 3").orderBy(F.desc("mean_risk"), "entity_id").limit(1).collect()
    return scoring.ego_network(rows, best[0]["entity_id"] if best else "")


def ego_graph(spark: SparkSession, d: str) -> DataFrame:
    """What lies within two steps of the same entity on the graph of entities, rows and addresses."""
    rows = _rows(spark, d)
    best = scoring.entity_profile(rows).where("tx_count >= 3").orderBy(F.desc("mean_risk"), "entity_id").limit(1).collect()
    return scoring.ego_graph(scoring.tripartite(rows), f"entity:{best[0]['entity_id']}" if best else "")


def ece(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ece(_rows(spark, d), F.col("risk_score") / 100, "is_anomaly")


def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.calibration(_rows(spark, d), F.col("risk_score") / 100, "is_anomaly")
    return c.select("bin", "n", X.rounded("mean_p", 6).alias("mean_p"), X.rounded("mean_y", 6).alias("mean_y"))


def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return metrics.precision_at(_rows(spark, d), "risk_score", "is_anomaly", "score_id", TOP)


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(_rows(spark, d), "risk_score", "is_anomaly")


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(_rows(spark, d), "risk_score", "is_anomaly")


def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_curve(_rows(spark, d), "risk_score", "is_anomaly")


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_rows(spark, d), F.col("risk_score") >= FLAGGED, "is_anomaly")


def type_recall(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).where("is_anomaly").groupBy("detected_type").agg(F.count(F.lit(1)).alias("n"), X.rounded(F.avg((F.col("risk_score") >= FLAGGED).cast("double")), 6).alias("recall"))


def contamination_cut(spark: SparkSession, d: str) -> DataFrame:
    """The score from which the top 5 % of rows lie, and how many lie there."""
    rows = _rows(spark, d)
    cut = order.percentiles(rows, ["risk_score"], [1 - K.CONTAMINATION]).select(F.get("q", F.lit(0)).alias("cut"))
    return with_row(rows, cut).groupBy("cut").agg(F.count_if(F.col("risk_score") >= F.col("cut")).alias("n_above")).select(X.rounded("cut", 4).alias("cut"), "n_above")


def run_union(spark: SparkSession, d: str) -> DataFrame:
    """Transactions of both the first and a later run, of one of them only: set operations on txids."""
    rows = _rows(spark, d).where("txid IS NOT NULL")
    a, b = rows.where("run_no = 1").select("txid"), rows.where("run_no > 1").select("txid")
    sets = (("both", a.intersect(b)), ("first_only", a.subtract(b)), ("any", a.union(b).distinct()))
    out = None
    for name, s in sets:
        one = s.agg(F.count(F.lit(1)).alias("n_tx")).select(F.lit(name).alias("part"), "n_tx")
        out = one if out is None else out.unionByName(one)
    return out


def deviation_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The noteworthy features of every row, farthest from the median first."""
    rows = _rows(spark, d)
    found = explain.deviations()
    return explain.profiled(rows, explain.profile(rows)).select("score_id", F.array_join(F.transform(found, lambda x: x["feature"]), ", ").alias("reasons"))


def full_explanation(spark: SparkSession, d: str) -> DataFrame:
    """The whole text of every row: direct signals, deviations, fallback."""
    rows = _rows(spark, d)
    none = F.lit(0)
    direct = X.signals(none, none, "detected_type", "fee", "amount_btc", "fan_in", "fan_out", none)
    return explain.profiled(rows, explain.profile(rows)).select("score_id", explain.explanation(F.col("risk_score"), direct).alias("explanation"))


QUERIES = {
    f.__name__: f
    for f in (
        type_counts, risk_tier, funnel, fused_priority, score_breakdown, severity_index, deviation_score, ip_diversity, profile_percentiles, percentile_rank, entity_profile, cluster_rows, cluster_summary, community_summary, isolated_total, risk_sorted, graph_top400, score_histogram, lead_top25, filtered_view,
        filter_values, country_top10, asn_top10, cidr_resolve, geo_enrich, range_join, ego_network, ego_graph, ece, calibration_curve, precision_at_k, roc_auc, average_precision, roc_curve, confusion, type_recall, contamination_cut, run_union, deviation_reasons, full_explanation,
    )
}

_T = lambda x: f"nullif(trim({x}), '')"
_FIN = lambda x: f"CASE WHEN isfinite({x}::DOUBLE) THEN {x}::DOUBLE END"
_TIER = lambda x: f"CASE WHEN {x} >= 80 THEN 'Critical' WHEN {x} >= 60 THEN 'High' WHEN {x} >= 40 THEN 'Medium' ELSE 'Low' END"
_WL = "detected_type = 'Whitelisted_Institutional'"
_PAT = "CASE WHEN detected_type IN ('CoinJoin_Mixer', 'Peel_Chain') THEN 100.0 WHEN detected_type IN ('FanOut_Dispersal', 'Fee_Spike') THEN 70.0 ELSE 0.0 END::DOUBLE"
FUSED = f"""e AS (SELECT min({_FIN('port_risk_combined')}) AS lo, max({_FIN('port_risk_combined')}) AS hi FROM scored_rows),
part AS (SELECT score_id, risk_score AS score_ml, {_PAT} AS score_pattern, {r(f"coalesce(({_FIN('port_risk_combined')} - lo) / nullif(hi - lo, 0), 0) * 100", 1)} AS score_network, 0.0::DOUBLE AS score_graph, CASE WHEN {_WL} THEN 0.15 ELSE 1.0 END::DOUBLE AS whitelist_factor FROM scored_rows, e)"""
_RAW = "(0.5::DOUBLE * score_ml + 0.25::DOUBLE * score_pattern + 0.15::DOUBLE * score_network + 0.1::DOUBLE * score_graph)"
_ABOVE = " + ".join(f"coalesce(({_FIN(x)} > p_{x})::INT, 0)" for x in SEVERITY)
_LONG = " UNION ALL ".join(f"SELECT '{m}' AS measure, {m}::DOUBLE AS value FROM scored_rows WHERE isfinite({m}::DOUBLE)" for m in MEASURES)
_WHOLE = lambda x: f"sum(floor({_FIN(x)} * 1e8 + 0.5)::BIGINT)"
_MEAN = lambda x: r(f"{_WHOLE(x)} / count({_FIN(x)})::DOUBLE / 1e8", 4)
_PROFILE = f"""SELECT trim(entity_id) AS entity_id, count(*) AS tx_count, {r(_WHOLE('amount_btc') + ' / 1e8', 4)} AS total_btc, {_MEAN('amount_btc')} AS mean_btc, {_MEAN('fan_out')} AS mean_fan_out, {_MEAN('fan_in')} AS mean_fan_in,
  {_MEAN('fee_rate_urgency')} AS mean_fee_urgency, {_MEAN('port_risk_combined')} AS mean_port_risk, count(DISTINCT {_T('src_ip')}) AS distinct_ips, {r("avg(CASE WHEN hour(ts) < 5 THEN 1.0 WHEN ts IS NOT NULL THEN 0.0 END)", 4)} AS night_share, {_MEAN('risk_score')} AS mean_risk FROM scored_rows WHERE {_T('entity_id')} IS NOT NULL GROUP BY 1"""


LABELS = f"""prof AS ({_PROFILE}), clus AS (SELECT entity_id AS ce, 'Cluster ' || {_TIER('mean_risk')} AS behaviour_cluster FROM prof),
home AS (SELECT e, 'Community ' || regexp_extract(ip, '^[^.:]+[.:][^.:]*') AS graph_community FROM (SELECT {_T('entity_id')} AS e, {_T('src_ip')} AS ip, count(*) AS n FROM scored_rows WHERE {_T('entity_id')} IS NOT NULL AND {_T('src_ip')} IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY e ORDER BY n DESC, ip) = 1),
lab AS (SELECT s.*, coalesce(behaviour_cluster, 'Cluster 0') AS behaviour_cluster, coalesce(graph_community, 'Community 0') AS graph_community FROM scored_rows s LEFT JOIN clus ON {_T('s.entity_id')} = ce LEFT JOIN home ON {_T('s.entity_id')} = e)"""


def _summary(group: str, name: str) -> str:
    return f"""{LABELS}, k AS (SELECT {group} AS grp, detected_type FROM lab GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY count(*) DESC, detected_type) = 1),
    g AS (SELECT {group} AS grp, count(DISTINCT {_T('entity_id')}) AS n_entities, count(DISTINCT {_T('src_ip')}) AS n_ips, count(*) AS n_tx, {r('avg(risk_score)', 4)} AS mean_risk, count(*) FILTER (is_anomaly) AS n_flagged FROM lab GROUP BY 1),
    summ AS (SELECT g.grp AS {name}, n_entities, n_ips, n_tx, mean_risk, n_flagged, detected_type AS dominant_type FROM g JOIN k ON g.grp = k.grp)"""


TRIPARTITE = "SELECT 'entity:' || trim(entity_id) AS src, 'tx:' || score_id AS dst FROM {t} WHERE trim(entity_id) <> '' UNION SELECT 'tx:' || score_id, 'ip:' || trim(src_ip) FROM {t} WHERE trim(src_ip) <> ''"
_IPN = "CASE WHEN regexp_full_match(ip, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}') THEN split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT END"
_GEO = lambda j, miss: "CASE " + " ".join(f"WHEN n BETWEEN {X.ip_to_long(x[0])} AND {X.ip_to_long(x[1])} THEN '{x[j]}'" for x in K.RESERVED) + f" ELSE '{miss}' END"
# Names of the countries that the test tables hold, so that the SQL doesn't read the list it checks.
_NAMES = {"AE": "United Arab Emirates", "AU": "Australia", "BR": "Brazil", "CA": "Canada", "CH": "Switzerland", "CN": "China", "DE": "Germany", "FR": "France", "GB": "United Kingdom", "IN": "India", "JP": "Japan", "KR": "South Korea", "NG": "Nigeria", "NL": "Netherlands", "RU": "Russia", "SE": "Sweden", "SG": "Singapore", "UA": "Ukraine", "US": "United States", "ZA": "South Africa"}
_ISO = "(VALUES " + ", ".join(f"('{a}', '{n}')" for a, n in _NAMES.items()) + ") iso(iso2, country_name)"
_BIN = " + ".join(f"(p >= {e}::DOUBLE)::INT" for e in metrics.EDGES)
SCORES = "v AS (SELECT risk_score AS value, count(*) AS n, count(*) FILTER (is_anomaly) AS pos FROM scored_rows WHERE risk_score IS NOT NULL AND NOT isnan(risk_score) GROUP BY 1), c AS (SELECT *, sum(n) OVER w AS n_up, sum(pos) OVER w AS pos_up, sum(n) OVER () AS n_all, sum(pos) OVER () AS pos_all FROM v WINDOW w AS (ORDER BY value DESC))"
_DEV = ("fan_in", "fan_out", "fee_rate_urgency", "port_risk_combined", "ip_observation_count", "observation_spread_s", "amount_btc", "fee")
_DEVS = ", ".join(
    f"CASE WHEN {_FIN(x)} >= p['{x}'].high AND {_FIN(x)} > p['{x}'].med THEN {{'z': coalesce(abs({x} - p['{x}'].med) / nullif(p['{x}'].std, 0), 0), 'o': {-i}, 'f': '{x}'}} END" for i, x in enumerate(_DEV)
)
ORACLE = {
    "deviation_reasons": "WITH l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS m, {m}::DOUBLE AS v FROM scored_rows WHERE isfinite({m}::DOUBLE)" for m in _DEV) + f"""), k AS (SELECT m, v, floor(count(*) OVER (PARTITION BY m ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY m)::DOUBLE * 1000 + 0.5) / 10 AS rk FROM l),
        s AS (SELECT m, stddev_samp(v) AS std, quantile_cont(v, 0.5) AS med, min(v) FILTER (rk >= 75) AS high FROM k GROUP BY 1), q AS (SELECT map_from_entries(list((m, {{'std': std, 'med': med, 'high': high}}))) AS p FROM s),
        d AS (SELECT score_id, list_filter([{_DEVS}], lambda x: x IS NOT NULL) AS l FROM scored_rows, q)
        SELECT score_id, array_to_string(list_transform(list_sort(l, 'DESC')[1:4], lambda x: x.f), ', ') AS reasons FROM d""",
    "type_counts": "SELECT detected_type, count(*) AS n_tx, count(*) FILTER (is_anomaly) AS n_flagged FROM scored_rows GROUP BY 1",
    "risk_tier": f"SELECT run_no, {_TIER('risk_score')} AS tier, count(*) AS n_tx, max(risk_score) AS top_score FROM scored_rows GROUP BY 1, 2",
    "funnel": f"SELECT count(*) AS scored, count(*) FILTER (is_anomaly) AS flagged, count(*) FILTER ({_WL}) AS cleared, count(*) FILTER (is_anomaly AND NOT {_WL}) AS actionable, count(*) FILTER (risk_score >= 80) AS critical FROM scored_rows",
    "fused_priority": f"WITH {FUSED}, p AS (SELECT *, {r(f'{_RAW} * whitelist_factor', 1)} AS priority FROM part) SELECT *, {_TIER('priority')} AS tier FROM p",
    "score_breakdown": f"WITH {FUSED} "
    + " UNION ALL ".join(f"SELECT score_id, '{n}' AS part, {r(f'{w}::DOUBLE * score_{n}', 1)} AS points FROM part" for n, w in K.WEIGHTS.items())
    + f" UNION ALL SELECT score_id, 'whitelist discount', {r(f'{_RAW} * whitelist_factor - {_RAW}', 1)} FROM part",
    "severity_index": "WITH p AS (SELECT " + ", ".join(f"quantile_cont({_FIN(x)}, 0.75) AS p_{x}" for x in SEVERITY) + f" FROM scored_rows) SELECT score_id, ({_ABOVE})::INT AS n_above, {r(f'0.7::DOUBLE * risk_score + 0.3::DOUBLE * 100 * ({_ABOVE}) / {len(SEVERITY)}', 2)} AS severity_index FROM scored_rows, p",
    "deviation_score": f"WITH e AS (SELECT min({_FIN('observation_spread_s')}) AS lo, max({_FIN('observation_spread_s')}) AS hi FROM scored_rows) SELECT score_id, {r('100 * (hi - observation_spread_s) / (hi - lo)', 1)} AS deviation_score FROM scored_rows, e WHERE isfinite(observation_spread_s)",
    "ip_diversity": f"WITH p AS (SELECT DISTINCT {_T('entity_id')} AS e, {_T('src_ip')} AS i FROM scored_rows WHERE {_T('entity_id')} IS NOT NULL AND {_T('src_ip')} IS NOT NULL) SELECT 'entity_ip_diversity' AS kind, e AS key, count(*) AS n_distinct FROM p GROUP BY 2 UNION ALL SELECT 'ip_entity_diversity', i, count(*) FROM p GROUP BY 2",
    "profile_percentiles": f"WITH l AS ({_LONG}) SELECT measure, {r('avg(value)', 4)} AS mean, {r('stddev_samp(value)', 3)} AS std, min(value) AS min, max(value) AS max, {r('quantile_cont(value, 0.5)', 6)} AS median, {r('quantile_cont(value, 0.75)', 6)} AS p75, {r('quantile_cont(value, 0.95)', 6)} AS p95, {r('quantile_cont(value, 0.99)', 6)} AS p99 FROM l GROUP BY 1",
    "percentile_rank": "SELECT score_id, floor(count(*) OVER (ORDER BY amount_btc RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER ()::DOUBLE * 1000 + 0.5) / 10 AS rank_pct FROM scored_rows WHERE isfinite(amount_btc)",
    "entity_profile": _PROFILE,
    "cluster_rows": f"WITH {LABELS} SELECT score_id, behaviour_cluster, graph_community FROM lab",
    "cluster_summary": f"WITH {_summary('behaviour_cluster', 'cluster')} SELECT * FROM summ",
    "community_summary": f"WITH {_summary('graph_community', 'community')} SELECT * FROM summ WHERE n_entities >= 3",
    "isolated_total": f"WITH {_summary('graph_community', 'community')} SELECT count(*) FILTER (n_entities >= 3) AS n_qualifying, count(*) FILTER (n_entities < 3) AS n_isolated FROM summ",
    "risk_sorted": "SELECT score_id, row_number() OVER (ORDER BY risk_score DESC, score_id) - 1 AS row_no FROM scored_rows",
    "graph_top400": f"WITH t AS (SELECT * FROM scored_rows ORDER BY risk_score DESC, score_id LIMIT 400) {TRIPARTITE.format(t='t')}",
    "ego_graph": f"""WITH best AS (SELECT entity_id FROM ({_PROFILE}) WHERE tx_count >= 3 ORDER BY mean_risk DESC, entity_id LIMIT 1), g AS ({TRIPARTITE.format(t='scored_rows')}), w AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g),
        one AS (SELECT 'entity:' || entity_id AS node FROM best UNION SELECT dst FROM w WHERE src = (SELECT 'entity:' || entity_id FROM best)), two AS (SELECT node FROM one UNION SELECT dst FROM w WHERE src IN (SELECT node FROM one))
        SELECT src, dst FROM g WHERE src IN (SELECT node FROM two) AND dst IN (SELECT node FROM two)""",
    "score_histogram": f"SELECT greatest(ceil(risk_score / 10), 1)::INT AS bin, {_WL} AS whitelisted, count(*) AS n_tx FROM scored_rows GROUP BY 1, 2",
    "lead_top25": "SELECT (row_number() OVER (ORDER BY risk_score DESC, score_id))::INT AS rank, score_id, txid, risk_score, detected_type FROM scored_rows ORDER BY risk_score DESC, score_id LIMIT 25",
    "filtered_view": "SELECT score_id, txid, risk_score, detected_type FROM scored_rows WHERE is_anomaly AND detected_type IN ('Peel_Chain', 'Fee_Spike', 'FanOut_Dispersal', 'CoinJoin_Mixer') AND risk_score >= 60 AND risk_score <= 100",
    "filter_values": "SELECT DISTINCT 'detected_type' AS field, detected_type AS value FROM scored_rows UNION ALL SELECT DISTINCT 'run_no', run_no::VARCHAR FROM scored_rows",
    "country_top10": f"WITH f AS (SELECT txid, max(risk_score) AS risk, max(is_anomaly::INT) AS flag FROM scored_rows GROUP BY 1), w AS (SELECT DISTINCT txid, geo_country FROM telemetry WHERE txid IS NOT NULL AND geo_country IS NOT NULL) SELECT geo_country, country_name, count(*) AS total, sum(flag)::BIGINT AS flagged, {r('avg(risk)', 4)} AS avg_risk FROM w JOIN f USING (txid) LEFT JOIN {_ISO} ON geo_country = iso2 GROUP BY 1, 2 ORDER BY flagged DESC, total DESC, geo_country LIMIT 10",
    "asn_top10": f"WITH i AS (SELECT asn, trim(src_ip) AS ip FROM telemetry WHERE txid IN (SELECT txid FROM scored_rows WHERE is_anomaly AND txid IS NOT NULL)), n AS (SELECT asn, {_IPN} AS n FROM i) SELECT asn, {_GEO(3, 'Unknown')} AS asn_org, count(*) AS n_flagged FROM n GROUP BY 1, 2 ORDER BY coalesce(asn = 'AS0', true), n_flagged DESC, asn, asn_org LIMIT 10",
    "cidr_resolve": f"WITH i AS (SELECT DISTINCT trim(src_ip) AS ip FROM telemetry WHERE trim(src_ip) <> ''), n AS (SELECT ip, {_IPN} AS n FROM i) SELECT ip, {_GEO(2, 'XX')} AS geo_country, 'AS0' AS asn, {_GEO(3, 'Unknown')} AS asn_org FROM n",
    "geo_enrich": f"WITH i AS (SELECT trim(src_ip) AS ip, geo_country AS g FROM telemetry), n AS (SELECT g, {_IPN} AS n FROM i) SELECT CASE WHEN g IS NULL OR g IN ('', 'nan', 'XX') THEN {_GEO(2, 'XX')} ELSE g END AS geo_country, {_GEO(3, 'Unknown')} AS asn_org, count(*) AS n_obs FROM n GROUP BY 1, 2",
    "range_join": f"WITH i AS (SELECT trim(src_ip) AS ip FROM telemetry), n AS (SELECT {_IPN} AS n FROM i) SELECT CASE WHEN n < {X.ip_to_long('240.0.0.0')} THEN {_GEO(3, 'none')} ELSE 'none' END AS org, count(*) AS n_obs FROM n GROUP BY 1",
    "ego_network": f"""WITH best AS (SELECT entity_id FROM ({_PROFILE}) WHERE tx_count >= 3 ORDER BY mean_risk DESC, entity_id LIMIT 1), s AS (SELECT 'tx:' || score_id AS t, {_T('entity_id')} AS e, {_T('src_ip')} AS ip FROM scored_rows),
        near AS (SELECT * FROM s WHERE e = (SELECT entity_id FROM best) OR ip IN (SELECT ip FROM s WHERE e = (SELECT entity_id FROM best) AND ip IS NOT NULL))
        SELECT DISTINCT 'entity:' || e AS src, t AS dst FROM near WHERE e IS NOT NULL UNION SELECT DISTINCT t, 'ip:' || ip FROM near WHERE ip IS NOT NULL""",
    "ece": f"WITH b AS (SELECT risk_score / 100 AS p, is_anomaly::INT AS y FROM scored_rows WHERE risk_score IS NOT NULL), g AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM b GROUP BY 1) SELECT {r('sum(n * abs(mp - my)) / sum(n)', 6)} AS ece FROM g",
    "calibration_curve": f"WITH b AS (SELECT risk_score / 100 AS p, is_anomaly::INT AS y FROM scored_rows WHERE risk_score IS NOT NULL) SELECT ({_BIN})::INT AS bin, count(*) AS n, {r('avg(p)', 6)} AS mean_p, {r('avg(y)', 6)} AS mean_y FROM b GROUP BY 1",
    "precision_at_k": f"SELECT {r('avg(is_anomaly::INT)', 6)} AS precision_at_k, count(*) AS k FROM (SELECT is_anomaly FROM scored_rows ORDER BY risk_score DESC, score_id LIMIT {TOP})",
    "roc_auc": f"WITH {SCORES} SELECT {r('sum(pos * ((n_all - n_up) - (pos_all - pos_up) + (n - pos) / 2::DOUBLE)) / max(pos_all) / max(n_all - pos_all)', 6)} AS roc_auc FROM c",
    "average_precision": f"WITH {SCORES} SELECT {r('sum(pos / pos_all::DOUBLE * pos_up / n_up)', 6)} AS average_precision FROM c",
    "roc_curve": f"WITH {SCORES} SELECT value AS threshold, {r('pos_up / pos_all::DOUBLE', 6)} AS tpr, {r('(n_up - pos_up) / (n_all - pos_all)::DOUBLE', 6)} AS fpr, {r('pos_up / n_up::DOUBLE', 6)} AS precision FROM c",
    "confusion": f"WITH c AS (SELECT count(*) FILTER (p AND is_anomaly) AS tp, count(*) FILTER (p AND NOT is_anomaly) AS fp, count(*) FILTER (NOT p AND is_anomaly) AS fn, count(*) FILTER (NOT p AND NOT is_anomaly) AS tn FROM (SELECT risk_score >= {FLAGGED} AS p, is_anomaly FROM scored_rows)) SELECT tp, fp, fn, tn, {r('coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)', 6)} AS precision, {r('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)', 6)} AS recall, {r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)', 6)} AS f1, {r('coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0)', 6)} AS fpr FROM c",
    "type_recall": f"SELECT detected_type, count(*) AS n, {r(f'avg((risk_score >= {FLAGGED})::INT)', 6)} AS recall FROM scored_rows WHERE is_anomaly GROUP BY 1",
    "contamination_cut": f"WITH c AS (SELECT quantile_cont(risk_score, 0.95) AS cut FROM scored_rows) SELECT {r('any_value(cut)', 4)} AS cut, count(*) FILTER (risk_score >= cut) AS n_above FROM scored_rows, c",
    "run_union": "WITH a AS (SELECT DISTINCT txid FROM scored_rows WHERE run_no = 1 AND txid IS NOT NULL), b AS (SELECT DISTINCT txid FROM scored_rows WHERE run_no > 1 AND txid IS NOT NULL) SELECT 'both' AS part, count(*) AS n_tx FROM a WHERE txid IN (SELECT txid FROM b) UNION ALL SELECT 'first_only', count(*) FROM a WHERE txid NOT IN (SELECT txid FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT txid FROM a UNION SELECT txid FROM b)",
}
