"""Queries over the ledger and the wire: ingestion, row features, joins, types, intelligence, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import columns as X
from tracewell.operators import chains, entities, explain, ingest, intel, order, scoring, trace
from tracewell.operators.correlate import correlate, first_seen, match_stats
from tracewell.operators.features import feature_matrix, fold_of, port_frequency
from tracewell.operators.reports import evidence, package
from tracewell.plans import base
from tracewell.plans.base import CHAINS, JUDGED, KINDS, MIX, TX, WATCHLIST, WHITELIST, r, with_
from tracewell.runtime import Scratch, read, small_side

SEEDS = 10
HOPS = 4


def pipe_parse(spark: SparkSession, d: str) -> DataFrame:
    return base.tx(spark, d).select("row_idx", F.size("ins").alias("n_in"), F.size("outs").alias("n_out"), F.size("in_amts").alias("n_in_amounts"), F.size("out_amts").alias("n_out_amounts"), X.rounded("total_in", 6).alias("total_in"), X.rounded("total_out", 6).alias("total_out"))


def strict_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums of whole cells in which every item is a number, 0 otherwise; over all ledger rows."""
    return read(spark, d, "tx_ledger").select("row_idx", X.rounded(X.strict_total("output_amounts"), 6).alias("total_out"), X.pipe_count("output_addresses").alias("n_out"))


def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return ingest.judged(read(spark, d, "tx_ledger")).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def ingestion_report(spark: SparkSession, d: str) -> DataFrame:
    return ingest.report(ingest.judged(read(spark, d, "tx_ledger")), "tx_ledger").drop("sha256")


def fan_stats(spark: SparkSession, d: str) -> DataFrame:
    return base.tx(spark, d).select("row_idx", "fan_in", "fan_out", X.fan_ratio("fan_in", "fan_out").alias("fan_ratio"))


def peel_disparity(spark: SparkSession, d: str) -> DataFrame:
    return base.tx(spark, d).select("row_idx", X.peel_disparity("out_amts").alias("disparity"))


def fee_urgency(spark: SparkSession, d: str) -> DataFrame:
    return base.tx(spark, d).select("row_idx", X.fee_urgency("fee", "total_in").alias("fee_rate_urgency"), (F.col("total_in") < K.MICRO_TX).cast("int").alias("is_micro_tx"))


def mixer_buckets(spark: SparkSession, d: str) -> DataFrame:
    return base.tx(spark, d).select("row_idx", F.greatest("fan_in", "fan_out").alias("participants"), X.rounded(X.dominant_ratio("out_amts"), 4).alias("dominant_ratio"), X.is_mixer("fan_in", "fan_out", "out_amts").alias("is_mixer"))


def change_address(spark: SparkSession, d: str) -> DataFrame:
    return entities.change_addresses(base.cut_tx(spark, d))


def first_observation(spark: SparkSession, d: str) -> DataFrame:
    return first_seen(read(spark, d, "telemetry"))


def correlate_layers(spark: SparkSession, d: str) -> DataFrame:
    return correlate(base.tx(spark, d), read(spark, d, "telemetry")).select("row_idx", "txid", "src_ip", "src_port", "ip_observation_count", "observation_spread_s")


def layer_match_stats(spark: SparkSession, d: str) -> DataFrame:
    return match_stats(base.tx(spark, d), read(spark, d, "telemetry"))


def freq_encode(spark: SparkSession, d: str) -> DataFrame:
    f = feature_matrix(base.cut_tx(spark, d))
    return f.select("row_idx", X.rounded("script_type_freq", 6).alias("script_type_freq"), X.rounded("src_ip_freq", 6).alias("src_ip_freq"))


def port_risk(spark: SparkSession, d: str) -> DataFrame:
    return feature_matrix(base.cut_tx(spark, d)).select("row_idx", "src_port_risk", "dst_port_risk", "port_risk_combined")


def port_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return port_frequency(base.cut_tx(spark, d)).select("port", X.rounded("freq", 6).alias("freq"))


def minmax_zscore(spark: SparkSession, d: str) -> DataFrame:
    f = feature_matrix(base.cut_tx(spark, d))
    return f.select("row_idx", X.rounded("amount_btc_scaled", 6).alias("amount_btc_scaled"), X.rounded("fee_scaled", 6).alias("fee_scaled"), X.rounded("value_zscore", 3).alias("value_zscore"))


def structural_type(spark: SparkSession, d: str) -> DataFrame:
    return base.classified(spark, d).select("row_idx", "structural", "kind")


def whitelist_side(spark: SparkSession, d: str) -> DataFrame:
    return intel.whitelisted(base.cut_tx(spark, d), intel.whitelist(read(spark, d, "institutional_whitelist")))


def watchlist_hit(spark: SparkSession, d: str) -> DataFrame:
    t = base.cut_tx(spark, d)
    return intel.watched(t, base.watchlist(t))


def taint_hops(spark: SparkSession, d: str) -> DataFrame:
    t = base.cut_tx(spark, d)
    return intel.taint_hops(t, base.watchlist(t))


def taint_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds, as many as the SQL beside it spells out; ``taint_converged`` goes on to the end."""
    t = base.cut_tx(spark, d)
    return intel.taint_scores(t, base.watchlist(t), iterations=3, tolerance=0).select("row_idx", X.rounded("taint_score", 3).alias("taint_score"))


def taint_converged(spark: SparkSession, d: str) -> DataFrame:
    t = base.cut_tx(spark, d)
    return intel.taint_scores(t, base.watchlist(t))


def entity_components(spark: SparkSession, d: str) -> DataFrame:
    return entities.entities(base.cut_tx(spark, d)).select("address", "entity_id", "size")


def entity_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = entities.entities(base.cut_tx(spark, d)).select("entity_id", "confidence", "size").distinct()
    return e.groupBy("confidence").agg(F.count(F.lit(1)).alias("n_entities"), F.sum("size").alias("n_addresses"), F.max("size").alias("largest"))


def peel_chains(spark: SparkSession, d: str) -> DataFrame:
    return chains.peel_chains(base.cut_tx(spark, d))


def _starts(t: DataFrame) -> DataFrame:
    """The transactions that take in most: the leads that are traced."""
    return t.orderBy(F.desc("total_in"), "row_idx").limit(SEEDS).select(F.col("row_idx").alias("seed"))


def trace_forward(spark: SparkSession, d: str) -> DataFrame:
    t = base.cut_classified(spark, d)
    return trace.trace(t, _starts(t), HOPS).drop("whitelisted_entity", "txid")


def trace_backward(spark: SparkSession, d: str) -> DataFrame:
    t = base.cut_classified(spark, d)
    return trace.trace(t, _starts(t), HOPS, backward=True).drop("whitelisted_entity", "txid")


def traceable_leads(spark: SparkSession, d: str) -> DataFrame:
    return trace.traceable(base.cut_tx(spark, d))


def rules_only(spark: SparkSession, d: str) -> DataFrame:
    """A fixed rule set: anonymiser port, fee over a tenth, over 20 outputs, or half of ten or more outputs equal."""
    t = base.tx(spark, d)
    ratio = F.coalesce(F.col("fee") / F.nullif("total_in", F.lit(0.0)), F.lit(0.0))
    equal = (F.size("out_amts") >= 10) & (X.dominant_ratio("out_amts") >= 0.5)
    return t.select("row_idx", (F.col("src_port").isin(*K.FUSION_ANON_PORTS) | (ratio > 0.1) | (F.col("fan_out") > 20) | equal).cast("int").alias("flag"))


def light_features(spark: SparkSession, d: str) -> DataFrame:
    """The light feature set: counts, sums, shares and the spread of the outputs (population deviation over mean; rounded just off the half, where shares of two outputs lie)."""
    mean = X.total("out_amts") / F.size("out_amts")
    var = F.aggregate("out_amts", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size("out_amts")
    return base.tx(spark, d).select("row_idx", "fan_in", "fan_out", X.rounded("total_in", 6).alias("total_in"), X.fee_urgency("fee", "total_in").alias("fee_rate"), X.rounded(X.dominant_ratio("out_amts"), 4).alias("equal_ratio"), (F.floor(F.coalesce(F.sqrt(var) / F.nullif(mean, F.lit(0.0)), F.lit(0.0)) * 1e4 + 0.50003) / 1e4).alias("amount_cv"))


def explain_text(spark: SparkSession, d: str) -> DataFrame:
    t = base.classified(spark, d)
    s = X.signals("src_port", "dst_port", "structural", "fee", "total_in", "fan_in", "fan_out", "chain_length")
    return t.select("row_idx", F.when(F.size(s) > 0, F.array_join(s, "; ")).otherwise("No direct signal").alias("explanation"))


def telemetry_rows(spark: SparkSession, d: str) -> DataFrame:
    """The noteworthy features of every transaction, with their percentile and the reason in words: 17 features."""
    return explain.telemetry(_features(spark, d), "row_idx")


def telemetry_json(spark: SparkSession, d: str) -> DataFrame:
    """The same as one JSON list per transaction."""
    return explain.telemetry_lists(_features(spark, d), "row_idx")


def feature_profile(spark: SparkSession, d: str) -> DataFrame:
    """The data set's profile: 17 features."""
    p = explain.dataset_profile(_features(spark, d))
    return p.select("measure", *[X.rounded(x, 6).alias(x) for x in p.columns if x != "measure"])


def split_folds(spark: SparkSession, d: str) -> DataFrame:
    """Five folds, stratified by script type; the order within a stratum is a keyed integer hash."""
    t = base.tx(spark, d).select("row_idx", F.coalesce("script_type", F.lit("")).alias("y"))
    return fold_of(t, "y", "row_idx", 5)


def type_mix(spark: SparkSession, d: str) -> DataFrame:
    t = base.classified(spark, d)
    return t.groupBy("kind", F.coalesce("whitelisted_side", F.lit("none")).alias("side")).agg(F.count(F.lit(1)).alias("n_tx"), F.sum(F.floor(F.col("total_in") * 1e8 + 0.5).cast("decimal(38,0)")).cast("long").alias("sats_in"), F.max("chain_length").alias("longest_chain"))


def observation_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Transactions seen on the wire by which country and port: a semi-join and a group."""
    wire = read(spark, d, "telemetry").join(base.tx(spark, d).select("txid"), "txid", "left_semi")
    return wire.groupBy("geo_country", "dst_port").agg(F.count(F.lit(1)).alias("n_obs"), F.countDistinct("txid").alias("n_tx"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    t = base.cut_tx(spark, d)
    return Scratch(spark, "matrix").cut(feature_matrix(t, chains.peel_chains(t), entities.entities(t), first_seen(read(spark, d, "telemetry"))), "features")


def full_features(spark: SparkSession, d: str) -> DataFrame:
    """All 23 features of every transaction, entities and chains included."""
    f = _features(spark, d)
    return f.select("row_idx", "entity_id", *[X.rounded(x, 5).alias(x) for x in f.columns if x not in ("row_idx", "entity_id")])


def trace_both(spark: SparkSession, d: str) -> DataFrame:
    """Backward and forward in one table, the start once."""
    t = base.cut_classified(spark, d)
    return trace.both_ways(t, _starts(t), HOPS).drop("whitelisted_entity", "txid")


def trace_advice(spark: SparkSession, d: str) -> DataFrame:
    t = base.cut_classified(spark, d)
    return trace.advice(trace.trace(t, _starts(t), HOPS))


def first_traceable(spark: SparkSession, d: str) -> DataFrame:
    """The 20 flagged transactions of highest risk whose forward trace has at least two hops."""
    t = base.cut_tx(spark, d)
    flagged = read(spark, d, "scored_rows").where("is_anomaly AND txid IS NOT NULL").groupBy("txid").agg(F.max("risk_score").alias("risk_score"))
    rows = t.select("row_idx", "txid").join(trace.traceable(t), "row_idx", "left_semi").join(flagged, "txid")
    return rows.orderBy(F.desc("risk_score"), "row_idx").limit(20).select("row_idx", "txid", "risk_score")


def ledger_by_time(spark: SparkSession, d: str) -> DataFrame:
    """The ledger in the order of time: a global order without a sort in one task."""
    rows = base.tx(spark, d).select("row_idx", F.lit(0).alias("g"), F.struct("ts", "row_idx").alias("o"))
    return order.numbered(rows, "g", "o").select("row_idx", "row_no")


def regulated_view(spark: SparkSession, d: str) -> DataFrame:
    """Transactions whose explanation speaks of a regulated entity."""
    t = base.classified(spark, d)
    text = F.when(F.col("whitelisted_side").isNotNull(), F.concat(F.lit("Whitelisted "), F.col("whitelisted_side"), F.lit(": "), F.coalesce("whitelisted_entity", F.lit("unnamed"))))
    return t.where(explain.regulated(text)).select("row_idx", text.alias("explanation"))


def fused_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The fused priority of every scored row with what the ledger knows of it: anonymiser ports set the network's part, watchlist hits the graph's."""
    t = base.cut_tx(spark, d)
    hits = intel.watched(t, base.watchlist(t)).select("row_idx", F.lit(True).alias("hit"))
    known = t.select("txid", "src_port", "dst_port", "row_idx").join(hits, "row_idx", "left").drop("row_idx")
    return scoring.fused_priority(read(spark, d, "scored_rows").join(known, "txid", "left"), anonymous=F.col("src_port").isin(*K.FUSION_ANON_PORTS) | F.col("dst_port").isin(*K.FUSION_ANON_PORTS), hit=F.col("hit"))


def evidence_package(spark: SparkSession, d: str) -> DataFrame:
    """Leads with their traces, as one JSON text each."""
    t = base.cut_classified(spark, d)
    return evidence(t, trace.trace(t, _starts(t), HOPS))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """Classified transactions with the highest score that any run gave them."""
    best = F.max_by(F.struct("risk_score", "is_anomaly", "detected_type"), F.struct("risk_score", -F.col("score_id"))).alias("b")
    scores = read(spark, d, "scored_rows").where("txid IS NOT NULL AND risk_score IS NOT NULL").groupBy("txid").agg(best).select("txid", "b.*")
    signals = X.signals("src_port", "dst_port", "structural", "fee", "total_in", "fan_in", "fan_out", "chain_length")
    return Scratch(spark, "ranked").cut(base.classified(spark, d).join(scores, "txid").withColumn("explanation", F.array_join(signals, "; ")), "rows")


def evidence_file(spark: SparkSession, d: str) -> DataFrame:
    """The whole evidence file as one JSON text."""
    rows = _ranked(spark, d)
    starts = rows.orderBy(F.desc("risk_score"), "row_idx").limit(SEEDS).select(F.col("row_idx").alias("seed"))
    return package(rows, trace.trace(rows, starts, HOPS), {"case_id": "case", "analyst": "analyst", "source": "tx_ledger"})


def evidence_funnel(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of the evidence file, read back from its JSON."""
    got = evidence_file(spark, d).select(*[F.get_json_object("package", f"$.executive_summary.{p}").cast("long").alias(n) for n, p in (("total", "funnel_numbers.total_ingested"), ("cleared", "funnel_numbers.whitelisted_cleared"), ("flagged", "funnel_numbers.flagged_anomalies"), ("critical", "tier_counts.Critical"), ("high", "tier_counts.High"))], F.get_json_object("package", "$.ranked_leads_top25[0].txid").alias("first_lead"), F.get_json_object("package", "$.ranked_leads_top25[24].txid").alias("last_lead"))
    return got


def whitelist_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per institution: transactions it stands in, by side."""
    t, table = base.tx(spark, d), small_side(intel.whitelist(read(spark, d, "institutional_whitelist")))
    rows = t.select("row_idx", F.inline(F.array(F.struct(F.lit("input").alias("side"), F.col("ins").alias("items")), F.struct(F.lit("output").alias("side"), F.col("outs").alias("items")))))
    hits = rows.select("row_idx", "side", F.explode(F.transform("items", F.lower)).alias("address")).join(table, "address")
    return hits.groupBy("label", "side").agg(F.countDistinct("row_idx").alias("n_tx"))


def chain_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = chains.peel_chains(base.cut_tx(spark, d)).groupBy("chain_head").agg(F.max("chain_length").alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_chains"), X.rounded(F.avg("n"), 4).alias("mean_length"), F.min("n").alias("shortest"), F.max("n").alias("longest"))


def holdout(spark: SparkSession, d: str) -> DataFrame:
    """A split by position: 60 % to learn from, 20 % to tune, 20 % to test."""
    t = base.tx(spark, d).select("row_idx", F.lit(0).alias("g"))
    n = t.agg(F.count(F.lit(1))).scalar()
    at = order.numbered(t, "g", "row_idx").select("row_idx", (F.col("row_no") / n).alias("at"))
    return at.select("row_idx", F.when(F.col("at") < 0.6, "train").when(F.col("at") < 0.8, "tune").otherwise("test").alias("part"))


QUERIES = {
    f.__name__: f
    for f in (
        pipe_parse, strict_totals, reject_reasons, ingestion_report, fan_stats, peel_disparity, fee_urgency, mixer_buckets, change_address, first_observation, correlate_layers, layer_match_stats, freq_encode, port_risk, port_frequencies,
        minmax_zscore, structural_type, whitelist_side, watchlist_hit, taint_hops, taint_pagerank, taint_converged, entity_components, entity_confidence, peel_chains, trace_forward, trace_backward, traceable_leads, rules_only, light_features,
        explain_text, telemetry_rows, telemetry_json, feature_profile, trace_both, trace_advice, first_traceable, ledger_by_time, regulated_view, fused_ledger, split_folds, type_mix, observation_overlap, full_features, evidence_package, evidence_file, evidence_funnel, whitelist_coverage, chain_sizes, holdout,
    )
}

_ports = lambda ports: ", ".join(map(str, ports))
CHANGE = f"""
seen AS (SELECT a, min(row_idx) AS first_row FROM (SELECT row_idx, unnest(list_concat(ins, outs)) AS a FROM tx) GROUP BY 1),
co0 AS (SELECT row_idx, ins, script_type, least(len(outs), len(out_amts)) AS k, outs[1:least(len(outs), len(out_amts))] AS o, out_amts[1:least(len(outs), len(out_amts))] AS v FROM tx WHERE least(len(outs), len(out_amts)) >= 2),
co1 AS (SELECT row_idx, k, v AS vs, unnest(o) AS a, unnest(v) AS v, unnest(range(k)) AS pos,
  list_concat(list_filter(list_distinct(list_transform(ins, lambda x: CASE WHEN lower(x) LIKE 'bc1q%' THEN 'P2WPKH' WHEN lower(x) LIKE 'bc1p%' THEN 'P2TR' WHEN x LIKE '1%' THEN 'P2PKH' WHEN x LIKE '3%' THEN 'P2SH' ELSE 'UNKNOWN' END)), lambda x: x <> 'UNKNOWN'),
    CASE WHEN script_type IS NOT NULL AND trim(script_type) NOT IN ('', 'nan') THEN [trim(script_type)] ELSE [] END) AS scripts FROM co0),
co2 AS (SELECT *, length(rtrim(split_part(printf('%.8f', v), '.', 2), '0')) AS d, CASE WHEN lower(a) LIKE 'bc1q%' THEN 'P2WPKH' WHEN lower(a) LIKE 'bc1p%' THEN 'P2TR' WHEN a LIKE '1%' THEN 'P2PKH' WHEN a LIKE '3%' THEN 'P2SH' ELSE 'UNKNOWN' END AS s FROM co1),
co3 AS (SELECT *, max(d) OVER (PARTITION BY row_idx) AS most, min(d) OVER (PARTITION BY row_idx) AS least_d FROM co2),
co4 AS (SELECT row_idx, a, d, pos, (CASE WHEN s <> 'UNKNOWN' AND len(scripts) > 0 THEN CASE WHEN list_contains(scripts, s) THEN 3 ELSE -1 END ELSE 0 END + CASE WHEN d > 3 AND least_d <= 3 THEN 2 ELSE 0 END + CASE WHEN d = most AND d > 3 THEN 1 ELSE 0 END
  + CASE WHEN first_row >= row_idx THEN 1 ELSE 0 END + CASE WHEN k = 2 AND vs[2 - pos] > 0 AND v / vs[2 - pos] > 10 THEN 1 ELSE 0 END)::INT AS score FROM co3 JOIN seen USING (a)),
change AS (SELECT row_idx, a AS change_address, score AS change_score FROM co4 WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, d DESC, pos) = 1
  AND score = max(score) OVER (PARTITION BY row_idx))"""
SEEN = """
obs AS (SELECT * FROM telemetry WHERE txid IS NOT NULL),
firsts AS (SELECT txid, src_ip AS first_ip, src_port AS first_port, ts AS first_ts FROM obs QUALIFY row_number() OVER (PARTITION BY txid ORDER BY ts NULLS LAST, src_ip NULLS LAST, obs_id) = 1),
counts AS (SELECT txid, count(src_ip) AS n_obs, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 * 100 + 0.5) / 100 AS spread FROM obs GROUP BY 1)"""
ENTITIES = f"""{MIX},{CHANGE},
en AS (SELECT row_idx, ins, mixer, CASE WHEN NOT mixer THEN change_address END AS chg FROM tx JOIN mix USING (row_idx) LEFT JOIN change USING (row_idx)),
vert AS (SELECT v, min(row_idx * 1000000 + pos) AS first_key FROM (SELECT row_idx, unnest(list_filter(list_append(ins, chg), lambda x: x IS NOT NULL)) AS v, unnest(range(len(list_filter(list_append(ins, chg), lambda x: x IS NOT NULL)))) AS pos FROM en) GROUP BY 1),
ids AS (SELECT v, first_key, row_number() OVER (ORDER BY first_key) AS i FROM vert),
pairs AS (SELECT DISTINCT ins[1] AS a, b FROM (SELECT ins, unnest(list_filter(list_append(ins[2:], chg), lambda x: x IS NOT NULL)) AS b FROM en WHERE NOT mixer) WHERE ins[1] <> b),
ways AS (SELECT p.i AS s, q.i AS t FROM pairs JOIN ids p ON a = p.v JOIN ids q ON b = q.v UNION SELECT q.i, p.i FROM pairs JOIN ids p ON a = p.v JOIN ids q ON b = q.v),
reach AS (SELECT i, i AS g FROM ids UNION SELECT t, g FROM reach JOIN ways ON i = s WHERE g < t),
root AS (SELECT i, min(g) AS g FROM reach GROUP BY 1),
comp AS (SELECT v, g, count(*) OVER (PARTITION BY g) AS size, dense_rank() OVER (ORDER BY g) - 1 AS no FROM root JOIN ids USING (i))"""
NODES = "touch AS (SELECT DISTINCT row_idx, unnest(list_concat(list_transform(list_concat(ins, outs), lambda x: 'addr:' || lower(x)), CASE WHEN trim(src_ip) <> '' THEN ['ip:' || trim(src_ip)] ELSE [] END)) AS node FROM tx)"
SEEDED = "sd AS (SELECT CASE WHEN type = 'address' THEN 'addr:' ELSE 'ip:' END || indicator AS node, min(label) AS label, max(severity) AS severity FROM watch GROUP BY 1)"
RANKS = "".join(
    f""",
sent{k} AS (SELECT t AS s, sum(x) AS x FROM (SELECT t, rk / deg AS x FROM ways2 JOIN rank{k - 1} USING (s)) GROUP BY 1),
rank{k} AS (SELECT s, deg, p, 0.85::DOUBLE * coalesce(x, 0) + 0.15::DOUBLE * p AS rk FROM rank{k - 1} LEFT JOIN sent{k} USING (s))"""
    for k in (1, 2, 3)
)


def _trace_sql(backward: bool, extra: str = "") -> str:
    made, spent, later = ("ins", "outs", "<") if backward else ("outs", "ins", ">")
    up = "" if not backward else "-"
    minutes = "abs(" if backward else "("
    return f"""{with_(TX, KINDS)},
    stepx AS (SELECT DISTINCT m.row_idx AS a, s.row_idx AS b FROM (SELECT row_idx, ts, unnest({made}) AS addr FROM tx) m JOIN (SELECT row_idx, ts, unnest({spent}) AS addr FROM tx) s USING (addr) WHERE s.ts {later} m.ts),
    seeds AS (SELECT row_idx AS seed FROM tx ORDER BY total_in DESC, row_idx LIMIT {SEEDS}),
    bfs AS (SELECT seed, seed AS row, 0 AS hop FROM seeds UNION SELECT seed, b, hop + 1 FROM bfs JOIN typed ON typed.row_idx = bfs.row JOIN stepx ON a = bfs.row WHERE hop < {HOPS} AND (hop = 0 OR (kind <> 'CoinJoin_Mixer' AND whitelisted_side IS NULL))),
    lev AS (SELECT seed, row, min(hop) AS hop FROM bfs GROUP BY 1, 2),
    par AS (SELECT c.seed, c.row, min(p.row) AS parent FROM lev c JOIN lev p ON p.seed = c.seed AND p.hop = c.hop - 1 JOIN stepx ON a = p.row AND b = c.row JOIN typed ON typed.row_idx = p.row WHERE p.hop = 0 OR (kind <> 'CoinJoin_Mixer' AND whitelisted_side IS NULL) GROUP BY 1, 2),
    full_ AS (SELECT l.seed, l.row, parent, l.hop, t.*, (epoch_us(t.ts) - epoch_us(pt.ts)) / 6e7 AS minutes, CASE WHEN st.total_in > 0 THEN st.total_in WHEN t.total_in > 0 THEN t.total_in ELSE 1.0 END AS initial, coalesce({r('list_max(t.out_amts)', 8)}, 0) AS largest
      FROM lev l LEFT JOIN par USING (seed, row) JOIN typed t ON t.row_idx = l.row JOIN tx st ON st.row_idx = l.seed LEFT JOIN tx pt ON pt.row_idx = parent QUALIFY row_number() OVER (PARTITION BY l.seed ORDER BY l.hop, t.total_in DESC, l.row) <= 200)
    SELECT seed, row, parent, {up}hop AS hop, {r(f'greatest(0, {minutes}coalesce(minutes, 0)))', 1)} AS delta_t_minutes, {r('total_in', 8)} AS btc_in, largest AS largest_output_btc, {r('least(100.0::DOUBLE, greatest(0.0::DOUBLE, largest / initial * 100))', 4)} AS retained_pct,
      greatest(0, {r(r('total_in', 8) + ' - largest - fee', 8)}) AS peeled_btc, CASE WHEN hop = 0 THEN 'Source' WHEN kind = 'CoinJoin_Mixer' THEN 'Mixer' WHEN whitelisted_side IS NOT NULL THEN 'Exchange endpoint' WHEN fan_out >= 5 THEN 'Dispersal' WHEN fan_in >= 5 THEN 'Consolidation' WHEN kind = 'Peel_Chain' THEN 'Layering (peel)' ELSE 'Intermediary' END AS role{extra} FROM full_"""


PORTS = f"""
pf AS (SELECT port, count(*) / sum(count(*)) OVER ()::DOUBLE AS freq FROM (SELECT src_port AS port FROM tx UNION ALL SELECT dst_port FROM tx) GROUP BY 1),
pr AS (SELECT port, CASE WHEN port IN ({_ports(K.ZERO_RISK_PORTS)}) THEN 0.0 WHEN port IN ({_ports(K.ANON_PORTS)}) THEN 1.0 ELSE {r('least(1.0 - freq, 0.8)', 4)} END AS risk FROM pf)"""
ANON = _ports(K.FUSION_ANON_PORTS)
ALL_FEATURES = "script_type_freq src_ip_freq amount_btc_scaled fee_scaled is_micro_tx src_port_risk dst_port_risk port_risk_combined peel_chain_disparity fan_in fan_out fan_ratio fee_rate_urgency value_zscore value_zscore_abs peel_chain_length peel_chain_hop_position fund_diminishment_ratio entity_ip_diversity ip_entity_diversity entity_tx_freq ip_observation_count observation_spread_s".split()
_SHARE = lambda x: f"coalesce(CASE WHEN {x} IS NOT NULL THEN count({x}) OVER (PARTITION BY {x}) / count({x}) OVER ()::DOUBLE END, 0)"
FEATS = f"""
fs AS (SELECT min(total_in) AS lo, max(total_in) AS hi, avg(total_in) AS m, stddev_samp(total_in) AS sd, min(fee) AS flo, max(fee) AS fhi FROM tx),
fa AS (SELECT row_idx, txid, src_ip, ins[1] AS first_in, {_SHARE('script_type')} AS script_type_freq, {_SHARE('src_ip')} AS src_ip_freq, coalesce((total_in - lo) / nullif(hi - lo, 0), 0) AS amount_btc_scaled, coalesce((fee - flo) / nullif(fhi - flo, 0), 0) AS fee_scaled,
  (total_in < 0.006)::INT::DOUBLE AS is_micro_tx, a.risk::DOUBLE AS src_port_risk, b.risk::DOUBLE AS dst_port_risk, {r('0.6 * a.risk::DOUBLE + 0.4 * b.risk::DOUBLE', 4)} AS port_risk_combined,
  CASE WHEN len(out_amts) = 2 AND total_out > 0 AND list_min(out_amts) / total_out < 0.01 AND list_max(out_amts) / total_out > 0.99 THEN {r('list_max(out_amts) / total_out - list_min(out_amts) / total_out', 6)} ELSE 0.0 END AS peel_chain_disparity,
  fan_in::DOUBLE AS fan_in, fan_out::DOUBLE AS fan_out, CASE WHEN fan_out > 0 THEN {r('fan_in / fan_out::DOUBLE', 4)} ELSE 0 END AS fan_ratio, CASE WHEN total_in > 0 AND fee > 0 THEN {r('fee / total_in', 8)} ELSE 0.0 END AS fee_rate_urgency, coalesce({r('(total_in - m) / nullif(sd, 0)', 4)}, 0) AS value_zscore
  FROM tx JOIN pr a ON a.port = src_port JOIN pr b ON b.port = dst_port, fs),
fb AS (SELECT fa.*, abs(value_zscore) AS value_zscore_abs, coalesce('Entity_' || no, 'UnknownEntity') AS entity_id FROM fa LEFT JOIN comp ON v = first_in),
fe AS (SELECT entity_id, count(DISTINCT src_ip)::DOUBLE AS entity_ip_diversity, count(*) / (SELECT count(*) FROM fb)::DOUBLE AS entity_tx_freq FROM fb GROUP BY 1),
fi AS (SELECT src_ip, count(DISTINCT entity_id)::DOUBLE AS ip_entity_diversity FROM fb WHERE src_ip IS NOT NULL GROUP BY 1),
feats AS (SELECT fb.*, coalesce(chain_length, 0)::DOUBLE AS peel_chain_length, coalesce(hop_position, 0)::DOUBLE AS peel_chain_hop_position, coalesce(fund_ratio, 0) AS fund_diminishment_ratio, entity_ip_diversity, entity_tx_freq, coalesce(ip_entity_diversity, 0) AS ip_entity_diversity,
  coalesce(n_obs, 1)::DOUBLE AS ip_observation_count, coalesce(spread, 0) AS observation_spread_s FROM fb JOIN fe USING (entity_id) LEFT JOIN fi ON fi.src_ip = fb.src_ip LEFT JOIN chain USING (row_idx) LEFT JOIN counts USING (txid))"""
LONG = " UNION ALL ".join(f"SELECT row_idx, '{f}' AS m, {f}::DOUBLE AS v FROM feats WHERE isfinite({f}::DOUBLE)" for f in explain.FEATURES)


def _written(x: str, form: str) -> str:
    return f"{x}::BIGINT::VARCHAR" if form == "%d" else f"printf('{form}', {r(x, int(form[2]))})"


def _case(of) -> str:
    return "CASE " + " ".join(f"WHEN m = '{f}' THEN {of(*x)}" for f, x in explain.FEATURES.items()) + " END"


def _means(text: str) -> str:
    a, _, b = text.partition("%d")
    return f"'{a}' || v::BIGINT || '{b}'" if b else f"'{a}'"


TELEMETRY = f"""{with_(TX, PORTS, SEEN, ENTITIES, CHAINS, FEATS)}, l AS ({LONG}), q AS (SELECT m, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.95) AS p95 FROM l GROUP BY 1),
    k AS (SELECT row_idx, m, v, floor(count(*) OVER (PARTITION BY m ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY m)::DOUBLE * 1000 + 0.5) / 10 AS rank FROM l),
    n AS (SELECT * FROM k JOIN q USING (m) WHERE CASE WHEN m = 'fan_ratio' THEN rank <= 25 AND v < med ELSE rank >= 75 AND v > med END OR m IN ('peel_chain_disparity', 'observation_spread_s') AND v > 0 AND v > med OR m = 'peel_chain_length' AND v >= 2 OR m = 'ip_observation_count' AND v >= 2 AND v > med)
    SELECT row_idx, m AS feature_name, {_case(lambda label, *_: f"'{label}'")} AS label, {r('v', 6)} AS observed_value, {r('med', 6)} AS dataset_median, {r('p95', 6)} AS dataset_p95, rank AS percentile_rank, {_case(lambda label, side, tag, *_: f"'{tag}'")} AS heuristic_flag,
      {_case(lambda label, side, tag, form, means: f"'{label} of ' || {_written('v', form)} || ' is in the ' || printf('%.1f', rank) || 'th percentile (dataset median: ' || {_written('med', form)} || ')' || {_means(means)}")} AS audit_reason FROM n"""
ORACLE = {
    "chain_sizes": f"{with_(TX, CHAINS)} SELECT count(*) AS n_chains, {r('avg(chain_length)', 4)} AS mean_length, min(chain_length) AS shortest, max(chain_length) AS longest FROM (SELECT chain_head, max(chain_length) AS chain_length FROM chain GROUP BY 1)",
    "holdout": f"{with_(TX)}, n AS (SELECT row_idx, (row_number() OVER (ORDER BY row_idx) - 1) / count(*) OVER ()::DOUBLE AS pos FROM tx) SELECT row_idx, CASE WHEN pos < 0.6 THEN 'train' WHEN pos < 0.8 THEN 'tune' ELSE 'test' END AS part FROM n",
    "pipe_parse": f"{with_(TX)} SELECT row_idx, len(ins)::INT AS n_in, len(outs)::INT AS n_out, len(in_amts)::INT AS n_in_amounts, len(out_amts)::INT AS n_out_amounts, {r('total_in', 6)} AS total_in, {r('total_out', 6)} AS total_out FROM tx",
    "strict_totals": f"WITH l AS (SELECT row_idx, {base._pipe('output_amounts')} AS l, {base._pipe('output_addresses')} AS o FROM tx_ledger) SELECT row_idx, {r('CASE WHEN len(list_filter(l, lambda x: try_cast(x AS DOUBLE) IS NULL)) = 0 THEN coalesce(list_sum(list_transform(l, lambda x: try_cast(x AS DOUBLE))), 0) ELSE 0 END', 6)} AS total_out, len(o)::INT AS n_out FROM l",
    "reject_reasons": f"{with_(JUDGED)} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM judged GROUP BY 1",
    "ingestion_report": f"{with_(JUDGED)} SELECT 'tx_ledger' AS source, count(*) AS rows_read, count(*) FILTER (reason IS NULL) AS rows_valid, count(reason) AS rows_rejected, min(ts) FILTER (reason IS NULL) AS first_ts, max(ts) FILTER (reason IS NULL) AS last_ts, "
    + ", ".join(f"count(*) FILTER (reason = '{x}') AS {x}" for x in ("missing_txid", "duplicate_txid", "unparseable_timestamp", "empty_addresses", "negative_or_non_numeric_amount"))
    + " FROM judged",
    "fan_stats": f"{with_(TX)} SELECT row_idx, fan_in::INT AS fan_in, fan_out::INT AS fan_out, CASE WHEN fan_out > 0 THEN {r('fan_in / fan_out::DOUBLE', 4)} ELSE 0 END AS fan_ratio FROM tx",
    "peel_disparity": f"{with_(TX)} SELECT row_idx, CASE WHEN len(out_amts) = 2 AND total_out > 0 AND list_min(out_amts) / total_out < 0.01 AND list_max(out_amts) / total_out > 0.99 THEN {r('list_max(out_amts) / total_out - list_min(out_amts) / total_out', 6)} ELSE 0.0 END AS disparity FROM tx",
    "fee_urgency": f"{with_(TX)} SELECT row_idx, CASE WHEN total_in > 0 AND fee > 0 THEN {r('fee / total_in', 8)} ELSE 0.0 END AS fee_rate_urgency, (total_in < 0.006)::INT AS is_micro_tx FROM tx",
    "mixer_buckets": f"{with_(TX, MIX)} SELECT row_idx, participants::INT AS participants, {r('ratio', 4)} AS dominant_ratio, mixer AS is_mixer FROM mix",
    "change_address": f"{with_(TX, CHANGE)} SELECT * FROM change",
    "first_observation": f"{with_(SEEN)} SELECT txid, first_ip, first_port, first_ts, n_obs AS ip_observation_count, spread AS observation_spread_s FROM firsts JOIN counts USING (txid)",
    "correlate_layers": f"{with_(TX, SEEN)} SELECT row_idx, tx.txid, coalesce(first_ip, '') AS src_ip, coalesce(first_port, 8333) AS src_port, coalesce(n_obs, 0) AS ip_observation_count, coalesce(spread, 0.0) AS observation_spread_s FROM tx LEFT JOIN firsts USING (txid) LEFT JOIN counts USING (txid)",
    "layer_match_stats": f"{with_(TX)}, j AS (SELECT count(*) FILTER (a.txid IS NOT NULL AND b.txid IS NOT NULL) AS matched, count(*) FILTER (a.txid IS NULL) AS telemetry_only, count(*) FILTER (b.txid IS NULL) AS chain_only, count(*) AS n FROM (SELECT DISTINCT txid FROM tx) a FULL JOIN (SELECT DISTINCT txid FROM telemetry WHERE txid IS NOT NULL) b ON a.txid = b.txid) SELECT matched, telemetry_only, chain_only, {r('matched / n::DOUBLE', 4)} AS match_rate FROM j",
    "freq_encode": f"{with_(TX)} SELECT row_idx, {r('coalesce(CASE WHEN script_type IS NOT NULL THEN count(script_type) OVER (PARTITION BY script_type) / count(script_type) OVER ()::DOUBLE END, 0)', 6)} AS script_type_freq, {r('coalesce(CASE WHEN src_ip IS NOT NULL THEN count(src_ip) OVER (PARTITION BY src_ip) / count(src_ip) OVER ()::DOUBLE END, 0)', 6)} AS src_ip_freq FROM tx",
    "port_frequencies": f"{with_(TX, PORTS)} SELECT port, {r('freq', 6)} AS freq FROM pf",
    "port_risk": f"{with_(TX, PORTS)} SELECT row_idx, a.risk::DOUBLE AS src_port_risk, b.risk::DOUBLE AS dst_port_risk, {r('0.6 * a.risk::DOUBLE + 0.4 * b.risk::DOUBLE', 4)} AS port_risk_combined FROM tx JOIN pr a ON a.port = src_port JOIN pr b ON b.port = dst_port",
    "minmax_zscore": f"{with_(TX)}, s AS (SELECT min(total_in) AS lo, max(total_in) AS hi, avg(total_in) AS m, stddev_samp(total_in) AS sd, min(fee) AS flo, max(fee) AS fhi FROM tx) SELECT row_idx, {r('(total_in - lo) / (hi - lo)', 6)} AS amount_btc_scaled, {r('(fee - flo) / (fhi - flo)', 6)} AS fee_scaled, {r(r('(total_in - m) / sd', 4), 3)} AS value_zscore FROM tx, s",
    "structural_type": f"{with_(TX, KINDS)} SELECT row_idx, structural, kind FROM typed",
    "whitelist_side": f"{with_(TX, WHITELIST)} SELECT * FROM side",
    "watchlist_hit": f"""{with_(TX, WATCHLIST)}, h AS (SELECT row_idx, 1 AS pri, pos, indicator, label FROM (SELECT row_idx, unnest(ins) AS a, unnest(range(len(ins))) AS pos FROM tx) JOIN watch ON type = 'address' AND lower(a) = indicator
        UNION ALL SELECT row_idx, 2, pos, indicator, label FROM (SELECT row_idx, unnest(outs) AS a, unnest(range(len(outs))) AS pos FROM tx) JOIN watch ON type = 'address' AND lower(a) = indicator UNION ALL SELECT row_idx, 3, 0, indicator, label FROM tx JOIN watch ON type = 'ip' AND trim(src_ip) = indicator)
        SELECT row_idx, indicator AS watchlist_indicator, label AS watchlist_label FROM h QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY pri, pos) = 1""",
    "taint_hops": f"""{with_(TX, WATCHLIST)}, {NODES}, {SEEDED}, near AS (SELECT row_idx, min(label) AS label FROM touch JOIN sd USING (node) GROUP BY 1), shared AS (SELECT node, min(label) AS label FROM touch JOIN near USING (row_idx) GROUP BY 1), far AS (SELECT row_idx, min(label) AS far FROM touch JOIN shared USING (node) GROUP BY 1)
        SELECT row_idx, CASE WHEN label IS NOT NULL THEN 1 ELSE 3 END AS taint_hops, coalesce(label, far) AS taint_nearest_label FROM far LEFT JOIN near USING (row_idx)""",
    "taint_pagerank": f"""{with_(TX, WATCHLIST)}, {NODES}, {SEEDED}, ways2 AS (SELECT 'tx:' || row_idx AS s, node AS t FROM touch UNION ALL SELECT node, 'tx:' || row_idx FROM touch), dg AS (SELECT s, count(*) AS deg FROM ways2 GROUP BY 1), live AS (SELECT node AS s, severity FROM sd WHERE node IN (SELECT s FROM dg)),
        rank0 AS (SELECT s, deg, coalesce(severity, 0) / (SELECT sum(severity) FROM live) AS p, 1.0::DOUBLE / (SELECT count(*) FROM dg) AS rk FROM dg LEFT JOIN live USING (s)){RANKS},
        own AS (SELECT row_idx, greatest(max(a.rk), max(b.rk)) AS rk FROM touch JOIN rank3 a ON a.s = node JOIN rank3 b ON b.s = 'tx:' || row_idx GROUP BY 1), e AS (SELECT min(rk) AS lo, max(rk) AS hi FROM own)
        SELECT row_idx, {r(r('(rk - lo) / (hi - lo) * 100', 4), 3)} AS taint_score FROM own, e""",
    "entity_components": f"{with_(TX, ENTITIES)} SELECT v AS address, 'Entity_' || no AS entity_id, size FROM comp",
    "entity_confidence": f"""{with_(TX, ENTITIES)}, mx AS (SELECT DISTINCT unnest(list_concat(ins, outs)) AS v FROM tx JOIN mix USING (row_idx) WHERE mixer), fi AS (SELECT ins[1] AS v, count(*) AS txs FROM tx GROUP BY 1),
        t AS (SELECT g, max(size) AS size, CASE WHEN count(mx.v) > 0 THEN 'Mixer-Affected' WHEN sum(txs) > 3 THEN 'High-Confidence' ELSE 'Heuristic/Inferred' END AS confidence FROM comp LEFT JOIN mx USING (v) LEFT JOIN fi USING (v) GROUP BY 1) SELECT confidence, count(*) AS n_entities, sum(size)::BIGINT AS n_addresses, max(size) AS largest FROM t GROUP BY 1""",
    "peel_chains": f"{with_(TX, CHAINS)} SELECT row_idx, chain_head, chain_length, hop_position, fund_ratio FROM chain",
    "trace_forward": _trace_sql(False),
    "trace_backward": _trace_sql(True),
    "traceable_leads": f"{with_(TX)} SELECT DISTINCT m.row_idx FROM (SELECT row_idx, ts, unnest(outs) AS addr FROM tx) m JOIN (SELECT ts AS bts, unnest(ins) AS addr FROM tx) s USING (addr) WHERE bts > ts",
    "rules_only": f"{with_(TX, MIX)} SELECT row_idx, (src_port IN ({ANON}) OR coalesce(fee / nullif(total_in, 0), 0) > 0.1 OR fan_out > 20 OR (len(out_amts) >= 10 AND ratio >= 0.5))::INT AS flag FROM tx JOIN mix USING (row_idx)",
    "light_features": f"{with_(TX, MIX)} SELECT row_idx, tx.fan_in::INT AS fan_in, tx.fan_out::INT AS fan_out, {r('total_in', 6)} AS total_in, CASE WHEN total_in > 0 AND fee > 0 THEN {r('fee / total_in', 8)} ELSE 0 END AS fee_rate, {r('ratio', 4)} AS equal_ratio, floor(coalesce(list_stddev_pop(out_amts) / nullif(list_avg(out_amts), 0), 0) * 1e4 + 0.50003) / 1e4 AS amount_cv FROM tx JOIN mix USING (row_idx)",
    "explain_text": f"""{with_(TX, KINDS)}, s AS (SELECT row_idx, list_filter([
        CASE WHEN src_port IN ({_ports(K.TOR_PORTS)}) THEN 'Routed through known Tor SOCKS port (src_port=' || src_port || ')' WHEN src_port IN ({_ports(K.PROXY_PORTS)}) THEN 'Routed through known proxy port (src_port=' || src_port || ')' WHEN src_port IN ({_ports(K.I2P_PORTS)}) THEN 'Routed through known I2P tunnel port (src_port=' || src_port || ')' END,
        CASE WHEN dst_port IN ({_ports(K.TOR_PORTS)}) THEN 'Destination is a known Tor control/SOCKS port (dst_port=' || dst_port || ')' WHEN dst_port IN ({_ports(K.I2P_PORTS)}) THEN 'Destination is a known I2P eepsite port (dst_port=' || dst_port || ')' END,
        CASE WHEN structural = 'CoinJoin_Mixer' THEN 'Matches deterministic equal-denomination CoinJoin signature' END,
        CASE WHEN structural = 'Fee_Spike' THEN CASE WHEN total_in > 0 THEN 'Abnormal fee-to-value ratio: ' || printf('%.8f', fee) || ' BTC fee on ' || printf('%.4f', total_in) || ' BTC transfer' ELSE 'Fee spike detected: ' || printf('%.8f', fee) || ' BTC on zero/micro transfer' END END,
        CASE WHEN structural = 'Peel_Chain' THEN 'Peel-chain output structure: one large and one small output' END, CASE WHEN total_in < 0.006 THEN 'Micro-transaction: possible dust-attack probe' END,
        CASE WHEN fan_out >= 5 THEN 'High fan-out of ' || fan_out || ' output addresses' END, CASE WHEN fan_in >= 5 THEN 'High fan-in of ' || fan_in || ' input addresses' END,
        CASE WHEN chain_length >= 2 THEN 'Multi-hop peel chain trajectory (' || chain_length || ' linked hops)' END], lambda x: x IS NOT NULL) AS s FROM typed)
        SELECT row_idx, CASE WHEN len(s) > 0 THEN array_to_string(s, '; ') ELSE 'No direct signal' END AS explanation FROM s""",
    "evidence_funnel": f"""{with_(TX, WHITELIST)}, sc AS (SELECT txid, arg_max({{'r': risk_score, 'a': is_anomaly}}, {{'r': risk_score, 'i': -score_id}}) AS b FROM scored_rows WHERE txid IS NOT NULL AND risk_score IS NOT NULL GROUP BY 1),
        a AS (SELECT tx.row_idx, tx.txid, b.r AS r, b.a AS a, whitelisted_side, row_number() OVER (ORDER BY b.r DESC, tx.row_idx) AS k FROM tx JOIN sc USING (txid) LEFT JOIN side USING (row_idx))
        SELECT count(*) AS total, count(*) FILTER (whitelisted_side = 'both') AS cleared, count(*) FILTER (a) AS flagged, count(*) FILTER (r >= 80) AS critical, count(*) FILTER (r >= 60 AND r < 80) AS high, max(txid) FILTER (k = 1) AS first_lead, max(txid) FILTER (k = 25) AS last_lead FROM a""",
    "telemetry_rows": TELEMETRY,
    "feature_profile": f"{with_(TX, PORTS, SEEN, ENTITIES, CHAINS, FEATS)}, l AS ({LONG}) SELECT m AS measure, {r('avg(v)', 6)} AS mean, {r('stddev_samp(v)', 6)} AS std, {r('min(v)', 6)} AS min, {r('max(v)', 6)} AS max, "
    + ", ".join(f"{r(f'quantile_cont(v, {q})', 6)} AS {n}" for n, q in (("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)))
    + " FROM l GROUP BY 1",
    "full_features": f"{with_(TX, PORTS, SEEN, ENTITIES, CHAINS, FEATS)} SELECT row_idx, entity_id, " + ", ".join(f"{r(f'{x}::DOUBLE', 5)} AS {x}" for x in ALL_FEATURES) + " FROM feats",
    "trace_both": f"SELECT * FROM ({_trace_sql(False)}) UNION ALL SELECT * FROM ({_trace_sql(True)}) WHERE hop < 0",
    "trace_advice": f"""SELECT seed, CASE WHEN count(*) FILTER (role = 'Exchange endpoint') > 0 THEN 'Funds reached ' || max_by(coalesce(whitelisted_entity, 'regulated exchange'), abs(hop) * 1000000000 + row) FILTER (role = 'Exchange endpoint') || '. Next step: lawful KYC request to this VASP.' ELSE 'Trail enters a mixer; further tracing has low confidence.' END AS advice
        FROM ({_trace_sql(False, ', whitelisted_entity')}) WHERE row <> seed GROUP BY 1 HAVING count(*) FILTER (role IN ('Exchange endpoint', 'Mixer')) > 0""",
    "first_traceable": f"{with_(TX)}, tr AS (SELECT DISTINCT m.row_idx FROM (SELECT row_idx, ts, unnest(outs) AS addr FROM tx) m JOIN (SELECT ts AS bts, unnest(ins) AS addr FROM tx) s USING (addr) WHERE bts > ts), fl AS (SELECT txid, max(risk_score) AS risk_score FROM scored_rows WHERE is_anomaly GROUP BY 1) SELECT row_idx, txid, risk_score FROM tx JOIN tr USING (row_idx) JOIN fl USING (txid) ORDER BY risk_score DESC, row_idx LIMIT 20",
    "ledger_by_time": f"{with_(TX)} SELECT row_idx, row_number() OVER (ORDER BY ts, row_idx) - 1 AS row_no FROM tx",
    "regulated_view": f"{with_(TX, WHITELIST)} SELECT row_idx, 'Whitelisted ' || whitelisted_side || ': ' || whitelisted_entity AS explanation FROM side WHERE contains(whitelisted_entity, 'Regulated')",
    "fused_ledger": f"""{with_(TX, WATCHLIST)}, h AS (SELECT DISTINCT row_idx FROM (SELECT row_idx, lower(unnest(list_concat(ins, outs))) AS a FROM tx) JOIN watch ON type = 'address' AND a = lower(indicator) UNION SELECT row_idx FROM tx JOIN watch ON type = 'ip' AND lower(trim(src_ip)) = lower(indicator)),
        e AS (SELECT min(port_risk_combined) AS lo, max(port_risk_combined) AS hi FROM scored_rows WHERE isfinite(port_risk_combined)),
        part AS (SELECT score_id, s.risk_score AS score_ml, CASE WHEN detected_type IN ('CoinJoin_Mixer', 'Peel_Chain') THEN 100.0 WHEN detected_type IN ('FanOut_Dispersal', 'Fee_Spike') THEN 70.0 ELSE 0.0 END::DOUBLE AS score_pattern,
          CASE WHEN tx.src_port IN ({_ports(K.FUSION_ANON_PORTS)}) OR tx.dst_port IN ({_ports(K.FUSION_ANON_PORTS)}) THEN 100.0::DOUBLE ELSE {r("coalesce((CASE WHEN isfinite(port_risk_combined) THEN port_risk_combined END - lo) / nullif(hi - lo, 0), 0) * 100", 1)} END AS score_network,
          CASE WHEN h.row_idx IS NOT NULL THEN 100.0 ELSE 0.0 END::DOUBLE AS score_graph, CASE WHEN detected_type = 'Whitelisted_Institutional' THEN 0.15 ELSE 1.0 END::DOUBLE AS whitelist_factor FROM scored_rows s LEFT JOIN tx ON tx.txid = s.txid LEFT JOIN h ON h.row_idx = tx.row_idx, e),
        p AS (SELECT *, {r('(0.5::DOUBLE * score_ml + 0.25::DOUBLE * score_pattern + 0.15::DOUBLE * score_network + 0.1::DOUBLE * score_graph) * whitelist_factor', 1)} AS priority FROM part)
        SELECT *, CASE WHEN priority >= 80 THEN 'Critical' WHEN priority >= 60 THEN 'High' WHEN priority >= 40 THEN 'Medium' ELSE 'Low' END AS tier FROM p""",
    "split_folds": f"{with_(TX)} SELECT row_idx, coalesce(script_type, '') AS y, ((row_number() OVER (PARTITION BY coalesce(script_type, '') ORDER BY (row_idx * 7919 + 104729) % 1000003, row_idx) - 1) % 5)::INT AS fold FROM tx",
    "type_mix": f"{with_(TX, KINDS)} SELECT kind, coalesce(whitelisted_side, 'none') AS side, count(*) AS n_tx, sum(floor(total_in * 1e8 + 0.5)::BIGINT)::BIGINT AS sats_in, max(chain_length) AS longest_chain FROM typed GROUP BY 1, 2",
    "observation_overlap": f"{with_(TX)} SELECT geo_country, dst_port, count(*) AS n_obs, count(DISTINCT txid) AS n_tx FROM telemetry WHERE txid IN (SELECT txid FROM tx) GROUP BY 1, 2",
    "whitelist_coverage": f"{with_(TX, WHITELIST)} SELECT label, side, count(DISTINCT row_idx) AS n_tx FROM (SELECT row_idx, 'input' AS side, unnest(ins) AS a FROM tx UNION ALL SELECT row_idx, 'output', unnest(outs) FROM tx) JOIN wl ON lower(a) = wl.address GROUP BY 1, 2",
}
