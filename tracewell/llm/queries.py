"""Queries of the problems for training data, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import components, digest, distinct, packing, residue, tokens
from tracewell.runtime import Scratch, read

MEASURES = ("amount_btc", "fee", "fan_in", "fan_out", "fee_rate_urgency", "port_risk_combined", "ip_observation_count", "observation_spread_s", "risk_score")
KINDS = {"detected_type": "detected_type", "entity_id": "entity_id", "day": None}
WIRE = ("geo_country", "asn", "dst_port")
CAPACITY = 2048
SCORES = ("detected_type", "run_no")


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.sketches(read(spark, sf_dir, "telemetry"), "ts", WIRE, {"src_ip": distinct.hashed("src_ip")})


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.sketches(read(spark, sf_dir, "scored_rows"), "ts", SCORES, {"src_ip": distinct.hashed("src_ip"), "entity_id": distinct.hashed("entity_id")})


def p2_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct source addresses per day and combination of groups, with bounds of three standard errors."""
    return distinct.merge(_wire(spark, sf_dir), ["id_name", "level", "day", *WIRE]).drop("sketch")


def p2_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.merge(_scores(spark, sf_dir), ["id_name", "level", "day", *SCORES]).drop("sketch")


def p2_all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all days, from the merged sketches of single days."""
    days = distinct.merge(_wire(spark, sf_dir), ["id_name", "level", "day", *WIRE])
    return distinct.union(days, ["id_name", "level", *WIRE]).drop("sketch")


def p2_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts whose sketches still list their hashes: exact ones."""
    return p2_telemetry(spark, sf_dir).where("low = high").drop("low", "high")


def p2_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by full sketches, of 2^8 registers here, so that most groups leave the list form: whether each lies within five standard errors of the exact number beside it."""
    size = distinct.Size(8)
    wire, keys = read(spark, sf_dir, "telemetry"), ["level", "day", *WIRE]
    found = distinct.merge(distinct.sketches(wire, "ts", WIRE, {"src_ip": distinct.hashed("src_ip")}, size), keys, size).where(F.octet_length("sketch") == size.m)
    ids = wire.select(F.to_date("ts").alias("day"), *[F.col(c).cast("string").alias(c) for c in WIRE], distinct.hashed("src_ip").alias("h")).where("h IS NOT NULL")
    exact = ids.cube(*WIRE, "day").agg(F.grouping("day").alias("gd"), *[F.grouping(c).alias(f"g_{c}") for c in WIRE], F.count_distinct("h").alias("n")).where("gd = 0")
    exact = exact.select(F.concat_ws(",", *[F.when(F.col(f"g_{c}") == 0, c) for c in WIRE]).alias("level"), "day", *WIRE, "n")
    same = [F.equal_null(found[k], exact[k]) for k in keys]
    near = F.abs(F.col("distinct_count") / F.col("n") - 1) <= 5 * size.error
    return found.join(exact, same).select(*[found[k] for k in keys], F.col("n").alias("exact_count"), near.alias("within"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(read(spark, sf_dir, "address_links"), "address_a", "address_b")


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, p95 and p99 per type, entity and day, each with its counted rank error."""
    rows = read(spark, sf_dir, "scored_rows")
    found = digest.estimates(digest.combined(digest.daily(rows, "ts", KINDS, MEASURES), MEASURES), MEASURES)
    done = digest.certified(rows, found, "ts", KINDS, MEASURES)
    named = [F.col("q")[j].alias(p) for j, p in enumerate(("median", "p95", "p99"))]
    return done.select("kind", "key", "measure", "n", "exact", *named, F.array_max("rank_error").alias("rank_error"))


def p6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles of groups whose digests hold every value, through the same digests of single days; six digits, rounded just off the half, where exact decimals lie."""
    rows = read(spark, sf_dir, "scored_rows")
    found = digest.estimates(digest.combined(digest.daily(rows, "ts", KINDS, MEASURES), MEASURES), MEASURES).where("exact")
    named = [F.floor(F.col("q")[j] * 1e6 + 0.50003) / 1e6 for j in range(3)]
    return found.where(F.col("n") <= digest.EXACT).select("kind", "key", "measure", "n", *[x.alias(p) for x, p in zip(named, ("median", "p95", "p99"))])


def p6_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups whose percentiles come from clustered digests: whether each rank error, counted over the rows, is within the bound."""
    done = p6_percentiles(spark, sf_dir).where(F.col("n") > digest.EXACT)
    return done.select("kind", "key", "measure", "n", (F.col("rank_error") <= digest.BOUND).alias("within"))


def p6_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles of single days per type: the digests that ``p6_percentiles`` combines."""
    rows = read(spark, sf_dir, "scored_rows")
    found = digest.estimates(digest.daily(rows, "ts", {"detected_type": "detected_type"}, MEASURES), MEASURES)
    return found.select("kind", "key", "day", "measure", "n", "exact", *[F.col("q")[j].alias(p) for j, p in enumerate(("median", "p95", "p99"))])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(read(spark, sf_dir, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids: the exact round trip."""
    return tokens.decoded(p7_ids(spark, sf_dir), "doc_id", "ids")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's (piece's) container of ``CAPACITY`` tokens."""
    return _filled(spark, sf_dir).select(F.col("item").cast("long").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), "container_id")


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(packing.pieces(tokens.counted(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY), CAPACITY)


def p8_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are and how many any packing needs."""
    return packing.certificate(_filled(spark, sf_dir), CAPACITY)


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that came out, those of more than one piece though they fit a container, and containers filled beyond their capacity."""
    done = Scratch(spark, "whole").cut(_filled(spark, sf_dir), "filled")
    texts = done.groupBy("item").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("size"))
    over = done.groupBy("container_id").agg(F.sum("size").alias("size")).agg(F.count_if(F.col("size") > CAPACITY).alias("n_over")).scalar()
    return texts.agg(F.count(F.lit(1)).alias("n_texts"), F.count_if((F.col("pieces") > 1) & (F.col("size") <= CAPACITY)).alias("n_cut_needlessly")).withColumn("n_overfull", over)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


def p9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mined templates that are residue, with their kinds and the number of documents that hold them."""
    return residue.templates(read(spark, sf_dir, "documents"), "doc_id", "text")


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residue's kinds, by source."""
    rows = read(spark, sf_dir, "documents")
    found = residue.residue(rows, "doc_id", "text").select("doc_id", F.explode("kinds").alias("kind"))
    return rows.select("doc_id", "source").join(found, "doc_id").groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {f.__name__: f for f in (p2_telemetry, p2_scored, p2_all_days, p2_listed, p2_registers, p5_found, p6_percentiles, p6_daily, p6_exact, p6_bounded, p7_ids, p7_decoded, p8_packed, p8_certificate, p8_whole, p9_found, p9_templates, p9_kinds)}

_CASES = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {key} AS key, '{m}' AS measure, {m}::DOUBLE AS v FROM scored_rows WHERE isfinite({m}::DOUBLE) AND {key} <> ''" for kind, key in (("detected_type", "trim(detected_type)"), ("entity_id", "trim(entity_id)"), ("day", "ts::DATE::VARCHAR")) for m in MEASURES)
ORACLE = {
    "p2_registers": f"""SELECT concat_ws(',', CASE WHEN grouping(geo_country) = 0 THEN 'geo_country' END, CASE WHEN grouping(asn) = 0 THEN 'asn' END, CASE WHEN grouping(dst_port) = 0 THEN 'dst_port' END) AS level, day, geo_country, asn, dst_port, count(DISTINCT ip) AS exact_count, true AS within
        FROM (SELECT ts::DATE AS day, geo_country, asn, dst_port::VARCHAR AS dst_port, trim(src_ip) AS ip FROM telemetry WHERE trim(src_ip) <> '') GROUP BY day, CUBE (geo_country, asn, dst_port) HAVING count(DISTINCT ip) >= {distinct.Size(8).listed}""",
    "p6_bounded": f"WITH c AS ({_CASES}) SELECT kind, key, measure, count(*) AS n, true AS within FROM c GROUP BY 1, 2, 3 HAVING count(*) > {digest.EXACT}",
    "p8_whole": "SELECT count(*) FILTER (text <> '') AS n_texts, 0::BIGINT AS n_cut_needlessly, 0::BIGINT AS n_overfull FROM documents",
    "p2_listed": f"""SELECT 'src_ip' AS id_name, concat_ws(',', CASE WHEN grouping(geo_country) = 0 THEN 'geo_country' END, CASE WHEN grouping(asn) = 0 THEN 'asn' END, CASE WHEN grouping(dst_port) = 0 THEN 'dst_port' END) AS level, day, geo_country, asn, dst_port, count(DISTINCT ip)::DOUBLE AS distinct_count
        FROM (SELECT ts::DATE AS day, geo_country, asn, dst_port::VARCHAR AS dst_port, trim(src_ip) AS ip FROM telemetry WHERE trim(src_ip) <> '') GROUP BY day, CUBE (geo_country, asn, dst_port) HAVING count(DISTINCT ip) < {distinct.SIZE.listed}""",
    "p6_exact": f"WITH c AS ({_CASES}) SELECT kind, key, measure, count(*) AS n, floor(quantile_cont(v, 0.5) * 1e6 + 0.50003) / 1e6 AS median, floor(quantile_cont(v, 0.95) * 1e6 + 0.50003) / 1e6 AS p95, floor(quantile_cont(v, 0.99) * 1e6 + 0.50003) / 1e6 AS p99 FROM c GROUP BY 1, 2, 3 HAVING count(*) <= {digest.EXACT}",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p5_found": r"""WITH RECURSIVE pairs AS (SELECT nullif(trim(address_a, E' \t\r\n'), '') AS a, nullif(trim(address_b, E' \t\r\n'), '') AS b FROM address_links),
        v AS (SELECT DISTINCT unnest([a, b]) AS x FROM pairs), ids AS (SELECT x, row_number() OVER (ORDER BY encode(x)) AS i FROM v WHERE x IS NOT NULL),
        e AS (SELECT DISTINCT p.i AS s, q.i AS t FROM pairs JOIN ids p ON a = p.x JOIN ids q ON b = q.x WHERE a <> b), ways AS (SELECT s, t FROM e UNION SELECT t, s FROM e),
        walk AS (SELECT i, i AS g FROM ids UNION SELECT t, g FROM walk JOIN ways ON i = s WHERE g < t), low AS (SELECT i, min(g) AS g FROM walk GROUP BY i)
        SELECT p.x AS address, q.x AS group_id FROM low JOIN ids p ON low.i = p.i JOIN ids q ON low.g = q.i""",
}
