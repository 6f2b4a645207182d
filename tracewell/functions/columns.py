"""Scalar functions as column expressions: all of them stay in the JVM, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as K

Col = str | Column


def c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Col, digits: int) -> Column:
    """Half up in binary arithmetic, so that other engines agree to the last bit."""
    return F.floor(c(x) * float(10**digits) + 0.5) / float(10**digits)


def pipe_strings(cell: Col) -> Column:
    """The values of a pipe list, trimmed, blanks dropped; a missing cell (null, empty, nan, None) has none."""
    raw = F.coalesce(c(cell), F.lit(""))
    return F.filter(F.transform(F.split(F.when(raw.isin("", "nan", "None"), "").otherwise(raw), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def numbers(items: Col) -> Column:
    """The items that are numbers, as doubles; others are skipped."""
    return F.filter(F.transform(c(items), lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def pipe_amounts(cell: Col) -> Column:
    return numbers(pipe_strings(cell))


def pipe_count(cell: Col) -> Column:
    return F.size(pipe_strings(cell))


def total(amounts: Col) -> Column:
    return F.aggregate(c(amounts), F.lit(0.0), lambda a, x: a + x)


def strict_total(cell: Col) -> Column:
    """The sum of a pipe list whose items are all numbers, else 0."""
    items = pipe_strings(cell)
    return F.when(F.forall(items, lambda x: x.try_cast("double").isNotNull()), total(numbers(items))).otherwise(0.0)


def has_addresses(items: Col) -> Column:
    return F.exists(c(items), lambda x: ~F.lower(x).isin("nan", "none", ""))


def valid_amounts(items: Col) -> Column:
    """At least one item, and all of them numbers of 0 or more."""
    return (F.size(c(items)) > 0) & F.forall(c(items), lambda x: F.coalesce((x.try_cast("double") >= 0) & ~F.isnan(x.try_cast("double")), F.lit(False)))


def fan_ratio(fan_in: Col, fan_out: Col) -> Column:
    return F.when(c(fan_out) > 0, rounded(c(fan_in) / c(fan_out), 4)).otherwise(0.0)


def peel_disparity(amounts: Col) -> Column:
    """Difference of the two outputs' shares if one is below 1 % and the other above 99 %, else 0."""
    high, low, all_ = F.array_max(c(amounts)), F.array_min(c(amounts)), total(amounts)
    return F.when((F.size(c(amounts)) == 2) & (all_ > 0) & (low / all_ < 0.01) & (high / all_ > 0.99), rounded(high / all_ - low / all_, 6)).otherwise(0.0)


def disparity(amounts: Col) -> Column:
    """Difference of the two outputs' shares; null unless there are two and their sum is positive."""
    return F.when((F.size(c(amounts)) == 2) & (total(amounts) > 0), (F.array_max(c(amounts)) - F.array_min(c(amounts))) / total(amounts))


def fee_urgency(fee: Col, total_in: Col) -> Column:
    return F.when((c(total_in) > 0) & (c(fee) > 0), rounded(c(fee) / c(total_in), 8)).otherwise(0.0)


def dominant_count(amounts: Col, tolerance: float = K.MIXER_TOLERANCE) -> Column:
    """Size of the largest bucket of equal amounts: sorted amounts join the last bucket if they are within the tolerance of its first."""
    start = F.struct(F.lit(None).cast("double").alias("rep"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        near = F.coalesce(F.abs(x - a["rep"]) / F.greatest(F.abs(a["rep"]), F.abs(x), F.lit(1e-12)) <= tolerance, F.lit(False))
        n = F.when(near, a["n"] + 1).otherwise(1)
        return F.struct(F.when(near, a["rep"]).otherwise(x).alias("rep"), n.alias("n"), F.greatest(a["best"], n).alias("best"))

    return F.aggregate(F.array_sort(c(amounts)), start, step, lambda a: a["best"])


def dominant_ratio(amounts: Col) -> Column:
    return F.when(F.size(c(amounts)) > 0, dominant_count(amounts) / F.size(c(amounts))).otherwise(0.0)


def is_mixer(fan_in: Col, fan_out: Col, amounts: Col, participants: int = K.MIXER_PARTICIPANTS) -> Column:
    return (F.greatest(c(fan_in), c(fan_out)) >= participants) & (dominant_ratio(amounts) >= K.MIXER_RATIO)


def script_of(address: Col) -> Column:
    a = F.lower(c(address))
    return F.when(a.startswith("bc1q"), "P2WPKH").when(a.startswith("bc1p"), "P2TR").when(a.startswith("1"), "P2PKH").when(a.startswith("3"), "P2SH").otherwise("UNKNOWN")


def decimals(amount: Col) -> Column:
    """Significant decimals of an amount written with eight."""
    return F.length(F.rtrim(F.split_part(F.format_string("%.8f", c(amount)), F.lit("."), F.lit(2)), F.lit("0")))


def port_risk(port: Col, frequency: Col) -> Column:
    p = c(port)
    return F.when(p.isNull(), 0.1).when(p.isin(*K.ZERO_RISK_PORTS), 0.0).when(p.isin(*K.ANON_PORTS), 1.0).otherwise(rounded(F.least(1.0 - F.coalesce(c(frequency), F.lit(0.0)), F.lit(0.8)), 4))


def structural_type(mixer: Col, chain_length: Col, fan_in: Col, fan_out: Col, urgency: Col) -> Column:
    return (
        F.when(c(mixer), "CoinJoin_Mixer")
        .when(c(chain_length) >= K.MIN_CHAIN, "Peel_Chain")
        .when((c(fan_out) >= K.FANOUT_OUTPUTS) & (c(fan_in) <= K.FANOUT_INPUTS), "FanOut_Dispersal")
        .when(c(urgency) >= K.FEE_URGENCY, "Fee_Spike")
        .otherwise("Normal_P2P")
    )


def final_type(kind: Col, side: Col) -> Column:
    """A whitelisted side overrides the type unless that is a mixer or a peel chain."""
    return F.when(c(side).isNotNull() & c(kind).isin("Normal_P2P", "FanOut_Dispersal", "Fee_Spike"), "Whitelisted_Institutional").otherwise(c(kind))


def tier(score: Col) -> Column:
    out = None
    for name, least in K.TIERS:
        out = F.when(c(score) >= least, name) if out is None else out.when(c(score) >= least, name)
    return out.otherwise("Low")


def pattern_score(kind: Col) -> Column:
    out = None
    for name, score in K.PATTERN_SCORES.items():
        out = F.when(c(kind) == name, score) if out is None else out.when(c(kind) == name, score)
    return out.otherwise(0.0)


def whitelist_factor(side: Col) -> Column:
    return F.when(c(side) == "both", 0.0).when(c(side).isin("input", "output"), K.ONE_SIDED_DISCOUNT).otherwise(1.0)


def fused(ml: Col, pattern: Col, network: Col, graph: Col, factor: Col) -> Column:
    w = K.WEIGHTS
    return rounded((w["ml"] * c(ml) + w["pattern"] * c(pattern) + w["network"] * c(network) + w["graph"] * c(graph)) * c(factor), 1)


def scaled(x: Col, low: Col, high: Col) -> Column:
    """To 0 and 1; 0 for a constant column."""
    return F.coalesce((c(x) - c(low)) / F.nullif(c(high) - c(low), F.lit(0.0)), F.lit(0.0))


def ip_number(ip: Col) -> Column:
    """An IPv4 address as a long; null for anything else."""
    text = F.trim(c(ip))
    octet = lambda i: F.split_part(text, F.lit("."), F.lit(i)).try_cast("long")
    valid = text.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    return F.when(valid, octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4))


def ip_to_long(ip: str) -> int:
    a, b, x, d = map(int, ip.split("."))
    return (a << 24) + (b << 16) + (x << 8) + d


def geo(ip: Col) -> Column:
    """Country label, AS number and organisation of an address: the reserved ranges, else unknown."""
    n = ip_number(ip)
    country = org = None
    for first, last, label, name in K.RESERVED:
        inside = n.between(ip_to_long(first), ip_to_long(last))
        country = F.when(inside, label) if country is None else country.when(inside, label)
        org = F.when(inside, name) if org is None else org.when(inside, name)
    return F.struct(country.otherwise("XX").alias("geo_country"), F.lit("AS0").alias("asn"), org.otherwise("Unknown").alias("asn_org"))


def hop_role(hop: Col, kind: Col, side: Col, fan_in: Col, fan_out: Col) -> Column:
    return (
        F.when(c(hop) == 0, "Source")
        .when(c(kind) == "CoinJoin_Mixer", "Mixer")
        .when(c(side).isNotNull(), "Exchange endpoint")
        .when(c(fan_out) >= 5, "Dispersal")
        .when(c(fan_in) >= 5, "Consolidation")
        .when(c(kind) == "Peel_Chain", "Layering (peel)")
        .otherwise("Intermediary")
    )


def amount_text(amount: Col) -> Column:
    """Eight decimals without trailing zeros."""
    return F.rtrim(F.rtrim(F.format_string("%.8f", c(amount)), F.lit("0")), F.lit("."))


def signals(src_port: Col, dst_port: Col, kind: Col, fee: Col, amount: Col, fan_in: Col, fan_out: Col, chain_length: Col) -> Column:
    """Plain reasons that need no statistics, in fixed order, as an array."""
    s, d, k = c(src_port), c(dst_port), c(kind)
    port = lambda what, p: F.concat(F.lit(what), p.cast("string"), F.lit(")"))
    spike = F.when(
        c(amount) > 0,
        F.concat(F.lit("Abnormal fee-to-value ratio: "), F.format_string("%.8f", c(fee)), F.lit(" BTC fee on "), F.format_string("%.4f", c(amount)), F.lit(" BTC transfer")),
    ).otherwise(F.concat(F.lit("Fee spike detected: "), F.format_string("%.8f", c(fee)), F.lit(" BTC on zero/micro transfer")))
    rules = [
        F.when(s.isin(*K.TOR_PORTS), port("Routed through known Tor SOCKS port (src_port=", s))
        .when(s.isin(*K.PROXY_PORTS), port("Routed through known proxy port (src_port=", s))
        .when(s.isin(*K.I2P_PORTS), port("Routed through known I2P tunnel port (src_port=", s)),
        F.when(d.isin(*K.TOR_PORTS), port("Destination is a known Tor control/SOCKS port (dst_port=", d)).when(d.isin(*K.I2P_PORTS), port("Destination is a known I2P eepsite port (dst_port=", d)),
        F.when(k == "CoinJoin_Mixer", "Matches deterministic equal-denomination CoinJoin signature"),
        F.when(k == "Fee_Spike", spike),
        F.when(k == "Peel_Chain", "Peel-chain output structure: one large and one small output"),
        F.when(c(amount) < K.MICRO_TX, "Micro-transaction: possible dust-attack probe"),
        F.when(c(fan_out) >= 5, F.concat(F.lit("High fan-out of "), c(fan_out).cast("string"), F.lit(" output addresses"))),
        F.when(c(fan_in) >= 5, F.concat(F.lit("High fan-in of "), c(fan_in).cast("string"), F.lit(" input addresses"))),
        F.when(c(chain_length) >= K.MIN_CHAIN, F.concat(F.lit("Multi-hop peel chain trajectory ("), c(chain_length).cast("string"), F.lit(" linked hops)"))),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


#: The functions offered to SQL: name, parameters, return type, body.
SQL_FUNCTIONS = (
    ("pipe_strings", "cell STRING", "ARRAY<STRING>", "filter(transform(split(CASE WHEN coalesce(cell, '') IN ('', 'nan', 'None') THEN '' ELSE cell END, '[|]'), x -> trim(x)), x -> x <> '')"),
    ("pipe_amounts", "cell STRING", "ARRAY<DOUBLE>", "filter(transform(split(CASE WHEN coalesce(cell, '') IN ('', 'nan', 'None') THEN '' ELSE cell END, '[|]'), x -> try_cast(trim(x) AS DOUBLE)), x -> x IS NOT NULL)"),
    ("risk_tier", "score DOUBLE", "STRING", "CASE WHEN score >= 80 THEN 'Critical' WHEN score >= 60 THEN 'High' WHEN score >= 40 THEN 'Medium' ELSE 'Low' END"),
    ("whitelist_factor", "side STRING", "DOUBLE", "CASE WHEN side = 'both' THEN 0.0D WHEN side IN ('input', 'output') THEN 0.15D ELSE 1.0D END"),
    ("script_of", "address STRING", "STRING", "CASE WHEN lower(address) LIKE 'bc1q%' THEN 'P2WPKH' WHEN lower(address) LIKE 'bc1p%' THEN 'P2TR' WHEN address LIKE '1%' THEN 'P2PKH' WHEN address LIKE '3%' THEN 'P2SH' ELSE 'UNKNOWN' END"),
    ("fee_urgency", "fee DOUBLE, total_in DOUBLE", "DOUBLE", "CASE WHEN total_in > 0 AND fee > 0 THEN floor(fee / total_in * 1e8 + 0.5) / 1e8 ELSE 0.0D END"),
)


def register_functions(spark: SparkSession) -> None:
    """Makes the functions callable from SQL; Catalyst inlines their bodies."""
    for name, params, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
