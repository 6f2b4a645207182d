"""A seeded source of synthetic transactions: column expressions over a range, the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("CoinJoin_Mixer", "Peel_Chain", "FanOut_Dispersal", "Fee_Spike")


def transactions(spark: SparkSession, total: int, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """``total`` rows in the shape of a ledger, of which ``ratio`` belong to the four suspicious kinds, with ``attack_type``. Peel chains run over four rows."""
    u = lambda *salt: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), *map(F.lit, salt)), F.lit(1_000_000)) / 1e6
    address = lambda *parts: F.concat(F.element_at(F.array(*map(F.lit, ("1", "3", "bc1q", "bc1p"))), (F.pmod(F.xxhash64(*parts), F.lit(4)) + 1).cast("int")), F.substring(F.sha2(F.concat_ws("-", *[p.cast("string") for p in parts]), 256), 1, 26))
    block = F.floor(F.col("id") / 4)
    kind: Column = F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(F.xxhash64(F.lit(seed), block, F.lit("k")), F.lit(4)) + 1).cast("int"))
    suspicious = F.pmod(F.xxhash64(F.lit(seed), block, F.lit("s")), F.lit(1_000_000)) / 1e6 < ratio
    base = spark.range(total).select("id", block.alias("block"), (F.col("id") % 4).alias("hop"), F.when(suspicious, kind).otherwise("Normal").alias("attack_type"))
    k = F.col("attack_type")
    n_in = F.when(k == "CoinJoin_Mixer", 12).when(k == "Normal", 1 + F.floor(u("i") * 3)).otherwise(1).cast("int")
    n_out = F.when(k == "CoinJoin_Mixer", 12).when(k == "FanOut_Dispersal", 8 + F.floor(u("o") * 10)).when(k == "Peel_Chain", 2).otherwise(1 + F.floor(u("o") * 3)).cast("int")
    amount = F.when(k == "Peel_Chain", 40 * F.pow(F.lit(0.9), F.col("hop"))).otherwise(0.01 + u("a") * 5)
    rows = base.select("*", n_in.alias("n_in"), n_out.alias("n_out"), amount.alias("amount"))
    spare = lambda i, side: address(F.lit(seed), F.col("id"), F.lit(side), i)
    chain = lambda hop: address(F.lit(seed), F.col("block"), F.lit("chain"), hop)
    ins = F.when(k == "Peel_Chain", F.array(chain(F.col("hop")))).otherwise(F.transform(F.sequence(F.lit(1), F.col("n_in")), lambda i: spare(i, "in")))
    outs = F.when(k == "Peel_Chain", F.array(chain(F.col("hop") + 1), spare(F.lit(0), "peel"))).otherwise(F.transform(F.sequence(F.lit(1), F.col("n_out")), lambda i: spare(i, "out")))
    share = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.format_string("%.8f", F.col("amount") / n))
    unlike = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.format_string("%.8f", F.col("amount") * 2 * i / (n * (n + 1))))
    out_amounts = F.when(k == "Peel_Chain", F.array(F.format_string("%.8f", F.col("amount") * 0.9), F.format_string("%.8f", F.col("amount") * 0.0999))).when(k == "FanOut_Dispersal", unlike(F.col("n_out"))).otherwise(share(F.col("n_out")))
    port = F.when((k != "Normal") & (u("p") < 0.4), 9050).otherwise(8333)
    return rows.select(
        F.col("id").alias("row_idx"),
        F.sha2(F.concat_ws("-", F.lit(seed).cast("string"), F.col("id").cast("string")), 256).alias("txid"),
        F.timestamp_micros(F.lit(1_782_864_000_000_000) + F.col("id") * 7_000_000).cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("10."), F.floor(u("x") * 256).cast("string"), F.lit("."), F.floor(u("y") * 256).cast("string"), F.lit(".1")).alias("src_ip"),
        F.lit("10.0.0.1").alias("dst_ip"),
        port.alias("src_port"),
        F.lit(8333).alias("dst_port"),
        F.array_join(ins, "|").alias("input_addresses"),
        F.array_join(outs, "|").alias("output_addresses"),
        F.array_join(share(F.col("n_in")), "|").alias("input_amounts"),
        F.array_join(out_amounts, "|").alias("output_amounts"),
        F.when(k == "Fee_Spike", F.col("amount") * 0.05).otherwise(F.col("amount") * 0.0004).alias("fee"),
        F.lit("P2WPKH").alias("script_type"),
        F.element_at(F.array(*map(F.lit, ("US", "DE", "SG", "BR", "JP"))), (F.floor(u("g") * 5) + 1).cast("int")).alias("geo_country"),
        "attack_type",
        F.when(k == "Peel_Chain", F.col("block")).alias("chain_id"),
        F.when(k == "Peel_Chain", F.col("hop") + 1).alias("chain_hop"),
    )


#: The profiles of evaluation sets. Share of the set, inputs and outputs (least, most), amount (least, most), how outputs divide it, fee as a share, source ports, destination ports, script.
PROFILES = {
    "benign": {
        "standard": (0.50, (1, 3), (1, 2), (0.1, 10.0), "equal", 0.001, (8333, 443, 8332), (8333, 18333), "P2WPKH"), "exchange": (0.20, (2, 4), (1, 2), (10.0, 250.0), "equal", 0.0005, (443,), (8333,), "P2WPKH"),
        "mining": (0.15, (1, 1), (50, 80), (0.1, 0.8), "near", 0.0005, (8333,), (8333,), "P2WPKH"), "treasury": (0.15, (8, 20), (1, 1), (5.0, 50.0), "equal", 0.0005, (443,), (8333,), "P2SH"),
    },
    "hard_negative": {
        "exchange": (0.30, (2, 4), (1, 2), (10.0, 250.0), "equal", 0.0005, (443,), (8333,), "P2WPKH"), "mining": (0.35, (1, 1), (50, 80), (0.1, 0.8), "near", 0.0005, (8333,), (8333,), "P2WPKH"), "treasury": (0.35, (8, 20), (1, 1), (5.0, 50.0), "equal", 0.0005, (443,), (8333,), "P2SH"),
    },
    "known": {
        "peel": (0.34, (1, 1), (2, 2), (0.5, 5.0), "peel", 0.00001, (9050, 9150), (8333,), "P2WPKH"), "coinjoin": (0.33, (10, 20), (10, 20), (0.1, 5.0), "equal", 0.0005, (9050, 9150), (8333,), "P2WPKH"), "fee_spike": (0.33, (1, 2), (1, 2), (0.05, 1.0), "equal", 0.2, (9050, 4444), (8333,), "P2PKH"),
    },
    "novel": {
        "dust": (0.34, (1, 1), (50, 80), (0.0003, 0.0005), "equal", 10.0, (4444,), (8333,), "P2PKH"), "mixed_port": (0.33, (10, 25), (1, 1), (0.05, 0.3), "equal", 0.02, (4444, 4445), (9050, 4444), "P2SH"), "layered": (0.33, (6, 12), (6, 12), (1.0, 10.0), "near", 0.0005, (9050, 9150), (4444, 8333), "P2PKH"),
    },
}


def evaluation_set(spark: SparkSession, kind: str, total: int, seed: int = 999) -> DataFrame:
    """``total`` ledger rows of the set ``kind`` (benign, hard_negative, known, novel) with their ``profile`` and ``label`` (1 for threats). Peel chains run over four rows."""
    profiles, low = [], 0.0
    for name, (share, ins, outs, amount, style, fee, src, dst, script) in PROFILES[kind].items():
        profiles.append((name, low, low + share, *ins, *outs, *amount, style, fee, list(src), list(dst), script))
        low += share
    table = F.broadcast(spark.createDataFrame(profiles, "profile string, lo double, hi double, in_lo int, in_hi int, out_lo int, out_hi int, amt_lo double, amt_hi double, style string, fee_share double, src array<int>, dst array<int>, script_type string"))
    u = lambda *salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(kind), F.col("id"), *map(F.lit, salt)), F.lit(1_000_000)) / 1e6
    within = lambda a, b, salt: (F.col(a) + F.floor(u(salt) * (F.col(b) - F.col(a) + 1))).cast("int")
    rows = spark.range(total).withColumn("at", (F.col("id") + 0.5) / total).join(table, (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    rows = rows.withColumns({"n_in": within("in_lo", "in_hi", "i"), "n_out": within("out_lo", "out_hi", "o"), "block": F.floor(F.col("id") / 4), "hop": F.col("id") % 4})
    peel = F.col("style") == "peel"
    rows = rows.withColumn("amount", F.when(peel, 4.0 * F.pow(F.lit(0.999), F.col("hop"))).otherwise(F.col("amt_lo") + u("a") * (F.col("amt_hi") - F.col("amt_lo"))))
    address = lambda *parts: F.concat(F.lit("bc1q"), F.substring(F.sha2(F.concat_ws("-", F.lit(f"{seed}-{kind}"), *[p.cast("string") for p in parts]), 256), 1, 30))
    chain = lambda hop: address(F.col("block"), F.lit("chain"), hop)
    many = lambda n, side: F.transform(F.sequence(F.lit(1), F.col(n)), lambda i: address(F.col("id"), F.lit(side), i))
    text = lambda x: F.format_string("%.8f", x)
    near = F.transform(F.sequence(F.lit(1), F.col("n_out")), lambda i: text(F.col("amount") / F.col("n_out") * (0.95 + F.pmod(F.xxhash64(F.col("id"), i), F.lit(1000)) / 1e4)))
    outs = F.when(peel, F.array(text(F.col("amount") * 0.999), text(F.col("amount") * 0.00099))).when(F.col("style") == "near", near).otherwise(F.transform(F.sequence(F.lit(1), F.col("n_out")), lambda i: text(F.col("amount") * 0.99 / F.col("n_out"))))
    port = lambda c, salt: F.element_at(c, (F.floor(u(salt) * F.size(c)) + 1).cast("int"))
    return rows.select(
        F.col("id").alias("row_idx"), F.sha2(F.concat_ws("-", F.lit(f"{seed}-{kind}"), F.col("id").cast("string")), 256).alias("txid"), F.timestamp_micros(F.lit(1_782_864_000_000_000) + F.col("id") * 11_000_000).cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("10."), F.floor(u("x") * 256).cast("string"), F.lit("."), F.floor(u("y") * 256).cast("string"), F.lit(".7")).alias("src_ip"), F.lit("10.0.0.1").alias("dst_ip"), port("src", "s").alias("src_port"), port("dst", "d").alias("dst_port"),
        F.array_join(F.when(peel, F.array(chain(F.col("hop")))).otherwise(many("n_in", "in")), "|").alias("input_addresses"), F.array_join(F.when(peel, F.array(chain(F.col("hop") + 1), address(F.col("id"), F.lit("peel")))).otherwise(many("n_out", "out")), "|").alias("output_addresses"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.col("n_in")), lambda i: text(F.col("amount") / F.col("n_in"))), "|").alias("input_amounts"), F.array_join(outs, "|").alias("output_amounts"), (F.col("amount") * F.col("fee_share")).alias("fee"), "script_type",
        F.element_at(F.array(*map(F.lit, ("US", "SG", "JP", "DE"))), (F.floor(u("g") * 4) + 1).cast("int")).alias("geo_country"), "profile", F.lit(int(kind in ("known", "novel"))).alias("label"),
    )


def institutional(spark: SparkSession, total: int, addresses: DataFrame, seed: int = 42) -> DataFrame:
    """``total`` large transfers to or from the given institutions (``address``), on standard ports. The list of institutions is for people: it is read by the driver."""
    known = sorted(r.address for r in addresses.select("address").where("address <> ''").distinct().collect())
    if not known:
        return transactions(spark, 0, seed=seed)
    u = lambda *salt: F.pmod(F.xxhash64(F.lit(seed), F.lit("institution"), F.col("id"), *map(F.lit, salt)), F.lit(1_000_000)) / 1e6
    theirs = F.element_at(F.array(*map(F.lit, known)), (F.floor(u("w") * len(known)) + 1).cast("int"))
    ours = F.concat(F.lit("bc1q"), F.substring(F.sha2(F.concat_ws("-", F.lit(f"institution-{seed}"), F.col("id").cast("string")), 256), 1, 30))
    deposit, amount = u("d") < 0.5, F.round(50 + u("a") * 450, 8)
    rows = spark.range(total).select("id", theirs.alias("theirs"), ours.alias("ours"), deposit.alias("deposit"), amount.alias("amount"), (0.0001 + u("f") * 0.0009).alias("fee"), u("p").alias("p"))
    text = lambda x: F.format_string("%.8f", x)
    side = lambda a, b: F.when(F.col("deposit"), F.col(a)).otherwise(F.col(b))
    return rows.select(
        F.col("id").alias("row_idx"), F.sha2(F.concat_ws("-", F.lit(f"institution-{seed}"), F.col("id").cast("string")), 256).alias("txid"), F.timestamp_micros(F.lit(1_782_864_000_000_000) + F.col("id") * 7_000_000).cast("timestamp_ntz").alias("ts"),
        F.lit("10.9.0.1").alias("src_ip"), F.lit("10.0.0.1").alias("dst_ip"), F.when(F.col("p") < 0.5, 8333).otherwise(8332).alias("src_port"), F.lit(8333).alias("dst_port"), side("ours", "theirs").alias("input_addresses"), side("theirs", "ours").alias("output_addresses"),
        text(F.col("amount") + F.col("fee")).alias("input_amounts"), text(F.col("amount")).alias("output_amounts"), "fee", F.lit("P2WPKH").alias("script_type"), F.lit("US").alias("geo_country"), F.lit("Whitelisted_Institutional").alias("attack_type"), F.lit(None).cast("long").alias("chain_id"), F.lit(None).cast("long").alias("chain_hop"),
    )
