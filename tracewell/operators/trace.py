"""Fund-flow traces: level-synchronous breadth-first joins, many starts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import columns as X
from tracewell.runtime import Scratch, hinted

MOST_NODES = 200


def steps(tx: DataFrame, backward: bool = False) -> DataFrame:
    """``a``, ``b``: transaction b spends an output of a later than a; turned for backward traces. ``b_in``: what b takes in."""
    made = tx.select(F.col("row_idx").alias("a"), F.col("ts").alias("ats"), F.explode(F.array_distinct("outs")).alias("addr"))
    spent = tx.select(F.col("row_idx").alias("b"), F.col("ts").alias("bts"), F.explode(F.array_distinct("ins")).alias("addr"))
    pairs = made.join(spent, "addr").where("bts > ats").select("a", "b").distinct()
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b")) if backward else pairs


def trace(tx: DataFrame, starts: DataFrame, hops: int = 6, backward: bool = False, most: int = MOST_NODES) -> DataFrame:
    """Per start (``seed``, a row_idx) the transactions reached: ``hop`` (negative when backward), ``parent`` (the smallest at the hop before), role and amounts.

    ``tx`` has ``kind``, ``whitelisted_side`` and ``whitelisted_entity``. A trace goes no further behind exchange endpoints and mixers (but the start) and holds at most ``most`` transactions, nearest
    first, in order of what they take in. Only the edges of the frontier are joined; the step table is not materialised.
    """
    scratch = Scratch(tx.sparkSession, "trace")
    ends = ("ins", "outs") if backward else ("outs", "ins")
    made, spent = (tx.select(F.col("row_idx").alias(k), F.col("ts").alias(f"{k}ts"), F.explode(F.array_distinct(e)).alias("addr")) for k, e in zip("ab", ends))
    later = "bts < ats" if backward else "bts > ats"
    # only addresses with a step at all are kept; a frontier then meets the steps of its own addresses
    last = spent.groupBy("addr").agg((F.min("bts") if backward else F.max("bts")).alias("bts"))
    made = scratch.cut(made.join(last, "addr").where(later).drop("bts"), "made")
    facts = tx.select(F.col("row_idx").alias("row"), "kind", "whitelisted_side", "total_in")
    frontier, got = scratch.measured(starts.select(F.col("seed"), F.col("seed").alias("row"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("hop"), F.lit(True).alias("open")), "hop-0", n=F.count(F.lit(1)))
    seen, n = frontier, got["n"]
    for hop in range(1, hops + 1):
        near = hinted(frontier.where("open").select("seed", F.col("row").alias("a")), n).join(made, "a")
        found = near.join(spent, "addr").where(later).groupBy("seed", F.col("b").alias("row")).agg(F.min("a").alias("parent")).join(seen.select("seed", "row"), ["seed", "row"], "left_anti")
        # a trace is full at `most`: what can't be among its nearest needs no further steps
        room = Window.partitionBy("seed").orderBy(F.desc("total_in"), "row")
        found = found.join(facts, "row").withColumn("k", F.row_number().over(room)).where(F.col("k") <= most)
        frontier, got = scratch.measured(found.select("seed", "row", "parent", F.lit(hop).alias("hop"), F.expr("kind <> 'CoinJoin_Mixer' AND whitelisted_side IS NULL").alias("open")), f"hop-{hop}", n=F.count(F.lit(1)))
        n = got["n"]
        seen = seen.unionByName(frontier)
        if not n:
            break
    rows = seen.join(tx.select(F.col("row_idx").alias("row"), "txid", "ts", "kind", "whitelisted_side", "whitelisted_entity", "fan_in", "fan_out", "total_in", "out_amts", "fee"), "row")
    kept = rows.withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy("hop", F.desc("total_in"), "row"))).where(F.col("k") <= most)
    first = tx.join(starts.select(F.col("seed").alias("row_idx")).distinct(), "row_idx", "left_semi").select(F.col("row_idx").alias("seed"), F.when(F.col("total_in") > 0, F.col("total_in")).alias("initial"))
    up = kept.select(F.col("seed"), F.col("row").alias("parent"), F.col("ts").alias("parent_ts"))
    kept = kept.join(first, "seed").join(up, ["seed", "parent"], "left")
    largest = F.coalesce(X.rounded(F.array_max("out_amts"), 8), F.lit(0.0))
    minutes = F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("parent_ts").cast("timestamp"))) / 6e7, F.lit(0.0))
    start = F.coalesce("initial", F.when(F.col("total_in") > 0, F.col("total_in")), F.lit(1.0))
    return kept.select(
        "seed",
        "row",
        "txid",
        "parent",
        (F.col("hop") * (-1 if backward else 1)).alias("hop"),
        X.rounded(F.greatest(F.lit(0.0), F.abs(minutes) if backward else minutes), 1).alias("delta_t_minutes"),
        X.rounded("total_in", 8).alias("btc_in"),
        largest.alias("largest_output_btc"),
        X.rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), largest / start * 100)), 4).alias("retained_pct"),
        F.greatest(F.lit(0.0), X.rounded(X.rounded("total_in", 8) - largest - F.col("fee"), 8)).alias("peeled_btc"),
        X.hop_role("hop", "kind", "whitelisted_side", "fan_in", "fan_out").alias("role"),
        "whitelisted_entity",
    )


def both_ways(tx: DataFrame, starts: DataFrame, hops: int = 6) -> DataFrame:
    """Backward and forward trace in one table; the start once, at hop 0."""
    return trace(tx, starts, hops).unionByName(trace(tx, starts, hops, backward=True).where("hop < 0"))


def advice(hops: DataFrame) -> DataFrame:
    """``seed`` and ``advice`` on a trace: the last exchange endpoint behind the start asks for a request to it; else a mixer lowers confidence; else the trail goes on."""
    reached = hops.where("row <> seed")
    last = F.max_by(F.coalesce("whitelisted_entity", F.lit("regulated exchange")), F.when(F.col("role") == "Exchange endpoint", F.struct(F.abs("hop"), F.col("row"))))
    per = reached.groupBy("seed").agg(last.alias("endpoint"), F.count_if(F.col("role") == "Exchange endpoint").alias("n"), F.count_if(F.col("role") == "Mixer").alias("m"))
    text = F.when(F.col("n") > 0, F.concat(F.lit("Funds reached "), F.col("endpoint"), F.lit(". Next step: lawful KYC request to this VASP."))).when(F.col("m") > 0, "Trail enters a mixer; further tracing has low confidence.")
    return per.where(text.isNotNull()).select("seed", text.alias("advice"))


def traceable(tx: DataFrame) -> DataFrame:
    """``row_idx`` of the transactions one of whose outputs is spent later: those whose forward trace has at least two hops."""
    made = tx.select("row_idx", "ts", F.explode(F.array_distinct("outs")).alias("addr"))
    last = tx.select(F.col("ts").alias("bts"), F.explode("ins").alias("addr")).groupBy("addr").agg(F.max("bts").alias("last"))
    return made.join(last, "addr").where("last > ts").select("row_idx").distinct()
