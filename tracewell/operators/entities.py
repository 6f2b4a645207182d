"""Addresses to entities: co-ownership edges, change addresses, connected components, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import columns as X
from tracewell.operators import graph
from tracewell.operators.order import cumulative
from tracewell.runtime import Scratch


def change_addresses(tx: DataFrame) -> DataFrame:
    """``row_idx``, ``change_address``, ``change_score`` of each transaction one of whose outputs scores above 0.

    +3 / -1 for a script type that the inputs (or the row) have / lack, +2 for an unround amount beside a round one, +1 for the most decimals (over 3),
    +1 for an address not seen in an earlier row, +1 for over ten times the other of two outputs. Ties: more decimals, then the first.
    """
    n = F.least(F.size("outs"), F.size("out_amts"))
    base = tx.where(n >= 2).select("row_idx", "ins", "script_type", F.slice(F.arrays_zip("outs", "out_amts"), 1, n).alias("pairs"))
    scripts = F.array_remove(F.array_distinct(F.transform("ins", lambda a: X.script_of(a))), "UNKNOWN")
    explicit = F.trim("script_type")
    scripts = F.when(explicit.isNotNull() & ~explicit.isin("", "nan"), F.array_append(scripts, explicit)).otherwise(scripts)
    base = base.select("row_idx", scripts.alias("scripts"), F.transform("pairs", lambda p: F.struct(p["outs"].alias("a"), p["out_amts"].alias("v"), X.decimals(p["out_amts"]).alias("d"))).alias("pairs"))
    base = base.select(
        "row_idx", "scripts", F.size("pairs").alias("k"), F.array_max(F.transform("pairs", lambda p: p["d"])).alias("most"), F.exists("pairs", lambda p: p["d"] <= 3).alias("any_round"),
        F.transform("pairs", lambda p: p["v"]).alias("vs"), F.posexplode("pairs").alias("pos", "p"),
    )
    seen = tx.select("row_idx", F.explode(F.concat("ins", "outs")).alias("a")).groupBy("a").agg(F.min("row_idx").alias("first_row"))
    rows = base.select("*", F.col("p.a").alias("a"), F.col("p.v").alias("v"), F.col("p.d").alias("d")).join(seen, "a")
    script = X.script_of("a")
    other = F.get("vs", 1 - F.col("pos"))
    score = (
        F.when((script != "UNKNOWN") & (F.size("scripts") > 0), F.when(F.array_contains("scripts", script), 3).otherwise(-1)).otherwise(0)
        + F.when((F.col("d") > 3) & F.col("any_round"), 2).otherwise(0)
        + F.when((F.col("d") == F.col("most")) & (F.col("d") > 3), 1).otherwise(0)
        + F.when(F.col("first_row") >= F.col("row_idx"), 1).otherwise(0)
        + F.when((F.col("k") == 2) & (other > 0) & (F.col("v") / F.nullif(other, F.lit(0.0)) > 10), 1).otherwise(0)
    )
    best = rows.groupBy("row_idx").agg(F.max(F.struct(score.alias("s"), F.col("d"), (-F.col("pos")).alias("p"), F.col("a"))).alias("b"))
    return best.where("b.s > 0").select("row_idx", F.col("b.a").alias("change_address"), F.col("b.s").alias("change_score"))


def edges(tx: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (``v``, ``first_key``) and pairs (``a``, ``b``): each co-input and the change address with the first input. Mixers give vertices only.

    ``first_key``: row and place of the first appearance among the vertices, the order in which entities are numbered.
    """
    mixer = X.is_mixer("fan_in", "fan_out", "out_amts")
    rows = tx.select("row_idx", "ins", mixer.alias("mixer")).join(changes.select("row_idx", "change_address"), "row_idx", "left")
    rows = rows.select("row_idx", "ins", F.when(F.col("mixer"), F.array().cast("array<string>")).otherwise(F.array_compact(F.concat(F.slice("ins", 2, 100_000_000), F.array("change_address")))).alias("links"), F.when(~F.col("mixer"), F.col("change_address")).alias("chg"))
    nodes = rows.select("row_idx", F.posexplode(F.array_compact(F.concat("ins", F.array("chg")))).alias("pos", "v"))
    vertices = nodes.groupBy("v").agg(F.min(F.struct("row_idx", "pos")).alias("first_key"))
    return vertices, rows.select(F.get("ins", F.lit(0)).alias("a"), F.explode("links").alias("b")).where("a <> b")


def components(pairs: DataFrame) -> DataFrame:
    """``u``, ``v``: each value of the pairs (``a``, ``b``) above the smallest of its component with that smallest. Values are numbered, so the rounds shuffle longs."""
    scratch = Scratch(pairs.sparkSession, "entities")
    linked = scratch.cut(graph.forests(pairs), "forests")
    ids = scratch.cut(graph.numbered(linked, "x"), "ids")
    of = lambda side, name: ids.select(F.col("x").alias(side), F.col("id").alias(name))
    links = linked.where("x <> root").join(of("x", "u"), "x").join(of("root", "v"), "root").select("u", "v").distinct()
    label = graph.stars(links, scratch)
    return label.join(of("a", "u"), "u").join(of("b", "v"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))


def entities(tx: DataFrame) -> DataFrame:
    """``address``, ``entity_id`` (numbered from 0 by first appearance), ``confidence``, ``size``."""
    scratch = Scratch(tx.sparkSession, "entity-graph")
    vertices, pairs = edges(tx, scratch.cut(change_addresses(tx), "changes"))
    root = components(pairs)
    of = scratch.cut(vertices.join(root.select(F.col("u").alias("v"), F.col("v").alias("r")), "v", "left").select("v", "first_key", F.coalesce("r", "v").alias("root")), "of")
    mixers = tx.where(X.is_mixer("fan_in", "fan_out", "out_amts")).select(F.explode(F.concat("ins", "outs")).alias("v")).distinct().withColumn("mixed", F.lit(1))
    firsts = tx.select(F.get("ins", F.lit(0)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("txs"))
    groups = of.join(mixers, "v", "left").join(firsts, "v", "left").groupBy("root").agg(F.min("first_key").alias("first_key"), F.count(F.lit(1)).alias("size"), F.max("mixed").alias("mixed"), F.sum("txs").alias("txs"))
    tier = F.when(F.col("mixed") == 1, "Mixer-Affected").when(F.col("txs") > 3, "High-Confidence").otherwise("Heuristic/Inferred")
    ranked = cumulative(groups.select("root", "first_key", "size", tier.alias("confidence"), F.lit(0).alias("g"), F.lit(1).cast("long").alias("n")), "g", "first_key")
    named = ranked.select("root", F.concat(F.lit("Entity_"), F.col("before").cast("string")).alias("entity_id"), "confidence", "size")
    return of.join(named, "root").select(F.col("v").alias("address"), "entity_id", "confidence", "size")
