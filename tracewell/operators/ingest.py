"""From raw ledger rows to canonical transactions: reasons for rejection, defaults, lists as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import columns as X
from tracewell.operators.list_tokens import any_items
from tracewell.runtime import Scratch

#: Other names for the reasons, as reports of other versions spell them.
REASON_ALIASES = {"missing_id": "missing_txid", "duplicate": "duplicate_txid", "bad_timestamp": "unparseable_timestamp", "no_addresses": "empty_addresses", "bad_amount": "negative_or_non_numeric_amount"}
REASONS = tuple(REASON_ALIASES.values())
#: A missing word in a list; a number whose digits are grouped.
GAP = r"(?i)(?<![\w.])(?:nan|none)(?![\w.])"
GROUPED = r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.\d*)?$"
REQUIRED = ("txid", "input_addresses", "output_addresses", "input_amounts", "output_amounts")


def check_columns(df: DataFrame) -> None:
    if missing := set(REQUIRED) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")


def whole_amounts(items: str, cell: str) -> Column:
    """Amounts of a list: commas that group digits go, and a missing word beside values stays an item, so that it's no number here either."""
    plain = F.transform(items, lambda x: F.when(x.rlike(GROUPED), F.replace(x, F.lit(","), F.lit(""))).otherwise(x))
    return F.when((F.size(items) > 0) & F.col(cell).rlike(GAP), F.concat(plain, F.array(F.lit("nan")))).otherwise(plain)


def judged(df: DataFrame, order: str = "row_idx", ts: str = "ts") -> DataFrame:
    """Canonical columns and ``reason`` (null for accepted rows); the first reason of the fixed order counts.

    Lists are read in any notation (``list_tokens``); a time, port or fee that can't be read is null, never an error of the job. Extra columns are dropped here, so they cannot clash.
    A row repeats its txid if an earlier row of that txid would be accepted on its own. The earliest such row of each txid is an aggregate, combined before the shuffle, and is joined back: a
    txid that a third of the rows share is split by adaptive execution. Rows without a txid have no repeats; they are spread over all partitions. The parsed rows are
    written to the shared folder once, since they are read twice.
    """
    check_columns(df)
    have = set(df.columns)
    opt = lambda name, kind: F.col(name).try_cast(kind) if name in have else F.lit(None).cast(kind)
    fee = opt("fee", "double")
    rows = df.select(
        F.col(order).alias("row_idx"),
        F.trim(F.col("txid").cast("string")).alias("txid"),
        F.col(ts).try_cast("timestamp_ntz").alias("ts"),
        *[opt(n, "string").alias(n) for n in ("src_ip", "dst_ip", "script_type", "geo_country", "asn")],
        F.coalesce(opt("src_port", "double").try_cast("int"), F.lit(0)).alias("src_port"),
        F.coalesce(opt("dst_port", "double").try_cast("int"), F.lit(0)).alias("dst_port"),
        F.when(fee.isNotNull() & ~F.isnan(fee), fee).otherwise(K.DEFAULT_FEE).alias("fee"),
        any_items("input_addresses").alias("ins"),
        any_items("output_addresses").alias("outs"),
        any_items("input_amounts").alias("in_items"),
        any_items("output_amounts").alias("out_items"),
        F.col("input_amounts").cast("string").alias("in_cell"),
        F.col("output_amounts").cast("string").alias("out_cell"),
    )
    rows = rows.withColumns({f"{k}_items": whole_amounts(f"{k}_items", f"{k}_cell") for k in ("in", "out")}).drop("in_cell", "out_cell")
    own = (
        F.when(F.col("txid").isNull() | F.lower("txid").isin("", "nan", "none", "null", "nat"), "missing_txid")
        .when(F.col("ts").isNull(), "unparseable_timestamp")
        .when(~(X.has_addresses("ins") & X.has_addresses("outs")), "empty_addresses")
        .when(~(X.valid_amounts("in_items") & X.valid_amounts("out_items")), "negative_or_non_numeric_amount")
        .when(F.col("fee") < 0, "negative_or_non_numeric_amount")
    )
    rows = Scratch(df.sparkSession, "ingest").cut(rows.withColumn("own", own), "rows")
    first = rows.where("own IS NULL").groupBy(F.col("txid").alias("_txid")).agg(F.min("row_idx").alias("_first"))
    missing = F.coalesce(F.col("own") == "missing_txid", F.lit(False))
    spread = F.when(missing, F.concat(F.lit("\0"), F.col("row_idx").cast("string"))).otherwise(F.col("txid"))
    reason = F.when(~missing & (F.col("_first") < F.col("row_idx")), "duplicate_txid").otherwise(F.col("own"))
    return rows.join(first, spread == F.col("_txid"), "left").withColumn("reason", reason).drop("own", "_txid", "_first")


def canonical(df: DataFrame, order: str = "row_idx", ts: str = "ts") -> DataFrame:
    """The accepted rows with amounts as doubles and their sums."""
    rows = judged(df, order, ts).where("reason IS NULL").drop("reason")
    rows = rows.select("*", X.numbers("in_items").alias("in_amts"), X.numbers("out_items").alias("out_amts")).drop("in_items", "out_items")
    return rows.select("*", X.total("in_amts").alias("total_in"), X.total("out_amts").alias("total_out"), F.size("ins").alias("fan_in"), F.size("outs").alias("fan_out"))


def report(judged_rows: DataFrame, source: str, sha256: str | None = None) -> DataFrame:
    """One row: what was read, accepted and rejected for which reason, and the time span; ``to_json(struct(*))`` is the report file."""
    return judged_rows.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.col("reason").isNull()).alias("rows_valid"),
        F.count("reason").alias("rows_rejected"),
        F.min(F.when(F.col("reason").isNull(), F.col("ts"))).alias("first_ts"),
        F.max(F.when(F.col("reason").isNull(), F.col("ts"))).alias("last_ts"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS],
    ).select(F.lit(source).alias("source"), F.lit(sha256).alias("sha256"), "*")
