"""Validation, defaults and lists."""

from datetime import datetime

import pytest

from tracewell.functions import columns as X
from tracewell.operators import ingest

SCHEMA = "row_idx long, txid string, ts timestamp_ntz, input_addresses string, output_addresses string, input_amounts string, output_amounts string, fee double, src_port int, reason string"
T0 = datetime(2026, 7, 27, 12)


def row(i, txid, ts=T0, ins="a", outs="b", ia="1.0", oa="0.9", fee=0.01, port=8333):
    return (i, txid, ts, ins, outs, ia, oa, fee, port, "clash")


def reasons(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.row_idx: r.reason for r in ingest.judged(df).collect()}


def test_ten_good_and_one_of_each(spark):
    rows = [row(i, f"tx{i}") for i in range(10)] + [row(10, None), row(11, "tx_bad", ts=None), row(12, "tx3")]
    got = reasons(spark, rows)
    assert [got[i] for i in (10, 11, 12)] == ["missing_txid", "unparseable_timestamp", "duplicate_txid"]
    assert sum(v is None for v in got.values()) == 10
    df = spark.createDataFrame(rows, SCHEMA)
    r = ingest.report(ingest.judged(df), "x").collect()[0]
    assert (r.rows_read, r.rows_valid, r.rows_rejected, r.missing_txid) == (13, 10, 3, 1)


def test_amounts_and_addresses(spark):
    rows = [row(0, "a"), row(1, "b", ia="-1"), row(2, "c", oa="x"), row(3, "d", ins=""), row(4, "e", outs="nan"), row(5, "f", fee=-0.1)]
    got = reasons(spark, rows)
    assert [got[i] for i in range(6)] == [None, "negative_or_non_numeric_amount", "negative_or_non_numeric_amount", "empty_addresses", "empty_addresses", "negative_or_non_numeric_amount"]


def test_lists_in_any_notation(spark):
    cells = [("a|b", "1|2"), ("['a', 'b']", "[1.0, 2]"), ("a,b", "1,2"), ("a\tb", "1\t2"), ('"a";"b"', '"1";"2"'), ("(a/b)", "{1 2}")]
    rows = [row(i, f"t{i}", ins=a, ia=n) for i, (a, n) in enumerate(cells)]
    rows += [row(90, "u", ia='"1,501.26";"2"', ins="a b"), row(91, "v", ia="1|nan"), row(92, "w", ia="[-1]"), row(93, "x", ins="[nan]"), row(94, "y", ia="None"), row(95, "z", ia=None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.row_idx: (r.ins, r.in_amts, r.fan_in) for r in ingest.canonical(df).collect()}
    assert got == {i: (["a", "b"], [1.0, 2.0], 2) for i in range(len(cells))} | {90: (["a", "b"], [1501.26, 2.0], 2)}
    why = {r.row_idx: r.reason for r in ingest.judged(df).collect()}
    assert [why[i] for i in range(91, 96)] == [*["negative_or_non_numeric_amount"] * 2, "empty_addresses", *["negative_or_non_numeric_amount"] * 2]


def test_first_valid_copy_is_kept(spark):
    got = reasons(spark, [row(0, "a", ia="x"), row(1, "a"), row(2, "a"), row(3, " a ")])
    assert [got[i] for i in range(4)] == ["negative_or_non_numeric_amount", None, "duplicate_txid", "duplicate_txid"]


def test_defaults(spark):
    df = spark.createDataFrame([("a", "x|y", "z", "1|2", "3")], "txid string, input_addresses string, output_addresses string, input_amounts string, output_amounts string").selectExpr("0L AS row_idx", "*", "timestamp_ntz'2026-07-01' AS ts")
    r = ingest.canonical(df).collect()[0]
    assert (r.fee, r.src_port, r.ins, r.in_amts, r.total_in) == (0.0001, 0, ["x", "y"], [1.0, 2.0], 3.0)
    with pytest.raises(ValueError):
        ingest.check_columns(df.drop("txid"))
    assert ingest.canonical(df.limit(0)).count() == 0


def test_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).collect()[0].x
    from pyspark.sql import functions as F

    assert one(X.pipe_amounts(F.lit("1|x| 2 |"))) == [1.0, 2.0]
    assert one(X.strict_total(F.lit("1|x"))) == 0.0
    assert one(X.pipe_strings(F.lit("None"))) == []
    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(X.peel_disparity(arr(0.001, 0.999))) == 0.998
    assert one(X.peel_disparity(arr(0.3, 0.7))) == 0.0
    assert one(X.dominant_count(arr(1.0, 1.005, 1.02, 5.0))) == 2
    assert one(X.is_mixer(F.lit(10), F.lit(2), arr(1.0, 1.0, 2.0))) is True
    assert one(X.decimals(F.lit(0.125))) == 3 and one(X.decimals(F.lit(2.0))) == 0
    assert [one(X.port_risk(F.lit(p), F.lit(0.5))) for p in (9050, 443, 6667)] == [1.0, 0.0, 0.5]
    assert [one(X.script_of(F.lit(a))) for a in ("1x", "3x", "bc1qx", "BC1Px", "zz")] == ["P2PKH", "P2SH", "P2WPKH", "P2TR", "UNKNOWN"]
    assert [one(X.geo(F.lit(ip))).geo_country for ip in ("10.0.0.1", "192.168.1.1", "127.0.0.1", "169.254.1.1", "192.0.2.1", "999.1.1.1", "8.8.8.8", None)] == ["PRIVATE", "PRIVATE", "LOCAL", "LOCAL", "DOC", "XX", "XX", "XX"]
    assert [one(X.tier(F.lit(s))) for s in (80, 79.9, 60, 40, 0)] == ["Critical", "High", "High", "Medium", "Low"]
    assert one(X.amount_text(F.lit(1.5))) == "1.5"
    X.register_functions(spark)
    assert spark.sql("SELECT pipe_amounts('1|b|2.5') AS a, risk_tier(61D) AS t, whitelist_factor('both') AS f").collect()[0] == ([1.0, 2.5], "High", 0.0)
