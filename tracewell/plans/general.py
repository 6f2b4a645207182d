"""Queries of the general problems: lines that fail to parse, heavy keys, packed lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.list_tokens import any_items, list_rows
from tracewell.operators.records import loaded, parse_lines, rejected
from tracewell.operators.skew import split_totals
from tracewell.plans.base import GROUPED
from tracewell.runtime import read, small_side

LIST_CELLS = ("input_addresses", "output_addresses", "input_amounts", "output_amounts")
#: Percent of the rows from which a key counts as heavy; whole numbers, so that the bound itself is exact.
HEAVY = 3


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(parse_lines(read(spark, sf_dir, "raw_lines"), "line_id", "raw_line"), "line_id")


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other lines as transactions; address lists as pipe texts, amounts by their number and their sum in units of 1e-8."""
    rows = loaded(parse_lines(read(spark, sf_dir, "raw_lines"), "line_id", "raw_line"), "line_id")
    whole = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + F.floor(F.coalesce(v, F.lit(0.0)) * 1e8 + 0.5))
    lists = {f"{side}_addresses": F.array_join(f"{side}_addresses", "|") for side in ("input", "output")}
    sums = {f"{side}_{what}": f(f"{side}_amounts") for side in ("input", "output") for what, f in (("n", F.size), ("sats", whole))}
    return rows.withColumns({**lists, **sums}).drop("input_amounts", "output_amounts")


def sats(x: str) -> Column:
    """An amount in units of 1e-8 as a long; null for null, NaN and infinite amounts, and from 9e10 on, where a long ends (thousands of times all coins there can be)."""
    return F.when(F.abs(F.col(x)) < 9e10, F.floor(F.col(x) * 1e8 + 0.5))


def entity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "scored_rows").select("entity_id", "ts", sats("amount_btc").alias("sats"), "score_id")
    return split_totals(rows, "entity_id", "ts", "sats", "score_id")


def whitelisted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each ledger row and whitelisted address in it."""
    listed = read(spark, sf_dir, "institutional_whitelist").select(F.lower(F.trim("address")).alias("address")).where("address <> ''").distinct()
    ledger = read(spark, sf_dir, "tx_ledger").select("row_idx", "ts", sats("fee").alias("sats"), any_items("input_addresses").alias("ins"), any_items("output_addresses").alias("outs"))
    stands = ledger.select("row_idx", "ts", "sats", F.explode(F.array_distinct(F.transform(F.concat("ins", "outs"), F.lower))).alias("address"))
    return stands.join(small_side(listed), "address")


def address_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_totals(whitelisted_rows(spark, sf_dir), "address", "ts", "sats", "row_idx", costly=True)


def heavy(totals: DataFrame, field: str, rows: DataFrame) -> DataFrame:
    every = rows.agg(F.count(F.lit(1))).scalar()
    return totals.where(F.col("n") * 100 >= every * HEAVY).select(F.lit(field).alias("key_field"), F.col("key").alias("key_text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = heavy(entity_totals(spark, sf_dir), "entity_id", read(spark, sf_dir, "scored_rows"))
    return entities.unionByName(heavy(address_totals(spark, sf_dir), "address", read(spark, sf_dir, "tx_ledger")))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(entity_totals(spark, sf_dir), "entity_id")


def p3_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(address_totals(spark, sf_dir), "address")


def named(totals: DataFrame, key: str) -> DataFrame:
    return totals.select(F.col("key").alias(key), F.col("n").alias("n_rows"), F.col("total").alias("total_sats"), F.col("measured").alias("n_amounts"), "first_at", "last_at", "longest_gap_us")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_rows(read(spark, sf_dir, "tx_ledger"), ["row_idx"], LIST_CELLS)


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p3_found, p3_entities, p3_addresses, p4_found)}

FIELD = """(?:"(?:[^"]|"")*"|[^",]*)"""
LINES = f"""
raw AS (SELECT line_id, regexp_replace(raw_line, '\\r$', '') AS line FROM raw_lines),
cut AS (SELECT line_id, line, regexp_full_match(line, '(?s){FIELD}(?:,{FIELD})*') AS sound, regexp_full_match(line, '(?s){FIELD}(?:,{FIELD}){{12}}') AS full13,
  regexp_extract(line, '(?s)^(?:{FIELD},){{8}}({FIELD})', 1) AS a, regexp_extract(line, '(?s)^(?:{FIELD},){{10}}({FIELD})', 1) AS f, regexp_extract(line, '(?s)^(?:{FIELD},){{3}}({FIELD})', 1) AS p FROM raw),
bare AS (SELECT line_id, sound, full13, trim(CASE WHEN starts_with(a, '"') THEN replace(a[2:-2], '""', '"') ELSE a END, E' \\t') AS a,
  trim(CASE WHEN starts_with(f, '"') THEN replace(f[2:-2], '""', '"') ELSE f END, E' \\t') AS f, trim(CASE WHEN starts_with(p, '"') THEN replace(p[2:-2], '""', '"') ELSE p END, E' \\t') AS p FROM cut),
items AS (SELECT *, list_filter(list_transform(string_split(a, '|'), lambda x: trim(x, E' \\t')), lambda x: x <> '') AS l FROM bare),
judged AS (SELECT line_id, CASE WHEN NOT sound THEN 'quoting' WHEN NOT full13 THEN 'columns'
  WHEN len(l) = 0 OR len(list_filter(l, lambda x: NOT regexp_full_match(x, '[+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?|-(0+\\.?0*|\\.0+)([eE][+-]?[0-9]+)?'))) > 0 THEN 'input_amounts'
  WHEN lower(f) NOT IN ('', 'nan', 'none', 'null') AND NOT regexp_full_match(f, '[+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?|-(0+\\.?0*|\\.0+)([eE][+-]?[0-9]+)?') THEN 'fee'
  WHEN lower(p) NOT IN ('', 'nan', 'none', 'null') AND NOT (regexp_full_match(p, '[0-9]+(\\.0+)?') AND coalesce(try_cast(regexp_extract(p, '^[0-9]+') AS HUGEINT), 99999) <= 65535) THEN 'src_port' END AS reason FROM items)"""

TOTALS = "count(*)::BIGINT AS n_rows, coalesce(sum(sats), 0)::BIGINT AS total_sats, count(sats)::BIGINT AS n_amounts, min(ts) AS first_at, max(ts) AS last_at, max(gap)::BIGINT AS longest_gap_us"
GAP = "epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {k} ORDER BY ts NULLS FIRST, {u}) AS gap"
SATS = "CASE WHEN isfinite({x}) AND abs({x}) < 9e10 THEN floor({x} * 1e8 + 0.5)::BIGINT END AS sats"
ADDRESSES = f"""
wl AS (SELECT DISTINCT lower(trim(address)) AS address FROM institutional_whitelist WHERE trim(address) <> ''),
stands AS (SELECT row_idx, ts, {SATS.format(x='fee')}, unnest(list_distinct(regexp_extract_all(lower(concat_ws('|', input_addresses, output_addresses)), '[0-9a-z]+'))) AS address FROM tx_ledger),
hits AS (SELECT row_idx, ts, sats, address FROM stands JOIN wl USING (address))"""

CELLS = " UNION ALL ".join(f"SELECT row_idx, '{c}' AS field_name, {GROUPED.format(c=c) if 'amounts' in c else c} AS cell FROM tx_ledger" for c in LIST_CELLS)

_RAW = lambda i: f"regexp_extract(line, '(?s)^(?:{FIELD},){{{i}}}({FIELD})', 1)"
_AT = lambda i: f"trim(CASE WHEN starts_with(f{i}, '\"') THEN replace(f{i}[2:-2], '\"\"', '\"') ELSE f{i} END, E' \\t')"
_GIVEN = lambda i: f"CASE WHEN lower({_AT(i)}) NOT IN ('', 'nan', 'none', 'null') THEN {_AT(i)} END"
_PARTS = lambda i: f"list_filter(list_transform(string_split({_AT(i)}, '|'), lambda x: trim(x)), lambda x: x <> '')"
_SUM = lambda i: f"coalesce(list_sum(list_transform({_PARTS(i)}, lambda x: floor(coalesce(try_cast(x AS DOUBLE), 0.0) * 1e8 + 0.5)::BIGINT)), 0)::BIGINT"
LOADED = f"""WITH {LINES}, flds AS (SELECT line_id, {", ".join(f"{_RAW(i)} AS f{i}" for i in range(13))} FROM judged JOIN raw USING (line_id) WHERE reason IS NULL)
    SELECT line_id, try_cast(replace({_AT(0)}, 'T', ' ') AS TIMESTAMP) AS ts, {_GIVEN(1)} AS src_ip, {_GIVEN(2)} AS dst_ip, try_cast({_GIVEN(3)} AS DOUBLE)::INT AS src_port, try_cast({_GIVEN(4)} AS DOUBLE)::INT AS dst_port, {_GIVEN(5)} AS txid,
      array_to_string({_PARTS(6)}, '|') AS input_addresses, array_to_string({_PARTS(7)}, '|') AS output_addresses, len({_PARTS(8)})::INT AS input_n, {_SUM(8)} AS input_sats, len({_PARTS(9)})::INT AS output_n, {_SUM(9)} AS output_sats,
      try_cast({_GIVEN(10)} AS DOUBLE) AS fee, upper({_GIVEN(11)}) AS script_type, upper({_GIVEN(12)}) AS geo_country FROM flds"""

ORACLE = {
    "p1_loaded": LOADED,
    "p1_found": f"WITH {LINES} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_found": f"""WITH {ADDRESSES}
        SELECT 'entity_id' AS key_field, trim(entity_id) AS key_text FROM scored_rows WHERE trim(entity_id) <> '' GROUP BY 2 HAVING count(*) * 100 >= {HEAVY} * (SELECT count(*) FROM scored_rows)
        UNION ALL SELECT 'address', address FROM hits GROUP BY 2 HAVING count(*) * 100 >= {HEAVY} * (SELECT count(*) FROM tx_ledger)""",
    "p3_entities": f"WITH r AS (SELECT trim(entity_id) AS entity_id, ts, {SATS.format(x='amount_btc')}, score_id FROM scored_rows WHERE trim(entity_id) <> ''), g AS (SELECT *, {GAP.format(k='entity_id', u='score_id')} FROM r) SELECT entity_id, {TOTALS} FROM g GROUP BY 1",
    "p3_addresses": f"WITH {ADDRESSES}, g AS (SELECT *, {GAP.format(k='address', u='row_idx')} FROM hits) SELECT address, {TOTALS} FROM g GROUP BY 1",
    "p4_found": rf"""WITH cells AS ({CELLS}),
        lists AS (SELECT row_idx, field_name, list_filter(regexp_extract_all(cell, '[0-9A-Za-z.+_-]+'), lambda x: lower(x) NOT IN ('nan', 'none')) AS l FROM cells),
        out AS (SELECT row_idx, field_name, unnest(l) AS item, unnest(range(1, len(l) + 1)) AS pos FROM lists)
        SELECT row_idx, field_name, pos::INT AS pos, replace(item, '_', ',') AS item FROM out""",
}
