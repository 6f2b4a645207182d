"""The canonical tables that queries start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.functions import columns as X
from tracewell.operators import chains, ingest, intel
from tracewell.operators.list_tokens import MISSING
from tracewell.runtime import Scratch, read


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted transactions of the ledger, for plans that read them once."""
    return ingest.canonical(read(spark, sf_dir, "tx_ledger"))


def cut_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written to the shared folder once, for plans that read them several times."""
    return Scratch(spark, "ledger").cut(tx(spark, sf_dir), "tx")


def watchlist(t: DataFrame) -> DataFrame:
    """A watchlist drawn from the ledger itself: what anonymiser ports paid to, and from where they were used."""
    anon = t.where(F.col("src_port").isin(*K.FUSION_ANON_PORTS))
    paid = anon.select(F.explode(F.array_distinct(F.transform("outs", F.lower))).alias("indicator"), F.lit("address").alias("type"))
    used = anon.select(F.trim("src_ip").alias("indicator"), F.lit("ip").alias("type")).where("indicator <> ''")
    n = paid.unionByName(used).groupBy("indicator", "type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("indicator", "type", F.concat(F.lit("anonymiser "), F.col("type")).alias("label"), F.least(F.lit(1.0), 0.5 + F.col("n") / 10).alias("severity"))


def classified(spark: SparkSession, sf_dir: str, t: DataFrame | None = None) -> DataFrame:
    """Transactions with ``kind``, chain length and whitelisted sides."""
    t = cut_tx(spark, sf_dir) if t is None else t
    chain = chains.peel_chains(t).select("row_idx", "chain_length", "chain_head", "hop_position", "fund_ratio")
    side = intel.whitelisted(t, intel.whitelist(read(spark, sf_dir, "institutional_whitelist")))
    rows = t.join(chain, "row_idx", "left").join(side, "row_idx", "left").withColumn("chain_length", F.coalesce("chain_length", F.lit(0)))
    rows = rows.withColumn("urgency", X.fee_urgency("fee", "total_in"))
    kind = X.structural_type(X.is_mixer("fan_in", "fan_out", "out_amts"), "chain_length", "fan_in", "fan_out", "urgency")
    return rows.withColumn("structural", kind).withColumn("kind", X.final_type("structural", "whitelisted_side"))


def cut_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written to the shared folder once: traces read it in every hop."""
    return Scratch(spark, "classified").cut(classified(spark, sf_dir), "rows")


def _pipe(cell: str) -> str:
    return f"list_filter(list_transform(string_split(CASE WHEN coalesce({cell}, '') IN ('', 'nan', 'None') THEN '' ELSE {cell} END, '|'), lambda x: trim(x)), lambda x: x <> '')"


#: Commas between digits directly inside a pair of quotes become "_" and are turned back after the split; no two are closer than three digits.
GROUPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '"([0-9.]+),([0-9][0-9.,eE+-]*)"', '"\1_\2"', 'g'), '''([0-9.]+),([0-9][0-9.,eE+-]*)''', '''\1_\2''', 'g'), '"([0-9._]+),([0-9][0-9.,eE+-]*)"', '"\1_\2"', 'g'), '''([0-9._]+),([0-9][0-9.,eE+-]*)''', '''\1_\2''', 'g')"""
_MISSING = ", ".join(f"'{x}'" for x in sorted(MISSING))


def _words(cell: str) -> str:
    return f"coalesce(regexp_extract_all({cell}, '[0-9A-Za-z.+_-]+'), [])"


def _addresses(cell: str) -> str:
    return f"list_filter({_words(cell)}, lambda x: lower(x) NOT IN ({_MISSING}))"


def _amounts(cell: str) -> str:
    """A missing word beside values stays, as an item that is no number; grouped digits are joined."""
    return f"list_transform(CASE WHEN len({_addresses(cell)}) = 0 THEN [] ELSE {_words(GROUPED.format(c=cell))} END, lambda x: replace(x, '_', ''))"


def _numbers(items: str) -> str:
    return f"list_filter(list_transform({items}, lambda x: try_cast(x AS DOUBLE)), lambda x: x IS NOT NULL)"


def _valid(items: str) -> str:
    return f"(len({items}) > 0 AND len(list_filter({items}, lambda x: NOT coalesce(try_cast(x AS DOUBLE) >= 0 AND NOT isnan(try_cast(x AS DOUBLE)), false))) = 0)"


def _has(items: str) -> str:
    return f"(len(list_filter({items}, lambda x: lower(x) NOT IN ('nan', 'none', ''))) > 0)"


JUDGED = f"""
led0 AS (SELECT row_idx, trim(txid) AS txid, ts, src_ip, dst_ip, script_type, geo_country, coalesce(src_port, 0) AS src_port, coalesce(dst_port, 0) AS dst_port,
  CASE WHEN fee IS NOT NULL AND NOT isnan(fee) THEN fee ELSE 0.0001 END AS fee, {_addresses('input_addresses')} AS ins, {_addresses('output_addresses')} AS outs, {_amounts('input_amounts')} AS in_items, {_amounts('output_amounts')} AS out_items FROM tx_ledger),
led1 AS (SELECT *, CASE WHEN txid IS NULL OR lower(txid) IN ('', 'nan', 'none', 'null', 'nat') THEN 'missing_txid' WHEN ts IS NULL THEN 'unparseable_timestamp'
  WHEN NOT ({_has('ins')} AND {_has('outs')}) THEN 'empty_addresses' WHEN NOT ({_valid('in_items')} AND {_valid('out_items')}) OR fee < 0 THEN 'negative_or_non_numeric_amount' END AS own FROM led0),
judged AS (SELECT *, CASE WHEN own = 'missing_txid' THEN own WHEN max((own IS NULL)::INT) OVER (PARTITION BY txid ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'duplicate_txid' ELSE own END AS reason FROM led1)"""
TX = f"""{JUDGED},
tx0 AS (SELECT row_idx, txid, ts, src_ip, dst_ip, script_type, geo_country, src_port, dst_port, fee, ins, outs, {_numbers('in_items')} AS in_amts, {_numbers('out_items')} AS out_amts FROM judged WHERE reason IS NULL),
tx AS (SELECT *, list_sum(in_amts) AS total_in, list_sum(out_amts) AS total_out, len(ins) AS fan_in, len(outs) AS fan_out FROM tx0)"""
_POORTS = ", ".join(map(str, K.FUSION_ANON_PORTS))
MIX = """
mix0 AS (SELECT row_idx, fan_in, fan_out, len(out_amts) AS k, list_reduce(list_transform(list_sort(out_amts), lambda x: {'rep': x, 'n': 1, 'best': 1}),
  lambda a, x: CASE WHEN abs(x.rep - a.rep) / greatest(abs(a.rep), abs(x.rep), 1e-12) <= 0.01 THEN {'rep': a.rep, 'n': a.n + 1, 'best': greatest(a.best, a.n + 1)} ELSE {'rep': x.rep, 'n': 1, 'best': a.best} END) AS b FROM tx),
mix AS (SELECT row_idx, greatest(fan_in, fan_out) AS participants, b.best / k::DOUBLE AS ratio, greatest(fan_in, fan_out) >= 10 AND b.best / k::DOUBLE >= 0.5 AS mixer FROM mix0)"""
WHITELIST = """
wl AS (SELECT lower(trim(address)) AS address, min(CASE WHEN entity_name IS NOT NULL THEN entity_name END) AS label FROM institutional_whitelist WHERE trim(address) <> '' GROUP BY 1),
hit AS (SELECT row_idx, side, arg_min(coalesce(label, '\\0'), pos) AS label FROM (SELECT row_idx, 'i' AS side, unnest(ins) AS a, unnest(range(len(ins))) AS pos FROM tx UNION ALL SELECT row_idx, 'o', unnest(outs), unnest(range(len(outs))) FROM tx) JOIN wl ON lower(a) = wl.address GROUP BY 1, 2),
side AS (SELECT row_idx, CASE WHEN count(*) = 2 THEN 'both' WHEN max(side) = 'i' THEN 'input' ELSE 'output' END AS whitelisted_side, CASE WHEN count(*) = 2 THEN 'Regulated Entity' ELSE nullif(max(label), '\\0') END AS whitelisted_entity FROM hit GROUP BY 1)"""
WATCHLIST = f"""
watch AS (SELECT indicator, type, 'anonymiser ' || type AS label, least(1.0::DOUBLE, 0.5::DOUBLE + count(*) / 10::DOUBLE) AS severity FROM (
  SELECT unnest(list_distinct(list_transform(outs, lambda x: lower(x)))) AS indicator, 'address' AS type FROM tx WHERE src_port IN ({_POORTS})
  UNION ALL SELECT trim(src_ip), 'ip' FROM tx WHERE src_port IN ({_POORTS}) AND trim(src_ip) <> '') GROUP BY 1, 2)"""
CHAINS = """
cand AS (SELECT row_idx, CASE WHEN out_amts[1] >= out_amts[2] THEN outs[1] ELSE outs[2] END AS a FROM tx WHERE len(outs) = 2 AND len(out_amts) = 2 AND out_amts[1] + out_amts[2] > 0 AND abs(out_amts[1] - out_amts[2]) / (out_amts[1] + out_amts[2]) >= 0.5),
spender AS (SELECT a, max(row_idx) AS nxt FROM (SELECT row_idx, unnest(ins) AS a FROM tx) GROUP BY 1),
hopto AS (SELECT row_idx, CASE WHEN nxt <> row_idx THEN nxt END AS nxt FROM cand LEFT JOIN spender USING (a)),
walk AS (SELECT row_idx AS head, row_idx, 1 AS pos FROM hopto WHERE row_idx NOT IN (SELECT nxt FROM hopto WHERE nxt IS NOT NULL)
  UNION ALL SELECT head, nxt, pos + 1 FROM walk JOIN hopto USING (row_idx) WHERE nxt IS NOT NULL AND pos < 10000),
owned AS (SELECT row_idx, arg_min(pos, head) AS hop_position, min(head) AS chain_head FROM walk GROUP BY 1),
long AS (SELECT chain_head, count(*) AS chain_length FROM owned GROUP BY 1 HAVING count(*) >= 2),
chain AS (SELECT o.row_idx, o.chain_head, chain_length, hop_position, floor(t.total_in / CASE WHEN f.total_in > 0 THEN f.total_in ELSE 1.0 END * 1e6 + 0.5) / 1e6 AS fund_ratio
  FROM owned o JOIN long USING (chain_head) JOIN tx t ON t.row_idx = o.row_idx JOIN tx f ON f.row_idx = o.chain_head)"""
KINDS = f"""{MIX},{WHITELIST},{CHAINS},
kinds AS (SELECT tx.*, mixer, coalesce(chain_length, 0) AS chain_length, whitelisted_side, whitelisted_entity, CASE WHEN total_in > 0 AND fee > 0 THEN floor(fee / total_in * 1e8 + 0.5) / 1e8 ELSE 0 END AS urgency,
  CASE WHEN mixer THEN 'CoinJoin_Mixer' WHEN coalesce(chain_length, 0) >= 2 THEN 'Peel_Chain' WHEN fan_out >= 5 AND fan_in <= 2 THEN 'FanOut_Dispersal' WHEN total_in > 0 AND fee > 0 AND floor(fee / total_in * 1e8 + 0.5) / 1e8 >= 0.01 THEN 'Fee_Spike' ELSE 'Normal_P2P' END AS structural
  FROM tx JOIN mix USING (row_idx) LEFT JOIN chain USING (row_idx) LEFT JOIN side USING (row_idx)),
typed AS (SELECT *, CASE WHEN whitelisted_side IS NOT NULL AND structural IN ('Normal_P2P', 'FanOut_Dispersal', 'Fee_Spike') THEN 'Whitelisted_Institutional' ELSE structural END AS kind FROM kinds)"""


def r(x: str, digits: int) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def with_(*ctes: str, recursive: bool = True) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(ctes)
