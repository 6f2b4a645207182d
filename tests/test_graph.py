"""Entities, chains, traces, taint and whitelists against small brute force."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewell.operators import chains, correlate, entities, intel, trace
from tracewell.operators.ingest import canonical

SCHEMA = "row_idx long, txid string, ts timestamp_ntz, input_addresses string, output_addresses string, input_amounts string, output_amounts string, fee double, src_ip string"
T0 = datetime(2026, 7, 1)


def table(spark, rows):
    return canonical(spark.createDataFrame([(i, f"t{i}", T0 + timedelta(minutes=i), a, b, x, y, 0.001, ip) for i, (a, b, x, y, ip) in enumerate(rows)], SCHEMA))


def chain_rows(n):
    return [(f"c{i}", f"c{i + 1}|p{i}", f"{10 * 0.9**i:.6f}", f"{9 * 0.9**i:.6f}|{0.9**i:.6f}", "10.0.0.1") for i in range(n)]


def test_long_chain(spark):
    got = {r.row_idx: r for r in chains.peel_chains(table(spark, chain_rows(40))).collect()}
    assert [got[i].hop_position for i in range(40)] == list(range(1, 41))
    assert {r.chain_length for r in got.values()} == {40} and {r.chain_head for r in got.values()} == {0}
    ratios = [got[i].fund_ratio for i in range(40)]
    assert ratios == sorted(ratios, reverse=True)


def test_shared_stretch_belongs_to_the_earliest_and_cycles_to_none(spark):
    rows = [("a", "m|x", "1", "0.9|0.1", ""), ("b", "m|y", "1", "0.9|0.1", ""), ("m", "z|w", "1", "0.9|0.1", ""), ("k2", "k1|q", "1", "0.9|0.1", ""), ("k1", "k2|q", "1", "0.9|0.1", "")]
    got = {r.row_idx: (r.chain_head, r.hop_position) for r in chains.peel_chains(table(spark, rows)).collect()}
    assert got == {0: (0, 1), 2: (0, 2)}


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [(f"v{rng.randrange(400):03}", f"v{rng.randrange(400):03}") for _ in range(260)] + [(f"w{i:03}", f"w{i + 1:03}") for i in range(120)]
    pairs = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for v in sorted(near):
        if v not in want:
            todo = deque([v])
            want[v] = v
            while todo:
                for y in near[todo.popleft()]:
                    if y not in want:
                        want[y] = v
                        todo.append(y)
    got = {r.u: r.v for r in entities.components(spark.createDataFrame(pairs, "a string, b string").repartition(5)).collect()}
    assert got == {v: r for v, r in want.items() if v != r}


def test_entities_and_mixers(spark):
    mixer = ("|".join(f"m{i}" for i in range(10)), "|".join(f"o{i}" for i in range(10)), "|".join(["1"] * 10), "|".join(["1"] * 10), "")
    got = {r.address: r for r in entities.entities(table(spark, [("a|b", "z", "1|1", "2", ""), ("b|c", "y", "1|1", "2", ""), mixer])).collect()}
    assert got["a"].entity_id == got["c"].entity_id == "Entity_0" and got["a"].size == 3
    assert got["m0"].size == 1 and got["m0"].confidence == "Mixer-Affected"


def test_trace(spark):
    t = table(spark, chain_rows(6)).withColumns({"kind": F.lit("Peel_Chain"), "whitelisted_side": F.when(F.col("row_idx") == 3, "output"), "whitelisted_entity": F.lit(None).cast("string")})
    starts = spark.createDataFrame([(0,)], "seed long")
    got = sorted((r.hop, r.row, r.parent, r.role) for r in trace.trace(t, starts).collect())
    assert got == [(0, 0, None, "Source"), (1, 1, 0, "Layering (peel)"), (2, 2, 1, "Layering (peel)"), (3, 3, 2, "Exchange endpoint")]
    kept = [r.retained_pct for r in sorted(trace.trace(t, starts).collect(), key=lambda r: r.hop)]
    assert kept == sorted(kept, reverse=True) and len(set(kept)) == len(kept)
    back = trace.trace(t, spark.createDataFrame([(2,)], "seed long"), backward=True).collect()
    assert sorted((r.hop, r.row) for r in back) == [(-2, 0), (-1, 1), (0, 2)]
    assert {r.row_idx for r in trace.traceable(t).collect()} == {0, 1, 2, 3, 4}


def test_whitelist_watchlist_taint(spark):
    t = table(spark, [("A1", "b", "1", "1", "10.1.1.1"), ("x", "a1", "1", "1", ""), ("a1", "a1", "1", "1", ""), ("q", "x", "1", "1", ""), ("far", "off", "1", "1", "")])
    table_ = intel.whitelist(spark.createDataFrame([(" a1 ", "Bank"), ("A1", None), ("", "none"), (None, "x")], "address string, entity_name string"))
    assert table_.count() == 1
    got = {r.row_idx: (r.whitelisted_side, r.whitelisted_entity) for r in intel.whitelisted(t, table_).collect()}
    assert got == {0: ("input", "Bank"), 1: ("output", "Bank"), 2: ("both", "Regulated Entity")}
    watch = spark.createDataFrame([("b", "address", "bad", 0.9), ("10.1.1.1", "ip", "relay", 0.5)], "indicator string, type string, label string, severity double")
    assert [(r.row_idx, r.watchlist_label) for r in intel.watched(t, watch).collect()] == [(0, "bad")]
    hops = {r.row_idx: r.taint_hops for r in intel.taint_hops(t, watch).collect()}
    assert hops == {0: 1, 1: 3, 2: 3}
    score = {r.row_idx: r.taint_score for r in intel.taint_scores(t, watch).collect()}
    assert score[0] == 100.0 and score[4] == 0.0 and score[1] > score[3]


def test_layers(spark):
    t = table(spark, [("a", "b", "1", "1", ""), ("c", "d", "1", "1", "")])
    wire = spark.createDataFrame([(1, T0, "10.0.0.1", 1, "t0"), (2, T0 + timedelta(seconds=25), "10.0.0.2", 2, "t0"), (3, T0, "10.0.0.3", 3, "t0"), (4, T0, "x", 4, "zz"), (5, None, None, None, None)], "obs_id long, ts timestamp_ntz, src_ip string, src_port int, txid string")
    m = correlate.match_stats(t, wire).collect()[0]
    assert (m.matched, m.telemetry_only, m.chain_only, m.match_rate) == (1, 1, 1, 0.3333)
    got = {r.txid: (r.src_ip, r.ip_observation_count, r.observation_spread_s) for r in correlate.correlate(t, wire).collect()}
    assert got == {"t0": ("10.0.0.1", 3, 25.0), "t1": ("", 0, 0.0)}
