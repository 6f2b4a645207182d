"""Telemetry, profiles, labels, traces with advice, country and range tables, evaluation sets."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell import constants as K
from tracewell.operators import explain, features, intel, scoring, trace
from tracewell.operators.ingest import canonical, judged
from tracewell.sources import generator, readers


def test_telemetry_and_profile(spark):
    rows = [(i, float(i % 10), 1.0, 0.0) for i in range(100)] + [(100, 50.0, 0.1, 30.0), (101, None, float("nan"), float("inf"))]
    df = spark.createDataFrame(rows, "row_idx int, fan_out double, fan_ratio double, observation_spread_s double")
    got = {(r.row_idx, r.feature_name): r for r in explain.telemetry(df, "row_idx").collect()}
    assert {k for k in got if k[0] >= 100} == {(100, "fan_out"), (100, "fan_ratio"), (100, "observation_spread_s")}
    top = got[100, "fan_out"]
    assert (top.percentile_rank, top.dataset_median, top.heuristic_flag) == (100.0, 5.0, "rapid_dispersal")
    assert top.audit_reason == "Output address count of 50 is in the 100.0th percentile (dataset median: 5) — rapid 1-to-many dispersal pattern"
    assert got[100, "observation_spread_s"].audit_reason.startswith("Telemetry observation spread (s) of 30.00s is")
    lists = {r.row_idx: json.loads(r.telemetry) for r in explain.telemetry_lists(df, "row_idx").collect()}
    assert [x["feature_name"] for x in lists[100]] == ["fan_out", "fan_ratio", "observation_spread_s"] and len(lists[100][0]) == 8 and 101 not in lists
    p = {r.measure: r for r in explain.dataset_profile(df).collect()}
    assert p["fan_out"].min == 0 and p["fan_out"].max == 50 and p["fan_out"].p75 == 7.0
    assert explain.telemetry(df.limit(0), "row_idx").count() == 0


def test_labels_and_outliers(spark):
    rows = spark.createDataFrame([(1, " e1 "), (2, "e2"), (3, None), (4, " ")], "score_id int, entity_id string")
    labels = spark.createDataFrame([("e1", "Cluster 7")], "entity_id string, behaviour_cluster string")
    assert {r.score_id: r.behaviour_cluster for r in scoring.labelled(rows, labels, "entity_id", "behaviour_cluster", "Cluster 0").collect()} == {1: "Cluster 7", 2: "Cluster 0", 3: "Cluster 0", 4: "Cluster 0"}
    texts = spark.createDataFrame([("Normal.", "Outlier"), ("Odd", "Outlier"), ("Odd", "Cluster 1"), (None, None)], "t string, c string").select(explain.with_outlier(F.col("t"), F.col("c")).alias("x"), explain.regulated(F.col("t")).alias("r")).collect()
    note = "Entity behaves unlike every known group (HDBSCAN outlier)."
    assert [r.x for r in texts] == [note, f"Odd. {note}", "Odd", None] and not any(r.r for r in texts)


def test_networks_on_the_watchlist(spark):
    t = spark.createDataFrame([(0, ["a"], ["b"], "10.0.0.1", " as64500"), (1, ["c"], ["d"], "10.0.0.2", "AS64500"), (2, ["e"], ["f"], "10.0.0.3", None)], "row_idx long, ins array<string>, outs array<string>, src_ip string, asn string")
    watch = spark.createDataFrame([("AS64500", "asn", "net", 0.5), ("10.0.0.1", "ip", "relay", 0.5), ("F", "address", "bad", 0.9)], "indicator string, type string, label string, severity double")
    assert {r.row_idx: (r.watchlist_indicator, r.watchlist_label) for r in intel.watched(t, watch).collect()} == {0: ("10.0.0.1", "relay"), 1: ("AS64500", "net"), 2: ("F", "bad")}
    assert intel.watched(t.drop("asn"), watch).count() == 2 and intel.watched(t, watch.limit(0)).count() == 0


def test_ego_graph(spark):
    edges = spark.createDataFrame([("entity:a", "tx:1"), ("tx:1", "ip:x"), ("tx:2", "ip:x"), ("entity:b", "tx:2")], "src string, dst string")
    near = lambda r: {tuple(e) for e in scoring.ego_graph(edges, "entity:a", r).collect()}
    assert near(1) == {("entity:a", "tx:1")} and near(2) == near(1) | {("tx:1", "ip:x")} and len(near(4)) == 4 and scoring.ego_graph(edges, "none").count() == 0


def test_advice(spark):
    hops = spark.createDataFrame([(1, 1, 0, "Source", None), (1, 2, 1, "Mixer", None), (1, 3, 2, "Exchange endpoint", "Bank"), (5, 5, 0, "Source", None), (5, 6, 1, "Mixer", None), (9, 9, 0, "Source", None)], "seed long, row long, hop int, role string, whitelisted_entity string")
    assert {r.seed: r.advice for r in trace.advice(hops).collect()} == {1: "Funds reached Bank. Next step: lawful KYC request to this VASP.", 5: "Trail enters a mixer; further tracing has low confidence."}


@pytest.mark.parametrize("column", sorted(K.LABEL_COLUMNS))
def test_no_model_reads_a_label(column):
    with pytest.raises(ValueError):
        features.leak_free(["fan_in", column])


def test_label_columns_are_all_there():
    assert len(K.LABEL_COLUMNS) == 17 and {"label", "watchlist_hit", "score_graph", "y", "target"} <= K.LABEL_COLUMNS


def test_files_with_odd_values(spark, tmp_path):
    head = "txid\ttimestamp\tinput_addresses\toutput_addresses\tinput_amounts\toutput_amounts\n"
    (tmp_path / "a.tsv").write_text(head + "t1\t2026-07-01 00:00:00\ta\tb\t1\t1\nt2\tnot a date\ta\tb\t1\t1\n")
    rows = readers.get_adapter(spark, str(tmp_path / "a.tsv")).load(str(tmp_path / "a.tsv"))
    assert {r.txid: r.reason for r in judged(rows, ts="timestamp").collect()} == {"t1": None, "t2": "unparseable_timestamp"}
    (tmp_path / "b.csv").write_text('2026-07-01 00:00:01,10.0.0.1,10.0.0.2,8333,8333,tx1,A,C,0.1,0.3,0.001,P2PKH,US\n2026-07-01 00:00:01,10.0.0.1,10.0.0.2,8333,8333,tx2,A,C,0.1,0.3,0.001,"lost,US\n')
    good, bad = readers.CsvAdapter(spark).load_lines(str(tmp_path / "b.csv"))
    assert [r.txid for r in good.collect()] == ["tx1"] and [r.reason for r in bad.collect()] == ["quoting"]


def test_country_and_range_tables(spark, tmp_path):
    names = {r.iso2: r.country_name for r in readers.iso_codes(spark).collect()}
    assert len(names) >= 249 and names["DE"] == "Germany"
    (tmp_path / "iso.csv").write_text("iso2,id,country_name\nDE,276,Germany\n")
    assert readers.iso_codes(spark, str(tmp_path / "iso.csv")).collect()[0].id == "276"
    none, status = readers.range_database(spark, ["x.csv"], [str(tmp_path)])
    assert none is None and status["in_use"] == "none"
    (tmp_path / "x.csv").write_text("first_ip,last_ip,country,asn,org\n10.0.0.0,10.0.0.255,DE,AS1,One\n")
    ranges, status = readers.range_database(spark, ["y.csv", "x.csv"], ["/nowhere", str(tmp_path)])
    assert status["name"] == "x.csv"
    got = scoring.range_lookup(spark.createDataFrame([("10.0.0.7",), ("10.0.1.7",)], "ip string"), "ip", ranges)
    assert {r.ip: r.asn for r in got.collect()} == {"10.0.0.7": "AS1", "10.0.1.7": None}


@pytest.mark.parametrize("kind", list(generator.PROFILES))
def test_evaluation_sets(spark, kind):
    made = generator.evaluation_set(spark, kind, 120)
    assert made.count() == 120 and canonical(made).count() == 120
    assert {r.profile for r in made.select("profile").distinct().collect()} == set(generator.PROFILES[kind])
    assert {r.label for r in made.select("label").distinct().collect()} == {int(kind in ("known", "novel"))}


def test_institutions(spark):
    banks = spark.createDataFrame([("bank1",), ("bank2",), (None,)], "address string")
    rows = canonical(generator.institutional(spark, 60, banks)).collect()
    assert len(rows) == 60 and all(({"bank1", "bank2"} & {*r.ins, *r.outs}) and r.total_in >= 50 for r in rows)
    assert generator.institutional(spark, 60, banks.limit(0)).count() == 0


def test_holdout_report(spark):
    from tracewell.ml import evaluation

    made = generator.transactions(spark, 400)
    rows = evaluation.prepared(canonical(made), made.select("row_idx", (F.col("attack_type") != "Normal").alias("label")))
    names = [c for c in rows.columns if c not in ("row_idx", "label", "rules", "pattern", "anonymous")]
    got = {(r.part, r.model): r for r in evaluation.report(rows, {}, names, trees=10, depth=6).collect()}
    assert {m for _, m in got} == {"calibrated", "uncalibrated", "isolation_forest", "rules", "fused"}
    assert got["holdout", "calibrated"].f1 >= 0.8 and got["holdout", "calibrated"].passes and 110 <= got["holdout", "rules"].n <= 130


def test_evidence_file(spark):
    from tracewell.operators import reports

    rows = spark.createDataFrame([(i, f"t{i}", float(i % 50), i % 2 == 0, "Fee_Spike", 1.0, 0.1, "10.0.0.1", None, 1, 2, "US", "both" if i == 3 else None, "Fee_Spike", "") for i in range(60)], "row_idx long, txid string, risk_score double, is_anomaly boolean, detected_type string, total_in double, fee double, src_ip string, dst_ip string, src_port int, dst_port int, geo_country string, whitelisted_side string, kind string, explanation string").withColumn("ts", F.lit("2026-07-01").cast("timestamp_ntz"))
    hops = spark.createDataFrame([(49, 0, 49, "t49", "Source", 1.0, 90.0, 0.1, 0.0), (49, 1, 50, "t50", "Mixer", 0.9, 80.0, 0.1, 5.0)], "seed long, hop int, row long, txid string, role string, btc_in double, retained_pct double, peeled_btc double, delta_t_minutes double")
    got = json.loads(reports.package(rows, hops, {"case_id": "c1"}).collect()[0].package)
    assert got["metadata"] == {"case_id": "c1"} and got["executive_summary"]["funnel_numbers"] == {"total_ingested": 60, "whitelisted_cleared": 1, "flagged_anomalies": 30}
    assert [x["rank"] for x in got["ranked_leads_top25"]] == list(range(1, 26)) and got["ranked_leads_top25"][0]["txid"] == "t49"
    assert len(got["top_10_detailed_profiles"]) == 10 and [h["role"] for h in got["top_10_detailed_profiles"][0]["forward_flow_trace"]] == ["Source", "Mixer"] and len(got["limitations"]) == 3
    none = json.loads(reports.package(rows.limit(0), hops.limit(0), {"case_id": "c1"}).collect()[0].package)
    assert none["ranked_leads_top25"] == [] and none["executive_summary"]["funnel_numbers"]["total_ingested"] == 0
