"""Scores, metrics, ranks, models and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.ml import clusters, iforest
from tracewell.operators import features, metrics, order, scoring
from tracewell.operators.ingest import canonical
from tracewell.sources import generator


def test_metric_vectors(spark):
    df = spark.createDataFrame([(i, float(i < 3), i < 3) for i in range(10)], "id int, p double, y boolean")
    assert metrics.ece(df, F.col("p"), "y").collect()[0].ece == 0.0
    assert metrics.precision_at(df, "p", "y", "id", 3).collect()[0].precision_at_k == 1.0
    assert metrics.precision_at(df, "p", "y", "id", 10).collect()[0].precision_at_k == 0.3
    assert metrics.roc_auc(df, "p", "y").collect()[0].roc_auc == 1.0
    edge = spark.createDataFrame([(0.3, True)], "p double, y boolean")
    assert metrics.calibration(edge, F.col("p"), "y").collect()[0].bin == 2


def test_auc_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 1), rng.random() < 0.4) for _ in range(200)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(metrics.roc_auc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").collect()[0].roc_auc - want) < 1e-5


def test_percentiles_and_ranks(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=501), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(float("nan"),), (float("inf"),), (None,)], "x double").repartition(6)
    got = order.percentiles(df, ["x"], [0.0, 0.5, 0.95, 1.0]).collect()[0].q
    assert np.allclose(got, np.percentile(x, [0, 50, 95, 100]))
    ranks = {r.value: r.rank_pct for r in order.weak_rank(df, "x").collect()}
    assert all(abs(ranks[v] - 100 * (x <= v).mean()) < 0.051 for v in set(x.tolist()))
    numbered = order.numbered(spark.range(100).selectExpr("id % 3 AS g", "id AS k"), "g", "k").collect()
    assert all(r.row_no == r.k // 3 for r in numbered)
    assert order.percentiles(df.limit(0), ["x"], [0.5]).count() == 0


def test_fusion(spark):
    cols = "score_id int, risk_score double, detected_type string, port_risk_combined double"
    got = {r.score_id: r for r in scoring.fused_priority(spark.createDataFrame([(1, 80.0, "Peel_Chain", 1.0), (2, 20.0, "Whitelisted_Institutional", 0.0), (3, 20.0, None, float("nan"))], cols)).collect()}
    assert got[1].priority == 0.5 * 80 + 25 + 15 and got[2].priority == 1.5 and got[2].tier == "Low" and got[3].score_network == 0.0


def test_range_lookup(spark):
    ranges = spark.createDataFrame([(0x0A000000, 0x0AFFFFFF, "ten"), (0x08080800, 0x080808FF, "dns")], "lo long, hi long, org string")
    rows = spark.createDataFrame([("10.9.8.7",), ("8.8.8.8",), ("8.8.9.9",), ("fd00::1",), (None,)], "ip string")
    assert {r.ip: r.org for r in scoring.range_lookup(rows, "ip", ranges).collect()} == {"10.9.8.7": "ten", "8.8.8.8": "dns", "8.8.9.9": None, "fd00::1": None, None: None}


def test_features(spark):
    t = canonical(generator.transactions(spark, 400))
    f = features.feature_matrix(t)
    assert f.count() == 400
    names = [c for c in f.columns if c != "row_idx"]
    kept = features.informative(f, names)
    assert "dst_port_risk" not in kept and "amount_btc_scaled" in kept
    with pytest.raises(ValueError):
        features.leak_free(["fan_in", "attack_type"])
    folds = features.fold_of(f.select("row_idx", F.lit("a").alias("y")), "y", "row_idx", 4).groupBy("fold").count().collect()
    assert {r["count"] for r in folds} == {100}


def test_isolation_forest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))] + [(1000 + i, 9.0 + i, -9.0) for i in range(6)] + [(2000, None, float("inf"))]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    forest = iforest.fit(df, "id", ["a", "b"], trees=60)
    score = {r.id: r.anomaly_score for r in iforest.score(df, "id", ["a", "b"], forest).collect()}
    assert len(score) == 607 and min(score[1000 + i] for i in range(6)) > np.percentile([score[i] for i in range(600)], 98)
    again = {r.id: r.anomaly_score for r in iforest.score(df.repartition(7), "id", ["a", "b"], iforest.fit(df.repartition(3), "id", ["a", "b"], trees=60)).collect()}
    assert again == score


def test_hdbscan_finds_blobs():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.1, (60, 2)), rng.normal(5, 0.1, (50, 2)), rng.uniform(-20, 20, (5, 2))])
    label = clusters.hdbscan(x, 10)
    assert len(set(label[:60]) - {-1}) == 1 and len(set(label[60:110]) - {-1}) == 1 and label[0] != label[60]
    assert (label[:110] >= 0).mean() > 0.9 and set(label[110:]) <= {-1, label[0], label[60]}


def test_density_clusters_learn_from_all_entities(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (4200, 3)), rng.normal(30, 0.1, (12, 3)), rng.normal(-30, 0.1, (300, 3)), np.full((15, 3), 60.0)])
    df = spark.createDataFrame([(f"e{i:05}", *map(float, r)) for i, r in enumerate(x)], "e string, a double, b double, c double")
    got = {r.e: r.behaviour_cluster for r in clusters.behaviour_clusters(df, "e", ["a", "b", "c"]).collect()}
    label = [got[f"e{i:05}"] for i in range(len(x))]
    for a, b in ((4200, 4212), (4512, 4527)):
        assert len(set(label[a:b])) == 1 and label[a] != "Outlier" and label.count(label[a]) == b - a
    y = np.round(np.vstack([x[:400], x[4190:]]), 1)
    core = np.array([np.sort(np.sqrt(((y - p) ** 2).sum(1)))[9] for p in y])
    for alone in (10**9, 0):  # on the driver, and by tasks
        monkeypatch.setattr(clusters, "ALONE", alone)
        tree = clusters.reachability_tree(spark, y, 10)
        assert len(tree) == len(y) - 1 and np.allclose(np.sort(tree[:, 2]), np.sort(clusters.spanning_tree(y, core)[:, 2]))


def test_profiles_are_whole():
    from tracewell.plans import models

    assert set(models.PROFILE) >= {"total_btc", "mean_risk"} and len(models.PROFILE) == 10


def test_trees_find_what_divides_the_labels():
    from tracewell.ml import supervised as S

    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    edges = S.edges_of(x)
    bins = S.binned(x, edges)
    assert all((np.searchsorted(e, c, "left") == b).all() for e, c, b in zip(edges, x.T, bins.T))
    tree = S.grow(bins, y, np.ones(800), np.random.default_rng(2), 64, 4)
    assert np.abs(S.probability([tree], bins) - y).max() < 0.51 and np.mean((S.probability([tree], bins) > 0.5) == y) > 0.99
    assert S.grow(bins, np.ones(800), np.ones(800), rng, 64, 4)["p"].tolist() == [1.0]
    assert len(S.grow(bins, y, np.ones(800), rng, 1, 4)) == 3


def test_isotonic_steps():
    from tracewell.ml import supervised as S

    place, level = S.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]))
    assert place.tolist() == [0.1, 0.2, 0.3, 0.4] and np.allclose(level, [0, 1 / 3, 1 / 3, 1])
    assert np.interp(0.7, *S.isotonic(np.zeros(0), np.zeros(0))) == 0.7


def test_calibrated_forests_learn_from_all_other_folds(spark):
    from tracewell.ml import supervised

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(rng.normal() + 3 * (i % 6 == 0)), float(rng.normal()), i % 6 == 0) for i in range(180)], "id long, a double, b double, y boolean")
    dealt = supervised.assembled(df, "id", ["a", "b"], "y", 5, 3).groupBy("fold", "part", "label").count().collect()
    assert {(r.label, r["count"]) for r in dealt} == {(1.0, 2), (0.0, 10)} and len(dealt) == 30
    got = {r.id: r for r in supervised.out_of_fold(df, "id", ["a", "b"], "y", trees=12).collect()}
    assert sorted(got) == list(range(180)) and all(0 <= r.ml_probability <= 100 for r in got.values())
    assert np.mean([r.ml_probability for r in got.values() if r.label]) > 30 + np.mean([r.ml_probability for r in got.values() if not r.label])
    again = {r.id: r for r in supervised.out_of_fold(df.repartition(7), "id", ["a", "b"], "y", trees=12).collect()}
    assert again == got
    few = supervised.out_of_fold(df, "id", ["a", "b"], "y", trees=12, most=60)
    assert few.count() == 180


def test_calibrated_forests_are_kept_as_plain_arrays(spark):
    from tracewell.ml import supervised as S

    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2))
    model = S.fit(spark, x, (x[:, 0] > 0).astype(float), np.arange(120) % 3, 3, 5, 64)
    back = S.unpacked(S.packed(model))
    assert all((a == b).all() for a, b in zip(model.predict(x), back.predict(x)))
    assert np.mean((model.predict(x)[1] > 0.5) == (x[:, 0] > 0)) > 0.9


def test_louvain_finds_cliques(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abc" for i in range(6) for j in range(i)] + [("a0", "b0", 1.0), ("b0", "c0", 1.0)]
    df = spark.createDataFrame(edges, "a string, b string, w double")
    names = clusters.louvain(df)
    got = {r.node: r.community for r in names.collect()}
    assert len(got) == 18 and clusters.modularity(df, names) > 0.55
    sizes = clusters.community_names(names).collect()
    assert {r.graph_community for r in sizes if r.size == max(x.size for x in sizes)} >= {"Community 1"}


def test_louvain_goes_on_until_no_communities_merge(spark):
    n = 90
    df = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", 1.0) for i in range(n)], "a string, b string, w double")
    names = clusters.louvain(df)
    got = {r.node: r.community for r in names.collect()}
    degree = {}
    for i in range(n + 1):
        degree[got[f"n{i:03}"]] = degree.get(got[f"n{i:03}"], 0) + (1 if i in (0, n) else 2)
    between = {}
    for i in range(n):
        a, b = sorted((got[f"n{i:03}"], got[f"n{i + 1:03}"]))
        if a != b:
            between[a, b] = between.get((a, b), 0) + 1
    assert len(got) == n + 1 and between and all(w <= degree[a] * degree[b] / (2 * n) + 1e-6 for (a, b), w in between.items())


def test_generator_is_the_same_on_any_cluster(spark):
    a = generator.transactions(spark, 200).collect()
    b = generator.transactions(spark, 200).repartition(9).orderBy("row_idx").collect()
    assert a == b and {r.attack_type for r in a} > {"Normal"}


def test_stored_forest(spark, tmp_path):
    from tracewell.ml import store

    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(rng.normal(size=80))], "id int, a double")
    forest = iforest.fit(df, "id", ["a"], trees=5)
    assert len(store.save_forest(spark, str(tmp_path / "m"), forest, ["a"])) == 64
    assert all((x == y).all() for x, y in zip(store.load_forest(spark, str(tmp_path / "m"), ["a"]), forest))
    assert store.load_forest(spark, str(tmp_path / "m"), ["b"]) is None


def test_explanations(spark):
    from tracewell.operators import explain

    rows = [(i, 10.0 if i else 90.0, 1.0 + i % 3, 0.1 * (i % 5)) for i in range(50)] + [(99, 95.0, 50.0, 0.0), (100, 60.0, None, None)]
    df = spark.createDataFrame(rows, "id int, score double, fan_in double, fee double")
    labels = {k: explain.LABELS[k] for k in ("fan_in", "fee")}
    p = explain.profiled(df, explain.profile(df, labels))
    none = F.array().cast("array<string>")
    got = {r.id: r.t for r in p.select("id", explain.explanation(F.col("score"), none, labels).alias("t")).collect()}
    assert got[1] == "Normal network traffic behavior." and "Input address count of 50" in got[99] and got[100].endswith("Multivariate anomaly.")
    noted = spark.range(1).select(explain.with_intelligence(F.lit("Old."), F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(3), F.lit("bad")).alias("t"), explain.with_outlier(F.lit("x"), F.lit("Outlier")).alias("o")).collect()[0]
    assert noted.t == "3 hop(s) from known-bad indicator (bad). Old." and noted.o == "x. Entity behaves unlike every known group (HDBSCAN outlier)."
