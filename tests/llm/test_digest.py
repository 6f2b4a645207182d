"""Percentiles from digests of single days."""

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import digest as G

KINDS = {"k": "k", "day": None}
M = ("x", "y")


def table(spark, n=20_000, seed=1):
    rng = np.random.default_rng(seed)
    x, y = rng.lognormal(0, 2, n), np.round(rng.normal(size=n), 1)
    rows = [(int(i), f"2026-07-{1 + i % 5:02}", ["big", "big", "small" if i % 97 == 0 else "big", None, " "][i % 5], float(x[i]) if i % 11 else None, float(y[i]), "clash", "clash") for i in range(n)]
    rows += [(n, "2026-07-01", "big", float("nan"), float("inf"), "", ""), (n + 1, None, "big", 1.0, 1.0, "", "")]
    return spark.createDataFrame(rows, "i long, d string, k string, x double, y double, m string, mean string").select("*", F.col("d").cast("date").alias("t")).repartition(6)


def groups(df):
    pdf = df.toPandas()
    out = {}
    for m in M:
        ok = pdf[np.isfinite(pdf[m].astype(float))]
        for k, g in ok[ok.k.notna() & (ok.k.str.strip() != "")].groupby("k"):
            out[("k", k, m)] = g[m].to_numpy(float)
        for k, g in ok[ok.d.notna()].groupby("d"):
            out[("day", k, m)] = g[m].to_numpy(float)
    return out


def test_rank_errors_and_exact_groups(spark):
    df = table(spark)
    found = G.estimates(G.combined(G.daily(df, "t", KINDS, M), M), M)
    rows = G.certified(df, found, "t", KINDS, M).collect()
    want = groups(df)
    assert {(r.kind, r.key, r.measure) for r in rows} == set(want)
    for r in rows:
        v = np.sort(want[(r.kind, r.key, r.measure)])
        assert r.n == len(v)
        for q, est, err in zip(G.QUANTILES, r.q, r.rank_error):
            lo, hi = np.searchsorted(v, est, "left") / len(v), np.searchsorted(v, est, "right") / len(v)
            true = max(0.0, lo - q, q - hi)
            assert true <= G.BOUND + 1 / len(v)
            if r.exact:
                assert np.isclose(est, np.quantile(v, q)) and err == 0
            else:
                assert abs(err - true) < 1e-9


def test_estimates_beyond_the_bound_become_exact(spark):
    df = table(spark)
    found = G.estimates(G.combined(G.daily(df, "t", KINDS, M), M), M)
    rows = G.certified(df, found, "t", KINDS, M, bound=1e-5).collect()
    want = groups(df)
    assert {(r.kind, r.key, r.measure) for r in rows} == set(want) and len(rows) == len(want)
    assert max(max(r.rank_error) for r in rows) <= 1e-5 and any(r.exact and r.n > G.EXACT for r in rows)
    for r in rows:
        if r.exact:
            assert r.n == len(want[(r.kind, r.key, r.measure)]) and np.allclose(r.q, np.quantile(want[(r.kind, r.key, r.measure)], G.QUANTILES))


def test_days_combine_in_any_order(spark):
    df = table(spark, 6000)
    days = G.daily(df, "t", KINDS, M)
    a = {(r.kind, r.key, r.measure): r for r in G.estimates(G.combined(days, M), M).collect()}
    b = {(r.kind, r.key, r.measure): r for r in G.estimates(G.regrouped(days.orderBy(F.rand(3)), M), M).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k].n == b[k].n and np.allclose(a[k].q, b[k].q, rtol=0.2, atol=0.2)


def test_equal_values_stay_to_the_last_bit(spark):
    df = spark.range(5000).selectExpr("id AS i", "'k' AS k", "date'2026-07-01' AS t", "0.1 AS x", "0.32D AS y")
    rows = G.estimates(G.combined(G.daily(df, "t", KINDS, M), M), M).collect()
    assert {tuple(r.q) for r in rows if r.measure == "y"} == {(0.32, 0.32, 0.32)}


def test_empty(spark):
    df = table(spark, 10).limit(0)
    found = G.estimates(G.combined(G.daily(df, "t", KINDS, M), M), M)
    assert G.certified(df, found, "t", KINDS, M).count() == 0
