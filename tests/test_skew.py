"""Totals per key from range partitions with stitched boundaries."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from tracewell.operators.skew import split_totals

SCHEMA = "u long, k string, t timestamp_ntz, v long, gap string, key string, total long"


def brute(rows):
    groups = defaultdict(list)
    for u, k, t, v, *_ in rows:
        if k and k.strip():
            groups[k.strip()].append((t or datetime.min, u, t, v))
    out = {}
    for k, g in groups.items():
        g.sort(key=lambda r: (r[0], r[1]))
        ts = [r[2] for r in g if r[2]]
        gaps = [int((b - a).total_seconds() * 1e6) for a, b in zip(ts, ts[1:])]
        vs = [r[3] for r in g if r[3] is not None]
        out[k] = (len(g), sum(vs), len(vs), min(ts, default=None), max(ts, default=None), max(gaps, default=None))
    return out


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    start = datetime(2026, 7, 1)
    rows = []
    for u in range(4000):
        k = rng.choice(["hot"] * 6 + [f"k{rng.randrange(200)}", " hot ", None, " "])
        t = None if rng.random() < 0.05 else start + timedelta(seconds=rng.randrange(50_000))
        rows.append((u, k, t, None if rng.random() < 0.1 else rng.randrange(1000), "clash", "clash", 1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.key: (r.n, r.total or 0, r.measured, r.first_at, r.last_at, r.longest_gap_us) for r in split_totals(df, "k", "t", "v", "u", slices=7).collect()}
    assert got == brute(rows)


def test_heavy_keys_are_split(spark):
    df = spark.range(20_000).selectExpr("id AS u", "'one' AS k", "timestamp_micros(id * 1000000) AS t", "id AS v")
    ranged = df.repartitionByRange(8, "k", "t", "u").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(ranged) == 8 and max(r["count"] for r in ranged) < 5000
    r = split_totals(df, "k", "t", "v", "u", slices=8).collect()[0]
    assert (r.n, r.longest_gap_us) == (20_000, 1_000_000)


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(1, "a", datetime(2026, 7, 1), 5)] * 9, "u long, k string, t timestamp_ntz, v long")
    r = split_totals(df, "k", "t", "v", "u", slices=4).collect()[0]
    assert (r.n, r.total, r.longest_gap_us) == (9, 45, 0)
    assert split_totals(df.limit(0), "k", "t", "v", "u").count() == 0
