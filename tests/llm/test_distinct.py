"""Sketches of distinct counts."""

import random
from datetime import datetime, timedelta

import numpy as np

from tracewell.llm import distinct as D

SCHEMA = "t timestamp_ntz, g string, h int, i string, sketch string, level string"
KEYS = ["id_name", "level", "day", "g", "h"]


def table(spark, n=6000, seed=1):
    rng = random.Random(seed)
    start = datetime(2026, 7, 1)
    rows = []
    for _ in range(n):
        i = rng.choice(["hot", " hot ", None, " ", *[f"id{rng.randrange(3000)}"] * 5])
        rows.append((start + timedelta(hours=rng.randrange(72)), rng.choice(["a", "b", None]), rng.choice([1, 2, None]), i, "clash", "clash"))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def exact(rows):
    out = {}
    for t, g, h, i, *_ in rows:
        if i and i.strip():
            for level, key in (("g,h", (g, h)), ("g", (g, None)), ("h", (None, h)), ("", (None, None))):
                out.setdefault((level, t.date(), key[0], None if key[1] is None else str(key[1])), set()).add(i.strip())
    return {k: len(v) for k, v in out.items()}


def test_against_exact_counts(spark):
    rows, df = table(spark)
    got = D.merge(D.sketches(df, "t", ["g", "h"], {"i": D.hashed("i")}), KEYS).collect()
    want = exact(rows)
    assert {(r.level, r.day, r.g, r.h) for r in got} == set(want)
    for r in got:
        n = want[(r.level, r.day, r.g, r.h)]
        assert r.low <= n <= r.high or abs(r.distinct_count / n - 1) < 5 * D.SIZE.error
        assert n >= D.SIZE.listed or r.distinct_count == n


def test_merging_days_gives_the_sketch_of_all_rows(spark):
    _, df = table(spark, 8000)
    keys = ["id_name", "level", "g", "h"]
    parts = D.sketches(df, "t", ["g", "h"], {"i": D.hashed("i")})
    by_days = {tuple(r)[:4]: r for r in D.union(D.merge(parts, KEYS), keys).collect()}
    at_once = {tuple(r)[:4]: r for r in D.merge(D.sketches(df, None, ["g", "h"], {"i": D.hashed("i")}), keys).collect()}
    assert by_days.keys() == at_once.keys() and all(by_days[k].sketch == at_once[k].sketch for k in by_days)


def test_error_of_full_sketches():
    rng = np.random.default_rng(3)
    errors = []
    for n in (5_000, 50_000, 400_000):
        for _ in range(8):
            index, mask = D.registers(rng.integers(0, 2**64, n, dtype=np.uint64), D.SIZE)
            errors.append(D.full(np.zeros(n, np.int64), index, mask, 1, D.SIZE)[1][0] / n - 1)
    assert np.sqrt(np.mean(np.square(errors))) < 1.6 * D.SIZE.error and abs(np.mean(errors)) < 0.01


def test_states_round_trip():
    masks = np.array([1, 2, 3, 5, 7, 8, 12, 1 << 40, (1 << 40) | (1 << 38), (1 << 52) | (1 << 51)])
    kept = D.to_mask(D.to_state(masks))
    assert (D.to_state(kept) == D.to_state(masks)).all()


def test_small_and_large_join_without_loss(spark):
    big = spark.range(5000).selectExpr("timestamp_ntz'2026-07-01' AS t", "'a' AS g", "1 AS h", "concat('x', id) AS i")
    one = spark.range(1).selectExpr("timestamp_ntz'2026-07-02' AS t", "'a' AS g", "1 AS h", "'x1' AS i")
    days = D.merge(D.sketches(big.unionByName(one), "t", ["g", "h"], {"i": D.hashed("i")}), KEYS)
    alone = D.merge(D.sketches(big, "t", ["g", "h"], {"i": D.hashed("i")}), KEYS).where("level = ''").collect()[0]
    both = D.union(days, ["id_name", "level", "g", "h"]).where("level = ''").collect()[0]
    assert both.sketch == alone.sketch and abs(both.distinct_count / 5000 - 1) < 5 * D.SIZE.error


def test_empty_and_null_only(spark):
    _, df = table(spark, 50)
    assert D.merge(D.sketches(df.limit(0), "t", ["g", "h"], {"i": D.hashed("i")}), KEYS).count() == 0
    assert D.merge(D.sketches(df.selectExpr("t", "g", "h", "cast(null AS string) AS i"), "t", ["g", "h"], {"i": D.hashed("i")}), KEYS).count() == 0
    nulls = df.selectExpr("cast(null AS timestamp_ntz) AS t", "cast(null AS string) AS g", "cast(null AS int) AS h", "repeat('y', 100000) AS i")
    assert {r.distinct_count for r in D.merge(D.sketches(nulls, "t", ["g", "h"], {"i": D.hashed("i")}), KEYS).collect()} == {1.0}


def test_full_sketches_of_many_tasks_meet_in_two_steps(spark):
    size = D.Size(6)
    df = spark.range(0, 40_000, 1, 16).selectExpr("timestamp_ntz'2026-07-01' AS t", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS g", "1 AS h", "concat('x', id % 9000) AS i")
    got = {r.g: r for r in D.merge(D.sketches(df, "t", ["g", "h"], {"i": D.hashed("i")}, size), KEYS, size).where("level = 'g,h'").collect()}
    one = {r.g: r for r in D.merge(D.sketches(df.coalesce(1), "t", ["g", "h"], {"i": D.hashed("i")}, size), KEYS, size).where("level = 'g,h'").collect()}
    assert got == one and all(len(r.sketch) == size.m for r in got.values())
    assert all(abs(got[g].distinct_count / n - 1) < 5 * size.error for g, n in (("a", 3000), ("b", 6000)))
