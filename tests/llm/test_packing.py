"""Containers and their bound."""

import random

import numpy as np

from tracewell.llm import packing as P


def test_best_fit_holds_capacity_and_fills():
    rng = random.Random(1)
    for _ in range(30):
        sizes = np.array(sorted((rng.randrange(1, 101) for _ in range(300)), reverse=True))
        bins = P.best_fit(sizes, 100)
        fill = np.bincount(bins, sizes)
        assert fill.max() <= 100
        bound = P.lower_bound(*np.unique(sizes, return_counts=True), 100)
        assert bound <= len(fill) <= bound * 1.23 + 1


def test_bound_beats_the_plain_sum_and_stays_below_the_optimum():
    big = np.array([51]), np.array([10])
    assert P.lower_bound(*big, 100) == 10
    assert P.lower_bound(np.array([34]), np.array([9]), 100) == 5
    assert P.lower_bound(np.array([50]), np.array([9]), 100) == 5
    assert P.lower_bound(np.array([100, 1]), np.array([3, 5]), 100) == 4


def pack(spark, counts, capacity=100, **options):
    df = spark.createDataFrame(counts, "doc string, n int")
    return P.fill(P.pieces(df, "doc", "n", capacity), capacity, **options).collect()


def test_whole_items_and_cut_ones(spark):
    rng = random.Random(2)
    counts = [(f"d{i}", rng.randrange(0, 60)) for i in range(3000)] + [("long", 1234), ("full", 100), ("none", None), ("same", 7), ("same", 7)]
    rows = pack(spark, counts, each=400)
    fill, per = {}, {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.size
        per.setdefault(r.item, []).append((r.piece, r.size))
    assert max(fill.values()) <= 100
    assert sorted(per["long"])[-1] == (12, 34) and len(per["long"]) == 13 and all(len(v) == 1 for k, v in per.items() if k not in ("long", "same"))
    total = sum(n for _, n in counts if n)
    assert sum(fill.values()) == total and "none" not in per and len(per["same"]) == 2
    assert len(fill) <= total / 100 * 1.01 + 2


def test_partitions_exchange_what_does_not_fit(spark):
    counts = [(f"d{i}", 51 if i % 2 else 49) for i in range(400)]
    few = len({r.container_id for r in pack(spark, counts, each=20)})
    none = len({r.container_id for r in pack(spark, counts, each=20, rounds=0)})
    assert 200 <= few < none


def test_certificate(spark):
    df = spark.createDataFrame([(f"d{i}", 1 + i % 40) for i in range(2000)], "doc string, n int")
    items = P.pieces(df, "doc", "n", 100)
    r = P.certificate(P.fill(items, 100, each=300), 100).collect()[0]
    assert r["items"] == 2000 and r.total_size == 2000 * 20.5 and r.bound <= r.containers <= r.bound + 1 and r.fullest <= 100
    assert P.certificate(P.fill(items.limit(0), 100), 100).collect()[0].containers == 0


def test_empty(spark):
    assert pack(spark, []) == [] and pack(spark, [("a", 0)]) == []
