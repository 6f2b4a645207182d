"""Louvain communities against brute force: no node gains by a move, no communities merge."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.ml import clusters, communities
from tracewell.runtime import Scratch


def planted(seed, n=60, groups=6):
    rng = random.Random(seed)
    pairs = {(i, j): round(rng.random() + 0.1, 3) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.5 if i % groups == j % groups else 0.03)}
    return pairs | {(n + i, n + i + 1): 1.0 for i in range(20)} | {(0, n + 30 + i): 0.5 for i in range(9)}


def gains(pairs, found, degree=None):
    """The most that a node gains by a move to another community or to one of its own, and that two communities gain by a merge, in weight."""
    k, into = dict(degree or {}), {}
    for (a, b), w in pairs.items():
        for x, y in ((a, b), (b, a)):
            if not degree or x not in degree:
                k[x] = k.get(x, 0) + w
            into[x, found[y]] = into.get((x, found[y]), 0) + w
    twice, tot = sum(k.values()), {}
    for x, w in k.items():
        tot[found[x]] = tot.get(found[x], 0) + w
    stay = {x: into.get((x, found[x]), 0) - k[x] * (tot[found[x]] - k[x]) / twice for x in k}
    move = max([w - k[x] * tot[c] / twice - stay[x] for (x, c), w in into.items() if c != found[x]] + [-s for s in stay.values()])
    between = {}
    for (x, c), w in into.items():
        between[found[x], c] = between.get((found[x], c), 0) + w
    return move, max([w - tot[c] * tot[d] / twice for (c, d), w in between.items() if c != d], default=0)


@pytest.mark.parametrize("few", [0, 5, 2_000])
def test_no_node_gains_and_none_merge(monkeypatch, few):
    monkeypatch.setattr(communities, "FEW", few)
    monkeypatch.setattr(communities, "LINKS", 16)
    for seed in range(12):
        pairs = planted(seed)
        degree = {5: 9.0, 200: 3.0} if seed % 2 else {}
        rows = [(a, b, w) for (a, b), w in pairs.items()] + [(a, a, w) for a, w in degree.items()]
        node, to = communities.louvain(*(np.array(x) for x in zip(*rows)))
        found = dict(zip(node.tolist(), to.tolist()))
        move, merge = gains(pairs, found, degree)
        assert move < 1e-6 and merge < 1e-6
        assert all(found[c] == c and c <= x for x, c in found.items())
        shuffled = random.Random(1).sample(rows, len(rows))
        again = communities.louvain(*(np.array(x) for x in zip(*shuffled)))
        assert dict(zip(again[0].tolist(), again[1].tolist())) == found


def frame(spark, pairs):
    return spark.createDataFrame([(f"n{a:03}", f"n{b:03}", w) for (a, b), w in pairs.items()], "a string, b string, w double")


def test_a_held_graph_takes_no_rounds_of_tables(spark, monkeypatch):
    """Each round of moves used to be a written table and some eight shuffles."""
    cuts, cut = [], Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, slot: cuts.append(slot) or cut(self, df, slot))
    pairs = planted(3)
    found = {r.node: r.community for r in clusters.louvain(frame(spark, pairs)).collect()}
    assert len(cuts) <= 8
    move, merge = gains({(f"n{a:03}", f"n{b:03}"): w for (a, b), w in pairs.items()}, found)
    assert move < 1e-6 and merge < 1e-6


@pytest.mark.parametrize("held", [0, 60])
def test_a_graph_that_no_task_holds(spark, held):
    pairs = planted(4)
    df = frame(spark, pairs)
    whole, levels = clusters.louvain(df), clusters.louvain(df, held)
    found = {r.node: r.community for r in levels.collect()}
    assert set(found) == {r.node for r in whole.collect()}
    assert all(found[c] == c and c <= x for x, c in found.items())
    assert clusters.modularity(df, levels) > clusters.modularity(df, whole) - 0.05
    assert gains({(f"n{a:03}", f"n{b:03}"): w for (a, b), w in pairs.items()}, found)[1] < 1e-6


def test_nodes_of_one_hash_and_no_edges(spark, monkeypatch):
    real, calls = F.xxhash64, []
    monkeypatch.setattr(clusters.F, "xxhash64", lambda *c: real(*c) if calls else calls.append(1) or F.lit(7).cast("long"))
    pairs = {(0, 1): 1.0, (2, 3): 1.0, (4, 4): 2.0}
    assert {r.node: r.community for r in clusters.louvain(frame(spark, pairs)).collect()} == {"n000": "n000", "n001": "n000", "n002": "n002", "n003": "n002"}
    assert clusters.louvain(frame(spark, {(4, 4): 2.0})).count() == 0
