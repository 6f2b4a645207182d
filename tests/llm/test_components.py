"""Groups from pairs."""

import random

from tracewell.llm.components import components

SCHEMA = "link_id long, address_a string, address_b string, address string, group_id string, u string"


def union_find(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = (x.strip() or None if x else None for x in (a, b))
        for x in (a, b):
            if x:
                parent.setdefault(x, x)
        if a and b and find(a) != find(b):
            lo, hi = sorted((find(a), find(b)), key=lambda s: s.encode())
            parent[hi] = lo
    return {x: find(x) for x in parent}


def check(spark, pairs):
    df = spark.createDataFrame([(i, a, b, "clash", "clash", "clash") for i, (a, b) in enumerate(pairs)], SCHEMA)
    rows = components(df, "address_a", "address_b").collect()
    assert {r.address: r.group_id for r in rows} == union_find(pairs) and len(rows) == len(union_find(pairs))


def test_random_graph_with_giant_chains_stars_and_dirt(spark):
    rng = random.Random(7)
    pairs = [(f"v{rng.randrange(900)}", f"v{rng.randrange(900)}") for _ in range(700)]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(150)] + [("hub", f"s{i}") for i in range(200)] + [("v1", "c75")]
    pairs += [(b, a) for a, b in pairs[:50]] + pairs[:20]
    pairs += [("solo", "solo"), ("alone", None), (None, "alone2"), ("", " "), (None, None), (" v1 ", "padded"), ("Zß", "zé")]
    rng.shuffle(pairs)
    check(spark, pairs)


def test_chain_only(spark):
    check(spark, [(f"n{i:04}", f"n{i + 1:04}") for i in range(300)])


def test_no_edges_and_empty(spark):
    check(spark, [("a", None), ("b", "b"), (None, "x" * 50_000)])
    df = spark.createDataFrame([], SCHEMA)
    assert components(df, "address_a", "address_b").count() == 0
