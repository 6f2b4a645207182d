"""Consolidating pairwise matches into groups: peel the giant component, label the rest by minimum propagation.

1. Each task replaces its pairs by a forest that links the same values (``graph.forests``), so repeated pairs and paths within a task are gone before a shuffle. Values are numbered in the
   order of their bytes; from here on only longs move, and the smallest number of a group is its smallest value.
2. Breadth-first frontier joins start at the vertex of highest degree. Each round is one join of the frontier with the edges. Where only a thin frontier is left (the end of a
   long chain needs as many rounds as the chain has links), one star round halves all paths, and the search goes on along the shorter ones, until no edge leaves what was reached.
3. What was reached is a whole component; an anti-join takes its edges away.
4. The small components that are left are labelled by minimum propagation in stars, in rounds that grow with the logarithm of the longest path.

Nothing is collected but counts. Each round is written to the shared folder, which cuts the lineage. Frontiers are broadcast behind a count of their rows, else shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import graph
from tracewell.runtime import BROADCAST_ROWS, Scratch

#: A frontier below this share of what has been reached is thin; paths are halved once that many rounds have passed.
THIN = 1 / 6
ROUNDS = 4


def usable(side: str) -> Column:
    """A side without surrounding blanks; null for blank ones."""
    x = F.regexp_replace(F.col(side), r"^\s+|\s+$", "")
    return F.when(x != "", x)


def hint(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def peel(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, DataFrame] | None:
    """The component of the vertex of highest degree (ties: the smallest) as ``u``, its smallest vertex, and the edges (perhaps with halved paths) of all components."""
    spark = edges.sparkSession
    degrees = graph.both_ways(edges).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    start = degrees.agg(F.max(F.struct("n", (-F.col("u")).alias("o"))).alias("m")).select(-F.col("m.o")).collect()[0][0]
    if start is None:
        return None
    level, n, least = scratch.cut(spark.createDataFrame([(start,)], "u long"), "level"), 1, start
    reached, size, rounds = scratch.cut(level, "reached-0"), 1, 0
    k = 0
    while True:
        k, rounds = k + 1, rounds + 1
        near = graph.both_ways(edges).join(hint(level, n), "u", "left_semi").select(F.col("v").alias("u")).distinct()
        level, seen = scratch.measured(near.join(hint(reached, size), "u", "left_anti"), "level", n=F.count(F.lit(1)), least=F.min("u"))
        n = seen["n"]
        if not n:
            return reached, least, edges
        least, size = min(least, seen["least"]), size + n
        reached = scratch.cut(reached.unionByName(level), f"reached-{k % 2}")
        if rounds >= ROUNDS and n < THIN * size:
            edges, _ = graph.star_round(edges, scratch, "halved")
            level, n, rounds = reached, size, 0


def components(df: DataFrame, a: str, b: str) -> DataFrame:
    """``address`` and ``group_id`` of every distinct non-blank trimmed value of the two columns; the id is the smallest value (by bytes) of the group.

    Pairs with a null or blank side, and pairs of a value with itself, link nothing but still name their values. Repeated and turned pairs count once.
    Other columns are not read. An empty table gives no row.
    """
    scratch = Scratch(df.sparkSession, "components")
    linked = scratch.cut(graph.forests(df.select(usable(a).alias("a"), usable(b).alias("b"))), "forests")
    ids = scratch.cut(graph.numbered(linked, "x"), "ids")
    of = lambda x, name: ids.select(F.col("x").alias(x), F.col("id").alias(name))
    edges = scratch.cut(linked.where("x <> root").join(of("x", "u"), "x").join(of("root", "v"), "root").select("u", "v").distinct(), "edges")
    peeled = peel(edges, scratch)
    if peeled is None:
        return ids.select(F.col("x").alias("address"), F.col("x").alias("group_id"))
    reached, root, edges = peeled
    label = graph.stars(edges.join(reached, "u", "left_anti"), scratch)
    name = ids.where(F.col("id") == root).select("x").scalar()
    groups = label.join(of("group_id", "v"), "v").select("u", "group_id").unionByName(reached.select("u", name.alias("group_id")))
    return ids.join(groups, F.col("id") == F.col("u"), "left").select(F.col("x").alias("address"), F.coalesce("group_id", "x").alias("group_id"))
