"""Behaviour of entities: standardised profiles, density clusters, principal components, communities."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.ml import communities
from tracewell.runtime import Scratch, partitions, small_side, with_row

NEAR = 24  # nearest entities that are kept of each; edges beyond them are searched for where a tree needs them
CELLS = 4_000_000  # distances held at once
LEAST_GAIN = 1e-7  # modularity that a round of moves must gain to count
PATIENCE = 5  # rounds of moves without it after which a level of communities ends
ALONE = 5_000_000  # distances that are no job of their own
HELD = 5_000_000  # edges of a graph that one task divides into communities (about 200 bytes an edge)


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features less their mean over their population deviation (1 where that is 0); nulls count as 0."""
    x = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features}
    stats = df.agg(*[F.avg(x[f]).alias(f"m_{f}") for f in features], *[F.stddev_pop(x[f]).alias(f"s_{f}") for f in features])
    return with_row(df, stats).withColumns({f: (x[f] - F.col(f"m_{f}")) / F.when(F.col(f"s_{f}") > 0, F.col(f"s_{f}")).otherwise(1.0) for f in features}).select(*df.columns)


def spanning_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Prim's tree of the mutual reachability distances: rows (a, b, distance), a row of distances at a time."""
    n = len(x)
    best, link, done = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    at, out = 0, []
    for _ in range(n - 1):
        done[at] = True
        d = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(1)), core), core[at])
        closer = (d < best) & ~done
        best[closer], link[closer] = d[closer], at
        at = int(np.argmin(np.where(done, np.inf, best)))
        out.append((link[at], at, best[at]))
    return np.array(out)


def hdbscan(x: np.ndarray, least: int) -> np.ndarray:
    """Labels (-1: noise) by the excess-of-mass selection over the condensed tree (Campello et al., 2013)."""
    n = len(x)
    if n < 2 * least:
        return np.zeros(n, np.int64) if n >= least else np.full(n, -1)
    core = np.array([np.partition(np.sqrt(((x - p) ** 2).sum(1)), least - 1)[least - 1] for p in x])
    return selected(spanning_tree(x, core), n, least)


def selected(tree: np.ndarray, n: int, least: int) -> np.ndarray:
    """Labels of ``n`` points by their spanning tree."""
    tree = tree[np.argsort(tree[:, 2], kind="stable")]
    parent, size, kids, height = list(range(2 * n - 1)), [1] * n, {}, {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (a, b, d) in enumerate(tree):
        ra, rb, new = find(int(a)), find(int(b)), n + k
        parent[ra] = parent[rb] = new
        kids[new], height[new] = (ra, rb), d
        size.append(size[ra] + size[rb])

    def leaves(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += kids[j]
        return out

    clusters: dict[int, dict] = {0: {"birth": 0.0, "kids": [], "mass": 0.0, "members": []}}
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            clusters[c]["members"].append(node)
            continue
        rate = 1.0 / max(height[node], 1e-12)
        big = [k for k in kids[node] if size[k] >= least]
        gain = rate - clusters[c]["birth"]
        if len(big) == 2:
            clusters[c]["mass"] += gain * size[node]
            for k in kids[node]:
                new = len(clusters)
                clusters[new] = {"birth": rate, "kids": [], "mass": 0.0, "members": []}
                clusters[c]["kids"].append(new)
                todo.append((k, new))
            continue
        for k in kids[node]:
            if k in big:
                todo.append((k, c))
            else:
                clusters[c]["mass"] += gain * size[k]
                clusters[c]["members"] += leaves(k)
    chosen: set[int] = set()
    total: dict[int, float] = {}
    for c in sorted(clusters, reverse=True):
        below = sum(total[k] for k in clusters[c]["kids"])
        if clusters[c]["kids"] and (below > clusters[c]["mass"] or c == 0):
            total[c] = below
        else:
            total[c] = clusters[c]["mass"]
            todo2 = list(clusters[c]["kids"])
            while todo2:
                k = todo2.pop()
                chosen.discard(k)
                todo2 += clusters[k]["kids"]
            if c or not clusters[c]["kids"]:
                chosen.add(c)
    label = np.full(n, -1)
    for i, c in enumerate(sorted(chosen)):
        todo3 = [c]
        while todo3:
            k = todo3.pop()
            label[clusters[k]["members"]] = i
            todo3 += clusters[k]["kids"]
    return label


def nearest(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each of some points: its ``k`` nearest (itself among them), their distances, and a distance below which no other point lies."""
    norm = (x * x).sum(1)
    square = norm[ids][:, None] + norm - 2 * (x[ids] @ x.T)
    near = np.argpartition(square, k - 1, axis=1)[:, :k]
    d = np.sqrt(((x[near] - x[ids][:, None]) ** 2).sum(2))
    low = np.take_along_axis(square, near, 1).max(1) - 1e-13 * (norm[ids] + norm.max())  # less what cancellation may hide
    return np.column_stack([near, d, np.sqrt(np.maximum(low, 0)) if k < len(x) else np.full(len(ids), np.inf)])


def outward(x: np.ndarray, ids: np.ndarray, core: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Of each of some points: the nearest point, by mutual reachability, of another part, and its distance."""
    d = np.zeros((len(ids), len(x)))
    for column in x.T:
        d += (column[ids][:, None] - column) ** 2
    d = np.maximum(np.maximum(np.sqrt(d), core), core[ids][:, None])
    d[part[ids][:, None] == part] = np.inf
    to = d.argmin(1)
    return np.column_stack([to, d[np.arange(len(ids)), to]])


def spread(spark: SparkSession, work: Callable[..., np.ndarray], ids: np.ndarray, x: np.ndarray, *more) -> np.ndarray:
    """``work(x, some of the ids, *more)`` for all ids, in order: a row for each, computed by tasks that share the points."""
    step = max(1, CELLS // len(x))
    if len(ids) * len(x) <= ALONE:
        return np.vstack([work(x, ids[i : i + step], *more) for i in range(0, len(ids), step)])
    shared = spark.sparkContext.broadcast((work, ids, x, more))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, ids, x, more = shared.value
        for batch in it:
            at = np.asarray(batch.column(0))
            for i in range(0, len(at), step):
                some = at[i : i + step]
                rows = work(x, ids[some], *more)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([r.tobytes() for r in rows], pa.binary())], ["at", "row"])

    found = spark.range(0, len(ids), 1, partitions(spark, 2)).mapInArrow(run, "at long, row binary").toArrow().sort_by("at")
    shared.destroy()
    return np.frombuffer(b"".join(found.column("row").to_pylist())).reshape(len(ids), -1)


def reachability_tree(spark: SparkSession, x: np.ndarray, least: int) -> np.ndarray:
    """The spanning tree of the mutual reachability distances of all points, rows (a, b, distance), by Borůvka's rounds.

    A part's shortest edge outward is looked for among the nearest of its points; only points that may have a shorter one beyond those are compared with all.
    The largest part waits for the others, whose edges are enough.
    """
    n = len(x)
    k = min(n, max(NEAR, least))
    table = spread(spark, nearest, np.arange(n), x, k)
    near, d, low = table[:, :k].astype(np.int64), table[:, k : 2 * k], table[:, 2 * k]
    core = np.partition(d, least - 1, axis=1)[:, least - 1]
    reach, low = np.maximum(np.maximum(d, core[near]), core[:, None]), np.maximum(low, core)
    part, out = np.arange(n), []
    while len(out) < n - 1:
        w = np.where(part[near] != part[:, None], reach, np.inf)
        at = w.argmin(1)
        to, w = near[np.arange(n), at], w[np.arange(n), at]
        best = np.full(n, np.inf)
        np.minimum.at(best, part, w)
        moves = part != np.bincount(part).argmax()
        if len(unsure := np.flatnonzero(moves & (low < best[part]))):
            found = spread(spark, outward, unsure, x, core, part)
            shorter = found[:, 1] < w[unsure]
            to[unsure[shorter]], w[unsure[shorter]] = found[shorter, 0].astype(np.int64), found[shorter, 1]
        order = np.lexsort((w, part))
        order = order[moves[order]]
        first = order[np.unique(part[order], return_index=True)[1]]
        up = np.arange(n)

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i in first[np.argsort(w[first], kind="stable")]:
            a, b = find(part[i]), find(part[to[i]])
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((i, to[i], w[i]))
        for p in np.unique(part):
            up[p] = find(p)
        part = up[part]
    return np.array(out).reshape(-1, 3)


def behaviour_clusters(profile: DataFrame, key: str, features: Sequence[str], least: int = 10) -> DataFrame:
    """``key``, ``behaviour_cluster`` ("Cluster 1" .., or "Outlier"), learnt from all entities. Their standardised features and the spanning tree (about 500 bytes an entity) are held by the driver."""
    spark = profile.sparkSession
    rows = standardised(profile.select(F.col(key).alias("k"), *features), features).orderBy("k").toArrow()
    x = np.column_stack([rows.column(f).to_numpy() for f in features])
    n, least = len(x), min(least, max(2, len(x)))
    if n < 2 * least:
        label = np.zeros(n, np.int64) if n >= least else np.full(n, -1)
    else:
        label = selected(reachability_tree(spark, x, least), n, least)
    names = pa.array(["Outlier" if i < 0 else f"Cluster {i + 1}" for i in label], pa.string())
    return spark.createDataFrame(pa.table({key: rows.column("k"), "behaviour_cluster": names}))


def components_2d(profile: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """``key``, ``pc1``, ``pc2``: the first two principal components of the standardised profile (their sign is arbitrary)."""
    rows = VectorAssembler(inputCols=list(features), outputCol="x").transform(standardised(profile.select(key, *features), features))
    out = PCA(k=2, inputCol="x", outputCol="pc").fit(rows).transform(rows).withColumn("a", vector_to_array("pc"))
    return out.select(key, F.col("a")[0].alias("pc1"), F.col("a")[1].alias("pc2"))


def held_communities(graph: DataFrame) -> DataFrame:
    """``a``, ``c``: the communities of a graph that one task holds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if batches := list(it):
            columns = [np.concatenate([np.asarray(b.column(i)) for b in batches]) for i in range(3)]
            batches.clear()
            node, found = communities.louvain(columns.pop(0), columns.pop(0), columns.pop(0))  # held once
            for i in range(0, len(node), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(found[i : i + (1 << 16)])], ["a", "c"])

    return graph.coalesce(1).mapInArrow(run, "a long, c long")


def numbers(ends: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``node`` and ``id`` of all ends of edges, and the seed of the hash that gives the ids: the first by which no two nodes share one."""
    seed = 0
    while True:
        nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).select(F.xxhash64("node", F.lit(seed)).alias("id"), "node").groupBy("id", "node").agg(F.lit(1).alias("_one")).select("id", "node")
        nodes = scratch.cut(nodes, "nodes")
        if not nodes.groupBy("id").count().where("count > 1").limit(1).count():
            return nodes, seed
        seed += 1


def louvain(edges: DataFrame, held: int = HELD) -> DataFrame:
    """``node``, ``community`` of a weighted undirected graph (``a``, ``b``, ``w``): Louvain moves until no node gains by one, then the same on the graph of communities, until none merge.

    A graph of up to ``held`` edges is divided by one task, where single nodes move last and all nodes are looked at again at the end. A larger one goes through levels of synchronous moves until its communities are such a graph, or
    none merge. A community is named by its smallest node.
    """
    scratch = Scratch(edges.sparkSession, "louvain")
    ends = scratch.cut(edges.where("a <> b").select("a", "b", F.col("w").cast("double").alias("w")), "ends")
    nodes, seed = numbers(ends, scratch)
    a, b = F.xxhash64("a", F.lit(seed)), F.xxhash64("b", F.lit(seed))
    graph, seen = scratch.measured(ends.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w")), "graph", n=F.count(F.lit(1)), w=F.sum("w"))
    scratch.drop("ends")
    n, twice = seen["n"], 2 * (seen["w"] or 0.0)
    names: DataFrame | None = None
    degree: DataFrame | None = None  # of communities: what lies inside them counts on
    level, merged = 0, True
    while n > held and merged:
        names, degree, graph, n, merged = one_level(scratch, graph, names, degree, twice, level)
        level += 1
    if merged and n:
        rows = graph if degree is None else graph.unionByName(degree.select("a", F.col("a").alias("b"), F.col("k").alias("w")))
        found = scratch.cut(held_communities(rows), "found")
        names = scratch.cut(merged_names(names, found), "names")
    if names is None:
        return nodes.select("node", F.col("node").alias("community")).limit(0)
    rows = scratch.cut(nodes.join(names.select(F.col("node").alias("id"), "community"), "id").select("node", F.col("community").alias("c")), "rows")
    scratch.drop("nodes", "graph", "ways", "label", "found", "names")
    named = rows.groupBy("c").agg(F.min("node").alias("community"))
    done = scratch.cut(rows.join(named, "c").select("node", "community"), "named")
    scratch.drop("rows")
    return done


def merged_names(names: DataFrame | None, label: DataFrame) -> DataFrame:
    """Communities (``node``, ``community``) after those of a level (``a``) have merged into others (``c``)."""
    if names is None:
        return label.select(F.col("a").alias("node"), F.col("c").alias("community"))
    return names.join(label.select(F.col("a").alias("community"), F.col("c").alias("up")), "community", "left").select("node", F.coalesce("up", "community").alias("community"))


def one_level(scratch: Scratch, graph: DataFrame, names: DataFrame | None, degree: DataFrame | None, twice: float, level: int) -> tuple[DataFrame, DataFrame, DataFrame, int, bool]:
    """A level of synchronous moves: names, the degrees, graph and number of edges of the communities, and whether any merged.

    In a round only the half of the nodes chosen by a keyed hash may move, so that neighbours don't swap places; the share halves while moves made at once don't raise modularity. The level ends
    when no node would gain, or after ``PATIENCE`` such rounds, with its best division.
    """
    ways = scratch.cut(graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "ways")
    if degree is None:
        degree = ways.groupBy("a").agg(F.sum("w").alias("k"))
    label = scratch.cut(degree.withColumn("c", F.col("a")), "label")
    r, stale, moved, top, kept, last = 0, 0, 0, float("-inf"), "", ""
    while True:
        tot = label.groupBy("c").agg(F.sum("k").alias("tot"))
        near = ways.where("a <> b").join(label.select(F.col("a").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("into"))
        own = label.select("a", F.col("c").alias("mine"), "k")
        gain = near.join(tot, "c").join(own, "a").withColumn("g", F.col("into") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / twice)
        same = F.col("c") == F.col("mine")
        best = gain.groupBy("a").agg(F.max_by(F.struct("c", "g"), F.struct(F.col("g"), same)).alias("t"), F.max(F.when(same, F.col("g"))).alias("stay"), F.max(F.when(same, F.col("into"))).alias("inside"))
        wants = F.coalesce(F.col("t.g") > F.coalesce("stay", F.lit(0.0)) + 1e-9, F.lit(False))
        moves = wants & (F.pmod(F.xxhash64("a", F.lit(r)), F.lit(2 << stale)) == 0)
        new = label.join(best, "a", "left").select("a", "k", F.when(moves, F.col("t.c")).otherwise(F.col("c")).alias("c"), F.col("c").alias("old"), wants.alias("wants"), moves.alias("moves"), "inside")
        slot = f"moved-{level}-{r}"
        new = scratch.cut(new, slot)
        inside, wanting, moving = new.agg(F.sum("inside"), F.count_if("wants"), F.count_if("moves")).collect()[0]
        square = new.groupBy("old").agg(F.sum("k").alias("tot")).agg(F.sum(F.col("tot") * F.col("tot"))).collect()[0][0]
        q = (inside or 0.0) / twice - square / twice**2  # of the labels before the moves, less what no move of this level changes
        if q > top:
            scratch.drop(kept)
            stale, top, kept, found = 0 if q > top + LEAST_GAIN else stale + moved, q, slot, new.select("a", "k", F.col("old").alias("c"))
        else:
            stale += moved
        if last != kept:
            scratch.drop(last)
        if not wanting or stale >= PATIENCE:
            break
        label, last, moved, r = new.select("a", "k", "c"), slot, int(moving > 0), r + 1
    label = found
    named = label.groupBy("c").agg(F.min("a").alias("name"))
    label = scratch.cut(label.join(named, "c").select("a", F.col("name").alias("c"), "k"), f"named-{level}")
    scratch.drop(kept, last)
    names = scratch.cut(merged_names(names, label), "names")
    degree = label.groupBy(F.col("c").alias("a")).agg(F.sum("k").alias("k"))
    graph = ways.where("a < b").join(label.select("a", F.col("c").alias("ca")), "a").join(label.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w"))
    graph, seen = scratch.measured(graph, "graph", n=F.count(F.lit(1)))
    return names, degree, graph, seen["n"], bool(label.where("a <> c").limit(1).count())


def modularity(edges: DataFrame, names: DataFrame) -> float:
    """Modularity of a division: one aggregate row."""
    a, b = names.select(F.col("node").alias("a"), F.col("community").alias("ca")), names.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    e = edges.where("a <> b").join(a, "a").join(b, "b")
    inside = e.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)), F.sum("w")).collect()[0]
    deg = e.select(F.inline(F.array(F.struct(F.col("ca").alias("c"), "w"), F.struct(F.col("cb").alias("c"), "w")))).groupBy("c").agg(F.sum("w").alias("k"))
    return inside[0] / inside[1] - (deg.agg(F.sum(F.col("k") * F.col("k"))).collect()[0][0] / (2 * inside[1]) ** 2)


def community_names(names: DataFrame) -> DataFrame:
    """Communities named by falling size: "Community 1" .. (ties: the smallest member); only the names of communities go through one task."""
    from tracewell.operators.order import numbered

    sizes = names.groupBy("community").agg(F.count(F.lit(1)).alias("size")).withColumn("o", F.struct((-F.col("size")).alias("s"), F.col("community").alias("c"))).withColumn("g", F.lit(0))
    ranked = numbered(sizes, "g", "o").select("community", F.concat(F.lit("Community "), (F.col("row_no") + 1).cast("string")).alias("graph_community"), "size")
    return names.join(small_side(ranked), "community").select("node", "graph_community", "size")
