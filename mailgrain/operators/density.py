"""Density clusters with noise (J7): the hierarchy of mutual reachability, cut by stability.

1. Equal vectors are one weighted node.  Random projections deal the nodes out to buckets of at most ``LEAF`` nodes,
   several tables of them; every bucket gives its nodes' nearest neighbours, and the merged lists give each node's core
   distance: how far it is to its ``min_samples``-th neighbour.
2. Every bucket gives the minimum spanning tree of its nodes under mutual reachability (the larger of the distance
   and both core distances).  Boruvka rounds join the trees of all buckets to one forest.
3. The forest's edges by rising weight are the hierarchy.  A component counts as a cluster from ``min_cluster_size``
   points on; a smaller one falls to the cluster it meets.  Each bucket follows its part of the forest as long as nothing
   outside can have come before; then the next table's buckets do so with what is left, and the rest, whose size is
   checked, is followed in one task.
4. Points that fell are summed up by cluster; the clusters, at most two for each ``min_cluster_size`` points, are chosen
   by excess of mass.  Points of no chosen cluster are noise, -1.

A set of at most ``LEAF`` different vectors is one bucket, and its result is exact.  Beyond that neighbours may be missed
where all tables part them.  There is no step over all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.operators.lloyd import matrix_of
from mailgrain.session import settled

LEAF, TABLES = 1024, 8
#: edges that are left for the last task, and clusters that are chosen from in one place
LAST_EDGES = 5_000_000
SMALLEST = 1e-12  # distance that stands for none


# ---------------------------------------------------------------- buckets


def bucketed(nodes: DataFrame, leaf: int, tables: int, seed: int) -> DataFrame:
    """(table, bucket, node): every table halves its buckets at the median of one random projection after the other."""
    total = nodes.count()
    depth = max(0, math.ceil(math.log2(max(total, 1) / leaf))) if total > leaf else 0
    if not depth:
        return nodes.select(F.lit(0).alias("table"), F.lit(1).cast("bigint").alias("bucket"), "node")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = None
        for batch in batches:
            if batch.num_rows:
                points = matrix_of(batch.column("vec"))
                if directions is None:
                    directions = np.random.default_rng(seed).normal(size=(points.shape[1], tables * depth))
                values = points @ directions
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array([[own.tolist() for own in row] for row in values.reshape(len(points), tables, depth)],
                     pa.list_(pa.list_(pa.float64())))], ["node", "values"])

    rows = nodes.select("node", "vec").mapInArrow(project, "node bigint, values array<array<double>>").select(
        "node", F.posexplode("values").alias("table", "value"))
    rows = settled(rows.withColumn("bucket", F.lit(1).cast("bigint")))
    for level in range(depth):
        halves = rows.groupBy("table", "bucket").agg(F.percentile_approx(F.col("value")[level], 0.5).alias("median"))
        rows = settled(rows.join(halves, ["table", "bucket"]).select(
            "table", (F.col("bucket") * 2 + (F.col("value")[level] > F.col("median")).cast("int")).alias("bucket"), "node", "value"))
    # medians are approximate and projections may be equal: what is still too large is dealt out by hash
    pieces = rows.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / leaf).alias("pieces"))
    dealt = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("node"), F.col("pieces"))).otherwise(0)
    return rows.join(pieces, ["table", "bucket"]).select("table", (F.col("bucket") * 1_000_003 + dealt).alias("bucket"), "node")


def _apart(points: np.ndarray) -> np.ndarray:
    lengths = (points ** 2).sum(axis=1)
    return np.sqrt(np.maximum(lengths[:, None] + lengths[None] - 2 * points @ points.T, 0))


def _exact(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs, the same for a pair in whatever bucket it is met."""
    return np.sqrt(((points[a] - points[b]) ** 2).sum(axis=1))


def _neighbours(count: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node").combine_chunks()
        node, weight = (rows.column(c).to_numpy() for c in ("node", "weight"))
        points = matrix_of(rows.column("vec").combine_chunks())
        apart = _apart(points)
        np.fill_diagonal(apart, np.inf)
        k = min(count, len(node) - 1)
        near = np.argsort(apart, axis=1, kind="stable")[:, :k] if k > 0 else np.zeros((len(node), 0), np.int64)
        a, b = np.repeat(np.arange(len(node)), near.shape[1]), near.ravel()
        return pa.table({"node": node[a], "distance": _exact(points, a, b), "other": node[b], "copies": weight[b]})

    return run


def neighbour_lists(members: DataFrame, count: int) -> DataFrame:
    """(node, near): the ``count`` nearest neighbours over all tables, nearest first, as (distance, other, copies)."""
    rows = members.groupBy("table", "bucket").applyInArrow(
        _neighbours(count), "node bigint, distance double, other bigint, copies bigint")
    near = F.collect_set(F.struct("distance", "other", "copies"))
    return rows.groupBy("node").agg(F.slice(F.array_sort(near), 1, count).alias("near"))


def core_distances(nodes: DataFrame, lists: DataFrame, min_samples: int) -> DataFrame:
    """``nodes`` with ``core``: the distance within which ``min_samples`` other points lie, copies of the node among them."""
    start = F.struct((F.col("weight") - 1).alias("seen"), F.lit(0.0).alias("core"))
    reached = F.aggregate("near", start, lambda s, x: F.when(s.seen >= min_samples, s).otherwise(
        F.struct((s.seen + x.copies).alias("seen"), x.distance.alias("core"))))
    joined = nodes.join(lists, "node", "left")
    return joined.select("node", "vec", "weight", F.coalesce(reached["core"], F.lit(0.0)).alias("core"))


# ---------------------------------------------------------------- forest


def _bucket_tree(rows: pa.Table) -> pa.Table:
    """Minimum spanning tree of a bucket under mutual reachability, grown node by node."""
    rows = rows.sort_by("node").combine_chunks()
    node, core = rows.column("node").to_numpy(), rows.column("core").to_numpy()
    points = matrix_of(rows.column("vec").combine_chunks())
    reach = np.maximum(_apart(points), np.maximum(core[:, None], core[None]))
    best, link = reach[0].copy(), np.zeros(len(node), np.int64)
    best[0] = np.inf
    a, b = [], []
    outside = np.ones(len(node), bool)
    outside[0] = False
    for _ in range(len(node) - 1):
        new = int(np.argmin(np.where(outside, best, np.inf)))
        a.append(int(link[new])), b.append(new)
        outside[new] = False
        closer = outside & (reach[new] < best)
        best[closer], link[closer] = reach[new][closer], new
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    weight = np.maximum(_exact(points, a, b), np.maximum(core[a], core[b])) if len(a) else np.zeros(0)
    return pa.table({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b]), "w": weight})


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of (a, b, w) by Boruvka rounds; ties go by the ends.  Nothing is collected."""
    edges = settled(edges.distinct().select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")))
    forest = None
    while not edges.isEmpty():
        sides = edges.select(F.col("x").alias("comp"), F.col("y").alias("to"), "w", "a", "b").unionByName(
            edges.select(F.col("y").alias("comp"), F.col("x").alias("to"), "w", "a", "b"))
        least = settled(sides.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("comp", "e.*"))
        chosen = least.select("a", "b", "w").distinct()
        forest = settled(chosen if forest is None else forest.unionByName(chosen))
        # two components that choose each other: the smaller becomes the root
        back = least.select(F.col("comp").alias("to"), F.col("to").alias("comp_of_to"))
        hooks = least.select("comp", "to").join(back, "to", "left").select(
            "comp", F.when((F.col("comp_of_to") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("root"))
        hooks = settled(hooks)
        while True:  # two jumps at a time along the pointers, which are short as a rule
            up = hooks.select(F.col("comp").alias("root"), F.col("root").alias("above"))
            far = up.select(F.col("root").alias("above"), F.col("above").alias("top"))
            jumped = settled(hooks.join(up, "root", "left").join(far, "above", "left").select(
                "comp", F.coalesce("top", "above", "root").alias("new"), "root"))
            moved = not jumped.filter(F.col("new") != F.col("root")).isEmpty()
            hooks = jumped.select("comp", F.col("new").alias("root"))
            if not moved:
                break
        rx = hooks.select(F.col("comp").alias("x"), F.col("root").alias("rx"))
        ry = hooks.select(F.col("comp").alias("y"), F.col("root").alias("ry"))
        edges = settled(edges.join(rx, "x").join(ry, "y").filter("rx <> ry").select("a", "b", "w", F.col("rx").alias("x"), F.col("ry").alias("y")))
    return forest


# ---------------------------------------------------------------- hierarchy

FOUND = "kind string, comp bigint, root bigint, size bigint, cluster string, parent string, level double"


def follow(comps: list[tuple], edges: list[tuple], least: int, name: str) -> list[tuple]:
    """Follow edges (a, b, w, crosses) by rising weight over components (comp, size, cluster or None).

    Two components merge unless something outside may have reached one of them before, which is so from its first
    crossing edge on, and spreads.  Rows of :data:`FOUND`: ``fall`` (a component smaller than ``least`` becomes part of
    a cluster at a level), ``split`` (a cluster's parent and the level where it ends), ``into`` (the component that
    holds another at the end) and ``root`` (size and cluster of that).
    """
    parent = {c: c for c, _, _ in comps}
    size = {c: s for c, s, _ in comps}
    cluster = {c: k for c, _, k in comps}
    held = {c: [c] for c, _, k in comps if k is None}  # members of a component that is no cluster yet
    closed: set[int] = set()
    out: list[tuple] = []
    made = 0

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def fall(x: int, into: str, level: float) -> None:
        out.extend(("fall", c, None, None, into, None, level) for c in held.pop(x))

    for a, b, w, crosses in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if crosses:
            closed.add(find(a if a in parent else b))
            continue
        x, y = find(a), find(b)
        if x in closed or y in closed:
            closed |= {x, y}
            continue
        if cluster[x] is None and cluster[y] is None:
            if size[x] + size[y] >= least:
                new = f"{name}{made}"
                made += 1
                fall(x, new, w), fall(y, new, w)
                cluster[x] = new
            else:
                held[x] += held.pop(y)
        elif cluster[x] is None or cluster[y] is None:
            small, own = (x, cluster[y]) if cluster[x] is None else (y, cluster[x])
            fall(small, own, w)
            cluster[x] = own
        else:
            new = f"{name}{made}"
            made += 1
            out += [("split", None, None, None, cluster[x], new, w), ("split", None, None, None, cluster[y], new, w)]
            cluster[x] = new
        parent[y] = x
        size[x] += size[y]
    for c in parent:
        root = find(c)
        out.append(("into", c, root, None, None, None, None))
        if root == c:
            out.append(("root", c, None, size[c], cluster[c], None, None))
    return out


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    columns = list(zip(*rows)) if rows else [[]] * 7
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "comp", "root", "size", "cluster", "parent", "level"])


def _follow_bucket(least: int, step: int):
    def run(key: tuple, comps: pa.Table, edges: pa.Table) -> pa.Table:
        own = list(zip(*(comps.column(c).to_pylist() for c in ("comp", "size", "cluster"))))
        links = list(zip(*(edges.column(c).to_pylist() for c in ("a", "b", "w", "crosses"))))
        return _table(follow(own, links, least, f"{step}/{key[0].as_py()}/"))

    return run


def hierarchy(nodes: DataFrame, forest: DataFrame, buckets: DataFrame, tables: list[int], least: int) -> tuple[DataFrame, DataFrame]:
    """Where each node falls (node, weight, cluster, level), and the tree of clusters (cluster, parent, level)."""
    comps = nodes.select(F.col("node").alias("comp"), F.col("weight").alias("size"),
                         F.when(F.col("weight") >= least, F.concat(F.lit("n"), "node")).alias("cluster"))
    edges = forest.select("a", "b", "w")
    # copies of one vector are a cluster by themselves where they are many enough
    placed = nodes.select("node", "weight", F.col("node").alias("comp"), F.when(F.col("weight") >= least, F.concat(F.lit("n"), "node")).alias("cluster"),
                          F.when(F.col("weight") >= least, F.lit(0.0)).alias("level"))
    splits = None
    for step, number in enumerate([*tables, None]):
        if number is None and edges.count() > LAST_EDGES:
            raise ValueError(f"more than {LAST_EDGES} edges are left for one task; raise min_cluster_size")
        if number is None:
            part = comps.select("comp", F.lit(0).cast("bigint").alias("part"))
        else:
            part = buckets.filter(F.col("table") == number).select(F.col("node").alias("comp"), F.col("bucket").alias("part")).join(comps.select("comp"), "comp")
        part = settled(part)
        pa_, pb = part.select(F.col("comp").alias("a"), F.col("part").alias("pa")), part.select(F.col("comp").alias("b"), F.col("part").alias("pb"))
        placed_edges = edges.join(pa_, "a").join(pb, "b").withColumn("crosses", F.col("pa") != F.col("pb"))
        # an edge between buckets goes to both
        sides = placed_edges.select(
            "a", "b", "w", "crosses", F.explode(F.array_distinct(F.array("pa", "pb"))).alias("part"))
        found = settled(comps.join(part, "comp").groupBy("part").cogroup(sides.groupBy("part")).applyInArrow(_follow_bucket(least, step), FOUND))
        more = found.filter("kind = 'split'").select("cluster", "parent", "level")
        splits = more if splits is None else splits.unionByName(more)
        into = found.filter("kind = 'into'").select("comp", "root")
        fell = found.filter("kind = 'fall'").select("comp", F.col("cluster").alias("c"), F.col("level").alias("l"))
        open_ = placed.join(into, "comp", "left").join(fell, "comp", "left")
        placed = settled(open_.select(
            "node", "weight", F.when(F.col("cluster").isNull(), F.col("root")).otherwise(F.col("comp")).alias("comp"),
            F.coalesce("cluster", "c").alias("cluster"), F.coalesce("level", "l").alias("level")))
        comps = found.filter("kind = 'root'").select("comp", "size", "cluster")
        ra = into.select(F.col("comp").alias("a"), F.col("root").alias("ra"))
        rb = into.select(F.col("comp").alias("b"), F.col("root").alias("rb"))
        edges = settled(edges.join(ra, "a").join(rb, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "w"))
        if edges.isEmpty():
            break
    return placed, splits


# ---------------------------------------------------------------- choice


def inverse(level: float) -> float:
    return 1 / max(level, SMALLEST)


def chosen_clusters(splits: list[tuple[str, str, float]], fallen: dict[str, tuple[int, float, float]]) -> dict[str, tuple[str, float]]:
    """Excess of mass: cluster to (the chosen cluster above it or itself, largest density of that cluster).

    ``splits`` are (cluster, parent, level); ``fallen`` gives points, summed and largest density of what fell into a
    cluster itself.  The cluster of everything is never chosen.
    """
    above = {c: (p, level) for c, p, level in splits}
    below: dict[str, list[str]] = {}
    for c, p, _ in splits:
        below.setdefault(p, []).append(c)
    names = set(fallen) | set(above) | set(below)
    tops = [c for c in names if c not in above]
    order, stack = [], list(tops)
    while stack:
        c = stack.pop()
        order.append(c)
        stack += below.get(c, [])
    points, most, value, chosen = {}, {}, {}, {}
    single = len(tops) == 1
    for c in reversed(order):  # children before parents
        n, total, peak = fallen.get(c, (0, 0.0, 0.0))
        kids = below.get(c, [])
        birth = inverse(above[c][1]) if c in above else 0.0
        own = total - n * birth
        if kids:
            own += sum(points[k] for k in kids) * (inverse(above[kids[0]][1]) - birth)
        points[c] = n + sum(points[k] for k in kids)
        most[c] = max([peak, *(most[k] for k in kids)])
        inner = sum(value[k] for k in kids)
        chosen[c] = not (single and c in tops) and (not kids or own >= inner)
        value[c] = own if chosen[c] else inner
    out: dict[str, tuple[str, float]] = {}
    label: dict[str, str] = {}
    for c in order:  # parents first
        up = above[c][0] if c in above else None
        if up in label:
            label[c] = label[up]
        elif chosen[c]:
            label[c] = c
        if c in label:
            out[c] = (label[c], most[label[c]])
    return out


def density_clusters(
    vectors: DataFrame, min_cluster_size: int = 50, min_samples: int = 10, leaf: int | None = None, tables: int = TABLES, seed: int = 42,
) -> DataFrame:
    """J7 with noise: ``email_id, cluster, prob`` of ``email_id, embedding``.

    ``cluster`` numbers the chosen clusters from 0, -1 is noise; ``prob`` is the density at which a point joins its
    cluster, relative to the cluster's densest point, 0 for noise.  Rows without a vector are left out.
    """
    spark = vectors.sparkSession
    rows = settled(vectors.filter(F.col("embedding").isNotNull()).select("email_id", F.col("embedding").cast("array<double>").alias("vec")))
    nodes = settled(rows.groupBy("vec").agg(F.min("email_id").alias("node"), F.count(F.lit(1)).alias("weight")).select("node", "vec", "weight"))
    buckets = settled(bucketed(nodes, leaf or LEAF, tables, seed))
    numbers = sorted(r["table"] for r in buckets.select("table").distinct().collect())  # one for each table
    members = buckets.join(nodes, "node")
    cored = settled(core_distances(nodes, neighbour_lists(members, min_samples), min_samples))
    trees = buckets.join(cored, "node").groupBy("table", "bucket").applyInArrow(_bucket_tree, "a bigint, b bigint, w double")
    forest = settled(trees) if len(numbers) == 1 else spanning_forest(trees)
    empty = spark.createDataFrame([], "a bigint, b bigint, w double")
    placed, splits = hierarchy(nodes, empty if forest is None else forest, buckets, numbers, min_cluster_size)
    dense = 1 / F.greatest(F.col("level"), F.lit(SMALLEST))
    sums = placed.filter(F.col("cluster").isNotNull()).groupBy("cluster").agg(
        F.sum("weight").alias("n"), F.sum(F.col("weight") * dense).alias("total"), F.max(dense).alias("peak"))
    # at most two clusters for each min_cluster_size points
    fallen = {r["cluster"]: (r["n"], r["total"], r["peak"]) for r in sums.collect()}
    chosen = chosen_clusters([tuple(r) for r in splits.collect()], fallen)
    number = {c: i for i, c in enumerate(sorted({label for label, _ in chosen.values()}))}
    names = spark.createDataFrame(
        [(c, number[label], peak) for c, (label, peak) in chosen.items()], "cluster string, label int, peak double")
    labelled = placed.join(names, "cluster", "left").select(
        "node", F.coalesce("label", F.lit(-1)).alias("cluster"), 
        F.when(F.col("label").isNotNull(), F.least(dense / F.col("peak"), F.lit(1.0))).otherwise(0.0).alias("prob"))
    members = rows.join(nodes.select("vec", "node"), "vec").select("email_id", "node")
    return members.join(labelled, "node").select("email_id", "cluster", "prob")
