"""Batched k-means against single fits."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
 

from mailgrain.operators import clusters, lloyd
from mailgrain.operators import density as density_


def single_fit(points, weights, centres, iterations=50):
    for _ in range(iterations):
        nearest = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = centres.copy()
        for k in range(len(centres)):
            if (nearest == k).any():
                moved[k] = np.average(points[nearest == k], axis=0, weights=weights[nearest == k])
        done = np.sqrt(((moved - centres) ** 2).sum(axis=1)).max() <= lloyd.TOLERANCE
        centres = moved
        if done:
            break
    apart = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    return centres, float((apart.min(axis=1) * weights).sum())


def test_costs_are_those_of_single_fits(spark):
    own = np.random.default_rng(3)
    spaces = {0: own.normal(size=(300, 2)), 1: np.round(own.normal(size=(200, 20)) * 2)}
    weights = {s: own.integers(1, 4, len(p)).astype(float) for s, p in spaces.items()}
    rows = [(s, p.tolist(), float(w)) for s, points in spaces.items() for p, w in zip(points, weights[s])]
    frame = spark.createDataFrame(rows, lloyd.POINTS).repartition(5).cache()
    start = lloyd.first_centres(frame, {0: 4, 1: 6}, 7, 3)
    spark.sparkContext.setJobGroup("lloyd", "batched")
    fits = lloyd.fit_spaces(frame, {0: 4, 1: 6}, start=dict(start))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("lloyd")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for s, k in ((0, 4), (1, 6)):
        want = [single_fit(spaces[s], weights[s], start[s, r]) for r in range(3)]
        assert fits[s].costs == pytest.approx([cost for _, cost in want])
        best = min(range(3), key=lambda r: want[r][1])
        assert fits[s].centres == pytest.approx(want[best][0])
        assert len(fits[s].centres) == k
    passes = max(f.iterations for f in fits.values()) + 1
    assert len(jobs) <= 2 * passes  # a shuffle stage of an iteration may be a job of its own


def test_dimensions_together_are_dimensions_alone(spark):
    a = spark.range(120).select(F.col("id").alias("email_id"), (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    b = spark.range(10, 140).select(F.col("id").alias("email_id"), (F.col("id") % 7).cast("double").alias("z"), F.lit(2.0).alias("still"))
    both = {r["email_id"]: r for r in clusters.cluster_all({"temporal": a, "service": b}, restarts=3).collect()}
    assert len(both) == 140
    assert both[5]["service_cluster"] is None and both[130]["temporal_cluster"] is None and both[50]["service_distance"] is not None
    alone = {r["email_id"]: r for r in clusters.cluster(a, "temporal", restarts=3).collect()}
    assert set(alone) == set(range(120))
    # 15 different points in 6 clusters: the same seeds give the same centres
    assert {i: r["cluster"] for i, r in alone.items()} == {i: both[i]["temporal_cluster"] for i in alone}
    seven = {r["email_id"] % 7: r["service_cluster"] for r in both.values() if r["service_cluster"] is not None}
    assert len(set(seven.values())) == 7  # eight clusters wanted, seven different points
    with pytest.raises(ValueError):
        clusters.cluster(a.limit(0), "temporal")


def test_content_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i % 3) * 10, 1.0]) for i in range(30)] + [(99, None)], "email_id bigint, embedding array<float>")
    got = clusters.cluster_content(rows, restarts=2).collect()
    assert len(got) == 30 and all(r["distance"] < 1e-6 for r in got)
    one = clusters.cluster_content(rows.limit(1), restarts=2).collect()
    assert [(r["cluster"], r["distance"]) for r in one] == [(0, 0.0)]


# ---------------------------------------------------------------- density


def plain_density(points, least, samples):
    """Labels by the definition: all pairs, Kruskal, the hierarchy taken apart from the top."""
    n = len(points)
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    core = np.sort(apart, axis=1)[:, min(samples, n - 1)]
    reach = np.maximum(apart, np.maximum(core[:, None], core[None]))
    edges = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    tree = []
    for w, i, j in edges:
        if find(i) != find(j):
            root[find(j)] = find(i)
            tree.append((w, i, j))

    def parts(members, links):
        """Components of members by links, as (members, links)."""
        of = {m: m for m in members}

        def top(x):
            while of[x] != x:
                x = of[x]
            return x

        for _, i, j in links:
            of[top(j)] = top(i)
        groups = {}
        for m in members:
            groups.setdefault(top(m), ([], []))[0].append(m)
        for e in links:
            groups[top(e[1])][1].append(e)
        return list(groups.values())

    clusters = []  # (stability, kids, points that leave it, all its members)

    def build(members, links, birth):
        own, all_members = 0.0, list(members)
        while True:
            if not links:
                own += len(members) * ((1e12 if len(members) > 1 else 0) - birth) if len(members) > 1 else 0
                return len(clusters), clusters.append((own, [], all_members))
            cut = max(links)
            level = 1 / max(cut[0], 1e-12)
            pieces = parts(members, [e for e in links if e != cut])
            big = [p for p in pieces if len(p[0]) >= least]
            own += sum(len(p[0]) for p in pieces if len(p[0]) < least) * (level - birth)
            if len(big) == 2:
                own += sum(len(p[0]) for p in big) * (level - birth)
                kids = [build(*p, level)[0] for p in big]
                return len(clusters), clusters.append((own, kids, all_members))
            if not big:
                return len(clusters), clusters.append((own, [], all_members))
            members, links = big[0]

    if n < least:
        return [-1] * n
    top = build(list(range(n)), tree, 0.0)[0]
    value, chosen = {}, {}
    for c, (own, kids, _) in enumerate(clusters):  # kids come first
        inner = sum(value[k] for k in kids)
        chosen[c] = c != top and (not kids or own >= inner)
        value[c] = own if chosen[c] else inner
    labels = [-1] * n

    def name(c):
        if chosen[c]:
            for m in clusters[c][2]:
                labels[m] = c
        else:
            for k in clusters[c][1]:
                name(k)

    name(top)
    return labels


def blobs(seed, sizes=(90, 60, 70), noise=40, dims=4):
    own = np.random.default_rng(seed)
    points = [own.normal(c * 7, 1.0, (n, dims)) for c, n in enumerate(sizes)]
    return np.concatenate([*points, own.uniform(-15, 30, (noise, dims))])


def density(spark, points, **settings):
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "email_id bigint, embedding array<double>").repartition(3)
    got = density_.density_clusters(frame, **settings).collect()
    assert len(got) == len(points)
    return {r["email_id"]: (r["cluster"], r["prob"]) for r in got}


def agreement(got, want):
    """Share of points in the same cluster under the best renaming of the larger overlaps."""
    pairs = {}
    for g, w in zip(got, want):
        pairs[g, w] = pairs.get((g, w), 0) + 1
    used_g, used_w, same = set(), set(), 0
    for (g, w), n in sorted(pairs.items(), key=lambda x: -x[1]):
        if g not in used_g and w not in used_w and (g == -1) == (w == -1):
            used_g.add(g), used_w.add(w)
            same += n
    return same / len(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_density_equals_the_definition(spark, seed):
    points = blobs(seed)
    want = plain_density(points, 20, 5)
    got = density(spark, points, min_cluster_size=20, min_samples=5)
    labels = [got[i][0] for i in range(len(points))]
    # points whose last edge ties with a merge of two clusters may go to either
    assert agreement(labels, want) >= 0.99
    assert len(set(labels) - {-1}) == 3 and labels.count(-1) > 10
    assert all((p > 0) == (c >= 0) and p <= 1 for c, p in got.values())


def test_density_over_buckets(spark):
    points = blobs(5, (80, 70, 60), 30)
    want = plain_density(points, 20, 5)
    got = density(spark, points, min_cluster_size=20, min_samples=5, leaf=130, tables=2)
    assert agreement([got[i][0] for i in range(len(points))], want) >= 0.97


def test_neighbour_recall(spark):
    points = np.random.default_rng(9).normal(size=(600, 8)) + np.repeat(np.arange(6) * 4, 100)[:, None]
    frame = spark.createDataFrame([(i, p.tolist(), 1) for i, p in enumerate(points)], "node bigint, vec array<double>, weight bigint")
    members = density_.bucketed(frame, 128, 8, 3).join(frame, "node")
    assert max(r["count"] for r in members.groupBy("table", "bucket").count().collect()) <= 128
    found = {r["node"]: [x["other"] for x in r["near"]] for r in density_.neighbour_lists(members, 10).collect()}
    apart = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    want = np.argsort(apart, axis=1)[:, :10]
    assert np.mean([len(set(found[i]) & set(want[i].tolist())) / 10 for i in range(len(points))]) >= 0.9


def test_density_edges(spark):
    assert density(spark, np.zeros((5, 2)), min_cluster_size=10, min_samples=2) == {i: (-1, 0.0) for i in range(5)}
    copies = np.concatenate([np.zeros((30, 2)), np.full((30, 2), 9.0), np.asarray([[40.0, 40.0], [50.0, 1.0]])])
    got = density(spark, copies, min_cluster_size=10, min_samples=3)
    assert len({got[i][0] for i in range(30)}) == 1 and got[0][0] != got[30][0] and got[60][0] == got[61][0] == -1
    empty = spark.createDataFrame([(1, None)], "email_id bigint, embedding array<float>")
    assert density_.density_clusters(empty).count() == 0


def test_forest_rounds_are_planned_in_time(spark):
    """Six rounds over a few thousand edges; planning grew fourfold with every join of a round."""
    own = np.random.default_rng(4)
    ends = np.concatenate([np.stack([np.arange(1, 1500), own.integers(0, np.arange(1, 1500))], axis=1), own.integers(0, 1500, (3000, 2))])
    edges = sorted({(float(w), int(min(e)), int(max(e))) for w, e in zip(own.random(len(ends)), ends) if e[0] != e[1]})
    parent = list(range(1500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = set()
    for w, a, b in edges:  # Kruskal
        x, y = find(a), find(b)
        if x != y:
            parent[x] = y
            want.add((a, b, w))
    begun = time.monotonic()
    got = density_.spanning_forest(spark.createDataFrame([(a, b, w) for w, a, b in edges], "a bigint, b bigint, w double"))
    assert {tuple(r) for r in got.collect()} == want
    assert time.monotonic() - begun < 60


def test_follow_stops_where_something_outside_may_come_first():
    comps = [(i, 1, None) for i in range(6)]
    edges = [(0, 1, 1.0, False), (1, 2, 2.0, False), (2, 9, 2.5, True), (2, 3, 3.0, False), (4, 5, 4.0, False)]
    out = density_.follow(comps, edges, 3, "x")
    assert {(r[1], r[4], r[6]) for r in out if r[0] == "fall"} == {(0, "x0", 2.0), (1, "x0", 2.0), (2, "x0", 2.0)}
    roots = {r[1]: (r[3], r[4]) for r in out if r[0] == "root"}
    assert roots[3] == (1, None) and sorted(s for s, _ in roots.values()) == [1, 2, 3]
