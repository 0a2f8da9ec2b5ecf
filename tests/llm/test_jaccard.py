"""The count-vector join against every pair of sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgrain.llm import jaccard, queries
from tests.llm import plain
from tests.llm.test_edges import DOCS, clash, edited, frame, words
from tests.llm.test_queries import SF, docs, result  # noqa: F401


def components(docs, size=5, percent=80):
    sets = {i: plain.shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op11(spark, docs):  # noqa: F811
    got = result(spark, "op11_jaccard", "doc_id", "n_shingles", "component_id")
    assert got == components(docs)
    assert any(r[1] != i for i, r in got.items())


@pytest.mark.parametrize("block, percent, size", [(1024, 80, 5), (7, 80, 5), (7, 60, 3)])
def test_families_at_the_threshold(spark, block, percent, size, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 40)
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "FANOUT", 2)
    own = random.Random(8)
    data = list(DOCS[:14])
    for family in range(6):
        text = words(own.choice([30, 80, 200]), 300 + family)
        for k in range(15):
            data.append((1000 + 100 * family + k, edited(text, 31 * family + k, own.randint(0, 9))))
    line = words(30, "line")
    data += [(3000 + i, line + " " + words(own.randint(5, 40), 40 + i)) for i in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(
        frame(spark, data), size, percent, block).collect()}
    assert got == components(data, size, percent)


def test_tree_keeps_every_pair_that_the_bound_allows():
    own = np.random.default_rng(1)
    base_points = own.poisson(2.0, (12, jaccard.GROUPS))
    points = np.concatenate([np.maximum(p + own.integers(-1, 2, (20, jaccard.GROUPS)) * (own.random((20, jaccard.GROUPS)) < 0.1), 0) for p in base_points])
    n = points.sum(axis=1)
    shared = np.minimum(points[:, None], points[None]).sum(axis=2)
    want = {(i, j) for i in range(len(n)) for j in range(i) if shared[i, j] >= jaccard.needed(n[i], n[j], 80)
            and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j])}
    tree = jaccard.Tree(points.astype(np.int32), n)
    got = {(max(i, j), min(i, j)) for a, b, _ in tree.pairs(80) for i, j in zip(a.tolist(), b.tolist())}
    assert got == want and len(want) > 100
    leaves = len(tree.levels[0][1])
    assert len(tree.leaf_pairs(80)[0]) < 0.75 * leaves * (leaves + 1) / 2  # boxes do prune
    assert (jaccard.unpacked([jaccard.packed(p) for p in points * np.asarray([[1], [300]])[np.arange(len(points)) % 2]])[0] == points[0]).all()


def test_prefixes_of_linked_sets_meet():
    own = np.random.default_rng(5)
    hot = np.sort(own.integers(1, 1 << 60, 5).astype(np.uint64))
    rank = np.arange(5, dtype=np.uint64)
    for _ in range(200):
        first = np.unique(np.r_[own.integers(1, 1 << 60, own.integers(1, 60)).astype(np.uint64), hot[: own.integers(0, 6)]])
        drop = own.integers(0, max(1, len(first) // 6) + 1)
        second = np.unique(np.r_[own.permutation(first)[drop:], own.integers(1, 1 << 60, own.integers(0, 3)).astype(np.uint64)])
        both = len(np.intersect1d(first, second))
        if not len(second) or 100 * both < 80 * (len(first) + len(second) - both):
            continue
        doc, found, _ = jaccard.prefixes(np.r_[first, second], np.asarray([0, len(first), len(first) + len(second)]), hot, rank, 80)
        assert set(found[doc == 0]) & set(found[doc == 1])


def test_edges(spark):
    assert jaccard.jaccard_join(frame(spark, [], 1)).count() == 0
    text = words(60, "t")
    odd = [(1, text), (1, text), (None, text), (None, None), (2, ""), (3, " \t"), (4, text + " x"), (None, "only one here"), (5, "ONLY one here")]
    got = sorted(map(tuple, jaccard.jaccard_join(clash(frame(spark, odd)).withColumn("bucket", F.lit(1))).collect()), key=repr)
    assert got == sorted([(1, 56, 1), (1, 56, 1), (None, 56, 1), (None, 0, None), (2, 0, 2), (3, 0, 3), (4, 57, 1), (None, 1, 5), (5, 1, 5)], key=repr)
    long = " ".join(words(20_000, "long").split())
    pair = jaccard.jaccard_join(frame(spark, [(7, long), (8, edited(long, 2, 5)), (9, words(15_000, "other"))])).collect()
    assert {r["doc_id"]: r["component_id"] for r in pair} == {7: 7, 8: 7, 9: 9}
    with pytest.raises(ValueError):
        jaccard.jaccard_join(frame(spark, [], 1), percent=0)
    assert "op11_jaccard" in queries.QUERIES
