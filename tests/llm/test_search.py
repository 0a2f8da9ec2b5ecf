"""Pair-bound MaxScore against scoring every document, and against DuckDB."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mailgrain.llm import queries, search
from tests.llm import plain
from tests.llm.test_edges import DOCS, HOT, clash, frame, words
from tests.llm.test_queries import SF, docs, table  # noqa: F401


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").repartition(2)


def test_op12(spark, docs):  # noqa: F811
    got = found(queries.op12_search(spark, SF))
    assert got == sorted(plain.ranking(docs, table("benchmark", "item_id", "text")), key=repr)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert got == sorted(con.execute(queries.ORACLES["op12_search"]).fetchall(), key=repr)


@pytest.mark.parametrize("top", [1, 3])
def test_against_plain(spark, top, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 1 << 9)
    own = random.Random(4)
    data = HOT + [(500 + i, words(own.randint(1, 40), 50 + i)) for i in range(150)]
    items = [(i, words(own.randint(1, 30), 5_000 + i)) for i in range(25)] + [(90, None), (91, ""), (92, "zzzz-unknown"), (93, data[0][1])]
    got = found(search.ranked_search(frame(spark, data), items_frame(spark, items), top=top, query_terms=100))
    assert got == sorted(plain.ranking(data, items, top), key=repr)


def test_blocks_and_bounds_hold():
    """Small blocks with rising thresholds: what is skipped never reaches the threshold."""
    own = np.random.default_rng(2)
    terms, size = 8, 60
    for _ in range(200):
        have = own.random((terms, size)) < own.random((terms, 1))
        part = own.integers(1, 50, (terms, size)) * have
        counts = have.sum(axis=1)
        offsets = np.r_[0, np.cumsum(counts)]
        doc = np.concatenate([np.flatnonzero(h) for h in have])
        flat = part[have]
        weight = own.integers(1, 30, terms)
        owner, a, b = search.paired_units(np.zeros(terms, np.int64), np.arange(terms), weight)
        pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
        q = search.QuerySet(owner, a, b, np.arange(len(a)), pairs, np.arange(terms), weight, 1, size, size, 3)
        pair, both, x, y = search.intersections(offsets, doc, flat, size, pairs)
        impact = flat * np.repeat(weight, counts)
        sizes = np.bincount(pair, minlength=len(pairs))
        joint = np.asarray([max((impact[x] + impact[y])[pair == p], default=0) for p in range(len(pairs))])
        row = dict(
            ids=list(range(size)), places=search.narrow(counts), doc=search.narrow(doc), part=search.narrow(flat),
            pair=search.narrow(np.arange(len(pairs))), size=search.narrow(sizes), both=search.narrow(both), joint=search.narrow(joint))
        block = search.Block(row, q)
        want = (part * weight[:, None]).sum(axis=0)
        for threshold in (1, int(np.median(want)), int(want.max()), int(want.max()) + 1):
            docs_, score = block.scores(np.arange(len(a)), max(threshold, 1))
            best = np.flatnonzero(want >= max(threshold, 1))
            assert docs_.tolist() == best.tolist() and score.tolist() == want[best].tolist()
        assert block.ceiling[0] >= want.max()


def test_ties_repeats_nulls_and_empty_tables(spark):
    data = [(9, "same words here"), (3, "same words here"), (3, "same words here"), (None, "same words here"), (5, None), (6, ""), (7, "other"), (8, "é È É")]
    items = [(1, "words SAME words"), (1, "words"), (None, "other"), (2, "È")]
    got = found(search.ranked_search(clash(frame(spark, data)), items_frame(spark, items).withColumn("query", F.lit(1)).withColumn("rank", F.lit(1))))
    assert got == sorted(plain.ranking(sorted(data, key=lambda d: (d[0] is None, d[0] or 0)), items), key=repr)
    assert search.ranked_search(frame(spark, [], 1), items_frame(spark, items)).count() == 0
    assert search.ranked_search(frame(spark, DOCS), items_frame(spark, [])).columns == ["item_id", "rank", "doc_id", "score"]
    with pytest.raises(ValueError):
        search.ranked_search(frame(spark, DOCS), items_frame(spark, items), top=0)


def test_lengths_beyond_64_bits():
    n = np.asarray([1, 10**9])
    assert search.length_part(n, 10**9, 10**10).tolist() == [10 + 9, 10 + 9 * 10**9]
    assert search.wide(search.narrow(np.asarray([3, 2**40]))).tolist() == [3, 2**40]
