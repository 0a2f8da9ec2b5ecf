"""Periodic runs against a version that tries every period."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailgrain.llm import queries, runs
from tests.llm import plain
from tests.llm.test_edges import frame
from tests.llm.test_queries import SF, docs, result  # noqa: F401

COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def longest_lyndon(word):
    best = 1
    for n in range(2, len(word) + 1):
        if all(word[:n] < word[i:n] for i in range(1, n)):
            best = n
    return best


@given(st.lists(st.integers(1, 3), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_lyndon_lengths(word):
    assert runs.lyndon_lengths(np.asarray(word)).tolist() == [longest_lyndon(word[i:]) for i in range(len(word))]


@given(st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=4), st.integers(1, 7), st.integers(2, 5))
@settings(max_examples=300, deadline=None)
def test_runs_of_a_chunk(texts, least, times):
    texts = [t + t * (i % 3) for i, t in enumerate(texts)]
    code = np.asarray([w for t in texts for w in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    start, end, period = runs.chunk_runs(code, owner, least, times)
    want, at = [], 0
    for t in texts:
        want += [(at + s, at + s + n, q) for s, n, q in plain.word_runs(t, least, times)]
        at += len(t)
    assert list(zip(start.tolist(), end.tolist(), period.tolist())) == want


def test_op13(spark, docs):  # noqa: F811
    got = result(spark, "op13_runs", "doc_id", *COLUMNS)
    assert got == plain.run_digests(docs)
    assert sum(r[0] > 0 for r in got.values()) >= 10


def test_edges(spark):
    own = random.Random(3)
    noise = [own.choice("abcdefghijkl") * own.randint(1, 3) for _ in range(30_000)]
    texts = {
        1: None, 2: "", 3: " \n\t", 4: "a a a a a", 5: "a a a a a a", 6: "x a b a b a b a b y", 7: "é é é é é é é", 8: "a\x0bA\ta a\ra  a a\n",
        9: " ".join(noise + ["one", "two", "three"] * 2_000 + noise[:50]), 10: "z " * 20_000,
        11: ("a b " * 5 + "c ") * 6, 12: "a a a a a a b b b b b b a a a a a a"}
    rows = [(i, t) for i, t in texts.items()] + [(6, texts[6]), (None, texts[6]), (None, None)]
    found = runs.periodic_runs(frame(spark, rows).withColumn("runs", F.lit(1)).withColumn("_text", F.lit(2)), keep=["doc_id", "lang"]).collect()
    assert len(found) == len(rows)
    for r in found:
        words = plain.SPACED.findall(texts.get(r.doc_id) or (texts[6] if r.n_words else ""))
        if r.doc_id != 9:
            assert [tuple(x) for x in r.runs] == plain.word_runs(words)
        gone = {i for s, n, q in r.runs for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        assert r.n_words == len(words) and r.lang == "en"
    assert (30_000, 6_000, 3) in {tuple(x) for r in found if r.doc_id == 9 for x in r.runs}
    assert runs.periodic_runs(frame(spark, [], 1)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(frame(spark, [], 1), min_exponent=1)


def test_null_ids_are_not_planted(spark):
    rows = [(None, "a b c d e f"), (None, None)]
    assert sorted((r.text or "") for r in runs.with_periodic_tails(frame(spark, rows)).collect()) == ["", "a b c d e f"]
    assert "op13_runs" in queries.QUERIES
