"""The clause grammar against a plain scorer, and what it must tell apart."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailgrain.llm import toxicity
from tests.llm import plain

WEIGHTS = {"fool": 3.0, "grobl": 2.5, "kill": 4.0}
SEEDS = [toxicity.THREATS, toxicity.TARGETS, toxicity.NEGATIONS, toxicity.REPORTS]


def feature_rows(texts):
    codes = toxicity._hashes(list(WEIGHTS))
    lexicon = toxicity.Lexicon(codes, np.asarray(list(WEIGHTS.values())))
    return np.expm1(toxicity.features(pa.array(texts, pa.string()), lexicon, toxicity.compiled()))


def plain_rows(texts):
    sets = [set(words) for words in SEEDS]
    return [plain.clause_features(t, WEIGHTS, *sets, toxicity.THREAT_WEIGHT) for t in texts]


PARTS = ["fool", "Grobl", "kill", "burn", "you", "not", "never", "said", "wrote", "tree", "é", ".", ",", ":", '"', "\n", "(", "!", "", "they"]


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_features_equal_the_plain_scorer(rows):
    texts = [" ".join(r) for r in rows] + [None, ""]
    assert feature_rows(texts) == pytest.approx(np.asarray(plain_rows(texts), float))


def test_kinds_of_threats_and_quoted_speech():
    texts = ["I will burn you", "I will burn it", "I will not burn you", "he said he will burn you", 'he said: "you fool"', "you fool",
             'he said. "you fool"', "x " * 3000 + "said " + ", x" * 3000 + " fool. fool you"]
    got = feature_rows(texts)[:, :8].round(6)
    where = [np.flatnonzero(r).tolist() for r in got]
    assert where == [[5], [4], [6], [7], [3], [1], [1], [1, 3]]
    assert got[0, 5] == toxicity.THREAT_WEIGHT and got[4, 3] == 3.0


def test_labelled_rows_are_bounded_and_learned_once(spark):
    docs = spark.createDataFrame([(k % 50, "b" if k < 50 else "a") for k in range(400)] + [(None, "c"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(2, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    rows = toxicity.labelled_texts(docs, labels).collect()
    known = [k for k in range(50) if not plain.zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(rows) == len(known) and {r["text"] for r in rows} == {"a"}
    assert toxicity.labelled_texts(docs, labels, 5).count() <= 5


def test_all_entries_with_evidence_are_kept(spark):
    words = ["zq%dv" % k for k in range(3000)]
    rows = [(" ".join(words), 1)] * 40 + [("tree é", 0)] * 40
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert set(toxicity._hashes(words).tolist()) <= set(lexicon.codes.tolist())
