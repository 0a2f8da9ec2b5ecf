"""Windows of more grams than a byte can count, against the plain versions."""

import random

import pytest

from mailgrain.llm import substrings, suffixes
from tests.llm import plain
from tests.llm.test_edges import frame, rows, words

PASSAGE = words(450, "wide")


def texts():
    own = random.Random(12)
    parts = PASSAGE.split(" ")
    return [(i, words(own.randint(0, 60), 70 + i) + " " + " ".join(parts[own.randint(0, 60): len(parts) - own.randint(0, 60)])
             + " " + words(own.randint(0, 60), 170 + i)) for i in range(6)] + [(8, PASSAGE), (9, PASSAGE), (10, words(500, "none"))]


@pytest.mark.parametrize("window", [255, 256, 272, 300, 400])
@pytest.mark.parametrize("gram", [16, 32])
def test_wide_passages(spark, window, gram):
    limit = 2000 if gram == 32 else 2  # small groups by automaton, or all window by window
    got = rows(substrings.remove_repeated_passages(frame(spark, texts()), window, gram, limit), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == plain.passages(texts(), window)


@pytest.mark.parametrize("window, gram, limit", [(255, 16, 2), (286, 32, 2000), (287, 32, 2), (300, 16, 2000), (400, 32, 2000)])
def test_wide_bytes(spark, window, gram, limit):
    got = rows(suffixes.remove_repeated_bytes(frame(spark, texts()), window, gram, limit), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == plain.byte_repeats(texts(), window)


def test_unsupported_widths(spark):
    for window, gram in ((10, 16), (70_000, 16), (50, 0)):
        with pytest.raises(ValueError):
            substrings.remove_repeated_passages(frame(spark, texts()), window, gram)
