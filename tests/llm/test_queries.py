"""Every opN query over the whole small tables against its plain version."""

import collections
import zlib

import pyarrow.parquet as pq
import pytest

from mailgrain.llm import media, queries
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def table(name, *columns):
    rows = pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pydict()
    return list(zip(*(rows[c] for c in columns)))


@pytest.fixture(scope="module")
def docs():
    return table("documents", "doc_id", "text")


def result(spark, name, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SF).collect()}


def test_op1(spark, docs):
    rows = queries.QUERIES["op1_brown"](spark, SF).collect()
    want = plain.base_scores(docs)
    assert len(rows) == len(want)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op2(spark, docs):
    rows = {r.doc_id: r for r in queries.QUERIES["op2_progressive_jpeg"](spark, SF).collect()}
    assert len(rows) == len(docs)
    for i, text in docs:
        data = (text or "").encode()
        payload = media.padded(data)
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256) == (len(data), len(payload), plain.sha(payload))
        assert rows[i].tail_crc32 == zlib.crc32(payload[-16:])
    by_text = collections.defaultdict(set)
    for i, text in docs:
        by_text[text].add((rows[i].media_sha256, rows[i].feature))
    assert all(len(x) == 1 for x in by_text.values())


def test_op3(spark, docs):
    assert result(spark, "op3_near_duplicates", "doc_id", "n_shingles", "component_id", "kept") == plain.near_duplicates(docs)


def test_op4(spark, docs):
    want = plain.contamination(docs, table("benchmark", "item_id", "text"))
    assert result(spark, "op4_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_op5(spark, docs):
    rows = queries.QUERIES["op5_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_op5_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    toxic = dict(zip(*(pq.read_table(f"{folder}/labels.parquet").to_pydict()[c] for c in ("doc_id", "toxic"))))
    rows = [r for r in queries.QUERIES["op5_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in toxic]
    good = [r.score for r in rows if not toxic[r.doc_id]]
    bad = [r.score for r in rows if toxic[r.doc_id]]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert wins > 0.8
    assert sum(r.predicted for r in rows if not toxic[r.doc_id]) <= 0.02 * len(good)


def test_op6(spark, docs):
    assert result(spark, "op6_substrings", "doc_id", "n_words", "n_removed", "kept_sha256") == plain.passages(docs)


def test_op7(spark, docs):
    assert result(spark, "op7_suffixes", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain.byte_repeats(docs)


def test_op8(spark, docs):
    rows = queries.QUERIES["op8_best_fit"](spark, SF).collect()
    ids = plain.token_ids(docs, queries.tokenizer_file("byte_bpe_50k.json"), 0)
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    for i, want in ids.items():
        at = 0
        for n, (piece, start, length, crc) in enumerate(sorted(pieces[i])):
            assert (piece, start) == (n, at) and (length == 2048 or n == 0)
            assert crc == plain.crc(want[start: start + length])
            at += length
        assert at == len(want)
    total = sum(map(len, ids.values()))
    assert len(sequences) <= -(-total // 2048) + 2


def test_op9(spark, docs):
    at, want = 0, {}
    for i, ids in sorted(plain.token_ids(docs, queries.tokenizer_file("word_bpe_49k.json"), 2).items()):
        want[i] = (at, len(ids), plain.crc(ids))
        at += len(ids)
    assert result(spark, "op9_wavelet", "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_op10(spark):
    rows = table("conversations", "conv_id", "turn", "role", "text")
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = result(spark, "op10_chat", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == plain.conversations(rows)
