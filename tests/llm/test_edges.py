"""Nulls, empty and long texts, repeated rows, empty tables, clashing columns, hot groups, and the parts themselves."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailgrain.llm import (
    base, brown, chat, components, decontaminate, jpeg, media, neardup, packing, queries, repeats, substrings, suffixes,
    tokens, toxicity, wavelet,
)
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(5)
WORDS = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 6))) for _ in range(400)]


def words(n, seed):
    own = random.Random(seed)
    return " ".join(own.choice(WORDS) for _ in range(n))


PASSAGE, LINE = words(80, "p"), words(60, "l")
DOCS = [
    (1, words(120, 1) + " " + PASSAGE + " " + words(40, 2)), (2, PASSAGE), (3, words(30, 3) + "\n" + PASSAGE + "\t" + words(90, 4)),
    (4, None), (5, ""), (6, "one two three"), (7, "One TWO three"), (8, words(120, 1) + " " + PASSAGE + " " + words(39, 2)),
    (9, " \n\t"), (10, (LINE + "\n") * 9), (11, LINE + " x " + words(20, 6)), (12, "é" * 400), (13, "é" * 150 + "z"), (14, "a" * 99),
    (15, words(9000, 7)), (16, words(4000, 7) + " " + words(10, 8)), (17, words(120, 1) + " " + PASSAGE + " " + words(40, 2)),
]
HOT = DOCS + [(100 + i, words(5, 900 + i) + " " + LINE + " " + words(5, 700 + i)) for i in range(60)]


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, "en", "src", None) for i, t in docs], SCHEMA).repartition(parts)


def rows(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def clash(df):
    """Extra columns named like those the operators use inside."""
    return df.select("*", *[F.lit(9).alias(c) for c in ("key", "g", "ctx", "place", "start", "spans", "score", "predicted", "root", "n")])


OPERATORS = {
    "passages": lambda d: substrings.remove_repeated_passages(d),
    "bytes": lambda d: suffixes.remove_repeated_bytes(d, keep_rows=True),
    "near": lambda d: neardup.near_duplicates(d, keep_rows=True),
    "score": lambda d: brown.class_scores(d, classes=8, rounds=2),
    "media": lambda d: media.stored_features(media.encode_texts(d)),
    "pieces": lambda d: packing.pack(packing.token_pieces(d, queries.tokenizer_file("byte_bpe_50k.json"))),
    "wavelet": lambda d: wavelet.read_documents(wavelet.write_shards(
        d, queries.tokenizer_file("word_bpe_49k.json"), base.new_path(d.sparkSession, "test"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_and_repeated_rows(spark, name):
    assert OPERATORS[name](frame(spark, [], 1)).count() == 0
    odd = [(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (None, None), (2, ""), (2, "x")]
    found = OPERATORS[name](clash(frame(spark, odd, 2)))
    assert found.count() == len(odd)


def test_passages_and_bytes(spark):
    for docs, limit in ((DOCS, 2000), (HOT, 5)):
        got = rows(substrings.remove_repeated_passages(frame(spark, docs), group_limit=limit), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == plain.passages(docs)
        got = rows(suffixes.remove_repeated_bytes(clash(frame(spark, docs)), group_limit=limit), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == plain.byte_repeats(docs)


def test_kept_text_is_whole_characters(spark):
    got = rows(suffixes.remove_repeated_bytes(frame(spark, DOCS)), "doc_id", "kept_text")
    assert got[4] == (None,) and got[5] == ("",) and got[2][0] == ""
    assert all("�" not in (t or "") for (t,) in got.values())


def test_equal_suffixes_over_many_buckets(spark):
    data = [(b"same" * 25, k, s) for k in range(40) for s in range(3)] + [(b"%100d" % k, k, 7) for k in range(30)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        frame_ = spark.createDataFrame([(bytearray(a), b, c) for a, b, c in data], "suffix binary, key long, start long")
        got = {(r["key"], r["start"]) for r in suffixes.late_across_buckets(frame_).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {(k, s) for k in range(40) for s in range(3)} - {(0, 0)}


@given(st.lists(st.binary(min_size=16, max_size=16), min_size=1, max_size=40), st.integers(0, 3))
@settings(max_examples=30, deadline=None)
def test_multikey_order(values, alike):
    values = [v[:alike * 4] + b"\0" * (16 - alike * 4) for v in values] if alike else values
    keys = np.stack([np.frombuffer(v, ">u8").astype(np.uint64) for v in values])
    order, run = suffixes.multikey_order(keys)
    assert [values[i] for i in order] == sorted(values)
    assert all((values[order[i]] == values[order[i - 1]]) == (run[i] == run[i - 1]) for i in range(1, len(values)))
    assert all(order[i - 1] < order[i] for i in range(1, len(values)) if run[i] == run[i - 1])


def edited(text, seed, edits):
    own, out = random.Random(seed), text.split(" ")
    for _ in range(edits):
        out[own.randrange(len(out))] = "edit%d" % own.randrange(10 ** 6)
    return " ".join(out)


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicates_in_a_large_group(spark, block):
    text = words(150, "near")
    docs = DOCS + [(200 + i, edited(text, i, 1 + i % 9)) for i in range(90)] + [(300 + i, edited(text, i, 2)) for i in range(3)]
    got = rows(neardup.near_duplicates(clash(frame(spark, docs)), block=block, nearest_rounds=1), "doc_id", "n_shingles", "component_id", "kept")
    assert got == plain.near_duplicates(docs)


def test_odd_sketches_estimate_and_bound():
    own = np.random.default_rng(1)
    common = own.integers(0, 2 ** 63, 900).astype(np.uint64)
    a = np.unique(np.r_[common, own.integers(0, 2 ** 63, 100).astype(np.uint64)])
    b = np.unique(np.r_[common, own.integers(0, 2 ** 63, 100).astype(np.uint64)])
    _, folded, parity = neardup.sketches(np.r_[a, b], np.asarray([0, len(a), len(a) + len(b)]))
    miss = int(np.bitwise_count(parity[0] ^ parity[1]).sum())
    assert miss <= 200 and miss > 150  # never above the true difference
    assert int(np.bitwise_count(folded[0] ^ folded[1]).sum()) <= neardup.largest_miss(80)


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 3), (20, 21), (30, 30)] + [(100 + i, 101 + i) for i in range(40)]
    got = rows(components.components(spark.createDataFrame(links, "a long, b long")), "v", "root")
    assert got == {v: (1,) for v in (2, 3, 8, 9, 10)} | {21: (20,)} | {v: (100,) for v in range(101, 141)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark):
    long = words(40, "item")
    items = [(1, long), (2, long), (3, "short item here"), (4, None), (5, ""), (None, "nameless words"), (7, "x")]
    docs = DOCS + [(50, "Says " + long.upper().replace("É", "é") + " end"), (51, "a Short, item. HERE b " + words(200, 9)), (52, "nameless words"),
                   (53, "x"), (54, " ".join(long.split()[:12])), (55, " ".join(long.split()[3:17]) + " " + words(500, 10))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain.contamination(docs, [(i, t) for i, t in items if i is not None])
    for sizes in ({}, {"shard_words": 20}, {"shard_words": 20, "pass_words": 30}):
        hits = decontaminate.with_verdict(decontaminate.benchmark_hits(frame(spark, docs), bench, **sizes))
        got = rows(hits.select("doc_id", "n_words", "n_hit", F.size("items").alias("k"), "contaminated"), "doc_id", "n_words", "n_hit", "k", "contaminated")
        for i, (n, hit, k, _, bad) in want.items():
            if i != 52:  # the item without an id marks words and is not listed
                assert got[i] == (n, hit, k, bad), i
        assert got[52] == (2, 2, 0, True)
    empty = decontaminate.benchmark_hits(frame(spark, DOCS), bench.where("false"))
    assert all(not r["hit_spans"] for r in empty.collect())


@pytest.mark.parametrize("limits", [{}, {"span_words": 1}, {"span_words": 16, "coverage": 2}])
def test_contamination_is_cut_out(spark, limits):
    long, other = words(40, "item"), words(300, "long item")
    items = [(1, long), (2, long), (3, "short item here"), (4, None), (5, ""), (6, other)]
    docs = DOCS + [(50, "Says " + long.upper().replace("É", "é") + " end"), (51, "a Short, item. HERE b " + words(200, 9)), (52, long),
                   (53, words(400, 21) + "\n" + " ".join(long.split()[3:17]) + ". é" + words(30, 22)), (53, "é " + other + " é"),
                   (54, words(300, 23) + " " + " ".join(other.split()[100:180]) + " " + words(9000, 24)), (None, "x " + long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = list(enumerate(t for _, t in docs))
    for sizes in ({}, {"shard_words": 60, "pass_words": 120}):
        found = decontaminate.remove_contamination(clash(frame(spark, docs)), bench, keep_rows=True, **limits, **sizes)
        got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in found.collect()}
        assert got == plain.cut_contamination(docs, items, **limits)
    again = [(53, long), (53, long), (None, long), (None, None)]
    got = decontaminate.remove_contamination(clash(frame(spark, again)), bench)
    assert sorted((r["n_removed"], r["kept_text"] or "") for r in got.collect()) == [(0, ""), (40, ""), (40, ""), (40, "")]
    assert decontaminate.remove_contamination(clash(frame(spark, [], 1)), bench).count() == 0
    same = decontaminate.remove_contamination(frame(spark, docs), bench.where("false"))
    assert rows(same, "doc_id", "kept_text", "n_removed") == {i: (t, 0) for i, t in docs}


def test_flat_automaton_is_small(spark):
    own = np.random.default_rng(11)
    items = [(str(k), (own.zipf(1.3, 400) % 50_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in range(100)]
    flat = decontaminate.FlatAutomaton.build(items, 13, 4)
    assert flat.nbytes() <= 100 * 40_000
    index = decontaminate.ItemIndex([flat], 13, 13, 4)
    marks, found = np.zeros(400, bool), set()
    index.scan(items[7][1], 0, marks, found)
    assert marks.all() and "7" in found


@given(st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=5), st.lists(st.integers(0, 3), max_size=30))
@settings(max_examples=80, deadline=None)
def test_suffix_automaton_matches(sequences, stream):
    automaton = decontaminate.SuffixAutomaton()
    for own in sequences:
        automaton.add(own)
    known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    state = matched = 0
    for i, symbol in enumerate(stream, 1):
        state, matched = automaton.step(state, matched, symbol)
        assert matched == max((n for n in range(i + 1) if n == 0 or tuple(stream[i - n: i]) in known), default=0)
    items = [(None, np.asarray(own, np.uint64) + np.uint64(7)) for own in sequences if own]
    if items:  # the flat form of the same automaton tells the same lengths
        flat = decontaminate.FlatAutomaton.build(items, 3, 1)
        lengths = [n for _, n in flat.walk(flat.numbers(np.asarray(stream, np.uint64) + np.uint64(7)))]
        assert lengths == [
            max(n for n in range(i + 1) if n == 0 or tuple(stream[i - n: i]) in known) for i in range(1, len(stream) + 1)]


@given(st.lists(st.integers(0, 9), max_size=80), st.integers(1, 20))
@settings(max_examples=60, deadline=None)
def test_leftmost_minimum(values, width):
    values = np.asarray(values, np.uint64) << np.uint64(40)
    if len(values) >= width:
        want = [i + int(np.argmin(values[i: i + width])) for i in range(len(values) - width + 1)]
        assert repeats.leftmost_minimum(values, width).tolist() == want


def test_toxicity_grammar_and_learning(spark):
    table, kinds = toxicity.compiled()

    def kind(*symbols):
        state = 0
        for s in symbols:
            state = table[state][s]
        return {f for i, f in enumerate(toxicity.FLAGS) if kinds[state] >> i & 1}

    o, i, h, t, n, r = range(6)
    assert kind(o, i) == {"insult"} and kind(t, o, i) == {"insult", "target"} and kind(i, t) == {"insult", "target"}
    assert kind(n, o, i) == {"insult", "negated"} and kind(n, o, o, o, o, i) == {"insult"}
    assert kind(r, o, i) == {"insult", "reported"} and kind(r, i, i) == {"insult", "reported"} and kind(h, t) == {"threat", "target"}
    assert kind(n, i, o, o, o, i) == {"insult"} and kind(o, t) == {"target"}
    docs = [(k, words(40, k) + (" you grobl%s fool. " % WORDS[k % 9] + " snarkle " if k % 4 == 0 else "") + words(20, k + 1)) for k in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "?!"), (1003, words(30000, 3))]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(5, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    frame_ = clash(frame(spark, docs))
    model = toxicity.train(frame_, labels)
    got = toxicity.toxicity_scores(frame_, model)
    assert got.columns[-2:] == ["score", "predicted"] and got.count() == len(docs)
    assert {r["doc_id"] for r in got.where("predicted = 1").collect()} == {k for k in range(400) if k % 4 == 0}
    blank = toxicity.toxicity_scores(frame_, toxicity.train(frame_, labels.where("false")))
    assert {r["predicted"] for r in blank.collect()} == {0}


def test_class_model_is_a_distribution():
    own = np.random.default_rng(2)
    matrix = own.integers(0, 50, (6, 6)).astype(float)
    matrix[0, 0] = 5
    lexicon = brown.Lexicon(np.asarray([3, 5, -1]), np.asarray([30, 20, 10]), 60, 0.1)
    model = brown.ClassModel(lexicon, np.zeros(lexicon.items, np.int64), matrix, {0: (10, 1), 1: (50, 2)}, 60, 3)
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    known = 10 ** model.emission(np.asarray([30, 20]), np.asarray([1, 1]))
    assert known.sum() + 10 ** model.unknown[1] == pytest.approx(1)


def test_end_token_of_few_long_texts_is_known(spark):
    text = "a b c " * 200_000  # one end in 600,001 tokens
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2]
    df = spark.createDataFrame([(ids[0], text)], "doc_id long, text string")
    row = brown.class_scores(df, classes=8, rounds=2).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (600_001, 600_001, 600_001)
    want = 600_000 * np.log10(200_001) + np.log10(2) - 600_001 * np.log10(600_001 + 4 + 1)
    assert row.base_score == pytest.approx(want)


def test_exchange_improves_and_is_exact():
    own = np.random.default_rng(3)
    counts = own.poisson(2.0, (9, 9)).astype(float)
    now = np.asarray([0, 1, 2, 3, 1, 2, 3, 1, 2])

    def matrix_of(classes):
        out = np.zeros((4, 4))
        np.add.at(out, (classes[:, None], classes[None]), counts)
        return out

    for item in range(1, 9):
        matrix = matrix_of(now)
        right, left = np.zeros(4), np.zeros(4)
        np.add.at(right, now, counts[item])
        np.add.at(left, now, counts[:, item])
        best = brown.best_class(matrix, int(now[item]), left, right, counts[item, item])
        scores = []
        for c in range(1, 4):
            trial = now.copy()
            trial[item] = c
            scores.append(brown.likelihood(matrix_of(trial)))
        assert scores[best - 1] == pytest.approx(max(scores))


def test_many_moves_equal_single_ones():
    own = np.random.default_rng(8)
    matrix = own.integers(400, 900, (7, 7)).astype(float)
    n = 60
    now = own.integers(1, 7, n)
    left, right = (own.poisson(1.0, (n, 7)).astype(float) * 3 for _ in range(2))
    self_ = np.minimum(np.minimum(left, right)[np.arange(n), now], own.integers(0, 3, n))
    want = [brown.best_class(matrix, int(c), a, b, s) for c, a, b, s in zip(now, left, right, self_)]
    assert brown.best_classes(matrix, now, left, right, self_).tolist() == want
    assert len(set(want)) > 2


def test_rare_words_get_classes_by_context(spark):
    own = random.Random(4)
    kinds = [["%s%dzzz" % (k, i) for i in range(30)] for k in "ab"]  # all of one ending, in two kinds of places
    often = ["mine", "thine"]  # frequent words in the same two kinds of places
    texts = [" ".join(f"{('le', 'um')[k]} {often[k] if own.random() < 0.5 else own.choice(kinds[k])}" for k in (
        own.randint(0, 1) for _ in range(40))) for _ in range(60)]
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2][:60]
    df = spark.createDataFrame([(i, t, True) for i, t in zip(ids, texts)], "doc_id long, text string, train boolean").repartition(3)
    code = lambda w: int(brown.text_tokens(pa.array([w]))[0][0])
    for known_share in (2e-6, 0.1):  # all words in the lexicon, or only the four frequent ones
        base.ship_code(spark)
        model, blocks, rare = brown.train(df, classes=6, cluster_share=0.1, known_share=known_share)
        got = dict(zip(model.lexicon.words.tolist(), model.known_class.tolist()))
        got |= {r["word"]: r["cls"] for r in rare.collect()}
        a, b = ({got[code(w)] for w in kind} for kind in kinds)
        assert None not in a | b and not a & b
        # the matrix and the scores are those of the classes found
        cls = [[0] + [got[code(w)] for w in t.split()] + [0] for t in texts]
        want = np.zeros((6, 6))
        for c in cls:
            np.add.at(want, (c[:-1], c[1:]), 1)
        state = spark.sparkContext.broadcast((model.known_class, model.ending_class))
        assert (brown.class_matrix(brown.with_rare(blocks, rare), state, 6) == want).all()
        counts = {}
        for t in texts:
            for w in t.split():
                counts[w] = counts.get(w, 0) + 1
        scores = {r["doc_id"]: r for r in brown.score_texts(blocks, model, rare).collect()}
        for i, t, c in zip(ids, texts, cls):
            n = np.asarray([counts[w] for w in t.split()] + [len(texts)])
            assert scores[i]["score"] == pytest.approx(model.transition[c[:-1], c[1:]].sum() + model.emission(n, np.asarray(c[1:])).sum())
            assert scores[i]["n_known"] == scores[i]["n_tokens"] == 81


def test_wavelet_matrix():
    own = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (700, 3), (3000, 50000)):
        ids = own.integers(0, top, n)
        matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
        assert matrix.all().tolist() == ids.tolist()
        for place in own.integers(0, n, 20).tolist() if n else []:
            value = int(ids[place])
            assert matrix.access(place) == value
            assert matrix.rank(value, place) == int((ids[:place] == value).sum())
            assert matrix.select(value, matrix.rank(value, place)) == place
        assert matrix.count(60000) == 0 and matrix.select(0, n + 1) == -1


def test_encoder_equals_the_tokenizer():
    own = random.Random(1)
    odd = ["", None, "  a", "a  b ", "a\n b", "x\n\n y", " lead", "tail ", "it's we'll 'S x2y 12345 ²³¼", "naïve œuvre ﬁ 漢字 <|endoftext|> z",
           "a\xa0b", "İstanbul ß µm", "emoji 😀 x", " ", "\n"]
    odd += ["".join(own.choice("ab' .\n\t12é,É-_$") for _ in range(own.randint(0, 40))) for _ in range(800)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode = tokens.PieceEncoder(queries.tokenizer_file(name))
        want = [x.ids for x in encode.tokenizer.encode_batch([o or "" for o in odd], add_special_tokens=False)]
        for _ in range(2):
            assert [x.tolist() for x in encode.column(pa.array(odd))] == want


@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit_plan_packs_everything(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit_plan(counts, 64)
    filled = {}
    for length, first, end, sequence, offset in plan:
        for rank in range(first, end):
            filled.setdefault(sequence + rank - first, []).append((offset, length))
    assert sum(len(x) for x in filled.values()) == len(lengths)
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64


@given(st.text(alphabet="</s>[INST]\\SY\n ab", max_size=40))
@settings(max_examples=200, deadline=None)
def test_escapes(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)
    turns = [(text[:5], text), ("assistant", "<s>" + text)]
    assert chat.parse(chat.instruct_template(turns)) == turns


def test_chat_formatting(spark):
    data = [(1, t, "user" if t % 2 == 0 else "assistant", "text %d </s> \\ [INST]" % t) for t in range(40)]
    data += [(2, 0, None, None), (2, 0, "assistant", ""), (2, None, "assistant", "first"), (None, 1, "assistant", "lost")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(df)
    got = rows(chat.conversation_digests(turns), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    want = plain.conversations([(c, -1 if t is None else t, r, x) for c, t, r, x in data])
    assert got == want
    assert all(r["exact"] and not r["rewrites_history"] for r in turns.collect())
    assert chat.conversation_digests(chat.format_turns(df.where("false"))).count() == 0

    def counting(own):  # tells the number of turns at the start, and so changes what was there
        return f"{len(own)}|" + "".join(f"[{r}]{t};" for r, t in own)

    assert all(r["rewrites_history"] for r in chat.format_turns(df.where("conv_id = 1"), counting, str).where("turn_no > 0").collect())


def test_chat_templates_that_depend_on_all_turns(spark):
    data = [(c, t, "user" if t % 2 == 0 else "assistant", "say %d" % (t * c)) for c, n in ((1, 17), (2, 12), (3, 3)) for t in range(n)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")

    def numbered(own):
        return "".join(f"<{k} {r}>{t}</{k}>" for k, (r, t) in enumerate(own))

    def last_ten(own):
        return "".join(f"[{r}]{t};" for r, t in own[-10:])

    def late_change(own):  # the fourth turn is changed when the thirteenth comes
        return "".join(f"[{r}]{'(old)' if k == 3 and len(own) > 12 else t};" for k, (r, t) in enumerate(own))

    def budget(own):  # at most 60 characters of text before the last turn
        at = len(own) - 1
        while at > 0 and sum(len(t) for _, t in own[at - 1:]) <= 60:
            at -= 1
        return "".join(f"[{r}]{t};" for r, t in own[at:])

    rewriting = {numbered: lambda k, c: False, last_ten: lambda k, c: k >= 10, late_change: lambda k, c: k == 12, budget: None}
    for template, rewrites in rewriting.items():
        found = {}
        for r in chat.format_turns(df, template, str).orderBy("conv_id", "turn_no").collect():
            found.setdefault(r["conv_id"], []).append(r)
        for conv, got in found.items():
            own = [(r, t) for c, _, r, t in data if c == conv]
            outputs = [template(own[: k + 1]) for k in range(len(own))]
            pieces = [(r["piece"], r["piece_start"], r["content_start"], r["content_end"], r["in_loss"]) for r in got]
            for k, r in enumerate(got):
                assert chat.assemble(pieces[: k + 1])[0] == outputs[k]
                assert r["exact"] and r["piece"][r["content_start"]: r["content_end"]] == own[k][1]
                assert r["rewrites_history"] == (not outputs[k].startswith(outputs[k - 1]) if k else False)
                assert len(outputs[k]) == (len(outputs[k - 1]) if k else 0) - r["n_replaced"] + len(r["piece"])
                assert rewrites is None or r["rewrites_history"] == rewrites(k, conv)
            whole, spans = chat.assemble(pieces)
            last = max([k for k, r in enumerate(got) if r["rewrites_history"]], default=0)
            kept = [t for k, (r, t) in enumerate(own) if r == "assistant" and (
                k >= last or got[k]["piece_start"] + got[k]["content_end"] <= min(r["piece_start"] for r in got[k + 1:]))]
            assert [whole[a:b] for a, b in spans] == kept


def test_jpeg_round_trip_and_pixels():
    own = np.random.default_rng(6)
    data = [b"", bytes(range(256)) * 3, own.integers(0, 256, 5000).astype(np.uint8).tobytes(), b" " * 900, "déjà vu".encode() * 90]
    payloads = [media.padded(d) for d in data]
    images = [jpeg.parse(m) for m in jpeg.encode_payloads(payloads, [b""] * len(data))]
    for payload, image, found in zip(payloads, images, jpeg.decode_coefficients(images)):
        assert jpeg.payload_of(found, len(payload)) == payload
        assert jpeg.rgb_tensor(image, found).shape == (image.height, image.width, 3)
    blocks = np.zeros((1, 64), np.int16)
    blocks[0, 0] = 80
    assert (jpeg.pixels(blocks, np.ones(64, np.int32)) == 138).all()
    blocks[0] = own.integers(-20, 20, 64)
    square = np.zeros(64)
    square[jpeg.NATURAL] = blocks[0]
    basis = jpeg._BASIS
    exact = np.clip(basis.T @ square.reshape(8, 8) @ basis + 128, 0, 255)
    assert np.abs(jpeg.pixels(blocks, np.ones(64, np.int32))[0] - exact).max() <= 1


def test_media_column(spark):
    good = jpeg.encode_payloads([media.padded(b"hello")], [b""])[0]
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(b"no image")), (None, bytearray(good))], "doc_id long, media binary")
    got = {(r["key"], r["height"], r["rgb"] and len(r["rgb"])) for r in media.decode_column(df).collect()}
    assert got == {(1, 16, 768), (2, None, None), (3, None, None), (4, None, None), (None, 16, 768)}


def test_texts_move_once_for_all_pieces(spark, monkeypatch):
    """Grams above the limit used to fetch their pieces, and so move the texts, a second time."""
    calls = []
    fetch = suffixes.repeats.with_pieces
    monkeypatch.setattr(suffixes.repeats, "with_pieces", lambda *given: calls.append(given[1].columns) or fetch(*given))
    got = rows(suffixes.remove_repeated_bytes(frame(spark, HOT), group_limit=5), "doc_id", "n_removed")
    assert len(calls) == 1 and "hot" in calls[0]
    assert len(got) == len(HOT)
