"""Each pipeline stage on what the stage before it kept, against plain versions."""

import pyarrow.parquet as pq

import corpus_pipeline
from mailgrain.llm import base, queries
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def read(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    docs = base.table(spark, SF, "documents")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(base.store(stage(spark, kept[-1], SF), "stage"))
    for before in kept[1:5]:
        assert before.dtypes == docs.dtypes
    whole, clean, unique, trimmed, safe = (read(k) for k in kept[:5])
    scores = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op5_toxicity"](spark, SF).collect()}
    assert clean == {i: r for i, r in whole.items() if not scores[i]}
    near = plain.near_duplicates([(i, r["text"]) for i, r in clean.items()])
    assert unique == {i: r for i, r in clean.items() if near[i][2]}
    repeats = plain.byte_repeats([(i, r["text"]) for i, r in unique.items()])
    assert trimmed.keys() == unique.keys()
    for i, r in trimmed.items():
        if repeats[i][1]:
            assert r["n_chars"] == len(r["text"])
            if (r["text"] or "").isascii() and unique[i]["text"].isascii():
                assert plain.sha(r["text"]) == repeats[i][3]
        else:
            assert r == unique[i]
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    bad = plain.contamination([(i, r["text"]) for i, r in trimmed.items()], list(zip(items["item_id"], items["text"])))
    assert safe == {i: r for i, r in trimmed.items() if not bad[i][4]}
    ids = plain.token_ids([(i, r["text"]) for i, r in safe.items()], queries.tokenizer_file("byte_bpe_50k.json"), 0)
    assert sum(r["length"] for r in kept[5].collect()) == sum(map(len, ids.values()))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (1, "a b", None, "s", 3), (None, "a b", "en", None, 3), (2, "", "", "", 0)], schema)
    for docs in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            docs = base.store(stage(spark, docs, SF), "odd")
        docs.count()
