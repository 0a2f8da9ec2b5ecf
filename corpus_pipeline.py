"""Corpus clean-up in five stages, each a Spark job on all that the stage before it kept.

``STAGES`` names them in order.  Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain.llm import base, decontaminate, neardup, packing, suffixes, toxicity
from mailgrain.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject; texts are unchanged."""
    model = toxicity.train(docs, base.table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity_scores(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col("text")), model)
    return scored.where("predicted = 0").select("_row.*")


def _restored(rows: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs`` from ``_row``, with those in ``new`` in their place and type."""
    kinds = dict(docs.dtypes)
    return rows.select(*[new.get(c, F.col(f"_row.`{c}`") if c != "text" else F.col("text")).cast(kinds[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id."""
    return _restored(neardup.near_duplicates(docs, keep_rows=True).where("kept"), docs)


def drop_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes that start earlier; ``n_chars`` follows the text, empty texts stay."""
    cleaned = suffixes.remove_repeated_bytes(docs, keep_rows=True)
    text = F.col("kept_text")
    length = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("_row.n_chars"))
    return _restored(cleaned, docs, text=text, n_chars=length)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window; texts are unchanged."""
    hits = decontaminate.with_verdict(decontaminate.benchmark_hits(docs, base.table(spark, sf_dir, "benchmark"), keep_rows=True))
    return hits.where("not contaminated").select("_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents left, packed into sequences of 2,048."""
    pieces = packing.token_pieces(docs, tokenizer_file("byte_bpe_50k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_bytes", drop_repeated_bytes),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: SQL cannot state the learned scores nor the packing; tests/llm compares the stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``; returns the packed pieces."""
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = base.store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            base.drop_stored(docs)
        docs = kept
    return docs
