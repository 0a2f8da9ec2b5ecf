"""Vector tables (operators I1, I2, I4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailgrain.session import bound_batches, cut_lineage

Encoder = Callable[[list[str]], list[list[float] | None]]

VECTOR_SCHEMA = "embedding array<float>, token_count int, content_hash string"


def embed(prepared: DataFrame, encoder: Encoder, key: str = "email_id", batch: int = 100) -> DataFrame:
    """Vectors for prepared texts (C12); texts the encoder fails on are dropped.

    ``encoder`` maps a list of texts to vectors, None for a failed text.  It is
    called once per batch inside each partition, so the partitioning of
    ``prepared`` is the parallelism.
    """
    bound_batches(prepared.sparkSession)
    key_type = prepared.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                try:
                    vectors = encoder(part["text"].tolist())
                except Exception:
                    vectors = _one_by_one(encoder, part["text"].tolist())
                if len(vectors) != len(part):  # cannot be matched to the texts
                    vectors = _one_by_one(encoder, part["text"].tolist())
                out = part[[key, "token_count", "content_hash"]].copy()
                out.insert(1, "embedding", vectors)
                yield out[out["embedding"].notna()]

    return prepared.select(key, "text", "token_count", "content_hash").mapInPandas(
        run, f"{key} {key_type}, {VECTOR_SCHEMA}"
    )


def _one_by_one(encoder: Encoder, texts: list[str]) -> list[list[float] | None]:
    vectors = []
    for text in texts:
        try:
            vectors.append(encoder([text])[0])
        except Exception:
            vectors.append(None)
    return vectors


def embed_counts(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Messages eligible for a vector and vectors present."""
    total = messages.agg(F.count_if(~F.col("is_sent")).alias("total_eligible"))
    return total.select("total_eligible", vectors.agg(F.count(F.lit(1))).scalar().alias("already_embedded"))


def centroid(vectors: DataFrame, by: list[str] | None = None, column: str = "embedding") -> DataFrame:
    """Element-wise mean per group (one row without ``by``), and the count.

    The mean is summed up map-side, one vector per group and task, so neither
    a group's size nor the dimension multiplies the shuffled rows.
    """
    present = vectors.filter(F.col(column).isNotNull())
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(column)))).alias("centroid")
    return present.groupBy(*(by or [])).agg(mean, F.count(F.lit(1)).alias("n"))


def range_of(df: DataFrame, columns: list[str]) -> Column:
    """Scalar subquery with ``struct(lo_<c>, hi_<c>, ...)`` over the rows of ``df``."""
    bounds = []
    for c in columns:
        bounds += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")]
    return df.agg(F.struct(*bounds).alias("bounds")).scalar()


def scaled(column: str, bounds: Column) -> Column:
    lo, hi = bounds[f"lo_{column}"], bounds[f"hi_{column}"]
    return (F.col(column) - lo) / F.when(hi > lo, hi - lo).otherwise(1.0)


def minmax(df: DataFrame, column: str, costly: bool = False) -> DataFrame:
    """I4: rows with a value, rescaled to [0, 1]; a zero range divides by one.

    The column is read twice, for its range and for the rescaling.  With
    ``costly`` the frame is checkpointed first, so the joins and vector
    arithmetic behind it run once.
    """
    rows = cut_lineage(df) if costly else df
    present = rows.filter(F.col(column).isNotNull())
    bounds = present.withColumn("_bounds", range_of(present, [column]))
    return bounds.withColumn(column, scaled(column, F.col("_bounds"))).drop("_bounds")
