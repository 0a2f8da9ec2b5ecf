"""Tensors by keys of any type."""

from pyspark.sql import functions as F

from mailgrain.llm import media
from tests.llm.test_edges import frame


def test_string_and_null_keys(spark):
    stored = media.encode_texts(frame(spark, [(1, "some text"), (2, None), (3, "x" * 500)])).withColumn(
        "file name", F.when(F.col("doc_id") != 2, F.concat(F.lit("f"), "doc_id"))).withColumn("key", F.lit(7))
    stored = stored.withColumn("media", F.when(F.col("doc_id") != 3, F.col("media")).otherwise(F.lit(b"no image")))
    got = {r["key"]: (r["height"], r["width"], r["rgb"] and len(r["rgb"])) for r in media.decode_column(stored, "file name").collect()}
    assert got == {"f1": (16, 16, 768), None: (16, 16, 768), "f3": (None, None, None)}
