"""Keyword search without reading all bodies (O11): posting lists of three-character grams.

The index is a folder with two tables.  ``grams``, divided by a hash of the gram, holds for every gram and part the ids of
the messages that contain it; ``texts``, divided by part, holds what a search shows and compares.  A part is a hash of the
message id, so a gram that every message contains is many lists of bounded length, and a message's lists meet in one
part.  A search reads the folders of its grams, intersects the lists of each part, and compares the texts of the parts that
are left.  Needles of fewer than three characters scan ``texts``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, BUCKETS = 3, 256
#: messages of one part, so the length of a posting list at most
PART_MESSAGES = 1 << 16
TEXTS = "id bigint, subject string, from_email string, date_parsed timestamp, head string, body string"
GRAMS = "gram bigint, part int, ids array<bigint>"


def grams_of(text: str) -> np.ndarray:
    """Distinct grams of a text: three code points of 21 bits each."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) < GRAM:
        return np.zeros(0, np.int64)
    return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:])


def bucket_of(gram: str) -> Column:
    """Folder of a gram."""
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, parts = (np.asarray(batch.column(c)) for c in ("id", "part"))
        grams, rows = [], []
        for i, texts in enumerate(zip(batch.column("head").to_pylist(), batch.column("body").to_pylist())):
            own = np.unique(np.concatenate([grams_of(t or "") for t in texts]))
            grams.append(own)
            rows.append(np.full(len(own), i))
        if not grams:
            continue
        gram, row = np.concatenate(grams), np.concatenate(rows)
        order = np.lexsort((ids[row], parts[row], gram))
        gram, row = gram[order], row[order]
        part = parts[row]
        opens = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])][: len(gram)])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[opens, len(gram)], pa.int32()), pa.array(ids[row]))
        yield pa.RecordBatch.from_arrays([pa.array(gram[opens]), pa.array(part[opens].astype(np.int32)), lists], ["gram", "part", "ids"])


def build_text_index(messages: DataFrame, path: str) -> None:
    """Write the index of the received messages to ``path``, over what is there."""
    mail = messages.filter(~F.col("is_sent"))
    parts = max(1, -(-mail.count() // PART_MESSAGES))
    rows = mail.select(
        "id", "subject", "from_email", "date_parsed", F.lower("subject").alias("head"), F.lower("body_text").alias("body"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/texts")
    texts = mail.sparkSession.read.schema(f"{TEXTS}, part int").parquet(f"{path}/texts").select("id", "part", "head", "body")
    # lists of a batch are joined to one for each gram and part
    lists = texts.mapInArrow(_postings, GRAMS).groupBy("gram", "part").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    lists.withColumn("bucket", bucket_of("gram")).repartition("bucket", "part").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy(
        "bucket").parquet(f"{path}/grams")


def matching(spark: SparkSession, path: str, query: str) -> DataFrame:
    """``id, subject, from_email, date_parsed`` of indexed messages with the words in subject or body."""
    needle = query.lower()
    texts = spark.read.schema(f"{TEXTS}, part int").parquet(f"{path}/texts")
    hit = F.col("head").contains(needle) | F.col("body").contains(needle)
    wanted = grams_of(needle)
    if len(wanted):
        named = spark.createDataFrame([(g,) for g in wanted.tolist()], "gram bigint").select(bucket_of("gram").alias("b")).distinct()
        folders = [r["b"] for r in named.collect()]  # one for each gram of the needle at most
        lists = spark.read.schema(f"{GRAMS}, bucket int").parquet(f"{path}/grams").filter(
            F.col("bucket").isin(folders) & F.col("gram").isin(wanted.tolist()))
        # lists of one part at most meet: as many as the needle has grams, each no longer than the part
        both = lists.groupBy("part").agg(F.collect_list("ids").alias("lists")).filter(F.size("lists") == len(wanted))
        common = F.aggregate(F.slice("lists", 2, len(wanted)), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        found = both.select("part", F.explode(common).alias("id"))
        # the parts that are left are named, so that no other folder is read
        parts = [r["part"] for r in found.select("part").distinct().toLocalIterator()]
        texts = texts.filter(F.col("part").isin(parts)).join(found, ["part", "id"], "left_semi")
    return texts.filter(hit).select("id", "subject", "from_email", "date_parsed")


def search_index(spark: SparkSession, path: str, priority: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """O11 on an index: the same rows as a scan of the messages it was built from, in rank order."""
    ranked = matching(spark, path, query).join(priority.select(F.col("email_id").alias("id"), "priority_rank"), "id", "left")
    if limit is None:
        return ranked
    return ranked.orderBy(F.asc_nulls_last("priority_rank"), F.desc("date_parsed"), "id").limit(limit)
