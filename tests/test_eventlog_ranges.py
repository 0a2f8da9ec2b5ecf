"""Numbering of events whose thread and hour hold nearly all of them."""

from pyspark.sql import functions as F

from mailgrain.operators import eventlog


def test_one_hour_of_one_thread_fills_many_tasks(spark):
    n = 20_000
    hot = F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 7))
    new = spark.range(n).select(
        F.format_string("e%05d", (F.col("id") * 7919) % n).alias("event_id"), hot.alias("thread_id"),
        F.when(F.col("id") % 10 < 9, F.pmod(F.xxhash64("id"), F.lit(3_600_000))).otherwise(F.col("id") * 1000).alias("ts"))
    log = spark.createDataFrame([("hot", 40), ("t3", 5)], "thread_id string, seq bigint")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = ["thread_id", "ts", "event_id"]
        ranges = new.repartitionByRange(*order).groupBy(F.spark_partition_id()).count().collect()
        got = eventlog.append_events(log, new).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    # 90 % of the events are in one hour of one thread, and yet no range is much larger than the others
    assert len(ranges) == 4 and max(r["count"] for r in ranges) < 1.3 * n / 4
    start = {"hot": 40, "t3": 5}
    by_thread = {}
    for r in got:
        by_thread.setdefault(r["thread_id"], []).append((r["ts"], r["event_id"], r["seq"]))
    assert len(got) == n
    for thread, rows in by_thread.items():
        assert [s for _, _, s in sorted(rows)] == list(range(start.get(thread, 0) + 1, start.get(thread, 0) + len(rows) + 1))


def test_events_without_a_thread_are_left_out(spark):
    new = spark.createDataFrame([("a", None, 1), ("b", "t", 2)], "event_id string, thread_id string, ts bigint")
    assert [(r["event_id"], r["seq"]) for r in eventlog.append_events(spark.createDataFrame([], "thread_id string, seq bigint"), new).collect()] == [("b", 1)]
