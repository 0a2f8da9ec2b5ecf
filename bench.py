"""Headline timings: prints one JSON line with the seconds of every query.

Each query is run once to warm the JVM and then timed from planning to the last
row; results go to the no-op sink so nothing is collected on the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from contract import load_all
from contract.adapter import driver_table
from contract.registry import QUERIES
from mailgrain.session import build_session

HEADLINE = {
    "threads": "D3_build_threads",
    "actions": "E9_label_actions_orders",
    "sender_stats": "F5_sender_stats",
    "features": "F12_message_features_orders",
    "contacts": "G11_build_contacts_orders",
    "rules": "H1_content_patterns",
    "classification": "H4_classify_orders",
    "clustering": "J5_cluster",
    "content_clusters": "J7_cluster_content",
    "whole_run": "R2_mailbox_run",
    "service_scores": "F7_service_importance",
    "clean_text": "C8_sanitize_messages",
    "strip_html": "C1_strip_html",
    "centroids": "I2_centroid",
    "cosine": "I3_cosine_distance",
    "rank": "K7_priority_rank",
    "priority": "K8_rank_messages",
    "append_events": "P1_append_events",
    "notifications": "Q1_parse_notifications",
}
# rows the timing covers, for rows per second
SOURCE = {
    "threads": "orders", "actions": "orders", "sender_stats": "orders", "features": "orders", "contacts": "orders",
    "rules": "orders", "service_scores": "orders", "clean_text": "documents", "strip_html": "pages",
    "centroids": "embeddings", "cosine": "embeddings", "rank": "lineitem", "priority": "conversations",
    "append_events": "events", "notifications": "events", "classification": "orders", "clustering": "conversations",
    "content_clusters": "embeddings", "whole_run": "conversations",
}


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "4m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rate = {}, {}
    for label, name in HEADLINE.items():
        run(spark, sf_dir, name)
        seconds[label] = round(min(run(spark, sf_dir, name) for _ in range(2)), 3)
        rows = driver_table(spark, sf_dir, SOURCE[label]).count()
        rate[label] = round(rows / seconds[label])
        print(label, seconds[label], "s", rate[label], "rows/s", file=sys.stderr)
    print(json.dumps({
        "metric": "mailbox operators, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rate, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
