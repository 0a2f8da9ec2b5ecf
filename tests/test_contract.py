"""Every oracle is parsed by DuckDB at the smallest scale; a sample of sections is run and compared."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from contract.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "A4_insert_new", "A5_upsert", "A10_constraint_report", "B5_parse_mail_date", "B15_build_messages", "C4_strip_quotes", "C8_sanitize_messages",
    "D3_build_threads", "E9_label_actions_orders", "F12_message_features", "G11_build_contacts", "H4_classify_messages", "I2_centroid",
    "J9_cluster_rollup", "K7_priority_rank", "K8_rank_messages", "L3_build_prompts", "M3_tasks_from_model", "M7_priority_contexts", "M8_extract_entities", "A3_deep_parts", "B13_message_bodies", "B14_has_attachment", "J7_cluster_invariants", "R2_run_counts",
    "N4_detect_projects", "O1_priority_inbox", "O5_digest_topics", "P1_append_events", "P8_turn_timeline", "Q2_dedup_notifications", "Q5_changed_ids",
]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, oracle, name):
    df = entry_module.queries()[name](spark, SF)
    cursor = oracle.execute(entry_module.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_every_oracle_parses(oracle):
    for name, sql in entry_module.oracle_sql().items():
        assert name in entry_module.queries()
        oracle.execute(f"EXPLAIN {sql}")


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
