"""The DuckDB statements of the queries against the plain versions; Spark's results are compared with both elsewhere."""

import duckdb
import pytest

from mailgrain.llm import queries
from tests.llm import plain
from tests.llm.test_jaccard import components
from tests.llm.test_queries import SF, table

PLAIN = {
    "op3_near_duplicates": (lambda docs, items: plain.near_duplicates(docs), ("n_shingles", "component_id", "kept")),
    "op4_decontaminate": (plain.contamination, ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")),
    "op6_substrings": (lambda docs, items: plain.passages(docs), ("n_words", "n_removed", "kept_sha256")),
    "op11_jaccard": (lambda docs, items: components(docs), ("n_shingles", "component_id")),
}


@pytest.mark.parametrize("name", PLAIN)
def test_statement_is_the_contract(name):
    run, columns = PLAIN[name]
    con = duckdb.connect()
    for view in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
    rows = con.execute(f"SELECT doc_id, {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert {r[0]: tuple(r[1:]) for r in rows} == run(table("documents", "doc_id", "text"), table("benchmark", "item_id", "text"))
