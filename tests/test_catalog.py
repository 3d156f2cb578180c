"""A choice of registered queries against their SQL on the smallest tables; check.py runs all."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest
from check import rows_of

import __spark_entry__ as entry_point
from threadloom.plans import catalog
from threadloom.plans.reference_sql import REFERENCE_SQL

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "session_stats_detail", "session_summary_listing", "find_session", "dfs_order", "compact_reparent", "tail_sections",
    "tool_call_results", "asked_options", "search_global", "stars_current", "export_json", "table_cells",
    "scan_transcripts", "lake_sessions", "tail_chunks", "tail_unknown_results", "json_sessions", "annotation_log", "export_markdown_calls",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    """The training-data operators have their own tests and need no SQL."""
    assert set(catalog.QUERIES) == set(REFERENCE_SQL)
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_training_data_is_optional():
    """Without that subpackage the entry point still imports and offers all other queries; other errors are raised."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith(('threadloom.llm', 'corpus_pipeline')):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "from threadloom.plans import catalog\n"
        "assert set(e.queries()) == set(catalog.QUERIES)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry_point.__file__))


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, db, name):
    got = entry_point.queries()[name](spark, FOLDER).toPandas()
    want = db.execute(entry_point.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want) and len(got)
