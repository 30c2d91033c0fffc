"""The registered queries: each has checking SQL, and a sample of them agrees with it on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["monthly_summary", "attendant_record_prizes", "mda_month", "canonical_ops", "canonical_prizes", "latest_upload_wins"]
SAMPLE += ["history_replaced", "history_receipt", "workbook_roundtrip", "bundle_roundtrip", "drop_folder_months"]


def test_every_query_has_checking_sql():
    assert set(entry.QUERIES) == set(entry.oracle.build())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_its_sql(spark, name):
    with duckdb.connect() as con:
        for table in ("orders", "lineitem"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        answer = con.execute(entry.oracle_sql()[name])
        columns, expected = [c[0] for c in answer.description], answer.fetchall()
    got = entry.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
