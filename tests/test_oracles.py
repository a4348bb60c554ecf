"""Some registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [
    "archive_totals", "pattern_counts", "narrative_extract", "fact_grid", "case_outcomes", "doc_cards", "normalize_value", "money_cents", "line_split", "label_parse", "local_fields",
    "local_warnings", "validate_fields", "case_fingerprint", "evidence_refs", "evidence_resolve", "letter_text", "packet_findings", "packet_html", "packet_facts", "packet_attachments",
    "html_escape", "dollars_fmt", "csv_scan", "packet_files", "field_problems", "dollar_escape", "overlaid", "sql_fields", "sql_validated", "api_pages", "research_refresh", "refresh_narratives", "payment_groups",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("orders", "customer", "documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(map(str, (tuple(r) for r in df.select(columns).collect())))
    theirs = sorted(map(str, db.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()))
    assert ours == theirs
