"""Where cases lie: dealt once, while their rows are narrow."""

import re

from pyspark.sql import functions as F

import __spark_entry__
from ledgerlight.operators import cases
from ledgerlight.plans import queries

BASE = "/root/testdata/sf0.001"
RESULTS = ("user_corrections", "duplicate_ids", "missing_amounts", "payment_collisions", "applied_payments", "case_outcomes", "letter_text")


def exchanges(df) -> list[str]:
    return re.findall(r"^[^A-Za-z]*Exchange (?:hash|single|range|RoundRobin)\w*\(?(.*)", df._jdf.queryExecution().executedPlan().toString(), re.M)


def test_nothing_is_dealt_again(spark):
    known = __spark_entry__.queries()
    for name in (*RESULTS, "evidence_resolve", "packet_facts", "packet_html", "validate_fields", "sql_validated"):
        found = exchanges(known[name](spark, BASE))
        assert found and all("REPARTITION_BY_NUM" in x for x in found), (name, found)


def test_facts_of_a_case_are_not_rows(spark):
    known = __spark_entry__.queries()
    for name in RESULTS:
        plan = known[name](spark, BASE)._jdf.queryExecution().executedPlan().toString()
        assert "Generate stack" not in plan and len(exchanges(known[name](spark, BASE))) == 1, name


def test_documents_are_spread_whatever_the_files(spark, tmp_path):
    for t in ("orders", "customer"):  # one file of one row group
        spark.read.parquet(f"{BASE}/{t}.parquet").coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    for each in ("case", "document"):
        counts = queries.wide(spark, str(tmp_path), each).groupBy(F.spark_partition_id()).count().collect()
        assert len(counts) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in counts) < 2 * min(r["count"] for r in counts)


def test_tasks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(queries, "CASES_A_TASK", 100)
    assert queries.wide(spark, BASE).rdd.getNumPartitions() == 15


def test_pivoted_facts_give_the_same_results(spark):
    columns = ("findings", "ledger", "collection_cents", "supported_balance_cents", "applied_payments_cents", "matched_document_ids", "excluded_document_ids", "corrected", "prints")
    shape = lambda d: F.struct(*[d[c].alias(c) for c in ("ord", "id", "kind", "title", "content", "included", "refs", "corrected", "pending", "n_facts")])
    rows = lambda r: {x["case_id"]: x for x in cases.settled(r, "all_docs", *columns).withColumn("all_docs", F.transform("all_docs", shape)).collect()}
    flat, held = rows(cases.reconcile(*queries.bundle(spark, BASE))), rows(queries.reconciled(spark, BASE))
    assert len(flat) == 1500 and flat == held


def test_only_parts_that_are_read_are_worked_out(spark):
    known = __spark_entry__.queries()
    for name, unread in {"duplicate_ids": "regexp_replace", "user_corrections": "regexp_replace", "case_overview": "regexp_replace", "export_gate": "regexp_replace", "timeline_guard": "sha2", "payment_collisions": "array_remove"}.items():
        assert unread not in known[name](spark, BASE)._jdf.queryExecution().executedPlan().toString(), name


def test_parts_give_the_same_results(spark):
    rows = lambda *columns: {x["case_id"]: x for x in queries.reconciled(spark, BASE, *columns).collect()}
    columns = ("duplicate_ids", "corrected", "timeline_ok", "missing_amounts", "stop", "ambiguous", "earlier", "supported_balance_cents", "ledger")
    whole = {x["case_id"]: x for x in cases.settled(queries.reconciled(spark, BASE), *columns).collect()}
    assert len(whole) == 1500 and rows(*columns) == whole
    for c in ("duplicate_ids", "corrected", "stop"):
        assert {k: x[c] for k, x in rows(c).items()} == {k: x[c] for k, x in whole.items()}


def test_payments_and_letters_are_dealt_once(spark):
    known = __spark_entry__.queries()
    for name in ("earlier_payments", "payment_conflicts", "payment_groups", "bill_arithmetic", "letter_points", "headline_finding"):
        df = known[name](spark, BASE)
        assert "Generate stack" not in df._jdf.queryExecution().executedPlan().toString() and len(exchanges(df)) == 1, name
