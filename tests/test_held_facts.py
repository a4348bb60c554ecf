"""Documents that hold their facts: the same results as from frames of facts, without rows of facts."""

from pyspark.sql import functions as F

import __spark_entry__
from ledgerlight.operators import packet
from ledgerlight.plans import queries

BASE = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fact_rows_are_written_where_documents_lie(spark):
    for name in ("packet_facts", "packet_html"):
        assert "Generate stack" not in plan(__spark_entry__.queries()[name](spark, BASE)), name


def test_held_facts_give_the_same_fact_rows(spark):
    odd = lambda c: F.concat(F.lit("<\"'&"), c)
    nameless = lambda df: df.withColumn("doc_id", F.when((F.col("case_id") % 7 != 0) | (F.col("doc_ordinal") != 1), F.col("doc_id")))
    docs, facts = queries.bundle(spark, BASE)
    facts = facts.withColumns({"value": F.when(F.col("field") == "provider", odd("value")).otherwise(F.col("value")), "confirmed": F.col("confirmed") & (F.col("case_id") % 11 != 0)})
    held = queries.pivoted(spark, BASE)
    held = held.withColumn("facts", F.col("facts").withField("provider.value", odd(F.col("facts.provider.value"))))
    for k in queries.K.FIELD_LABELS:
        held = held.withColumn("facts", F.col("facts").withField(f"{k}.confirmed", F.col(f"facts.{k}.confirmed") & (F.col("case_id") % 11 != 0)))
    flat, rows = ({r["case_id"]: r["fact_rows"] for r in df.collect()} for df in (packet.fact_rows(nameless(docs), facts), packet.fact_rows(nameless(held))))
    assert 1300 < len(flat) < 1500 and rows == flat and "&lt;&quot;&#x27;&amp;Clinic" in rows[1]


def test_packets_are_written_in_the_row_of_their_case(spark, monkeypatch):
    monkeypatch.setattr(queries, "PACKETS_A_TASK", 100)
    df = __spark_entry__.queries()["packet_html"](spark, BASE)
    assert plan(df).count("Exchange hashpartitioning") == 1 and not any(x in plan(df) for x in ("SortMergeJoin", "ShuffledHashJoin")) and df.rdd.getNumPartitions() == 15
    frames = packet.packets(queries.reconciled(spark, BASE, *packet.PACKET_COLUMNS, parts=packet.LETTER_PARTS), *queries.bundle(spark, BASE), as_of="2026-01-01")
    once, apart = ({r["case_id"]: r["html"] for r in x.collect()} for x in (df, frames))
    assert len(once) == 1500 and once == apart
