"""The six scenarios and changes of one fact each, all reconciled in one job."""

import copy

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import cases, packet, review
from ledgerlight.plans.scenarios import SCENARIOS, frames, scenario
from ledgerlight.streaming import incremental

def base():
    return scenario("paid")


def changed(**changes):
    """changes: receipt__account="X" and so on; None removes the fact."""
    out = base()
    for k, v in changes.items():
        doc, field = k.split("__")
        out[doc][field] = v
        if v is None:
            del out[doc][field]
    return out


def with_copy(**fields):
    out = base()
    out["receipt_copy"] = {**out["receipt"], **fields}
    out["receipt_copy"] = {k: v for k, v in out["receipt_copy"].items() if v is not None}
    return out


def without(doc):
    out = base()
    del out[doc]
    return out


CASES = {
    "paid": (scenario("paid"), 0, 15000),
    "missing_receipt": (scenario("missing_receipt"), 15000, 0),
    "partial": (scenario("partial_payment"), 10000, 5000),
    "duplicate": (scenario("duplicate_receipt"), 0, 15000),
    "wrong_account": (scenario("wrong_account"), None, 0),
    "no_discrepancy": (scenario("no_discrepancy"), 0, 0),
    "two_payments": ({**changed(receipt__payment_amount="50.00"), "receipt_copy": {**base()["receipt"], "payment_amount": "100.00", "payment_reference": "PAY-8"}}, 0, 15000),
    "status_synonym": (with_copy(payment_status="Paid"), 0, 15000),
    "reversal": (with_copy(payment_status="Reversed"), None, 0),
    "lookalike": (with_copy(payment_reference=None, claim_id="CL-260701"), None, 0),
    "cents_differ": (with_copy(payment_amount="15.00"), None, 0),
    "overpaid": (changed(receipt__payment_amount="151.00"), None, 15100),
    "masked": (changed(bill__account="xxxx1042"), None, 0),
    # no such day, another form, the bill's own day, after the notice, before the service
    **{f"date {d}": (changed(receipt__payment_date=d), None, 0) for d in ("2026-02-30", "21 July 2026", "2026-7-21", "2026-07-15", "2026-12-24", "2025-07-21")},
    **{f"status {s}": (changed(receipt__payment_status=s), None, 0) for s in ("In progress", "Charged back", "Declined", "?")},
    **{f"balance {b}": (changed(bill__balance=b), None, 0) for b in ("150.01", "150.0000", "Infinity", "(150.00)", "one hundred")},
    **{f"no {d} {f}": (changed(**{f"{d}__{f}": None}), None, 0) for d, f in (("bill", "charges"), ("collection", "balance"), ("receipt", "payment_amount"), ("receipt", "provider"), ("bill", "account"))},
}


@pytest.fixture(scope="module")
def results(spark):
    docs, facts = frames(spark, [c[0] for c in CASES.values()])
    r = cases.settled(cases.reconcile(docs, facts), "all_docs", "findings", "ledger", "collection_cents", "supported_balance_cents", "applied_payments_cents", "matched_document_ids", "excluded_document_ids").cache()
    return docs, facts, r, {n: x for n, x in zip(CASES, sorted(r.collect(), key=lambda x: x["case_id"]), strict=True)}


@pytest.mark.parametrize("name", CASES)
def test_balance(results, name):
    _, supported, applied = CASES[name]
    r = results[3][name]
    got = r["supported_balance_cents"]
    assert (None if got is None else int(got), int(r["applied_payments_cents"])) == (supported, applied)


def test_scenarios_are_known():
    assert len(SCENARIOS) == 6
    with pytest.raises(ValueError):
        scenario("another")


def test_findings_and_refs(results):
    rows = results[3]
    codes = {n: [f["code"] for f in r["findings"]] for n, r in rows.items()}
    assert codes["paid"] == ["eob_is_not_payment_proof", "possible_uncredited_payment"]
    assert codes["missing_receipt"] == ["eob_is_not_payment_proof", "missing_payment_evidence"]
    assert codes["duplicate"] == ["eob_is_not_payment_proof", "duplicate_payment_evidence", "possible_uncredited_payment"]
    assert codes["masked"] == ["ambiguous_document_match"]
    for r in rows.values():  # every reference is a confirmed fact of the case
        known = {ref for d in r["all_docs"] for ref in d["refs"]}
        assert all(ref in known for f in r["findings"] for ref in f["refs"])
    assert [x["cents"] for x in rows["paid"]["ledger"]] == [120000, -40000, -65000, 0, 15000, -15000, 0]


def test_partitioning_does_not_matter(spark, results):
    docs, facts, r, _ = results
    again = cases.settled(cases.reconcile(docs.repartition(7), facts.repartition(5, "field")), "findings", "supported_balance_cents").collect()
    assert {x["case_id"]: (x["findings"], x["supported_balance_cents"]) for x in again} == {x["case_id"]: (x["findings"], x["supported_balance_cents"]) for x in r.collect()}


def test_packet(spark, results):
    docs, facts, r, _ = results
    evil = copy.deepcopy(base())
    evil["bill"]["provider"] = evil["collection"]["provider"] = "<script>"
    d, f = frames(spark, [evil])
    html = packet.packets(cases.settled(cases.reconcile(d, f), *packet.PACKET_COLUMNS), d, f, as_of="2026-01-01").first()["html"]
    assert "<script>" not in html and "&lt;script&gt;" in html and "Provider inquiry" in html
    letter = packet.letter_text(r, as_of="2026-01-01", recipient="collector").where("case_id = 0").first()["letter"]
    assert letter.startswith("2026-01-01\n\nTo the debt collector,") and "requests $150.00." in letter
    with pytest.raises(ValueError):
        packet.letter_text(r, as_of="2026-01-01", recipient="nobody")


def test_edits(spark, results):
    docs, facts, _, _ = results
    edits = spark.createDataFrame([(0, 2, "payment_amount", "10.00", True), (0, 2, "payment_reference", " ", True), (0, 1, "balance", "x", True), (0, 1, "charges", "1.00", True)], "case_id long, doc_ordinal int, field string, new_value string, reviewed boolean")
    got = {(r["doc_ordinal"], r["field"]): (r["value"], r["origin"]) for r in review.merge_edits(facts, edits).where("case_id = 0").collect()}
    assert got[2, "payment_amount"] == ("10.00", "user") and (2, "payment_reference") not in got
    assert got[1, "charges"] == ("1200.00", "document")  # one bad edit keeps all of the document's facts


def test_only_touched_cases_are_reconciled_again(spark, results, tmp_path):
    docs, facts, _, rows = results
    spark.createDataFrame([(0,), (1,), (1,), (None,)], "case_id long").write.parquet(str(tmp_path / "new"))
    stream = spark.readStream.schema("case_id long").parquet(str(tmp_path / "new"))
    got = []
    incremental.reconcile_stream(stream, lambda: docs, lambda: facts, lambda r, n: got.extend(r.collect()), str(tmp_path / "checkpoint")).awaitTermination(300)
    assert sorted((r["case_id"], r["supported_balance_cents"]) for r in got) == [(i, rows[n]["supported_balance_cents"]) for i, n in enumerate(list(CASES)[:2])]


def test_fingerprints(spark, results):
    docs, facts, _, _ = results
    of = lambda d, f: {r["case_id"]: r["token"] for r in review.fingerprint(d, f).where("case_id < 3").collect()}
    base_tokens = of(docs, facts)
    assert len(set(base_tokens.values())) == 3 and of(docs.repartition(5, "title"), facts.repartition(3, "value")) == base_tokens
    one = (F.col("case_id") == 1) & (F.col("doc_ordinal") == 0)
    for c in ("doc_id", "kind", "title", "text"):
        assert of(docs.withColumn(c, F.when(one, F.lit(None)).otherwise(F.col(c))), facts)[1] != of(docs.withColumn(c, F.when(one, "").otherwise(F.col(c))), facts)[1] != base_tokens[1], c
    charges = one & (F.col("field") == "charges")
    for c, v in {"value": "1", "quote": "", "page": 2, "origin": "user", "confirmed": False, "field_ordinal": 99}.items():
        changed_tokens = of(docs, facts.withColumn(c, F.when(charges, F.lit(v)).otherwise(F.col(c))))
        assert changed_tokens[1] != base_tokens[1] and changed_tokens[0] == base_tokens[0], c
    new = facts.where(charges).withColumn("value", F.lit("5.00"))
    kept = review.updated(review.summed(review.row_marks(docs, facts)), review.row_marks(docs.limit(0), new), review.row_marks(docs.limit(0), facts.where(charges)))
    assert {r["case_id"]: r["token"] for r in review.tokens(kept).where("case_id < 3").collect()} == of(docs, facts.where(~charges).unionByName(new))
    plan = review.fingerprint(docs, facts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(case_id") == 1
