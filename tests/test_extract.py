import pytest

from ledgerlight.operators import extract


def run(spark, text, kind="bill"):
    r = extract.local_fields(spark.createDataFrame([(text, kind)], "text string, kind string")).first()
    return {f["field"]: (f["value"], f["page"], f["quote"]) for f in r["fields"]}, r["warnings"]


def test_pages_and_forms(spark):
    fields, warnings = run(spark, "Provider: Maple\nBalance due = $150.00\f Notice date : 08/10/2026\r\nPatient:  Mary\x1cnothing here")
    assert fields["balance"] == ("150.00", 1, "Balance due = $150.00")
    assert fields["statement_date"][:2] == ("2026-08-10", 2) and fields["patient"][0] == "Mary" and not warnings


def test_conflicts_and_bad_values(spark):
    fields, warnings = run(spark, "Balance: $150\nBalance: 150.00\nBalance: $250\nBalance: oops\nCharges: 1,50")
    assert "balance" not in fields
    assert warnings == ["Conflicting Statement / collection balance values; confirm the applicable one manually.", "Review Provider charges: the source value could not be parsed.", "No labeled fields found. Add the relevant facts in review, or enable AI extraction."]


def test_amount_due_depends_on_kind(spark):
    assert "patient_responsibility" in run(spark, "Amount due: 5", "eob")[0]
    assert "balance" in run(spark, "Amount due: 5", "bill")[0]


def test_proposals(spark):
    text = "Balance: 150.00\fPatient: Mary"
    items = [("balance", "150", "Balance: 150.00", 1), ("patient", "Mary", "Patient: Mary", 1), ("claim_id", "9", "Patient: Mary", 2), ("nothing", "1", "x", 1), ("patient", "Mary", " Patient: Mary ", 2)]
    df = spark.createDataFrame([(text, items)], "text string, proposals array<struct<key:string,value:string,quote:string,page:int>>")
    r = extract.validated_fields(df).first()
    assert {f["field"]: f["value"] for f in r["fields"]} == {"balance": "150.00", "patient": "Mary"}
    assert r["warnings"] == ["Discarded patient: its source quote could not be verified.", "Discarded claim_id: its value was not supported by the quoted text."]


def test_documents_are_checked(spark):
    rows = [(1, 0, "bill", "t" * 200, "Balance: 1.50"), (1, 1, "letter", "t", "Balance: 1"), (1, 2, "bill", "t", " \n"), (1, 3, "eob", "t", "x" * 60_001), (1, 4, "bill", "t", "Balance: 1.50"), (1, 5, None, None, None)]
    docs = spark.createDataFrame(rows, "case_id long, doc_ordinal int, kind string, title string, text string")
    got = {r["doc_ordinal"]: r for r in extract.extract_documents(docs).collect()}
    assert [got[i]["problem"] is None for i in range(6)] == [True, False, False, False, True, False]
    assert len(got[0]["title"]) == 180 and got[0]["fields"][0]["value"] == "1.50" and got[1]["fields"] is None
    assert got[4]["new_id"] == got[0]["new_id"] + "-5" and got[0]["extraction_method"] == "Local labeled-field parser"
    given = docs.selectExpr("*", "array(named_struct('key', 'balance', 'value', '1.50', 'quote', 'Balance: 1.50', 'page', 1)) AS proposals").where("doc_ordinal = 0")
    assert extract.extract_documents(given, "proposals").first()["fields"][0]["value"] == "1.50"
    with pytest.raises(ValueError):
        extract.extract_documents(docs, "another")
