"""The six labelled scenarios as bundles of documents and facts, all facts confirmed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.functions.constants import FIELD_LABELS

# Facts of the scenarios (fixed values), document by document.
COMMON = {"provider": "Maple Grove Medical", "patient": "Maya Ellis", "account": "MG-1042", "claim_id": "CL-260701", "service_date": "2026-07-01"}
EOB = {"statement_date": "2026-07-12", "charges": "1200.00", "adjustments": "400.00", "allowed": "800.00", "insurer_paid": "650.00", "patient_responsibility": "150.00"}
BILL = {"statement_date": "2026-07-15", "charges": "1200.00", "adjustments": "400.00", "insurer_paid": "650.00", "patient_paid": "0.00", "balance": "150.00"}
RECEIPT = {"statement_date": "2026-07-20", "payment_date": "2026-07-20", "payment_amount": "150.00", "payment_reference": "PAY-715028", "payment_status": "Completed"}
NOTICE = {"statement_date": "2026-08-15", "collector": "Pine Valley Account Services", "balance": "150.00", "validation_end": "2026-09-20"}
TITLES = {"eob": "Insurance explanation", "bill": "Provider bill", "receipt": "Payment receipt", "receipt_copy": "Payment receipt (copy)", "collection": "Collection notice"}
SCENARIOS = ("paid", "missing_receipt", "wrong_account", "partial_payment", "duplicate_receipt", "no_discrepancy")

DOCUMENTS = "case_id long, doc_ordinal int, doc_id string, kind string, title string, text string, included boolean"
FACTS = "case_id long, doc_ordinal int, field string, field_ordinal int, value string, quote string, page int, confirmed boolean, origin string"


def scenario(name: str) -> dict[str, dict[str, str]]:
    """The documents of a scenario in order: their own facts laid over the common ones."""
    if name not in SCENARIOS:
        raise ValueError(f"Choose one of {', '.join(SCENARIOS)}.")
    bundle = {"eob": {**COMMON, **EOB}, "bill": {**COMMON, **BILL}, "receipt": {**COMMON, **RECEIPT}, "collection": {**COMMON, **NOTICE}}
    if name == "missing_receipt":
        del bundle["receipt"]
    elif name == "wrong_account":
        bundle["receipt"]["account"] = "MG-9999"
    elif name == "partial_payment":
        bundle["receipt"]["payment_amount"] = "50.00"
    elif name == "duplicate_receipt":
        notice = bundle.pop("collection")
        bundle |= {"receipt_copy": dict(bundle["receipt"]), "collection": notice}
    elif name == "no_discrepancy":
        bundle["bill"] |= {"statement_date": "2026-07-25", "patient_paid": "150.00", "balance": "0.00"}
        bundle["collection"]["balance"] = "0.00"
        del bundle["collection"]["validation_end"]
    return bundle


def frames(spark: SparkSession, bundles: list[dict[str, dict[str, str]]]) -> tuple[DataFrame, DataFrame]:
    """(documents, facts) of bundles, one case each."""
    docs, facts, place = [], [], list(FIELD_LABELS)
    for case, bundle in enumerate(bundles):
        for n, (name, fields) in enumerate(bundle.items()):
            title = TITLES.get(name, name)
            lines = [f"{FIELD_LABELS[k]}: {v}" for k, v in fields.items()]
            docs.append((case, n, name, name.split("_")[0], title, "\n".join([f"FICTIONAL DEMO — {title.removesuffix(' (copy)')}", *lines]), True))
            facts += [(case, n, k, place.index(k), v, line, 1, True, "document") for (k, v), line in zip(fields.items(), lines, strict=True)]
    return spark.createDataFrame(docs, DOCUMENTS), spark.createDataFrame(facts, FACTS)
