"""Cases and complaints derived from the driver's tables by SQL that reads the same in Spark and DuckDB.

One case for each order; ``s = o_orderkey % 40`` picks what is odd about it. The text is shared by queries and oracles;
what the operators then do with the rows is written separately on either side.
"""

from __future__ import annotations

from ledgerlight.functions.constants import FIELD_LABELS, NOT_OWED


def _money(e: str) -> str:
    return f"(cast(cast(floor(({e}) / cast(100 AS double)) AS bigint) AS string) || '.' || lpad(cast(({e}) % 100 AS string), 2, '0'))"


def _date(e: str) -> str:
    return f"cast({e} AS string)"


_RECEIPT = "kind = 'receipt'"
_FIELDS = {
    "provider": "CASE WHEN slot = 2 AND s = 7 THEN 'Other Clinic' WHEN slot = 4 AND s = 11 THEN NULL ELSE 'Clinic No. ' || cast(ck % 25 AS string) END",
    "patient": "CASE WHEN slot = 2 AND s = 6 THEN 'Somebody Else' WHEN slot = 4 THEN upper(patient) ELSE patient END",
    "account": "CASE WHEN slot = 2 AND s = 2 THEN 'AC-0' WHEN slot = 1 AND s = 10 THEN 'AC-X' WHEN slot IN (1, 4) AND s = 31 THEN '****1042' WHEN slot = 4 THEN 'ac ' || cast(ck AS string) ELSE 'AC-' || cast(ck AS string) END",
    "claim_id": "CASE WHEN slot = 2 AND s = 9 THEN 'CL-0' WHEN slot = 4 THEN NULL ELSE 'CL-' || cast(case_id AS string) END",
    "service_date": f"CASE WHEN slot = 2 AND s = 8 THEN {_date('svc + 1')} ELSE {_date('svc')} END",
    "statement_date": f"CASE WHEN slot = 1 AND s = 12 THEN NULL WHEN kind = 'eob' THEN CASE WHEN s = 39 THEN {_date('svc + 50')} ELSE {_date('svc + 11')} END WHEN kind = 'bill' THEN CASE WHEN s = 5 THEN {_date('svc + 25')} WHEN s = 38 THEN {_date('svc + 60')} ELSE {_date('svc + 14')} END WHEN kind = 'receipt' THEN CASE WHEN s = 16 THEN {_date('svc + 47')} ELSE {_date('svc + 19')} END ELSE {_date('svc + 45')} END",
    "charges": f"CASE WHEN kind NOT IN ('eob', 'bill') THEN NULL WHEN slot = 0 AND s = 29 THEN {_money('ch + 100')} WHEN slot = 3 AND s = 30 THEN {_money('ch + 500')} ELSE {_money('ch')} END",
    "adjustments": f"CASE WHEN kind IN ('eob', 'bill') THEN {_money('adj')} END",
    "allowed": f"CASE WHEN kind = 'eob' THEN {_money('ch - adj')} END",
    "insurer_paid": f"CASE WHEN kind IN ('eob', 'bill') THEN {_money('ins')} END",
    "patient_responsibility": f"CASE WHEN kind = 'eob' THEN {_money('rem')} END",
    "patient_paid": f"CASE WHEN kind = 'bill' THEN CASE WHEN s = 5 THEN {_money('rem')} ELSE '0.00' END END",
    "balance": f"CASE WHEN kind = 'bill' THEN CASE WHEN s = 5 THEN '0.00' WHEN s = 20 THEN {_money('rem + 1')} WHEN s = 21 THEN '150.001' ELSE {_money('rem')} END WHEN kind = 'collection' THEN '$' || CASE WHEN s = 5 THEN '0.00' WHEN s = 37 THEN {_money('rem + 1000')} ELSE {_money('rem')} END END",
    "payment_amount": f"CASE WHEN {_RECEIPT} THEN CASE WHEN s = 3 OR (s = 26 AND slot = 2) THEN {_money('half')} WHEN s = 26 THEN {_money('rem - half')} WHEN s = 27 THEN {_money('rem * 2')} WHEN s = 23 AND slot = 3 THEN {_money('rem + 1')} ELSE {_money('rem')} END END",
    "payment_date": f"CASE WHEN {_RECEIPT} THEN CASE WHEN s = 13 THEN '07/20/2026' WHEN s = 15 THEN {_date('svc + 14')} WHEN s = 16 THEN {_date('svc + 46')} WHEN s = 17 THEN {_date('svc - 1')} WHEN s = 28 THEN {_date('svc + 12')} ELSE {_date('svc + 19')} END END",
    "payment_reference": f"CASE WHEN {_RECEIPT} THEN CASE WHEN s = 22 OR (s = 25 AND slot = 3) THEN NULL WHEN s = 26 AND slot = 3 THEN 'PAY-' || cast(case_id AS string) || '-B' ELSE 'PAY-' || cast(case_id AS string) END END",
    "payment_status": f"CASE WHEN {_RECEIPT} THEN CASE WHEN s = 14 THEN 'Pending' WHEN s = 24 AND slot = 3 THEN 'Reversed' WHEN s = 4 AND slot = 3 THEN 'Paid' ELSE 'Completed' END END",
    "collector": "CASE WHEN kind = 'collection' THEN 'Pine Street Collectors' END",
    "validation_end": f"CASE WHEN kind = 'collection' THEN {_date('svc + 90')} END",
}
FIELDS = list(FIELD_LABELS)
_TEXT = " || ".join(f"coalesce('{label}: ' || v_{k} || chr(10), '')" for k, label in FIELD_LABELS.items())

#: (case_id, s, doc_ordinal, doc_id, kind, title, included, v_<field> for 19 fields, unconfirmed, user_field, text)
CASE_DOCS = f"""
case_base AS (
  SELECT o_orderkey AS case_id, cast(o_orderkey % 40 AS int) AS s, cast(o_orderdate AS date) AS svc, c_name AS patient, o_custkey AS ck,
         cast(round(o_totalprice * 100) AS bigint) AS ch
  FROM orders JOIN customer ON o_custkey = c_custkey),
case_adj AS (SELECT *, cast(floor(ch / cast(3 AS double)) AS bigint) AS adj FROM case_base),
case_ins AS (SELECT *, cast(floor((ch - adj) * cast(0.8 AS double)) AS bigint) AS ins FROM case_adj),
case_rem AS (SELECT *, ch - adj - ins AS rem, cast(floor((ch - adj - ins) / cast(2 AS double)) AS bigint) AS half FROM case_ins),
case_slots AS (
  SELECT *, CASE WHEN slot = 0 THEN 'eob' WHEN slot = 1 OR (slot = 3 AND s IN (30, 32)) THEN 'bill' WHEN slot = 4 THEN 'collection' ELSE 'receipt' END AS kind
  FROM case_rem CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS slots(slot)
  WHERE NOT (slot = 2 AND s = 1) AND NOT (slot = 1 AND s = 35) AND NOT (slot = 4 AND s = 34)
    AND (slot <> 3 OR s IN (4, 22, 23, 24, 25, 26, 30, 32, 33))),
case_wide AS (
  SELECT case_id, s, slot AS doc_ordinal,
         CASE WHEN slot = 0 THEN 'eob' WHEN slot = 1 THEN 'bill' WHEN slot = 2 OR s = 33 AND slot = 3 THEN 'receipt' WHEN slot = 3 THEN 'extra' ELSE 'collection' END AS doc_id,
         kind,
         CASE WHEN slot = 3 AND s <> 22 THEN 'Second record' WHEN kind = 'eob' THEN 'Insurance explanation' WHEN kind = 'bill' THEN 'Provider bill' WHEN kind = 'receipt' THEN 'Payment receipt' ELSE 'Collection <notice> & more' END AS title,
         NOT (s = 37 AND slot = 2) AS included,
         {", ".join(f"{e} AS v_{k}" for k, e in _FIELDS.items())},
         CASE WHEN s = 18 AND slot = 2 THEN 'payment_amount' WHEN s = 19 AND slot = 1 THEN 'patient_paid' ELSE '' END AS unconfirmed,
         CASE WHEN s = 36 AND slot = 2 THEN 'payment_amount' ELSE '' END AS user_field
  FROM case_slots),
case_docs AS (SELECT *, title || chr(10) || {_TEXT} AS text FROM case_wide)
"""

_PHRASES = [
    "I already paid this bill and have a receipt",
    "my insurance sent an explanation of benefits",
    "this is not my debt and I suspect identity theft",
    "please validate and send proof of payment",
    "the wrong amount and a duplicate charge on the itemized statement",
    "no reply to my collection notice",
    "they call me every day",
    "the zero balance was confirmed by a bank statement",
    "an invoice with an incorrect balance",
]
_PHRASE = "CASE n_kind " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " ELSE '' END"

#: (row_idx, complaint_id, date_received, product, sub_product, issue, sub_issue, narrative)
COMPLAINTS = f"""
complaint_base AS (
  SELECT o_orderkey AS row_idx, o_custkey AS ck, o_orderpriority AS priority, cast('2025-01-01' AS date) + cast(o_orderkey % 59 AS int) AS d,
         cast(o_orderkey % 11 AS int) - 2 AS n_kind FROM orders),
complaints AS (
  SELECT row_idx, 'C' || cast(row_idx AS string) AS complaint_id,
         CASE WHEN row_idx % 5 = 4 THEN 'no date' WHEN row_idx % 2 = 0 THEN cast(d AS string)
              ELSE substring(cast(d AS string), 6, 2) || '/' || substring(cast(d AS string), 9, 2) || '/' || substring(cast(d AS string), 1, 4) END AS date_received,
         CASE WHEN row_idx % 5 = 4 THEN 'Credit card' ELSE 'Debt collection' END AS product,
         CASE WHEN row_idx % 5 = 3 THEN 'Other debt' ELSE 'Medical debt' END AS sub_product,
         CASE WHEN substring(priority, 1, 1) IN ('1', '2') THEN '{NOT_OWED}' WHEN substring(priority, 1, 1) = '3' THEN 'Written notification about debt' ELSE 'Communication tactics' END AS issue,
         'Sub-issue ' || cast(ck % 4 AS string) AS sub_issue,
         CASE WHEN n_kind = -2 THEN NULL WHEN n_kind = -1 THEN '   '
              WHEN row_idx % 3 = 0 THEN '  ' || upper({_PHRASE}) || '   no.  ' || cast(ck % 40 AS string)
              ELSE {_PHRASE} || ' no. ' || cast(ck % 40 AS string) END AS narrative
  FROM complaint_base)
"""

FACT_STACK = f"stack({len(FIELDS)}, {', '.join(f'{i}, {chr(39)}{k}{chr(39)}, v_{k}' for i, k in enumerate(FIELDS))}) AS (field_ordinal, field, value)"
