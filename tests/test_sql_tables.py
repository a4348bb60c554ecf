"""The SQL table functions give what the DataFrame operators give, on odd texts and proposals."""

from ledgerlight.functions import tables
from ledgerlight.operators import extract

TEXTS = [
    "Balance: $1,200.50\nbalance due = 1200.5\nCharges: 1,50\nPatient:  Ann \n", "Balance: 1\nBalance: 2\nBalance: 1", "Amount due: 5.00\n", "a=b: c\nAccount = x: y\n: nothing\n=\nStatus:\n",
    "Date of service: March 5, 2025\fService date: 2025-03-05\nIssued: mar 7, 2025\r\nNotice date: 3/8/2025 Dispute by: 2025-02-30", "Provider: " + "x" * 241 + "\nCreditor: it's \"quoted\" \\ back", "", "\f\f", "no label",
]
PROPOSALS = [
    [("balance", "1200.50", "Balance: $1,200.50", 1), ("charges", "1.50", "Charges: 1,50", 1), ("patient", "ANN", " Patient:  Ann ", 1), ("nonsense", "1", "Balance", 1), ("balance", "1200.5", "balance due = 1200.5", 1)],
    [("balance", "1", "Balance: 1", 1), ("balance", "2", "Balance: 2", 1), ("balance", "1", "Balance: 1", 2), (None, "1", "Balance: 1", 1)],
    [("balance", "5", "due: 5.00", 1), ("payment_amount", "5", "", 1), ("collector", None, "Amount", 1)],
    [("account", "x", "Account = x: y", None), ("account", "X: Y", "Account = x: y", 1), ("payment_status", "Status", "Status:", 0)],
    [("service_date", "2025-03-05", "Date of service: March 5, 2025", 1), ("statement_date", "mar 7, 2025", "Issued: mar 7, 2025", 2), ("validation_end", "2025-02-30", "Dispute by: 2025-02-30", 2), ("service_date", "3/5/2025", "Service date: 2025-03-05", 2)],
    [("provider", "it's \"quoted\" \\ back", "Creditor: it's \"quoted\" \\ back", 1)], [], [("balance", "1", "1", 2)], None,
]


def test_functions_equal_operators(spark):
    names = tables.register(spark)
    rows = [(i, k, t, p) for i, (t, p) in enumerate(zip(TEXTS, PROPOSALS, strict=True)) for k in ("bill", "eob")] + [(99, "bill", None, [])]
    docs = spark.createDataFrame(rows, "id int, kind string, text string, proposals array<struct<key:string,value:string,quote:string,page:int>>")
    docs.createOrReplaceTempView("odd_docs")
    for table, array, operator in (("ll_fields(d.text, d.kind)", "ll_field_array(text, kind)", extract.local_fields), ("ll_validated(d.text, d.proposals)", "ll_validated_array(text, proposals)", extract.validated_fields)):
        want = sorted((r["id"], r["kind"], *f) for r in operator(docs).collect() for f in r["fields"] or [])
        df = spark.sql(f"SELECT d.id, d.kind, f.field, f.value, f.quote, f.page FROM odd_docs d, LATERAL {table} f")
        assert sorted(map(tuple, df.collect())) == want and len(want) > 5
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r["id"], r["kind"], *f) for r in spark.sql(f"SELECT id, kind, {array} AS fields FROM odd_docs").collect() for f in r["fields"] or []) == want
    assert names == ["ll_fields", "ll_validated", "ll_field_array", "ll_validated_array"]
